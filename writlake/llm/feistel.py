"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number is its rank in (doc_id, checksum, size) order. The permutation mixes the two digits of the number
in mixed radix a x b >= n by rounds of modular additions, and walks the cycle until it is below n again;
position p then goes to shard p mod k at slot p div k, so that counts differ by one at most and slots have no gaps.

Null ids sort first, null texts count as empty, rows that are equal share their positions among them in any order,
other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from writlake.llm.common import Scratch, prepare

ROUNDS, WALK = 6, 64


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big") for i in range(ROUNDS)]


def radix(n: int) -> tuple[int, int]:
    """a, b with n <= a * b < n + a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute_sql(number: str, n: int, seed: int) -> str:
    """SQL of the permuted number, in [0, n). Fewer than a numbers lie outside, so a long walk can't happen; one would raise an error."""
    a, b = radix(n)
    if a >= 1 << 31:
        raise ValueError("too many rows for 64-bit rounds")

    def mixed(x: str) -> str:
        y = f"(({x}) % 2147483647L * 1103515245L + 12345L) % 2147483648L"
        return f"((({y}) ^ (({y}) div 32768L)) * 48271L % 2147483647L)"

    keys = round_keys(seed)
    # Each fold step does two rounds: the low digit takes from the high one, then the high one from the low one.
    steps = ", ".join(f"named_struct('p', {p}L, 'q', {q}L)" for p, q in zip(keys[::2], keys[1::2], strict=True))
    low = f"(s.l + {mixed('s.h + k.p')}) % {a}L"
    high = f"(s.h + {mixed(f'({low}) + k.q')}) % {b}L"
    once = f"aggregate(array({steps}), named_struct('l', x % {a}L, 'h', x div {a}L), (s, k) -> named_struct('l', {low}, 'h', {high}), s -> s.h * {a}L + s.l)"
    step = f"transform(transform(array(w.x), x -> {once}), y -> named_struct('x', y, 'done', y < {n}L))[0]"
    return f"aggregate(sequence(1, {WALK}), named_struct('x', cast({number} as bigint), 'done', false), (w, i) -> if(w.done, w, {step}), w -> if(w.done, w.x, raise_error('cycle walk too long')))"


def numbered(df: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """The rows with ``row_number`` from 0 in order of the keys, and their count; no task sees more than its range."""
    tie = "__tie"
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys).drop(tie)
    rows = scratch.keep(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    n = int(sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])
    offsets = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__from"))
    return rows.join(F.broadcast(offsets), "__part").withColumn("row_number", F.col("__from") + F.col("__at")).drop("__part", "__at", "__from"), n  # one offset for each partition


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = 0) -> DataFrame:
    """Rows of ``doc_id``, ``text`` with size, checksum, ``row_number``, ``position``, ``shard`` and ``slot``."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"], Scratch(docs.sparkSession, "feistel"))
    placed = rows.withColumn("position", F.expr(permute_sql("row_number", max(n, 1), seed)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % n_shards).cast("int").alias("shard"),
        F.expr(f"position div {n_shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )
