"""Suffix-array dedup with a run-length index.

A byte is removed where a string of ``least`` bytes that covers it also starts elsewhere, in the same text or another.

1. Every such string holds an anchor: the smallest hash of the 32-byte windows in it. Anchors seen once are left.
2. Each other anchor gets the smallest anchor of the texts that hold it as its label, so that texts with much in common meet
   in one block, and all places of an anchor always do. The text around its anchors goes to the block of their label.
3. A block is a repetitive text: its suffixes are sorted, the Burrows-Wheeler transform is run-compressed, and the matching
   length of every suffix with its neighbour is streamed from the samples at the runs' ends (between them it falls by one a
   byte). Lengths of ``least`` or more mark bytes.
4. A label too large for one block is dealt out by anchor instead; its blocks overlap by the text around each anchor, so
   that all places of an anchor still meet. Only if the places of one anchor alone exceed ``label_bytes`` (thousands of different texts
   around one passage), which no block could hold at any size of input, their windows' 64-bit hashes settle them, dealt
   out by hash, which no group's size makes uneven.

Equal texts are one text with a count: where it is 2 or more, all strings in it occur elsewhere. Null texts are empty ones, and
texts shorter than ``least`` stay whole. Rows may repeat and ids be null; other columns are ignored; an empty table gives an empty
result. Hashes of texts, anchors and windows have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from writlake.llm.common import Scratch, delta, pack, prepare, ranges, slices, trim, undelta, unpack

WINDOW = 32
#: Samples whose matches are measured at a time.
SAMPLES = 1 << 18
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of all windows of a byte string, from sums of its bytes times powers."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: bytes):
        n = len(data)
        if len(Rolling._up) <= n:
            size = max(n + 1, 1 << 16)
            one = np.ones(1, np.uint64)
            Rolling._up = np.cumprod(np.concatenate([one, np.full(size, _B)]), dtype=np.uint64)
            Rolling._down = np.cumprod(np.concatenate([one, np.full(size, _B_INVERSE)]), dtype=np.uint64)
        terms = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * Rolling._down[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def windows(self, size: int) -> np.ndarray:
        count = max(len(self.sums) - size, 0)
        return mixed((self.sums[size : size + count] - self.sums[:count]) * Rolling._up[:count])


def sliding(values: np.ndarray, size: int, f) -> np.ndarray:
    """f (minimum or maximum) over all runs of ``size`` values."""
    width, out = 1, values
    while width * 2 <= size:
        out = f(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that are the smallest in some string of ``least`` bytes."""
    if len(data) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, span = Rolling(data).windows(WINDOW), least - WINDOW + 1
    low = sliding(hashes, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, low, pad]), span, np.maximum) == hashes)
    return at, hashes[at]


READ = "kind int, doc_id long, key long, n_bytes long, sha256 string, anchor long, places array<int>, low long"


def read_anchors(least: int):
    """A row for each text (kind 0), and one for each anchor (1) of each text that this task has not seen before, with its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, most=4 << 20):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            keys = batch.column("key").to_pylist()
            n = len(texts)
            none = lambda k: pa.nulls(n, k)
            yield pa.record_batch({"kind": pa.array([0] * n, pa.int32()), "doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts]), "anchor": none(pa.int64()), "places": none(pa.list_(pa.int32())), "low": none(pa.int64())})
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # key, anchors, how often, places by anchor
            for key, text in zip(keys, texts, strict=True):
                if key not in seen:
                    seen.add(key)
                    at, h = anchors(text, least)
                    if len(at):
                        order = np.argsort(h, kind="stable")
                        h, times = np.unique(h, return_counts=True)
                        out.append((key, h, times, at[order]))
            if out:
                size = [len(x[1]) for x in out]
                low = np.repeat(np.array([x[1][0] for x in out], np.uint64).view(np.int64), size)
                ends = np.concatenate([[0], np.cumsum(np.concatenate([x[2] for x in out]))])
                places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([x[3] for x in out]).astype(np.int32)))
                m = len(low)
                yield pa.record_batch({"kind": pa.array(np.ones(m, np.int32)), "doc_id": pa.nulls(m, pa.int64()), "key": pa.array(np.repeat(np.array([x[0] for x in out], np.int64), size)), "n_bytes": pa.nulls(m, pa.int64()), "sha256": pa.nulls(m, pa.string()), "anchor": pa.array(np.concatenate([x[1] for x in out]).view(np.int64)), "places": places, "low": pa.array(low)})

    return run


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted intervals; touching ones join."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    head = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(ends) - 1)]


RANGES = "kind int, block int, chunk string, key long, start int, payload binary"


def cut_ranges(least: int, n_hot: int):
    """Texts with their repeated anchors become byte ranges by block (kind 0), and, for hot labels (block -1), window hashes: the task's own (1) and those of each part (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in slices(batches, most=4 << 20):
            rows: list[tuple] = []
            hot: list[tuple[int, np.ndarray, np.ndarray]] = []
            for key, text, marks in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                data = (text or "").encode()
                place = np.array([p for x in marks for p in x["places"]], np.int64)
                block = np.repeat(np.array([x["block"] for x in marks], np.int64), [len(x["places"]) for x in marks])
                order = np.lexsort((place, block))
                place, block = place[order], block[order]
                for b in np.unique(block).tolist():
                    at = place[block == b]
                    a, z = union(np.maximum(at - (least - WINDOW), 0), np.minimum(at + least, len(data)))
                    if b >= 0:
                        rows += [(0, b, None, key, s, data[s:e]) for s, e in zip(a.tolist(), z.tolist(), strict=True) if e - s >= least]
                    else:
                        starts = ranges(a, np.maximum(z - a - least + 1, 0))
                        hot.append((key, starts, Rolling(data).windows(least)[starts]))
            if hot:
                chunk = f"{task}-{number}"
                number += 1
                found, where, n = np.unique(np.concatenate([x[2] for x in hot]), return_inverse=True, return_counts=True)
                rows.append((1, -1, chunk, None, None, pack(np.array([x[0] for x in hot], np.int64), np.array([len(x[1]) for x in hot], np.int64), np.concatenate([x[1] for x in hot]).astype(np.int32), where.astype(np.int32))))
                part = (found % np.uint64(n_hot)).astype(np.int64)
                for p in np.unique(part).tolist():
                    mine = np.flatnonzero(part == p)
                    rows.append((2, p, chunk, None, None, pack(delta(found[mine]), mine.astype(np.int32), (n[mine] > 1).astype(np.uint8))))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary())
            for i in range(0, len(rows), 2000):
                yield pa.record_batch({n: pa.array([x[j] for x in rows[i : i + 2000]], k) for j, (n, k) in enumerate(zip(("kind", "block", "chunk", "key", "start", "payload"), kinds, strict=True))})

    return run


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling, from 7 symbols of 9 bits; suffixes that only the end tells apart stay in order of place.

    Places and ranks have 32 bits: a block's index is the largest thing that a worker holds.
    """
    n = len(symbols)
    key = packed(symbols)
    order = np.argsort(key, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    new = np.zeros(n, np.int32)
    key = key[order]
    np.cumsum(key[1:] != key[:-1], out=new[1:])
    del key
    rank[order] = new
    width = 7
    while len(new) and new[-1] < n - 1 and width < n:
        # Only suffixes that share their rank are sorted again, within their places.
        places = np.concatenate([[True], new[1:] != new[:-1], [True]])
        places = np.flatnonzero(~(places[:-1] & places[1:])).astype(np.int32)
        del new
        some = order[places]
        both = rank[some].astype(np.int64) * (n + 1)
        inside = np.flatnonzero(some < n - width)
        both[inside] += rank[some[inside] + np.int32(width)] + 1
        del inside
        again = np.argsort(both, kind="stable")
        order[places], both = some[again], both[again]
        del some, again
        full = np.ones(n, np.int32)
        full[0] = 0
        # Two numbers that differ have another rank or another second part.
        full[places[1:]] = both[1:] != both[:-1]
        full[places[0]] = int(places[0] > 0)
        del both, places
        new = np.cumsum(full, dtype=np.int32)
        del full
        rank[order] = new
        width *= 2
    return order


def packed(symbols: np.ndarray) -> np.ndarray:
    """At each place, the next 7 symbols in one number; past the end there is a smaller one."""
    padded = np.concatenate([symbols.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    out = np.zeros(len(symbols), np.uint64)
    for i in range(7):
        out = (out << np.uint64(9)) | padded[i : i + len(symbols)]
    return out


def common_prefix(keys: np.ndarray, symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of the suffixes at a and b."""
    n, out, alive, step = len(symbols), np.zeros(len(a), np.int32), np.arange(len(a)), 0
    while len(alive):
        x, y = a[alive] + step, b[alive] + step
        inside = np.maximum(x, y) + 7 <= n
        same = inside & (keys[np.minimum(x, n - 1)] == keys[np.minimum(y, n - 1)])
        ended, alive = alive[~same], alive[same]
        length, going = np.full(len(ended), step), np.ones(len(ended), bool)
        for i in range(7):
            x, y = a[ended] + step + i, b[ended] + step + i
            going &= (np.maximum(x, y) < n) & (symbols[np.minimum(x, n - 1)] == symbols[np.minimum(y, n - 1)])
            length += going
        out[ended] = length
        step += 7
    return out


def matching_lengths(symbols: np.ndarray) -> np.ndarray:
    """For each suffix, the longest beginning it shares with another, streamed from the run-compressed transform's samples."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int32)
    order = suffix_order(symbols)
    transform = np.where(order > 0, symbols[order - 1], np.uint16(511))  # nothing stands before suffix 0
    heads = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]])).astype(np.int32)
    del transform
    # Inside a run, the suffix and its neighbour both follow the same symbol, so that their match is one shorter than that
    # of the suffixes one to the left. Only where a run begins is the match measured, with the end of the run before.
    before = np.full(n, -2, np.int32)  # at each sampled place, the suffix before it in order (-1: none); -2 elsewhere
    before[order[heads]] = np.where(heads > 0, order[heads - 1], -1)
    if before[0] == -2:
        row = int(np.flatnonzero(order == 0)[0])
        before[0] = order[row - 1] if row else -1
    del heads
    sampled = np.flatnonzero(before > -2).astype(np.int32)
    last = np.cumsum(before > -2, dtype=np.int32) - np.int32(1)
    before = before[sampled]
    length = np.zeros(len(sampled), np.int32)
    some = np.flatnonzero(before >= 0)
    keys = packed(symbols)
    for i in range(0, len(some), SAMPLES):
        part = some[i : i + SAMPLES]
        length[part] = common_prefix(keys, symbols, sampled[part], before[part])
    del keys, some, before
    left = length[last] + sampled[last]  # with the suffix before it in order
    del last, sampled, length
    left -= np.arange(n, dtype=np.int32)
    in_order = np.maximum(left, 0, out=left)[order]
    in_order[:-1] = np.maximum(in_order[:-1], in_order[1:])
    left[order] = in_order
    return left


SPANS = "key long, start int, end int"


def index_block(least: int):
    """Marked bytes of one block's ranges."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("payload").to_pylist()]
        keys, starts = table.column("key").to_pylist(), table.column("start").to_numpy()
        sizes = np.array([len(x) + 1 for x in parts], np.int64)
        ends = np.cumsum(sizes) - 1  # the separator's place
        symbols = np.zeros(int(sizes.sum()), np.uint16)
        keep = np.ones(len(symbols), bool)
        keep[ends] = False
        symbols[keep] = np.concatenate(parts).astype(np.uint16) + 1
        del keep, parts
        length = matching_lengths(symbols)
        # Separators are equal: a match over one ends at the same distance in both texts.
        at = np.flatnonzero(length >= least)
        at = at[ends[np.searchsorted(ends, at)] - at >= least]
        a, z = union(at, at + least)
        who = np.searchsorted(ends, a)
        shift = np.array(starts, np.int64) - (ends - sizes + 1)
        del length, symbols
        trim()
        return pa.table({"key": pa.array([keys[i] for i in who], pa.int64()), "start": pa.array((a + shift[who]).astype(np.int32)), "end": pa.array((z + shift[who]).astype(np.int32))})

    return run


def count_hot(table: pa.Table) -> pa.Table:
    """Which window hashes of a part occur twice, back to each chunk."""
    got = [unpack(x) for x in table.column("payload").to_pylist()]
    hashes = [undelta(x[0]) for x in got]
    found, where, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    many = n > 1
    many[where[np.concatenate([x[2] for x in got]) > 0]] = True
    ends = np.cumsum([len(x) for x in hashes])
    rows = [x[1][many[where[e - len(h) : e]]] for x, h, e in zip(got, hashes, ends.tolist(), strict=True)]
    m = len(rows)
    return pa.table({"kind": pa.array([3] * m, pa.int32()), "block": table.column("block"), "chunk": table.column("chunk"), "key": pa.nulls(m, pa.int64()), "start": pa.nulls(m, pa.int32()), "payload": pa.array([pack(x) for x in rows], pa.binary())})


def mark_hot(least: int):
    def run(table: pa.Table) -> pa.Table:
        kinds, payload = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        keys, counts, starts, where = unpack(payload[kinds.index(1)])
        many = np.zeros(int(where.max(initial=-1)) + 1, bool)
        for k, x in zip(kinds, payload, strict=True):
            if k == 3:
                many[unpack(x)[0]] = True
        hit, owner = many[where], np.repeat(np.arange(len(keys)), counts)
        # Texts are set apart so that runs of different texts don't touch.
        gap = int(starts.max(initial=0)) + 2 * least
        at = starts[hit].astype(np.int64) + owner[hit] * gap
        a, z = union(at, at + least)
        who = a // gap if gap else a
        return pa.table({"key": pa.array(keys[who], pa.int64()), "start": pa.array((a - who * gap).astype(np.int32)), "end": pa.array((z - who * gap).astype(np.int32))})

    return run


def repeated_spans(docs: DataFrame, least: int, block_bytes: int, label_bytes: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (a row for each input row), distinct texts that hold repeated anchors, and marked spans by text key."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    read = scratch.keep(keyed.mapInArrow(read_anchors(least), READ), "read")
    texts = scratch.keep(read.where("kind = 0").select("doc_id", "key", "n_bytes", "sha256"), "texts")
    places = read.where("kind = 1").select("anchor", "key", "places", "low")
    shared = places.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max(F.size("places")).alias("n"), F.min("low").alias("label")).where("a != b or n > 1").select("anchor", "label")
    marks = scratch.keep(places.join(shared, "anchor").select("key", "anchor", "places", "label").dropDuplicates(["key", "anchor"]), "marks")
    scratch.drop("read")
    around = 2 * least - WINDOW

    def bytes_of(group: str) -> DataFrame:
        """Bytes of the ranges of each label or anchor, at most: the ranges of a text overlap."""
        ends = F.min(F.element_at("places", 1)).alias("lo"), F.max(F.element_at("places", -1)).alias("hi"), F.sum(F.size("places")).alias("n")
        return marks.groupBy(group, "key").agg(*ends).withColumn("n", F.least(F.col("n") * around, F.col("hi") - F.col("lo") + around)).groupBy(group).agg(F.sum("n").alias("n"))

    sizes = scratch.keep(bytes_of("label"), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, int(total // block_bytes) + 1)

    def block(name: str) -> Column:
        """A label or anchor of more than a block's bytes has a number of its own, so that no others add to it."""
        dealt = lambda n: F.pmod(F.xxhash64(name), F.lit(n))
        return F.when(F.col("n") > block_bytes, blocks + dealt(1 << 30)).otherwise(dealt(blocks)).cast("int").alias("block")

    small = marks.join(sizes.where(F.col("n") <= label_bytes).select("label", block("label")), "label").select("key", "places", "block")
    large = marks.join(sizes.where(F.col("n") > label_bytes).select("label"), "label", "left_semi")
    dealt = bytes_of("anchor").join(large.select("anchor").distinct(), "anchor", "left_semi").select("anchor", F.when(F.col("n") > label_bytes, -1).otherwise(block("anchor")).alias("block"))
    marked = small.unionByName(large.join(dealt, "anchor").select("key", "places", "block")).groupBy("key").agg(F.collect_list(F.struct("places", "block")).alias("marks"))  # the anchors of one text
    held = scratch.keep(keyed.select("key", "text").join(marked, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("marks").alias("marks")), "held")
    scratch.drop("marks")
    hot = max(8, int(total // (64 * block_bytes)))
    cut = scratch.keep(held.mapInArrow(cut_ranges(least, hot), RANGES), "cut")
    cold = cut.where("kind = 0").groupBy("block").applyInArrow(index_block(least), SPANS)
    counted = cut.where("kind = 2").groupBy("block").applyInArrow(count_hot, RANGES)
    warm = cut.where("kind = 1").unionByName(counted).groupBy("chunk").applyInArrow(mark_hot(least), SPANS)
    spans = scratch.keep(cold.unionByName(warm), "spans", blocks + hot)
    scratch.drop("cut")
    return texts, held.select("key", "text"), spans


CLEANED = "key long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept binary"


def kept_pieces(data: bytes, marks: list[dict]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Maximal marked runs of a text, and what is left between them."""
    pairs = np.array(sorted((x["start"], x["end"]) for x in marks), np.int64).reshape(-1, 2)
    a, z = union(pairs[:, 0], pairs[:, 1])
    edges = [0, *np.stack([a, z], 1).reshape(-1).tolist(), len(data)]
    return a, z, [data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)]


def clean_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their marks: merged spans and what is left."""
    for batch in slices(batches):
        out = []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            a, z, pieces = kept_pieces(text.encode(), marks)
            kept = b"".join(pieces)
            out.append((int((z - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in zip(a.tolist(), z.tolist(), strict=True)], kept))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
        names = ("n_removed", "n_spans", "kept_sha256", "spans", "kept")
        yield pa.record_batch({"key": batch.column("key")} | {n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def dedup(docs: DataFrame, least: int = 400, block_bytes: int = 1_000_000, label_bytes: int = 3_000_000, kept: bool = False) -> DataFrame:
    """A row for each row of ``doc_id``, ``text``: bytes, removed bytes, spans, and the checksum of what is left.

    ``kept`` adds the bytes left (null: all of the text) and the spans.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts, held, spans = repeated_spans(docs, least, block_bytes, label_bytes, Scratch(spark, "runs"))
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # the marks of one text
    cleaned = held.join(lists, "key").mapInArrow(clean_texts, CLEANED).select("key", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if kept else []))
    copies = texts.groupBy("key").agg(F.count("*").alias("n"))
    found = copies.join(cleaned, "key", "left")
    out = texts.join(found, "key")
    gone = (F.col("n") > 1) & (F.col("n_bytes") >= least)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    columns = {
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long"),
        "n_spans": F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"),
        "kept_sha256": F.when(gone, empty).otherwise(F.coalesce("kept_sha256", "sha256")),
    }
    if kept:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
        columns |= {"spans": F.when(gone, whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"))), "kept": F.when(gone, F.lit(b"")).otherwise(F.col("kept"))}
    return out.select("doc_id", "n_bytes", *(c.alias(n) for n, c in columns.items()))


def remove_repeats(docs: DataFrame, least: int = 400, block_bytes: int = 1_000_000, label_bytes: int = 3_000_000) -> DataFrame:
    """The rows with the marked bytes cut out of ``text`` (a character that a cut splits goes with it); all other columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    texts, held, spans = repeated_spans(docs, least, block_bytes, label_bytes, Scratch(spark, "runs"))
    lists = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                pieces = kept_pieces(text.encode(), marks)[2]
                kept.append("".join(x.decode("utf-8", "ignore") for x in pieces))  # each by itself: no character of two halves
            yield pa.record_batch({"__key": batch.column("key"), "__kept": pa.array(kept, pa.string())})

    cleaned = held.join(lists, "key").mapInArrow(whole_characters, "__key long, __kept string")
    copies = texts.where(F.col("n_bytes") >= least).groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("n")).where("n > 1").select("__key", F.lit("").alias("__kept"))
    changed = copies.unionByName(cleaned.join(copies.select("__key"), "__key", "left_anti"))
    out = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit("")))).join(changed, "__key", "left")
    return out.withColumn("text", F.coalesce("__kept", "text")).select(*docs.columns)
