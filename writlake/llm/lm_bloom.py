"""LM scoring with a log-frequency Bloom filter.

Word 1- and 2-gram counts of the training texts are quantised to powers of two; level j of an n-gram is
inserted as its own key, so that a count is read back by probing levels 1, 2, ... until one is missing.
The filter is built in blocks by n-gram hash, each as large as its n-grams need. Every block of documents sends
its distinct n-grams to their block of the filter and gets the probed levels back, so that no process holds the
whole filter, and the smoothed probability of every token comes from probes alone:

    P(w) = (c(w) + 1) / (N + V + 1),  P(w | v) = (c(vw) + mu P(w)) / (c(v) + mu)

with c the middle of the probed level. Exact counts (for the add-one base score) go back to each block of
documents through a join on blocks of the vocabulary, so that no task holds the vocabulary.

Nulls and empty texts are texts without words: they hold the end token alone. Rows may repeat, a null
doc_id is trained on (it has no checksum), and other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from writlake.llm.common import Scratch, coded_words, delta, mix64, pack, prepare, slices, undelta, unpack

END = np.uint64(0)
_PAIR, _LEVEL, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(2**64 - 2**20)


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """44-bit keys (low bits 0), whose collisions are far rarer than a filter's false levels and which pack well."""
    return mix64(before * _PAIR + mix64(word)) & _TOP


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of the hash range that a key belongs to, which is its block of the filter too."""
    return ((keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0, or 1 + floor(log2(count))."""
    out = np.zeros(len(counts), np.int64)
    some = counts > 0
    out[some] = np.frexp(counts[some].astype(float))[1]
    return out


#: The count that a level stands for: the middle of [2^(level-1), 2^level - 1].
LEVEL_COUNTS = np.array([0.0, *((2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, 64))])


@dataclass
class Filter:
    """Blocks of a log-frequency Bloom filter; a key's block is its part of the hash range."""

    blocks: list[np.ndarray]
    hashes: int

    def __post_init__(self) -> None:
        sizes = np.array([len(x) for x in self.blocks], np.int64)
        self.bits = (sizes * 8).astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64) * np.uint64(8)
        self.bytes = np.concatenate(self.blocks) if self.blocks else np.zeros(0, np.uint8)
        self.blocks = []

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        if not len(self.bytes):
            return np.zeros(len(keys), bool)
        block = part_of(keys, len(self.bits))
        alive = np.arange(len(keys))
        a, b = key_hashes(keys, level)
        for i in range(self.hashes):
            bit = self.starts[block[alive]] + (a[alive] + np.uint64(i) * b[alive]) % self.bits[block[alive]]
            alive = alive[(self.bytes[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), bool)
        out[alive] = True
        return out

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Levels by probing upwards until one is missing."""
        level, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for q in range(1, 63):
            alive = alive[self.has(keys[alive], q)]
            if not len(alive):
                break
            level[alive] = q
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return LEVEL_COUNTS[self.probe(keys)]


def key_hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys + np.uint64(level * int(_LEVEL) & (1 << 64) - 1))
    return h >> np.uint64(24), (mix64(h) >> np.uint64(24)) | np.uint64(1)


def build_block(keys: np.ndarray, counts: np.ndarray, hashes: int, bits_per_entry: float, most_bytes: int | None = None) -> np.ndarray:
    """One block: every key at each level up to its quantised count. It grows with them unless ``most_bytes`` is given."""
    q = levels(counts)
    bits = max(64, math.ceil(float(q.sum()) * bits_per_entry))
    if most_bytes is not None:
        bits = max(64, min(most_bytes * 8, bits))
    bits = (bits + 7) // 8 * 8
    out = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        a, b = key_hashes(keys[q >= level], level)
        for i in range(hashes):
            out[((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def held_out(ids: list[int | None], modulus: int, rest: int) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % modulus == rest for x in ids], bool)


READ = "kind int, chunk string, part int, payload binary"


def read_blocks(n_parts: int, modulus: int, rest: int):
    """Blocks of about 8 MB of text: coded words (kind 0), and for each part of the hash range, the block's words (1) and pairs (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            codes, names, counts = coded_words(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            out = held_out(ids, modulus, rest)
            # Codes in order of the hashes, the end's (0) first, so that a part of the hash range is a run of codes.
            names, place = np.unique(np.append(names, END), return_inverse=True)
            codes = place[codes]
            end = int(place[-1])
            # The end token follows each text's words.
            ends = np.cumsum(counts + 1) - 1
            tokens = np.full(len(codes) + len(counts), end, np.int32)
            where = np.ones(len(tokens), bool)
            where[ends] = False
            tokens[where] = codes
            train = np.repeat(~out, counts + 1)
            seen = np.bincount(tokens[train], minlength=len(names)).astype(np.uint32)
            before = np.roll(tokens, 1)
            before[ends - counts] = end
            # All pairs are probed, those of held-out texts too; these count nothing.
            pairs, where = np.unique(bigram_keys(names[before], names[tokens]), return_inverse=True)
            n = np.bincount(where[train], minlength=len(pairs)).astype(np.uint32)
            chunk, rows = f"{task}-{at}", []
            known = np.array([x is not None for x in ids], bool)
            rows.append((0, 0, pack(np.array([x or 0 for x in ids], np.int64), known, out, (counts + 1).astype(np.int64), tokens, delta(names))))
            parts = np.arange(n_parts + 1)
            cuts, cuts2 = np.searchsorted(part_of(names, n_parts), parts), np.searchsorted(part_of(pairs, n_parts), parts)
            for p in range(n_parts):
                mine, mine2 = slice(cuts[p], cuts[p + 1]), slice(cuts2[p], cuts2[p + 1])
                if cuts[p] < cuts[p + 1]:
                    rows.append((1, p, pack(delta(names[mine]), cuts[p : p + 1], seen[mine])))
                if cuts2[p] < cuts2[p + 1]:
                    rows.append((2, p, pack(delta(pairs[mine2]), n[mine2])))
            at += 1
            yield pa.record_batch({"kind": pa.array([x[0] for x in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows)), "part": pa.array([x[1] for x in rows], pa.int32()), "payload": pa.array([x[2] for x in rows], pa.binary())})

    return run


COUNTED = "kind int, chunk string, part int, payload binary, tokens long, words long"


def count_part(hashes: int, bits_per_entry: float):
    """Per part of the hash range: exact counts and probed levels of words (1) and levels of pairs (2) back to each block, and totals (3)."""

    def run(table: pa.Table) -> pa.Table:
        kind, chunks = table.column("kind").to_numpy(), table.column("chunk").to_pylist()
        part, payload = table.column("part")[0].as_py(), table.column("payload")
        words, spans = [], []
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            if not some:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            all_keys, n = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]).astype(np.int64)
            order = np.argsort(all_keys, kind="stable")
            all_keys, n = all_keys[order], n[order]
            first = np.flatnonzero(np.diff(all_keys, prepend=~all_keys[:1]) != 0)
            return all_keys[first], np.add.reduceat(n, first)

        for i in np.flatnonzero(kind == 1):
            names, first, n = unpack(payload[i].as_py())
            words.append((undelta(names), n))
            spans.append((chunks[i], words[-1][0], first))
        names, n = merged(words)
        pending, size = [], 0
        for i in np.flatnonzero(kind == 2):
            got, c = unpack(payload[i].as_py())
            trained = c > 0
            pending.append((undelta(got)[trained], c[trained]))
            size += len(pending[-1][1])
            if size > 1_500_000:
                keys, sums = merged([(keys, sums), *pending])
                pending, size = [], 0
        keys, sums = merged([(keys, sums), *pending])
        block = build_block(np.concatenate([names[n > 0], keys]), np.concatenate([n[n > 0], sums]), hashes, bits_per_entry)
        del keys, sums, pending
        model = Filter([block], hashes)
        rows = [(1, c, pack(first, n[np.searchsorted(names, own)], model.probe(own).astype(np.uint8))) for c, own, first in spans]
        rows += [(2, chunks[i], pack(model.probe(undelta(unpack(payload[i].as_py())[0])).astype(np.uint8))) for i in np.flatnonzero(kind == 2)]
        rows += [(3, "", b"")]
        last = len(rows) - 1
        return pa.table({
            "kind": pa.array([x[0] for x in rows], pa.int32()), "chunk": pa.array([x[1] for x in rows]), "part": pa.array([part] * len(rows), pa.int32()), "payload": pa.array([x[2] for x in rows], pa.binary()),
            "tokens": pa.array([int(n.sum()) if i == last else 0 for i in range(len(rows))], pa.int64()), "words": pa.array([int((n > 0).sum()) if i == last else 0 for i in range(len(rows))], pa.int64()),
        })

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(total: int, words: int, mu: float):
    def run(table: pa.Table) -> pa.Table:
        payload, kind = table.column("payload"), table.column("kind").to_numpy()
        ids, known, out, counts, tokens, names = unpack(payload[int(np.flatnonzero(kind == 0)[0])].as_py())
        names = undelta(names)
        exact, single = np.zeros(len(names), np.int64), np.zeros(len(names), np.float64)
        for i in np.flatnonzero(kind == 1):
            (at,), n, found = unpack(payload[i].as_py())
            exact[at : at + len(n)] = n
            single[at : at + len(n)] = LEVEL_COUNTS[found]
        # Parts are runs of the sorted keys, so that the levels in order of the parts are those of the chunk's sorted pairs.
        part = table.column("part").to_numpy()
        pair_levels = np.concatenate([unpack(payload[i].as_py())[0] for i in sorted(np.flatnonzero(kind == 2), key=lambda i: part[i])])
        ends = np.cumsum(counts)
        first = ends - counts
        base = np.log10((exact + 1.0) / (total + 1.0 * (words + 1)))
        prior = (single + 1.0) / (total + words + 1.0)
        before = np.roll(tokens, 1)
        before[first] = 0  # the end's code
        pair, where = np.unique(before.astype(np.int64) * len(names) + tokens, return_inverse=True)
        v, w = pair // len(names), pair % len(names)
        keys, place = np.unique(bigram_keys(names[v], names[w]), return_inverse=True)
        if len(keys) != len(pair_levels):
            raise ValueError(f"{len(keys)} pairs, levels of {len(pair_levels)}")
        both = np.minimum(LEVEL_COUNTS[pair_levels[place]], np.maximum(single[v], 1.0))
        logs = np.log10((both + mu * prior[w]) / (np.maximum(single[v], both) + mu))
        add = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=~known), "held_out": pa.array(out), "n_tokens": pa.array(counts), "n_known": pa.array(add((exact[tokens] > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(ids), total, np.int64)), "base_score": pa.array(add(base[tokens])), "score": pa.array(add(logs[where])),
        })

    return run


def lm_scores(docs: DataFrame, modulus: int = 7, rest: int = 2, mu: float = 4.0, bits_per_entry: float = 8.0, hashes: int = 5, part_bytes: int = 8 << 20) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod ``modulus`` is not ``rest`` and score all rows of ``doc_id``, ``text``.

    The filter takes ``bits_per_entry`` bits for each inserted level at any size, so that the rate of false levels stays. It has
    a part of the hash range for every ``part_bytes`` of text, so that a task's share does not grow with the input.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "lm")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = 16 + int(size // part_bytes)
    read = scratch.keep(docs.select("doc_id", "text").mapInArrow(read_blocks(n_parts, modulus, rest), READ), "read", by=("kind",))
    counted_parts = scratch.keep(read.where("kind > 0").groupBy("part").applyInArrow(count_part(hashes, bits_per_entry), COUNTED), "counted")
    scratch.drop("read/kind=1")
    scratch.drop("read/kind=2")
    totals = counted_parts.where("kind = 3").agg(F.sum("tokens"), F.sum("words")).first()
    total, words = int(totals[0] or 0), int(totals[1] or 0)
    both = read.where("kind = 0").unionByName(counted_parts.where("kind < 3").select("kind", "chunk", "part", "payload"))
    scores = scratch.keep(both.groupBy("chunk").applyInArrow(score_chunk(total, words, mu), SCORES), "scores")
    # The tables leave the disk before the scores are read.
    scratch.drop("read")
    scratch.drop("counted")
    return scores
