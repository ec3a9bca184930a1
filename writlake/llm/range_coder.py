"""Token-id files: blocks of ids, each coded by an adaptive context-mixing range coder of its own.

For every id, the order-2 and order-1 contexts of its block each predict the id that followed them last, and order 0 has adaptive
counts of id classes; their weights come from how often each was right in this block. The three are one distribution, in
which the id takes one step of a range coder with carries. A block starts with an empty model, so it is read without any other, and it
has checksums of its bytes and of its ids. Blocks of a segment are coded side by side, one id of each at a time.

A segment holds consecutive documents: ids and counts of the documents, then the blocks' headers and bytes. Segments are
rows of a table in the shared folder, written in order of doc_id (nulls first, then equal ids in order of their texts).

Null and empty texts have the end id alone; rows may repeat; other columns are ignored; an empty table gives an empty result. A damaged
segment raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from writlake.llm.common import Scratch, prepare, slices, token_ids, trim

MAGIC, VERSION = b"WLID", 2
SLOTS, MIX, COUNTS, REFRESH = 2048, 512, 2048, 64
U = np.uint64


class Model:
    """The blocks' models, one lane for each block."""

    def __init__(self, lanes: int, id_bits: int):
        self.low_bits = max(8, id_bits - 8)
        if self.low_bits > 10:
            raise ValueError("ids of more than 18 bits")
        self.classes = 1 << max(id_bits - self.low_bits, 0)
        self.total_bits = 20 + self.low_bits  # log2(MIX * COUNTS) + low_bits
        self.table = np.zeros((2, lanes * SLOTS), np.int32)
        self.lane = np.arange(lanes, dtype=np.int32)
        self.base = self.lane * np.int32(SLOTS)
        self.hits, self.tries = np.zeros((2, 2, lanes), np.int32)
        self.last = np.zeros((2, lanes), np.int32)
        self.counts = np.zeros((lanes, self.classes), np.int32)
        self.steps = 0
        self.refresh()

    def refresh(self) -> None:
        """Order-0 shares from the counts so far, each 1 at least."""
        share = (1 + self.counts.astype(np.int64) * (COUNTS - self.classes) // max(self.steps, 1)).astype(np.int32)
        share[:, 0] += COUNTS - share.sum(1, dtype=np.int32)
        self.share = share.reshape(-1)
        self.below = (np.cumsum(share, 1, dtype=np.int32) - share).reshape(-1)
        self.kind_of = None

    def predict(self) -> None:
        """Predicted ids (-1: none) and the weights of the three orders, of MIX in all."""
        a, b = self.last
        self.at1 = self.base + ((a * 40503 >> 4) & (SLOTS - 1))
        self.at2 = self.base + (((a * 40503) ^ (b * 30011 >> 3)) & (SLOTS - 1))
        self.id1, self.id2 = self.table[0].take(self.at1) - 1, self.table[1].take(self.at2) - 1
        self.has2 = self.id2 >= 0
        self.has1 = (self.id1 >= 0) & (self.id1 != self.id2)
        h, n = self.hits, self.tries
        self.w2 = np.minimum((h[1] + 1) * MIX // (n[1] + 2) + 1, MIX - 32) * self.has2
        rest = MIX - self.w2
        self.w1 = np.minimum((h[0] + 1) * rest // (n[0] + 2) + 1, rest - 16) * self.has1
        self.w0 = rest - self.w1

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids' parts of 2 ** total_bits."""
        unit = COUNTS << self.low_bits
        kind = ids >> self.low_bits
        cell = self.lane * np.int32(self.classes) + kind
        share = self.share.take(cell)
        start = (self.below.take(cell) << self.low_bits) + (ids & ((1 << self.low_bits) - 1)) * share
        start, size = (MIX - self.w0) * unit + self.w0 * start, self.w0 * share
        one = self.has1 & (ids == self.id1)
        start, size = np.where(one, self.w2 * unit, start), np.where(one, self.w1 * unit, size)
        two = ids == self.id2
        return np.where(two, 0, start), np.where(two, self.w2 * unit, size)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose parts hold the values."""
        unit = COUNTS << self.low_bits
        inner = np.maximum(value - (MIX - self.w0) * unit, 0) // self.w0
        if self.kind_of is None:  # the class of each of a lane's COUNTS parts, until the shares change
            self.kind_of = np.repeat(np.tile(np.arange(self.classes, dtype=np.int16), len(self.lane)), self.share[: len(self.lane) * self.classes])
        kind = self.kind_of.take(self.lane * np.int32(COUNTS) + (inner >> self.low_bits)).astype(np.int32)
        cell = self.lane * np.int32(self.classes) + kind
        ids = (kind << self.low_bits) + (inner - (self.below.take(cell) << self.low_bits)) // self.share.take(cell)
        ids = np.where(value < (MIX - self.w0) * unit, self.id1, ids)
        return np.where(value < self.w2 * unit, self.id2, ids)

    def update(self, ids: np.ndarray) -> None:
        two = ids == self.id2
        self.hits[1] += two
        self.tries[1] += self.has2
        self.hits[0] += self.has1 & (ids == self.id1)
        self.tries[0] += self.has1 & ~two
        old = self.tries > 254
        if old.any():
            self.hits[old] >>= 1
            self.tries[old] >>= 1
        self.table[0][self.at1] = self.table[1][self.at2] = ids + 1
        self.last[1] = self.last[0]
        self.last[0] = ids
        self.counts[self.lane, ids >> self.low_bits] += 1
        self.steps += 1
        if self.steps % REFRESH == 0:
            self.refresh()

    def narrow(self, lanes: int) -> None:
        """Only the first lanes go on: the last block may be short."""
        for name in ("base", "lane", "counts"):
            setattr(self, name, getattr(self, name)[:lanes])
        for name in ("hits", "tries", "last"):
            setattr(self, name, getattr(self, name)[..., :lanes])


def encode_blocks(ids: np.ndarray, block: int, id_bits: int) -> list[bytes]:
    """Each block's bytes; the arithmetic keeps 63 bits, and puts out 32 with a carry to add."""
    n, lanes = len(ids), -(-len(ids) // block)
    if not n:
        return []
    full = np.zeros(block * lanes, np.int32)
    full[:n] = ids
    grid = np.ascontiguousarray(full.reshape(lanes, block).T)
    del full
    model = Model(lanes, id_bits)
    bits = U(model.total_bits)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 63) - 1, np.uint64)
    out, at = np.zeros((lanes, block * model.total_bits // 32 + 8), np.uint64), np.zeros(lanes, np.int64)
    short = n - (lanes - 1) * block
    for t in range(block if lanes > 1 else short):
        if t == short:
            model.narrow(lanes - 1)
        m = len(model.lane)
        model.predict()
        start, size = model.interval(grid[t, :m])
        unit = span[:m] >> bits
        low[:m] += unit * start.astype(np.uint64)
        span[:m] = unit * size.astype(np.uint64)
        some = np.flatnonzero(span[:m] < U(1 << 31))
        out[some, at[some]] = low[some] >> U(31)
        low[some] = (low[some] & U((1 << 31) - 1)) << U(32)
        span[some] <<= U(32)
        at[some] += 1
        model.update(grid[t, :m])
    every = np.arange(lanes)
    for _ in range(2):
        out[every, at] = low >> U(31)
        low = (low & U((1 << 31) - 1)) << U(32)
        at += 1
    for k in range(int(at.max()) - 1, 0, -1):
        out[:, k - 1] += out[:, k] >> U(32)
    words = out.astype(np.uint32).astype(">u4")
    return [words[i, : at[i]].tobytes() for i in range(lanes)]


def decode_blocks(payloads: list[bytes], sizes: np.ndarray, id_bits: int) -> np.ndarray:
    """The ids of all blocks; only the last may be shorter than the first."""
    lanes = len(payloads)
    if not lanes:
        return np.zeros(0, np.int32)
    block, short = int(sizes[0]), int(sizes[-1])
    model = Model(lanes, id_bits)
    bits = U(model.total_bits)
    lengths = np.array([len(x) // 4 for x in payloads])
    words = np.zeros((lanes, int(lengths.max()) + 4), np.uint64)
    for i, x in enumerate(payloads):
        words[i, : lengths[i]] = np.frombuffer(x, ">u4")
    code = (words[:, 0] << U(31)) | (words[:, 1] >> U(1))
    # From here on the code takes 32 bits that start at the last one of a word.
    words = ((words[:, 1:-1] & U(1)) << U(31)) | (words[:, 2:] >> U(1))
    span, at = np.full(lanes, (1 << 63) - 1, np.uint64), np.zeros(lanes, np.int64)
    grid = np.zeros((block, lanes), np.int32)
    for t in range(block):
        if t == short and short < block:
            model.narrow(lanes - 1)
        m = len(model.lane)
        if not m:
            break
        model.predict()
        unit = span[:m] >> bits
        value = np.minimum(code[:m] // unit, U((1 << model.total_bits) - 1)).astype(np.int32)
        ids = model.find(value)
        start, size = model.interval(ids)
        code[:m] -= unit * start.astype(np.uint64)
        span[:m] = unit * size.astype(np.uint64)
        some = np.flatnonzero(span[:m] < U(1 << 31))
        code[some] = (code[some] << U(32)) | words[some, np.minimum(at[some], words.shape[1] - 1)]
        span[some] <<= U(32)
        at[some] += 1
        model.update(ids)
        grid[t, :m] = ids
    return np.ascontiguousarray(grid.T).reshape(-1)[: (lanes - 1) * block + short]


def write_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, id_bits: int, block: int = 2048) -> bytes:
    payloads = encode_blocks(ids, block, id_bits)
    sizes = [min(block, len(ids) - i * block) for i in range(len(payloads))]
    raw = ids.astype("<u4")
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes() + counts.astype("<i8").tobytes()
    docs = zlib.compress(docs, 3)
    heads = b"".join(struct.pack("<IIII", n, len(x), zlib.crc32(raw[i * block : i * block + n]), zlib.crc32(x)) for i, (n, x) in enumerate(zip(sizes, payloads, strict=True)))
    head = MAGIC + struct.pack("<HHIIII", VERSION, id_bits, block, len(doc_ids), len(payloads), len(docs))
    body = head + docs + heads
    return body + struct.pack("<I", zlib.crc32(body)) + b"".join(payloads)


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, counts, and all ids; every checksum is compared."""
    if data[:4] != MAGIC or len(data) < 28:
        raise ValueError("not a segment of token ids")
    version, id_bits, block, n, blocks, size = struct.unpack_from("<HHIIII", data, 4)
    end = 24 + size + 16 * blocks
    if version != VERSION or len(data) < end + 4 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("damaged head of a segment")
    docs = zlib.decompress(data[24 : 24 + size])
    names, null, counts = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, np.uint8, n, 8 * n), np.frombuffer(docs, "<i8", n, 9 * n)
    heads = np.frombuffer(data, "<u4", 4 * blocks, 24 + size).reshape(-1, 4)
    at, payloads = end + 4, []
    for _, length, _, check in heads.tolist():
        payloads.append(data[at : at + length])
        at += length
        if zlib.crc32(payloads[-1]) != check:
            raise ValueError(f"damaged block {len(payloads) - 1}")
    ids = decode_blocks(payloads, heads[:, 0], id_bits).astype("<u4")
    for i, (size, _, check, _) in enumerate(heads.tolist()):
        if zlib.crc32(ids[i * block : i * block + size]) != check:
            raise ValueError(f"ids of block {i} differ from those written")
    return [None if z else x for x, z in zip(names.tolist(), null.tolist(), strict=True)], counts, ids


SEGMENTS = "part int, number int, n_docs long, n_ids long, segment binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_ids(docs: DataFrame, scratch: Scratch, tokenizer: str, boundary: str = "word", end_id: int = 1, id_bits: int = 16, segment_bytes: int = 8 << 20) -> DataFrame:
    """Write the ids of all documents as segments in order of doc_id; gives the written table."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), token_ids(tokenizer, boundary)
        for number, batch in enumerate(slices(batches, most=segment_bytes)):
            flat, counts = coder.encode(batch.column("text"))
            stops = np.cumsum(counts + 1) - 1
            ids = np.full(len(flat) + len(counts), end_id, np.int32)
            body = np.ones(len(ids), bool)
            body[stops] = False
            ids[body] = flat
            data = write_segment(batch.column("doc_id").to_pylist(), counts + 1, ids, id_bits)
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": pa.array([len(counts)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "segment": pa.array([data], pa.binary())})

    ranged = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return scratch.keep(ranged.mapInArrow(run, SEGMENTS), "segments")


def read_ids(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document what the segments hold: its place among all ids, its count and checksum (and its ids)."""
    prepare(segments.sparkSession)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = Window.partitionBy("part").orderBy("number")
    starts = segments.select("part", "number", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("inside")).join(offsets, "part")
    starts = starts.select("part", "number", (F.col("base") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column("segment"), batch.column("first").to_pylist(), strict=True):
                names, counts, ids = read_segment(data.as_py())
                stops = np.cumsum(counts)
                cut = [ids[s - n : s] for s, n in zip(stops.tolist(), counts.tolist(), strict=True)]
                table = {"doc_id": pa.array(names, pa.int64()), "start": pa.array(first + stops - counts), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64())}
                if with_ids:
                    table["ids"] = pa.array([x.tolist() for x in cut], pa.list_(pa.int64()))
                yield pa.record_batch(table)
                del data, ids, cut, table
                trim()

    return segments.select("part", "number", "segment").join(F.broadcast(starts), ["part", "number"]).mapInArrow(run, ROWS + (", ids array<long>" if with_ids else ""))


def written_and_read(docs: DataFrame, tokenizer: str, boundary: str = "word", end_id: int = 1) -> DataFrame:
    return read_ids(write_ids(docs, Scratch(docs.sparkSession, "ids"), tokenizer, boundary, end_id))
