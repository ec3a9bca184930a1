"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens. The open sequence repeatedly takes the
item whose size vector (as shares of the limits) has the largest dot product with what is left of the limits; where items may
be cut, one that doesn't fit is cut at what is left. Each input partition packs a bounded window of documents at a time
and keeps only its unplaced tails, so no row leaves its task, and memory does not grow with the input.

Null and empty texts have the end token alone; rows may repeat and null ids stay; equal items are taken in input order;
other columns are ignored; an empty table gives an empty result. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from writlake.llm.common import prepare, slices, token_ids, trim


@dataclass
class Packer:
    """Packs items; an item is a document (its row), a start, and counts of tokens and of loss-bearing ones."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024
    cut: bool = True
    first: int = 0
    items: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))  # row, start, tokens, loss
    pieces: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # row, start, tokens, sequence, offset

    def next_sequence(self) -> int:
        self.first += 1
        return self.first - 1

    def add(self, items: np.ndarray) -> None:
        """New items; where cutting is allowed, what fills whole sequences by itself is placed at once."""
        if self.cut:
            step = min(self.tokens, self.loss)
            whole = items[:, 2] // step
            for row, start, n, times in zip(*items[:, :3].T.tolist(), whole.tolist(), strict=True):
                if times and step == self.tokens and self.segments:
                    for i in range(times):
                        self.pieces.append((row, start + i * step, step, self.next_sequence(), 0))
            if step == self.tokens:
                items = items.copy()
                items[:, 1] += whole * step
                items[:, 2] -= whole * step
                items[:, 3] -= np.minimum(items[:, 3], whole * step)
        elif len(items) and ((items[:, 2] > self.tokens) | (items[:, 3] > self.loss)).any():
            raise ValueError("an item is larger than a sequence")
        self.items = np.concatenate([self.items, items[items[:, 2] > 0]])

    def pack(self, last: bool) -> None:
        """Place items while they can fill a sequence; ``last`` places what remains too."""
        limits = np.array([self.tokens, self.segments, self.loss], float)
        alive = np.ones(len(self.items), bool)
        left_tokens = int(self.items[:, 2].sum())
        while left_tokens and (last or left_tokens >= 4 * self.tokens):
            sequence, left, used = self.next_sequence(), limits.copy(), 0
            while left.min() >= 1 and left_tokens:
                sizes = self.items[:, 2:4] * alive[:, None]
                fits = alive & (sizes[:, 0] <= left[0]) & (sizes[:, 1] <= left[2])
                share = left / limits
                score = sizes[:, 0] / limits[0] * share[0] + share[1] / limits[1] + sizes[:, 1] / limits[2] * share[2]
                if fits.any() and not (self.cut and left[1] == 1):
                    i = int(np.argmax(np.where(fits, score, -1)))
                    n = int(self.items[i, 2])
                elif self.cut:
                    # Nothing fits whole, or this is the last segment: the largest item, cut at what is left.
                    i = int(np.argmax(sizes[:, 0]))
                    n = int(min(self.items[i, 2], left[0], left[2]))
                else:
                    break
                row, start, size, bearing = self.items[i].tolist()
                self.pieces.append((row, start, n, sequence, used))
                lost = bearing if n == size else min(bearing, n)
                left -= (n, 1, lost)
                used += n
                left_tokens -= n
                self.items[i] = (row, start + n, size - n, bearing - lost)
                alive[i] = size > n
            if last and self.cut and not left_tokens:
                self.split_last(sequence, used)
        self.items = self.items[alive]

    def split_last(self, sequence: int, used: int) -> None:
        """The one unfilled sequence becomes sequences of powers of two, which need no padding."""
        if used == self.tokens or used & (used - 1) == 0:
            return
        own = [x for x in self.pieces if x[3] == sequence]
        self.pieces = [x for x in self.pieces if x[3] != sequence]
        parts = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        room, offset, here = parts.pop(0), 0, sequence
        for row, start, n, _, _ in own:
            while n:
                if offset == room:
                    room, offset, here = parts.pop(0), 0, self.next_sequence()
                take = min(n, room - offset)
                self.pieces.append((row, start, take, here, offset))
                start, n, offset = start + take, n - take, offset + take


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, boundary: str = "space", end_id: int = 0, tokens: int = 1024, segments: int = 64, loss: int | None = None, with_ids: bool = False, bearing: str | None = None, remembered: int = 350_000, piece_bytes: int = 6 << 20, forget: bool = False) -> DataFrame:
    """Pieces of all documents of ``doc_id``, ``text``: ids of a tokenizer's file and an end id, cut and packed.

    ``bearing`` names a column with how many of a document's ids, its last ones, bear loss (null: all, and never more than it has);
    without it every id does. ``loss`` (by default ``tokens``) limits them in a sequence. ``with_ids`` adds the ids of each piece.
    A worker remembers the ids of ``remembered`` pieces of text and codes ``piece_bytes`` at a time; both only trade memory for time.
    With ``forget`` it keeps none of them when a task ends, for workers that go on to other stages.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = Packer(tokens, segments, loss or tokens)
        names: list[int | None] = []
        ids: list[np.ndarray] = []

        def out(last: bool) -> pa.RecordBatch:
            nonlocal names, ids
            packer.pack(last)
            pieces, packer.pieces = packer.pieces, []
            cut = [ids[r][s : s + n] for r, s, n, _, _ in pieces]
            table = {
                "doc_id": pa.array([names[r] for r, *_ in pieces], pa.int64()), "start": pa.array([x[1] for x in pieces], pa.int64()), "length": pa.array([x[2] for x in pieces], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "doc_tokens": pa.array([len(ids[r]) for r, *_ in pieces], pa.int64()),
                "sequence_id": pa.array([base + x[3] for x in pieces], pa.int64()), "offset": pa.array([x[4] for x in pieces], pa.int64()),
            }
            if with_ids:
                table["ids"] = pa.array([x.tolist() for x in cut], pa.list_(pa.int64()))
            rows = np.unique(packer.items[:, 0])
            names, ids = [names[r] for r in rows], [ids[r] for r in rows]
            packer.items[:, 0] = np.searchsorted(rows, packer.items[:, 0])
            return pa.record_batch(table)

        coder = token_ids(tokenizer, boundary, remembered)
        for batch in slices(batches, most=piece_bytes):
            flat, counts = coder.encode(batch.column("text"))
            at, stops = len(ids), np.cumsum(counts)
            for name, a, b in zip(batch.column("doc_id").to_pylist(), (stops - counts).tolist(), stops.tolist(), strict=True):
                names.append(name)
                ids.append(np.append(flat[a:b], end_id).astype("<u4"))
            size = counts + 1
            some = size if bearing is None else np.minimum(size, np.array([s if x is None else max(x, 0) for x, s in zip(batch.column("bearing").to_pylist(), size.tolist(), strict=True)], np.int64))
            packer.add(np.stack([np.arange(at, len(ids)), np.zeros(len(size), np.int64), size, some], 1))
            yield out(False)
        yield out(True)
        if forget:
            coder.clear()
            trim()

    rows = docs.select("doc_id", "text", *([] if bearing is None else [F.col(bearing).cast("long").alias("bearing")]))
    return rows.mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))
