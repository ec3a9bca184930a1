"""Media columns: ISO base media files are walked box by box, and their sample tables decoded, without touching payloads.

``media_columns`` reads a binary column and gives each file's tracks with codec, duration, sample count and key frames'
byte ranges. ``write_track`` makes a file with one track, so that a byte string can be stored as samples.

Null contents give no tracks and status "null"; empty or damaged ones the tracks found so far and a status. Equal contents
give equal values, rows may repeat, other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from writlake.llm.common import prepare, slices

#: Boxes that hold boxes, by the ISO base media file format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"moof", b"traf", b"mvex", b"udta"}
SAMPLE, PER_CHUNK, KEY_EVERY, TIMESCALE = 64, 64, 32, 8000


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: list[tuple[int, int]] = field(default_factory=list)
    chunks: list[tuple[int, int, int]] = field(default_factory=list)
    chunk_offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray | None = None

    def offsets(self) -> np.ndarray:
        """Byte offset of every sample: chunk offsets and the samples' sizes within their chunks."""
        per = np.zeros(len(self.chunk_offsets), np.int64)
        for i, (first, count, _) in enumerate(self.chunks):
            stop = self.chunks[i + 1][0] - 1 if i + 1 < len(self.chunks) else len(per)
            per[first - 1 : stop] = count
        n = len(self.sizes)
        chunk = np.repeat(np.arange(len(per)), per)[:n]
        if len(chunk) < n:
            raise ValueError("more samples than chunks hold")
        before = np.cumsum(self.sizes) - self.sizes
        head = np.concatenate([[0], np.cumsum(per)[:-1]])[chunk] if n else np.zeros(0, np.int64)
        return self.chunk_offsets[chunk] + before - before[np.minimum(head, max(n - 1, 0))]

    def key_ranges(self) -> list[tuple[int, int]]:
        """[start, end) of every key frame; without a sync table every sample is one."""
        at = np.arange(len(self.sizes)) if self.keys is None else self.keys - 1
        starts = self.offsets()[at]
        return list(zip(starts.tolist(), (starts + self.sizes[at]).tolist(), strict=True))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of each box; 64-bit sizes, size 0 (to the end) and extended types are known."""
    while start + 8 <= end:
        size, kind, head = int.from_bytes(data[start : start + 4], "big"), bytes(data[start + 4 : start + 8]), 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("cut box")
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} of {size} bytes is cut")
        yield kind, start + head, start + size
        start += size


def numbers(data: memoryview, at: int, count: int, end: int, kind: str = ">u4") -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > end:
        raise ValueError("cut sample table")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def walk(data: bytes) -> tuple[list[Track], str, str]:
    """Tracks, brand and status ("ok", "no movie", what is damaged, or "fragments are not decoded": then samples are missing)."""
    view, tracks, brand, fragments = memoryview(data), [], "", False
    try:
        stack = [(0, len(view))]
        while stack:
            start, end = stack.pop()
            inner = []
            for kind, a, b in boxes(view, start, end):
                fragments |= kind in (b"moof", b"mvex")
                if kind in CONTAINERS:
                    inner.append((a, b))
                    if kind == b"trak":
                        tracks.append(Track())
                        fill(tracks[-1], view, a, b)
                elif kind == b"ftyp":
                    brand = bytes(view[a : a + 4]).decode("latin-1")
            stack += [x for x in reversed(inner)]
    except ValueError as e:
        return tracks, brand, str(e)
    return tracks, brand, "no movie" if not tracks else "fragments are not decoded" if fragments else "ok"


def fill(track: Track, view: memoryview, start: int, end: int) -> None:
    for kind, a, b in boxes(view, start, end):
        if kind in CONTAINERS:
            fill(track, view, a, b)
            continue
        if kind not in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64", b"stss"):
            continue
        if b - a < 8:
            raise ValueError(f"box {kind!r} is cut")
        long, n = view[a] == 1, int.from_bytes(view[a + 4 : a + 8], "big")
        if kind == b"mdhd":
            track.timescale, track.duration = struct.unpack_from(">IQ" if long else ">II", view, a + (20 if long else 12))
        elif kind == b"hdlr":
            track.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd" and n:
            track.codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stts":
            track.times = list(map(tuple, numbers(view, a + 8, 2 * n, b).reshape(-1, 2).tolist()))
        elif kind == b"stsc":
            track.chunks = list(map(tuple, numbers(view, a + 8, 3 * n, b).reshape(-1, 3).tolist()))
        elif kind == b"stsz":
            count = int.from_bytes(view[a + 8 : a + 12], "big")
            track.sizes = np.full(count, n, np.int64) if n else numbers(view, a + 12, count, b)
        elif kind == b"stz2":
            count = int.from_bytes(view[a + 8 : a + 12], "big")
            track.sizes = compact_sizes(view, a + 12, n & 255, count, b)
        elif kind == b"stss":
            track.keys = numbers(view, a + 8, n, b)
        else:
            track.chunk_offsets = numbers(view, a + 8, n, b, ">u4" if kind == b"stco" else ">u8")


def compact_sizes(view: memoryview, at: int, bits: int, count: int, end: int) -> np.ndarray:
    """Sample sizes of 4, 8 or 16 bits; of two in a byte the high one comes first."""
    if bits not in (4, 8, 16):
        raise ValueError(f"sample sizes of {bits} bits")
    if bits == 4:
        pairs = numbers(view, at, (count + 1) // 2, end, "u1")
        return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:count]
    return numbers(view, at, count, end, "u1" if bits == 8 else ">u2")


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return (struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24), *parts)


def write_track(payload: bytes) -> bytes:
    """A file with one sound track of 8-bit samples ("raw ", 8000 Hz), 64 to a sample entry; the payload is a multiple of 64 bytes."""
    n = len(payload) // SAMPLE
    chunks = -(-n // PER_CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    spread = [(1, min(n, PER_CHUNK), 1)] + ([(chunks, n - (chunks - 1) * PER_CHUNK, 1)] if n % PER_CHUNK and chunks > 1 else [])
    wide = len(payload) >= (1 << 32) - (1 << 20)

    def movie(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * SAMPLE * PER_CHUNK
        table = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, SAMPLE)), full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(spread)), *(struct.pack(">III", *x) for x in spread)), full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, n * SAMPLE, 0x55C4, 0), version=1), full(b"hdlr", struct.pack(">I4s12xB", 0, b"soun", 0)), box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url "))), table))
        head = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, n * SAMPLE, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1)
        track = full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, n * SAMPLE, 0, 0, 0x100, 0), matrix, bytes(8), version=1)
        return box(b"moov", head, box(b"trak", track, media))

    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    data = box(b"mdat", payload)
    base = len(brand) + len(movie(0)) + len(data) - len(payload)
    return brand + movie(base) + data


def samples(media: bytes, track: Track) -> bytes:
    """The payload that the sample table points to; neighbouring chunks are read at once."""
    starts = track.offsets()
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != starts[:-1] + track.sizes[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    return b"".join(media[starts[i] : starts[j] + track.sizes[j]] for i, j in zip(first.tolist(), last.tolist(), strict=True))


TRACKS = "status string, brand string, tracks array<struct<handler:string,codec:string,timescale:long,duration:long,n_samples:long,key_ranges:array<struct<start:long,end:long>>>>"


def media_columns(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key``, status, brand and tracks of a binary column."""
    prepare(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    to = to_arrow_type(StructType.fromDDL(TRACKS)["tracks"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, content):
            found = [([], None, "null") if x is None else walk(x) for x in batch.column(content).to_pylist()]
            tracks, status = [], []
            for own, _, said in found:
                ranges = [safe_ranges(t) for t in own]
                tracks.append([{"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "key_ranges": [{"start": a, "end": b} for a, b in r or []]} for t, r in zip(own, ranges, strict=True)])
                status.append("sample tables contradict each other" if said == "ok" and None in ranges else said)
            yield pa.record_batch({key: batch.column(key), "status": pa.array(status, pa.string()), "brand": pa.array([x[1] for x in found], pa.string()), "tracks": pa.array(tracks, to)})

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, {TRACKS}")


def safe_ranges(track: Track) -> list[tuple[int, int]] | None:
    """Byte ranges of the key frames; None where the tables contradict each other."""
    try:
        return track.key_ranges()
    except (ValueError, IndexError):
        return None


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(text: str | None) -> tuple:
    raw = (text or "").encode()
    media = write_track(raw + bytes(-len(raw) % SAMPLE or (0 if raw else SAMPLE)))
    (track,), _, status = walk(media)
    payload, ranges = samples(media, track), track.key_ranges()
    seconds = track.duration / track.timescale
    kept = zlib.crc32(np.array(ranges, ">u8").tobytes())
    feature = f"codec={track.codec.strip()};duration={seconds:.6f};samples={len(track.sizes)};keys={len(ranges)};first={ranges[0][0]}-{ranges[0][1]};ranges={kept:08x};status={status}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def text_media_features(docs: DataFrame) -> DataFrame:
    """Each text stored as a media file's samples, read back through its sample table, with the file's columns."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(zip(*map(features, batch.column("text").to_pylist()), strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | {n: pa.array(x, k) for n, x, k in zip(names, rows, kinds, strict=True)})

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)
