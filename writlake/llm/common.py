"""Shared pieces of the training-data operators: scratch tables, word tokens, token-id caches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Long texts must not come to a worker by ten thousand at a time.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII white space of the word rule: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> str:
    """Return the shared scratch folder of the session, and let Python workers import this package.

    The folder is ``spark.checkpoint.dir``; only where that is unset and all runs on this machine a local one is made.
    """
    env = spark.sparkContext.environment
    if spark.conf.get(BATCH_BYTES, None) is None:  # Spark's own bound is more than a worker's share of memory
        spark.conf.set(BATCH_BYTES, str(2 << 20))
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or own_folder()


@functools.cache
def own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="writlake-")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{prepare(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, tasks: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """Write the table (by at most so many tasks where its size is known, in folders by some columns) and read it."""
        path = f"{self.base}/{name}"
        (df.coalesce(max(tasks, 1)) if tasks is not None else df).write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that is read no more; the driver's collector then lets go of the shuffles behind it too."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


def plain(texts: pa.Array) -> pa.Array:
    """The texts without nulls, copied so that no kernel sees an array that starts inside a buffer."""
    return pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of each text (A-Z lower-cased, split at ASCII white space; null: none): all words, and each text's count."""
    texts = plain(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets]
    return words.filter(full), np.diff(ends)


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, never 0 (0 stands for the end of a text)."""
    h = xxhash.xxh3_64_intdigest
    out = np.fromiter((h(x.as_buffer()) if x.is_valid else 0 for x in values.cast(pa.large_binary())), np.uint64, len(values))
    out[out == 0] = 1
    return out


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, hashes by code, and each text's word count."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), hash_strings(coded.dictionary), counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, for rows that hold a whole block."""
    raw = b"".join(len(x).to_bytes(8, "little") + x.dtype.str.encode().ljust(8) + x.tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(raw[at + 8 : at + 16].decode().strip())
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def delta(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, byte planes apart, which compress."""
    d = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).reshape(-1)


def undelta(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def trim() -> None:
    """Give memory that is free back to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut and join record batches so that a piece holds about ``most`` bytes of the column, one row at least."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + most, "right")))
            own = int(ends[stop - 1] - floor)
            if held and size + own > most:
                yield joined()
                held, size = [], 0
            held.append(batch.slice(start, stop - start))
            size, start = size + own, stop
    if held:
        yield joined()
    held.clear()
    trim()


#: The patterns by which the two public vocabularies cut a text before their merges.
PRETOKENS = {
    "space": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+",
}


#: Marks that are a pre-token of their own behind letters.
END_MARKS = frozenset(".,;:!?")

#: Marks a text's first piece; a text that holds it is one piece as a whole.
FIRST = "\ufdd0\ufdd1\ufdd0"


class TokenIds:
    """Token ids of texts by a ``tokenizers`` file, remembering pieces between places where its pre-tokenizer always cuts.

    The library's own pre-tokenizing is the costly part, so new pieces are cut by the same pattern and given to its model.
    ``boundary`` is "word" (white space is dropped by the vocabulary) or "space" (a space starts the next piece).
    The memory of pieces is bounded by ``most`` and emptied when full; ids are the library's own.
    """

    def __init__(self, path: str, boundary: str, most: int = 350_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.boundary, self.most = Tokenizer.from_file(path), boundary, most
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(PRETOKENS[boundary])
        plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in plain_bytes]
        self.table = {x: x for x in plain_bytes} | {x: 256 + i for i, x in enumerate(rest)}
        self.letters = np.array([self.table[x] for x in range(256)], "<u4")
        # No text has byte 255. Where no longer token has it and words' ends are not marked, it can part words in one call of the model.
        model, bar = self.tokenizer.model, chr(self.table[255])
        self.bar = model.token_to_id(bar)
        self.joins = self.bar is not None and not model.end_of_word_suffix and not model.continuing_subword_prefix and not any(bar in x for x in self.tokenizer.get_vocab(False) if len(x) > 1)
        self.bare = Tokenizer(model)
        if not self.joins:
            self.bare.pre_tokenizer = WhitespaceSplit()
            self.letters[255] = ord(" ")
            vocabulary, end = self.tokenizer.get_vocab(False), model.end_of_word_suffix
            self.lasts = np.zeros(max(vocabulary.values()) + 1, bool)
            self.lasts[[i for x, i in vocabulary.items() if end and x.endswith(end)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def normalized(self, pieces: list[str]) -> list[str]:
        """The pieces by the library's normalizer, those that are not ASCII in one call with a mark between them that it leaves alone."""
        odd = [i for i, x in enumerate(pieces) if not x.isascii()]
        whole = self.tokenizer.normalizer.normalize_str("\x01".join(pieces[i] for i in odd)).split("\x01") if odd else []
        if len(whole) != len(odd) or any("\x01" in pieces[i] for i in odd):
            whole = [self.tokenizer.normalizer.normalize_str(pieces[i]) for i in odd]
        out = list(pieces)
        for i, x in zip(odd, whole, strict=True):
            out[i] = x
        return out

    def encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the pieces, and each one's count."""
        names: dict[str, int] = {}
        which, counts = [], np.zeros(len(new), np.int64)
        if self.boundary == "word":
            new = self.normalized(new)
        for i, piece in enumerate(new):
            lead = ""
            if self.boundary == "space":
                lead, piece = ("", piece[len(FIRST) :]) if piece.startswith(FIRST) else (" ", piece)
            if piece.isalpha():
                which.append(names.setdefault(lead + piece, len(names)))
                counts[i] = 1
            elif piece[-1:] in END_MARKS and piece[:-1].isalpha():  # the commonest other kind
                which += (names.setdefault(lead + piece[:-1], len(names)), names.setdefault(piece[-1], len(names)))
                counts[i] = 2
            else:
                parts = self.pattern.findall(lead + piece)
                which += [names.setdefault(x, len(names)) for x in parts]
                counts[i] = len(parts)
        own, rows = list(names), []
        for i in range(0, len(own), 500):
            raw = b"\xff".join(map(str.encode, own[i : i + 500])) + b"\xff"
            rows.append(self.letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le"))
        place = np.array(which, np.int64)
        if not self.joins:  # a space parts the words, and a word's last id is one that ends words
            flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for i, x in enumerate(self.bare.encode_batch_fast(rows, add_special_tokens=False)):
                n = min(len(own) - i * 500, 500)
                ids = np.array(x.ids, np.int32)
                ends = np.flatnonzero(self.lasts[ids])
                if len(ends) == n and ends[-1] == len(ids) - 1:
                    sizes.append(np.diff(ends, prepend=-1))
                else:  # a vocabulary without such ids: each id's own word, which the slower call tells
                    words = self.bare.encode(rows[i], add_special_tokens=False).word_ids
                    sizes.append(np.bincount(np.array(words, np.int64), minlength=n))
                flat.append(ids)
            flat, sizes = np.concatenate(flat), np.concatenate(sizes)
            return flat[ranges((np.cumsum(sizes) - sizes)[place], sizes[place])], segment_sums(sizes[place], counts)
        flat = np.concatenate([np.zeros(0, np.int32), *(np.array(x.ids, np.int32) for x in self.bare.encode_batch_fast(rows, add_special_tokens=False))])
        ends = np.flatnonzero(flat == self.bar)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(ends)]
        sizes = (ends - starts)[place]
        return flat[ranges(starts[place], sizes)], segment_sums(sizes, counts)

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        texts = plain(texts)
        if self.boundary == "word":
            return split_words(texts)
        # A cut before a lone space between two other characters; other white space stays inside a piece.
        odd = pc.match_substring_regex(texts, r"[\s\p{Z}\x{1c}-\x{1f}\x{85}] | [\s\p{Z}\x{1c}-\x{1f}\x{85}]").to_numpy(zero_copy_only=False)
        marked = pc.match_substring(texts, FIRST).to_numpy(zero_copy_only=False)
        if (odd | marked).any():
            cut, lists = re.compile(r"(?<=\S)(?= \S)"), []
            for text, strange, whole in zip(texts.to_pylist(), odd, marked, strict=True):
                if whole:
                    lists.append([FIRST + text])
                    continue
                parts = cut.split(text) if strange else text.split(" ")
                lists.append([FIRST + parts[0], *(x[1:] for x in parts[1:])] if strange else [FIRST + parts[0], *parts[1:]])
            return pa.array([x for y in lists for x in y], pa.large_string()), np.array([len(x) for x in lists])
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        # A piece's leading space is not written out: names of known pieces lack it, and a text's first piece, which has none, is marked.
        first = (offsets - offsets[0])[:-1]
        values = pc.replace_with_mask(values, self.mask(len(values), first), pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), values.take(pa.array(first)), pa.scalar("", pa.large_string())))
        return values, np.diff(offsets)

    @staticmethod
    def mask(n: int, places: np.ndarray) -> pa.Array:
        out = np.zeros(n, bool)
        out[places] = True
        return pa.array(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) and each text's count; null and empty texts have none."""
        pieces, counts = self.pieces(texts)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) + len(names) > self.most:
            self.clear()
        place = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = [names[i] for i in fresh.tolist()]
            place[fresh] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, place[fresh].tolist(), strict=True))
            got, size = self.encode_new(new)
            self.ids = np.concatenate([self.ids, got])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        place = place[coded.indices.to_numpy()]
        starts, sizes = self.ends[place], np.diff(self.ends)[place]
        out = self.ids[ranges(starts, sizes)]
        return out, segment_sums(sizes, counts)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, ... for each pair."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, np.int64)
    return np.arange(total) + shift


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (0 for empty runs)."""
    ends = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(counts)
    return (ends[stops] - ends[stops - counts]).astype(np.int64)


_tokenizers: dict[tuple[str, str, int], TokenIds] = {}


def token_ids(path: str, boundary: str, most: int = 350_000) -> TokenIds:
    """The worker's own tokenizer, loaded once."""
    if (path, boundary, most) not in _tokenizers:
        _tokenizers[path, boundary, most] = TokenIds(path, boundary, most)
    return _tokenizers[path, boundary, most]


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out_column(key: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the key's text leaves ``rest``; false for null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == rest, F.lit(False))
