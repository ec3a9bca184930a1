"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings is fitted on a bounded sample of labelled rows. For
every labelled text that names a group, copies with the identity term swapped for each other term of its kind are
made, and squared differences between the two logits are part of the loss, so that naming a group does not move a score.

Null and empty texts get the model's base rate. Rows may repeat and get equal scores; a doc_id with several labels
counts as toxic if half of them say so; other columns are ignored; an empty table gives an empty result, and without
labels every score is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from writlake.llm.common import Scratch, prepare, ranges, slices, split_words

#: Identity terms by kind; a swap stays within a kind and a grammatical number.
IDENTITY_TERMS = (
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "african", "arab", "latino", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("muslime", "juden", "christen"),
    ("femmes", "hommes"),
    ("musulmans", "juifs", "chrétiens"),
    ("mujeres", "hombres"),
    ("musulmanes", "judíos", "cristianos"),
)
PREFIXES = (3, 4, 5, 6)
STRIP = " \t\r\n.,;:!?\"'()[]{}<>«»“”‘’…-–—_*/\\|#"


def word_features(word: str) -> list[str]:
    """A word without outer punctuation, and its beginnings."""
    word = word.strip(STRIP).lower()
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)] if word else []


def text_words(text: str | None) -> set[str]:
    return {x.strip(STRIP).lower() for x in (text or "").split()} - {""}


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def logit(self, words: Iterable[str]) -> float:
        return self.bias + sum(self.weights.get(x, 0.0) for x in {y for w in words for y in word_features(w)})


def counterfactuals(words: set[str]) -> list[set[str]]:
    """The word set with one identity term swapped, for every term in it and every other term of its kind."""
    return [words - {x} | {y} for kind in IDENTITY_TERMS for x in kind if x in words for y in kind if y not in words]


def train(labels: np.ndarray, rows: list[np.ndarray], swaps: list[list[np.ndarray]], features: int, fairness: float = 1.0, ridge: float = 0.02, steps: int = 250) -> tuple[float, np.ndarray]:
    """Bias and weights from each text's label, its features' places, and those of its swapped copies."""

    def matrix(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(some)), [len(c) for c in some]), np.concatenate([*some, np.zeros(0, np.int64)]).astype(np.int64)

    n, y = len(rows), np.asarray(labels, float)
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    origin = np.array([i for i, x in enumerate(swaps) for _ in x], np.int64)
    (r, c), (r2, c2), m = matrix(rows), matrix([z for x in swaps for z in x]), len(origin)
    w, b = np.zeros(features), float(np.log(rate / (1 - rate)))
    # Adam on the mean log loss, the mean squared change of the logit under swaps, and a ridge.
    moment, square = np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(r, w[c], n)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(c, e[r], features) + ridge * w / n
        if m:
            d = fairness * 2 * (z[origin] - b - np.bincount(r2, w[c2], m)) / m
            g += np.bincount(c, np.bincount(origin, d, n)[r], features) - np.bincount(c2, d[r2], features)
        g = np.append(g, e.sum())
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = 0.15 * moment / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return float(b), w


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task's piece hold a feature, and how many of them are toxic."""
    for batch in slices(batches, most=2 << 20):
        seen, toxic = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = {f for w in text_words(text) for f in word_features(w)}
            seen.update(own)
            if label:
                toxic.update(own)
        yield pa.record_batch({"feature": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64()), "toxic": pa.array([toxic[f] for f in seen], pa.int64())})


def design(places):
    """Of each text the label, its chosen features' places, and those of each copy with a term swapped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = places.value
        at = lambda words: sorted({index[f] for w in words for f in word_features(w) if f in index})
        for batch in slices(batches):
            words = list(map(text_words, batch.column("text").to_pylist()))
            lists = pa.list_(pa.int32())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "own": pa.array(list(map(at, words)), lists), "swapped": pa.array([list(map(at, counterfactuals(x))) for x in words], pa.list_(lists))})

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, modulus: int, rest: int, most: int) -> DataFrame:
    """At most ``most`` labelled ids, those of the smallest hashes, outside the held-out ids, with a text of each."""
    ids = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != rest)
    ids = ids.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, most: int = 16_000, fairness: float = 1.0, least: int = 5, evidence: float = 3.0) -> Model:
    """Train on at most ``most`` labelled rows. Features are those in ``least`` of them whose label rate departs by ``evidence`` deviations, and the identity terms'."""
    spark = docs.sparkSession
    prepare(spark)
    sample = Scratch(spark, "toxicity").keep(labelled_sample(docs, labels, modulus, rest, most), "sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return Model()
    rate = toxic / n
    counts = sample.select("text", "toxic").mapInArrow(count_features, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = counts.where((F.col("n") >= least) & (F.abs(F.col("toxic") - F.col("n") * rate) >= evidence * F.sqrt(F.col("n") * rate * (1 - rate) + 0.25)))
    identity = {f for kind in IDENTITY_TERMS for x in kind for f in word_features(x)}
    names = sorted(identity | {x.feature for x in counts.select("feature").toLocalIterator()})
    places = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    rows = sample.mapInArrow(design(places), "doc_id long, toxic int, own array<int>, swapped array<array<int>>").orderBy("doc_id").toArrow()
    own = [np.array(x, np.int64) for x in rows.column("own").to_pylist()]
    swapped = [[np.array(y, np.int64) for y in x] for x in rows.column("swapped").to_pylist()]
    bias, w = train(rows.column("toxic").to_numpy(), own, swapped, len(names), fairness)
    return Model(bias, {f: float(w[i]) for i, f in enumerate(names) if abs(w[i]) > 1e-3})


def score_texts(texts: pa.Array, bias: float, weights: dict[str, int], values: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1; ``weights`` gives a feature's place in ``values``."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    lists = [[weights[f] for f in word_features(x) if f in weights] for x in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((y for x in lists for y in x), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(counts)), counts)
    hit = sizes[codes] > 0
    codes, row = codes[hit], row[hit]
    pairs = np.unique(np.repeat(row, sizes[codes]) * max(len(values), 1) + flat[ranges(starts[codes], sizes[codes])])
    z = bias + np.bincount(pairs // max(len(values), 1), values[pairs % max(len(values), 1)] if len(pairs) else None, len(counts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1 of their ``text``; a column of that name is replaced."""
    spark = docs.sparkSession
    prepare(spark)
    names = sorted(model.weights)
    known = spark.sparkContext.broadcast((model.bias, {f: i for i, f in enumerate(names)}, np.array([model.weights[f] for f in names])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = score_texts(batch.column("text"), *known.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, column])

    docs = docs.drop(column)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
