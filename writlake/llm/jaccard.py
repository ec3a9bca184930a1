"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Texts with equal sets are one class. Chunks of texts send their distinct n-grams to parts of the hash range, which count them
exactly and answer with the columns (n-grams) that are in two sets or more. Columns are ordered rare first; two sets that
link share one among the first n - ceil(t n) + 1 of each, so only those entries are multiplied, and n-grams of one set alone, which
most of them are, never leave their chunk. Pairs beyond the bounds that their sizes and a shared column's places give are
discarded. The other pairs are dealt to blocks (a row and some of its partners), which hold whole rows, and the block's product
accumulates the overlap counts that decide the links.

A class that meets thousands of others is not multiplied with each: rounds first join every class to a few partners of its
columns, and then only pairs of different components are left, of which all are tested. So no link between components is missed,
and no group of copies is expanded into pairs.

Nulls and texts without words have empty sets, link with nothing, and are their own component; fewer words than a shingle make
one shingle. Equal texts (also with equal ids) share a class; null ids never name a component that has another id; other columns are
ignored; an empty table gives an empty result. Shingles, sets and texts are compared by 64-bit hashes; the counts that order
the columns take 48 bits of them, where two n-grams that fall together only count as more frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from writlake.llm.common import WORD, Scratch, coded_words, delta, mix64, pack, prepare, segment_sums, slices, undelta, unpack

MOST_BROADCAST, PARTNERS, ROWS = 500_000, 6, 100_000
#: Text of a chunk, and of a part of the n-grams; both grow with the root of the input, so that what a chunk sends to a part stays about 1 KB.
CHUNK_BYTES, PIECE_BYTES = 3 << 20, 1000
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted hashes, one after another, and their counts."""
    codes, names, counts = coded_words(texts)
    h = np.append(names, np.uint64(0))[codes]
    stops = np.cumsum(counts)
    size = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), size)
    first = np.repeat(stops - counts, size) + (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))
    long = np.minimum(counts, words)[row]
    out = np.zeros(len(row), np.uint64)
    for i in range(words):
        some = np.flatnonzero(i < long)
        out[some] = mix64(out[some] * _A + h[first[some] + i])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.bincount(row[new], minlength=len(counts))


def set_keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    with np.errstate(over="ignore"):
        sums = segment_sums(mix64(grams ^ _C).view(np.int64), counts).view(np.uint64)
        return mix64(sums + counts.astype(np.uint64) * _A).view(np.int64)


INCIDENCE = "kind int, doc_id long, text_key long, cls long, n int, part int, chunk long, payload binary"
COUNTED = "kind int, part int, chunk long, payload binary"
ENTRIES = "gram long, cls long, n int, place int"


def row_of(kind: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of INCIDENCE rows with some of its columns."""
    kinds = {"doc_id": pa.int64(), "text_key": pa.int64(), "cls": pa.int64(), "n": pa.int32(), "part": pa.int32(), "chunk": pa.int64(), "payload": pa.binary()}
    return pa.record_batch({"kind": pa.array(np.full(size, kind, np.int32))} | {n: columns.get(n, pa.nulls(size, k)) for n, k in kinds.items()})


def incidence(words: int, parts: int, chunk_bytes: int):
    """A row for each text (kind 0); for each chunk, the sets that this task has not seen as places in the chunk's sorted n-grams (1), and those n-grams by part of the hash range (2)."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, seen = TaskContext.get().partitionId() << 24, np.zeros(0, np.int64)
        for batch in slices(batches, most=chunk_bytes):
            grams, counts = shingle_sets(batch.column("text"), words)
            keys = set_keys(grams, counts)
            yield row_of(0, len(keys), doc_id=batch.column("doc_id"), text_key=batch.column("text_key"), cls=pa.array(keys, mask=counts == 0), n=pa.array(counts.astype(np.int32)))
            new = np.zeros(len(keys), bool)
            new[np.unique(keys, return_index=True)[1]] = True
            new &= ~np.isin(keys, seen) & (counts > 0)
            if not new.any():
                continue
            seen = np.concatenate([seen, keys[new]])
            grams, keys, counts = grams[np.repeat(new, counts)], keys[new], counts[new]
            names, where, times = np.unique(grams, return_inverse=True, return_counts=True)
            yield row_of(1, 1, chunk=pa.array([chunk], pa.int64()), payload=pa.array([pack(keys, counts.astype(np.int32), np.array([len(names)]), planes(np.diff(where.astype(np.int32), prepend=np.int32(0))))], pa.binary()))
            edges = [0, *np.searchsorted(names, bounds).tolist(), len(names)]
            some = [i for i in range(parts) if edges[i] < edges[i + 1]]
            send = [pack(np.array([edges[i]]), delta(names[edges[i] : edges[i + 1]] >> np.uint64(16)), np.minimum(times[edges[i] : edges[i + 1]], 255).astype(np.uint8)) for i in some]
            yield row_of(2, len(some), part=pa.array(some, pa.int32()), chunk=pa.array([chunk] * len(some), pa.int64()), payload=pa.array(send, pa.binary()))
            chunk += 1

    return run


def planes(values: np.ndarray) -> np.ndarray:
    """32-bit numbers as byte planes, which compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).reshape(-1)


def unplanes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).reshape(-1).view(np.int32)


def count_part(table: pa.Table) -> pa.Table:
    """The part's columns, numbered; each chunk is told which of its n-grams are columns, their numbers and the levels (eight to a doubling) of their counts."""
    got = [unpack(x) for x in table.column("payload").to_pylist()]
    names = [undelta(x[1]) for x in got]
    _, where = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([x[2] for x in got]))
    level = np.where(total > 1, np.minimum(8 * np.log2(np.maximum(total, 1)), 255), 0).astype(np.uint8)
    out, at = [], 0
    for x, own in zip(got, names, strict=True):
        mine = where[at : at + len(own)]
        at += len(own)
        local = np.flatnonzero(level[mine])
        ids = mine[local]
        out.append(pack(x[0], planes(np.diff(local.astype(np.int32), prepend=np.int32(0))), planes(np.diff(ids.astype(np.int32), prepend=np.int32(0))), level[ids]))
    return pa.table({"kind": pa.array([3] * len(out), pa.int32()), "part": table.column("part"), "chunk": table.column("chunk"), "payload": pa.array(out, pa.binary())})


def first_entries(num: int, den: int):
    """The shared columns among the first entries of each set of a chunk, with their places in the order of columns; n-grams of one set alone come first."""

    def run(table: pa.Table) -> pa.Table:
        kind, payload, part = table.column("kind").to_pylist(), table.column("payload").to_pylist(), table.column("part").to_pylist()
        keys, counts, size, steps = unpack(payload[kind.index(1)])
        level, gram = np.zeros(int(size[0]), np.uint8), np.zeros(int(size[0]), np.int64)
        for k, x, p in zip(kind, payload, part, strict=True):
            if k == 3:
                base, local, ids, own = unpack(x)
                at = int(base[0]) + np.cumsum(unplanes(local), dtype=np.int64)
                level[at], gram[at] = own, (p << 32) + np.cumsum(unplanes(ids), dtype=np.int64)
        where = np.cumsum(unplanes(steps), dtype=np.int32)
        shared = level[where] > 0
        alone = counts - segment_sums(shared, counts)
        most = counts - (counts.astype(np.int64) * num + den - 1) // den + 1
        row = np.repeat(np.arange(len(counts)), counts)
        some = np.flatnonzero(shared & (alone < most)[row])
        row, where = row[some], where[some]
        order = np.lexsort((where, gram[where], level[where], row))
        row, where = row[order], where[order]
        first = np.searchsorted(row, row, "left")
        place = alone[row] + np.arange(len(row)) - first
        keep = place < most[row]
        row, where, place = row[keep], where[keep], place[keep]
        return pa.table({"gram": pa.array(gram[where]), "cls": pa.array(keys[row]), "n": pa.array(counts[row].astype(np.int32)), "place": pa.array(place.astype(np.int32))})

    return run


def set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            grams, counts = shingle_sets(batch.column("text"), words)
            raw, ends = grams.tobytes(), np.cumsum(counts) * 8
            yield pa.record_batch({"cls": pa.array(set_keys(grams, counts)), "grams": pa.array([raw[e - 8 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())})

    return run


def block_product(num: int, den: int):
    """A block's one row times its other rows: overlap counts in one pass, and the links among them."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        rows = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        cls = table.column("cls").to_numpy()
        hub = int(np.flatnonzero(kind == 0)[0])
        others = np.flatnonzero(kind == 1)
        sizes = np.array([len(rows[i]) for i in others], np.int64)
        flat = np.concatenate([rows[i] for i in others]) if len(others) else np.zeros(0, np.uint64)
        at = np.searchsorted(rows[hub], flat)
        hits = rows[hub][np.minimum(at, len(rows[hub]) - 1)] == flat
        overlap = segment_sums(hits, sizes)
        linked = overlap * (den + num) >= num * (sizes + len(rows[hub]))
        return pa.table({"a": pa.array(np.full(int(linked.sum()), cls[hub])), "b": pa.array(cls[others[linked]])})

    return run


def size_bound(num: int, den: int) -> Column:
    return F.least("n", "n2") * den >= F.greatest("n", "n2") * num


def may_link(num: int, den: int) -> Column:
    """Bounds on a pair from sizes and from the places of a shared column."""
    sizes = size_bound(num, den)
    rest = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    return sizes & (rest.cast("long") * (den + num) >= (F.col("n") + F.col("n2")).cast("long") * num)


def components(links: DataFrame, scratch: Scratch, name: str, tasks: int) -> DataFrame:
    """node, comp (the smallest node reachable) of the nodes of links a, b: smallest labels of neighbours, and labels of labels."""
    both = scratch.keep(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), f"{name}-both", tasks)
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp"))
    step = 0
    while True:
        labels = scratch.keep(labels, f"{name}-{step}", tasks)
        near = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        moved = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("c"))
        after = scratch.keep(moved.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("c", "comp")).alias("comp")), f"{name}-{step}-next", tasks)
        if not after.where("old != comp").limit(1).count():
            return after.select("node", "comp")
        labels, step = after.select("node", "comp"), step + 1


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links among pairs x, hub: blocks of one hub and about 500 others, dealt by hash where a hub has more."""
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / 500).cast("int").alias("salts"))
    dealt = pairs.join(salts, "hub").withColumn("salt", F.expr("pmod(xxhash64(x), salts)").cast("int"))
    others = dealt.select("hub", "salt", F.col("x").alias("cls")).join(sets, "cls").withColumn("kind", F.lit(1))
    hubs = dealt.select("hub", "salt").distinct().withColumn("cls", F.col("hub")).join(sets, "cls").withColumn("kind", F.lit(0))
    return others.unionByName(hubs).groupBy("hub", "salt").applyInArrow(block_product(num, den), "a long, b long")


def similar_classes(docs: DataFrame, words: int, num: int, den: int, scratch: Scratch, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Texts with their class, and the component of every class that has a link."""
    spark: SparkSession = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunk_bytes = max(CHUNK_BYTES, int((size * PIECE_BYTES) ** 0.5))
    parts = int(size // chunk_bytes) + 1
    kept = scratch.keep(keyed.mapInArrow(incidence(words, parts, chunk_bytes), INCIDENCE), "incidence")
    counted = scratch.keep(kept.where("kind = 2").select("kind", "part", "chunk", "payload").groupBy("part").applyInArrow(count_part, COUNTED), "counted")
    sent = kept.where("kind = 1").select("kind", "part", "chunk", "payload").unionByName(counted)
    entries = scratch.keep(sent.groupBy("chunk").applyInArrow(first_entries(num, den), ENTRIES), "entries")
    texts = scratch.keep(kept.where("kind = 0").select("doc_id", "text_key", "cls", "n"), "texts")
    scratch.drop("counted")
    scratch.drop("incidence")
    columns = entries.groupBy("gram").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("gram")
    members = scratch.keep(entries.join(columns, "gram").distinct(), "members")
    scratch.drop("entries")
    width = members.count() // ROWS + 1
    reps = scratch.keep(texts.where("cls is not null").groupBy("cls").agg(F.min("text_key").alias("text_key")), "reps")

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        """The sets of the classes of some pairs, from one text of each."""
        need = scratch.keep(pairs.select(F.col("x").alias("cls")).unionByName(pairs.select(F.col("hub").alias("cls"))).distinct().join(reps, "cls").select("text_key"), f"{name}-need", width)
        many = need.count()
        keys = F.broadcast(need) if many <= MOST_BROADCAST else need
        wanted = keyed.select("text", "text_key").join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
        return scratch.keep(wanted.select("text").mapInArrow(set_rows(words), "cls long, grams binary"), name, many // 1000 + 1)

    comps = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("comp"))
    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    last = False
    for i in range(rounds + 1):
        last = last or i == rounds
        placed = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        mixed = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("gram")
        placed = scratch.keep(placed.join(mixed, "gram"), f"placed-{i}", width)
        if not last:
            # Every class with a few partners: of the columns' chosen members, those it shares the most columns with.
            chosen = placed.groupBy("gram").agg(F.min_by(F.struct(F.col("cls").alias("hub"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("comp").alias("comp2")), F.struct(F.expr(f"place + pmod(xxhash64(gram, {i}, cls), {1 + 4 * i})"), F.xxhash64("gram", "cls"))).alias("h"))
            met = placed.join(chosen.select("gram", "h.*"), "gram").where("comp != comp2").where(may_link(num, den))
            met = met.groupBy("cls", "hub").agg(F.count("*").alias("shared"))
            best = Window.partitionBy("cls").orderBy(F.desc("shared"), "hub")  # a class meets one partner a column at most
            pairs = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PARTNERS).select(F.col("cls").alias("x"), "hub")
        else:
            # All pairs that are left: one of the two is outside the column's largest component.
            sizes = placed.groupBy("gram", "comp").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"))
            placed = placed.join(sizes, "gram")
            strays = placed.where("comp != major").select("gram", F.col("cls").alias("hub"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("comp").alias("comp2"))
            met = placed.join(strays, "gram").where("comp != comp2 and (comp = major or cls < hub)").where(may_link(num, den))
            pairs = met.select(F.least("cls", "hub").alias("x"), F.greatest("cls", "hub").alias("hub")).distinct()
        pairs = scratch.keep(pairs, f"pairs-{i}", None if last else width)
        tested = pairs.count()
        scratch.drop(f"placed-{i}")
        found = scratch.keep(verified(pairs, sets_of(pairs, f"sets-{i}"), num, den), f"links-{i}", tested // 2000 + 1)
        scratch.drop(f"sets-{i}")
        linked = found.count()
        if linked:
            links = links.unionByName(found)
            comps = components(links, scratch, f"components-{i}", max(width, links.count() // ROWS + 1))
        if last:
            break
        last = linked * 50 < tested
    return texts, comps


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of every row: texts link when den * intersection >= num * union."""
    prepare(docs.sparkSession)
    texts, comps = similar_classes(docs, words, num, den, Scratch(docs.sparkSession, "jaccard"))
    classes = texts.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    names = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "comp").select("cls", "component_id", "comp")
    out = texts.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_key", "comp")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows without near duplicates: of each component the row of the smallest id stays, and every row without words."""
    found = near_duplicates(docs, words, num, den)
    first = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k"))
    stay = first.select(F.coalesce("k.doc_id", F.lit(0)).alias("__id"), F.col("k.none").alias("__none"), F.col("k.text_key").alias("__text"))
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__text": F.xxhash64(F.coalesce("text", F.lit("")))})
    empty = F.col("text").isNull() | ~F.col("text").rlike(WORD)
    kept = keyed.where(~empty).join(stay, ["__id", "__none", "__text"], "left_semi").dropDuplicates(["__id", "__none", "__text"])
    return kept.unionByName(keyed.where(empty)).select(*docs.columns)
