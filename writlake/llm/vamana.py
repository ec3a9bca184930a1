"""Approximate nearest neighbours by robust-pruned directed graphs.

Equal vectors are one node. Nodes are dealt to shards of a bounded size; each shard's graph is built by inserting batches:
a greedy beam search from the medoid proposes neighbours, relaxed pruning (drop c where alpha * d(kept, c) <= d(node, c)) keeps
diverse ones, edges are mirrored and overfull lists pruned again. Blocks of queries beam-search every shard, and what
is found is measured again in double precision on the original vectors.

Null vectors, empty or zero ones, and those with null or non-finite components take no part, nor do null ids; vectors are
compared within one length; ties go to the smaller id; a repeated (id, vector) row is a candidate once for each distinct id; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from writlake.llm.common import Scratch, prepare


def beam_search(queries: np.ndarray, points: np.ndarray, graph: np.ndarray, start: int, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Lanes search together, each opening its ``at_once`` nearest unopened nodes in a step: ids (-1: none) and squared distances of the ``width`` nearest found, nearest first."""
    m = len(queries)
    ids = np.full((m, width), -1, np.int64)
    far = np.full((m, width), np.inf, np.float32)
    open_ = np.zeros((m, width), bool)
    seen = np.zeros((m, len(points)), bool)
    ids[:, 0], far[:, 0], open_[:, 0], seen[:, start] = start, 2 - 2 * queries @ points[start], True, True
    lanes = np.arange(m)
    while len(lanes):
        lanes = lanes[open_[lanes].any(1)]
        if not len(lanes):
            break
        row = np.arange(len(lanes))[:, None]
        at = np.argsort(~open_[lanes], 1, kind="stable")[:, :at_once]
        go = open_[lanes[:, None], at]
        open_[lanes[:, None], at] = False
        near = graph[np.where(go, ids[lanes[:, None], at], 0)]
        near[~go] = -1
        for k in range(near.shape[1]):
            some = near[:, k]
            some[seen[lanes[:, None], np.maximum(some, 0)]] = -1
            lane, col = np.nonzero(some >= 0)
            seen[lanes[lane], some[lane, col]] = True
        near = near.reshape(len(lanes), -1)
        # New nodes to the front, and as many columns as the lane with the most needs.
        order = np.argsort(near < 0, 1, kind="stable")[:, : max(int((near >= 0).sum(1).max()), 1)]
        near = near[row, order]
        new = near >= 0
        d = 2 - 2 * np.matmul(points[np.maximum(near, 0)], queries[lanes][:, :, None])[:, :, 0]
        d[~new] = np.inf
        all_d = np.concatenate([far[lanes], d], 1)
        best = np.argsort(all_d, 1, kind="stable")[:, :width]
        far[lanes] = all_d[row, best]
        ids[lanes] = np.where(np.isinf(far[lanes]), -1, np.concatenate([ids[lanes], near], 1)[row, best])
        open_[lanes] = np.concatenate([open_[lanes], new], 1)[row, best] & ~np.isinf(far[lanes])
    return ids, far


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each node the kept candidates, nearest first (-1: none)."""
    own = points[nodes]
    near = points[np.maximum(candidates, 0)]
    d = 2 - 2 * np.matmul(near, own[:, :, None])[:, :, 0]
    d[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
    order = np.argsort(d, 1, kind="stable")
    row = np.arange(len(nodes))[:, None]
    candidates, d, near = candidates[row, order], d[row, order], near[row, order]
    between = 2 - 2 * np.matmul(near, near.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, np.int64)
    alive, lane = ~np.isinf(d), np.arange(len(nodes))
    # The same candidate may stand twice; the second is at distance 0 of the first, and dropped with it.
    for k in range(degree):
        pick = np.argmax(alive, 1)
        some = alive[lane, pick]
        if not some.any():
            break
        out[some, k] = candidates[lane, pick][some]
        alive &= alpha * np.maximum(between[lane, pick], 0) > d
        alive[lane, pick] = False
    return out


def build(points: np.ndarray, degree: int, width: int, alpha: float, batch: int = 512) -> tuple[np.ndarray, int]:
    """Graph (nodes x degree, -1: no edge) and start of unit vectors."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int64)
    start = int(np.argmax(points @ points.mean(0))) if n else 0
    order = np.random.default_rng(1).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        nodes = order[at : at + size]
        found, _ = beam_search(points[nodes], points, graph, start, width)
        graph[nodes] = robust_prune(points, nodes, found, alpha, degree)
        source, target = np.repeat(nodes, degree), graph[nodes].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.lexsort(((points[source] * points[target]).sum(1) * -1, target))
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        most = int(min(count.max(initial=0), 2 * degree))
        extra = np.full((len(heads), most), -1, np.int64)
        ok = place < most  # candidates for edges into one node: the nearest of its batch
        extra[np.repeat(np.arange(len(heads)), count)[ok], place[ok]] = source[ok]
        for i in range(0, len(heads), batch):
            h = heads[i : i + batch]
            both = np.concatenate([graph[h], extra[i : i + batch]], 1)
            total = (both >= 0).sum(1)
            roomy = total <= degree
            packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)
            if both.shape[1] < degree:
                packed = np.pad(packed, ((0, 0), (0, degree - both.shape[1])), constant_values=-1)
            graph[h[roomy]] = packed[roomy][:, :degree]
            if (~roomy).any():
                graph[h[~roomy]] = robust_prune(points, h[~roomy], both[~roomy], alpha, degree)
        at += size
        size = min(2 * size, batch, max(1, n // 10))
    return graph, start


def usable(vectors: list, ids: list) -> list[tuple[bytes, int]]:
    out = []
    for v, i in zip(vectors, ids, strict=True):
        if i is None or not v or any(x is None for x in v):
            continue
        a = np.array(v, np.float64)
        if np.isfinite(a).all() and a.any() and np.isfinite(a @ a) and a @ a > 0:
            out.append(((a + 0.0).tobytes(), i))
    return out


NODES = "vector binary, ids array<long>"
SHARD = "dim int, shard int, vectors binary, ids array<array<long>>, graph binary, start int"


def nodes_of(k: int):
    """Distinct vectors of each batch with their smallest ids; more than k + 1 are never needed for k neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, set[int]] = {}
            for v, i in usable(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                groups.setdefault(v, set()).add(i)
            yield pa.record_batch({"vector": pa.array(list(groups), pa.binary()), "ids": pa.array([sorted(x)[: k + 1] for x in groups.values()], pa.list_(pa.int64()))})

    return run


def build_shard(degree: int, width: int, alpha: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.array(table.column("vector").to_pylist(), object), kind="stable")))
        vectors = np.stack([np.frombuffer(x) for x in table.column("vector").to_pylist()])
        unit = (vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))).astype(np.float32)
        graph, start = build(unit, degree, width, alpha)
        one = {"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "vectors": pa.array([vectors.tobytes()], pa.binary()), "ids": pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))}
        return pa.table(one | {"graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()), "start": pa.array([start], pa.int32())})

    return run


FOUND = "query_id long, vec_id long, score double"


def search(k: int, width: int):
    """Beam-search rows of (shard, block of queries); each gives a query's k best of that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row] for c in batch.schema.names}
                dim = x["dim"].as_py()
                vectors = np.frombuffer(x["vectors"].as_py()).reshape(-1, dim)
                norms = np.sqrt((vectors * vectors).sum(1))
                graph = np.frombuffer(x["graph"].as_py(), np.int32).reshape(len(vectors), -1).astype(np.int64)
                ids = x["ids"].as_py()
                unit = (vectors / norms[:, None]).astype(np.float32)
                names = x["query_ids"].as_py()
                queries = np.stack([np.frombuffer(v) for v in x["queries"].as_py()])
                q_norms = np.sqrt((queries * queries).sum(1))
                out = []
                for i in range(0, len(queries), 1024):
                    q, qn = queries[i : i + 1024], q_norms[i : i + 1024]
                    found, _ = beam_search((q / qn[:, None]).astype(np.float32), unit, graph, x["start"].as_py(), width)
                    score = (vectors[np.maximum(found, 0)] * q[:, None, :]).sum(2) / (norms[np.maximum(found, 0)] * qn[:, None])
                    for name, nodes, s in zip(names[i : i + 1024], found.tolist(), score.tolist(), strict=True):
                        some = [(-v, c) for node, v in zip(nodes, s, strict=True) if node >= 0 for c in ids[node] if c != name]
                        out += [(name, c, -v) for v, c in sorted(some)[:k]]
                yield pa.record_batch({n: pa.array([y[j] for y in out], t) for j, (n, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    return run


def nearest(df: DataFrame, every: int = 50, k: int = 5, shard_nodes: int = 20_000, degree: int = 32, width: int = 64, alpha: float = 1.2, search_width: int = 200, block: int = 16_384) -> DataFrame:
    """The k nearest found of each row of ``vec_id``, ``embedding`` whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "vamana")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    nodes = rows.mapInArrow(nodes_of(k), NODES).groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    nodes = scratch.keep(nodes.withColumn("dim", (F.length("vector") / 8).cast("int")), "nodes")
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_nodes).cast("int").alias("shards"))  # one row for each vector length
    dealt = nodes.join(sizes, "dim").withColumn("shard", F.expr("pmod(xxhash64(vector), shards)").cast("int")).drop("shards")
    # Shards are few and heavy: without a number of tasks of its own the plan would build several in one task.
    n_shards = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    index = scratch.keep(dealt.repartition(4 * n_shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build_shard(degree, width, alpha), SHARD), "index")
    wanted = rows.where(F.col("vec_id") % every == 0).mapInArrow(nodes_of(1 << 30), NODES)
    wanted = wanted.select(F.explode("ids").alias("query_id"), "vector").groupBy("query_id").agg(F.min("vector").alias("vector"))
    wanted = wanted.withColumns({"dim": (F.length("vector") / 8).cast("int"), "block": F.expr(f"query_id div {every} div {block}")})
    blocks = wanted.groupBy("dim", "block").agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("vector").alias("queries"))  # ``block`` rows at most
    pairs = blocks.join(sizes, "dim").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).drop("shards", "block")
    found = pairs.join(index, ["dim", "shard"]).repartition("dim", "shard").mapInArrow(search(k, search_width), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
