"""Nearest neighbours by inner product with a hierarchical k-means tree, searched best bin first.

The tree is fitted in numpy on a bounded sample and every vector goes down to a leaf. A query walks the tree through a
priority queue that always opens the most promising node, and visits so many leaves as calibration asks for: the
true neighbours of some queries are found by a search of all leaves, and the visits are widened until the wanted share
of them is reached. Blocks of queries meet blocks of a leaf's vectors in one matrix product in double precision.

Equal vectors are one entry of the index with its smallest ids, so many copies of one vector cost no more than one.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import read_table, scratch_table

BLOCK = 2048


class KMeansTree:
    """Nodes as arrays: centre, children (empty for a leaf), leaf number."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = 4, rounds: int = 8, seed: int = 0):
        self.centres, self.children, self.leaf, self.leaves = [], [], [], 0
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float64)
        waiting = [(-len(sample), 0, np.arange(len(sample)))]
        self._node(sample.mean(axis=0) if len(sample) else np.zeros(0))
        count = 1
        # the largest leaf is split next, until there are enough
        while waiting and count < leaves:
            _, node, rows = heapq.heappop(waiting)
            parts = self._split(sample[rows], min(branch, leaves - count + 1), rounds, rng)
            if len(parts) < 2:
                continue
            count += len(parts) - 1
            for part in parts:
                child = self._node(sample[rows[part]].mean(axis=0))
                self.children[node].append(child)
                heapq.heappush(waiting, (-len(part), child, rows[part]))
        self.centres = np.array(self.centres)
        for node, below in enumerate(self.children):
            if not below:
                self.leaf[node] = self.leaves
                self.leaves += 1

    def _node(self, centre):
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    @staticmethod
    def _split(x, k, rounds, rng):
        if len(x) < 2:
            return []
        centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            own = ((centre ** 2).sum(axis=1)[None] - 2 * x @ centre.T).argmin(axis=1)
            centre = np.stack([x[own == i].mean(axis=0) for i in range(len(centre)) if (own == i).any()])
        own = ((centre ** 2).sum(axis=1)[None] - 2 * x @ centre.T).argmin(axis=1)
        return [p for i in range(len(centre)) if len(p := np.flatnonzero(own == i))]

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: down to the nearest child each time."""
        node = np.zeros(len(x), np.int64)
        out = np.full(len(x), -1, np.int64)
        while (out < 0).any():
            for n in np.unique(node[out < 0]):
                rows = np.flatnonzero((node == n) & (out < 0))
                if not self.children[n]:
                    out[rows] = self.leaf[n]
                    continue
                below = np.array(self.children[n])
                c = self.centres[below]
                node[rows] = below[((c ** 2).sum(axis=1)[None] - 2 * x[rows] @ c.T).argmin(axis=1)]
        return out

    def order(self, query: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first by inner product with the centres."""
        score = self.centres @ query
        queue, found = [(-score[0], 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-score[child], child))
            else:
                found.append(self.leaf[node])
        return found


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float32).reshape(len(column), -1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest and of all that tie with the last of them."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])


def _search(queries: DataFrame, n_queries: int, index: DataFrame, tree: KMeansTree, visits: int, k: int) -> DataFrame:
    """(rep, embedding) queries -> (rep, ids, scores, leaves): the k + 1 best of the visited leaves, best first, ties to smaller ids."""
    def walk(batches):
        reps, vecs = [], []
        for batch in batches:
            reps.append(batch.column("rep").to_numpy())
            vecs.append(_matrix(batch.column("embedding")))
        if not reps:
            return
        reps, vecs = np.concatenate(reps), np.concatenate(vecs)
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vecs.astype(np.float64)):
            for leaf in tree.order(v, visits):
                by.setdefault(leaf, []).append(i)
        for leaf, rows in by.items():
            for lo in range(0, len(rows), BLOCK):
                r = rows[lo:lo + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([reps[r].tobytes()], pa.binary()), pa.array([vecs[r].tobytes()], pa.binary())],
                                                 names=["leaf", "reps", "queries"])

    def meet(batches):
        for batch in batches:
            out = []
            for leaf, reps, q, block, sizes, ids in zip(*(batch.column(c) for c in ("leaf", "reps", "queries", "vectors", "sizes", "ids"))):
                reps = np.frombuffer(reps.as_buffer(), np.int64)
                q = np.frombuffer(q.as_buffer(), np.float32).reshape(len(reps), -1).astype(np.float64)
                x = np.frombuffer(block.as_buffer(), np.float32).reshape(-1, q.shape[1]).astype(np.float64)
                ends = np.cumsum(np.frombuffer(sizes.as_buffer(), np.int64))
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                scores = q @ x.T
                for rep, row in zip(reps, scores):
                    near = _best(row, k + 1)
                    own = np.concatenate([ids[(ends[i - 1] if i else 0):ends[i]] for i in near])
                    s = np.repeat(row[near], [ends[i] - (ends[i - 1] if i else 0) for i in near])
                    order = np.lexsort([own, -s])[:k + 1]
                    out.append((int(rep), own[order], s[order], np.full(len(order), leaf.as_py())))
            yield _lists(out)

    def _lists(out):
        wide = lambda c, t: pa.array([r[c] for r in out], pa.list_(t))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), wide(1, pa.int64()), wide(2, pa.float64()), wide(3, pa.int64())],
                                          names=["rep", "ids", "scores", "leaves"])

    def join(t: pa.Table) -> pa.Table:
        rep, n = t.column("rep").to_numpy(), np.array([len(x) for x in t.column("ids")])
        ids, scores, leaves = (np.asarray(t.column(c).combine_chunks().flatten()) for c in ("ids", "scores", "leaves"))
        owner = np.repeat(rep, n)
        order = np.lexsort([ids, -scores, owner])
        edges = np.flatnonzero(np.diff(owner[order], prepend=np.iinfo(np.int64).min, append=np.iinfo(np.int64).max))
        out = [(int(owner[order[a]]), ids[order[a:min(b, a + k + 1)]], scores[order[a:min(b, a + k + 1)]], leaves[order[a:min(b, a + k + 1)]]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.Table.from_batches([_lists(out)])

    parts = max(1, -(-n_queries // BLOCK))
    asked = queries.select("rep", "embedding").repartition(parts, "rep").mapInArrow(walk, "leaf long, reps binary, queries binary")
    # a query stands in ``asked`` once a leaf it visits, but Spark takes the queries' own size for it and would broadcast it by the driver
    found = asked.hint("merge").join(index, "leaf").mapInArrow(meet, "rep long, ids array<long>, scores array<double>, leaves array<long>")
    return found.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(max(1, -(-n_queries // 256))))).groupBy("part") \
        .applyInArrow(join, "rep long, ids array<long>, scores array<double>, leaves array<long>")


def nearest(vectors: DataFrame, is_query, k: int = 20, wanted: float = 0.97, sample: int = 20_000, leaf_rows: int = 1024, calibrate: int = 256, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) with ``is_query``, its k best other rows.

    Largest inner product first, ties to the smaller vec_id; fewer than k if there are no more. Rows without vec_id, null or zero
    vectors, vectors with null or non-finite components or another length than most rows take no part. Rows with the same
    vec_id as the query are its own; equal rows count once. The tree is fitted on at most ``sample`` distinct vectors
    (smallest hash of vec_id) and has about a leaf for each ``leaf_rows``; leaf visits are widened until ``calibrate`` queries
    find the ``wanted`` share of their true neighbours (``nearest.report`` has the last run's figures).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0))
    width = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("embedding") == (width[0] if width else 0))
    firsts = rows.withColumn("r", F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    entries = scratch_table(firsts.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "entries")
    asking = scratch_table(rows.filter(is_query).select("vec_id", "embedding").distinct().join(entries.select("rep", "embedding"), "embedding").select("vec_id", "rep"), "asking")
    reps = asking.select("rep").distinct()
    queries = scratch_table(entries.select("rep", "embedding").join(reps, "rep", "left_semi"), "queries")
    n, n_queries = entries.count(), queries.count()

    fit = _matrix(entries.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(sample).select("embedding").toArrow().column("embedding")) if n else np.zeros((0, 1))
    tree = KMeansTree(fit, max(1, min(max(16, n // leaf_rows), max(1, len(fit) // 8))), seed=seed)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("ids"), batch.column("embedding"), pa.array(tree.place(_matrix(batch.column("embedding")).astype(np.float64)))],
                                             names=["rep", "ids", "embedding", "leaf"])

    def blocks(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("embedding"))
        sizes = np.array([len(i) for i in t.column("ids")], np.int64)
        return pa.table({"leaf": t.column("leaf")[:1], "vectors": pa.array([x.tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()),
                         "ids": pa.array([np.asarray(t.column("ids").combine_chunks().flatten(), dtype=np.int64).tobytes()], pa.binary())})

    placed = scratch_table(entries.select("rep", "ids", "embedding").mapInArrow(place, "rep long, ids array<long>, embedding array<float>, leaf long"), "placed")
    per = dict(placed.groupBy("leaf").count().collect())  # one row a leaf
    pieces = F.element_at(F.array(*[F.lit(max(1, math.ceil(per.get(i, 0) / BLOCK))) for i in range(tree.leaves)]), (F.col("leaf") + 1).cast("int"))
    index = scratch_table(placed.withColumn("piece", F.pmod(F.xxhash64("rep"), pieces)).groupBy("leaf", "piece")
                          .applyInArrow(blocks, "leaf long, vectors binary, sizes binary, ids binary"), "index")

    some = scratch_table(queries.orderBy(F.xxhash64("rep", F.lit(seed + 1)), "rep").limit(calibrate), "calibration")
    truth = {r["rep"]: r for r in _search(some, min(calibrate, n_queries), index, tree, tree.leaves, k).select("rep", "ids", "leaves").collect()}
    places = []
    for r in some.collect():
        if r["rep"] in truth:
            at = {leaf: i for i, leaf in enumerate(tree.order(np.array(r["embedding"]), tree.leaves))}
            places += [at[leaf] for i, leaf in zip(truth[r["rep"]]["ids"], truth[r["rep"]]["leaves"]) if i != r["rep"]]
    visits, places = 1, np.array(places)
    while visits < tree.leaves and len(places) and (places < visits).mean() < wanted:
        visits += max(1, visits // 16)
    visits = min(visits, tree.leaves)
    nearest.report = {"leaves": tree.leaves, "visits": visits, "recall": float((places < visits).mean()) if len(places) else 1.0}

    found = scratch_table(_search(queries, n_queries, index, tree, visits, k), "found")
    own = asking.join(found, "rep").withColumn("near", F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("vec_id")), 1, k))
    return own.select(F.col("vec_id").alias("query_id"), F.posexplode("near").alias("rank", "x")) \
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
