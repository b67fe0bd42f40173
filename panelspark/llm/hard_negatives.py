"""Hard-negative mining by threshold joins in the manner of L2AP; scores are whole numbers.

Rows are dealt into tiles. A tile keeps its rows' components by dimension, widest dimensions last. For a threshold, a row's
first dimensions are left out of the index as long as their norm times the largest anchor norm stays below it: no anchor can
reach the threshold there alone. Partial scores are accumulated over the indexed dimensions, from the last; a pair goes as soon
as its partial score plus the product of the remaining norms is below the anchor's threshold. Who is left is completed.

Anchors stream past the tiles, a batch at a time. Positives: an anchor's threshold in a tile is the k-th best score it has
found there. Negatives: rounds of falling thresholds; a window (anchor and positive) that is full at a threshold is done, the
others go on to a lower one, the last of which is the window's lower end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import read_table, scratch_table

TILE_ROWS = 65_536
LEAST_TILES = 32
BLOCK = 2048
STEP = 8
ANCHORS = 256
ROUNDS = (95, 90, 85)
_SAFE = 1 << 53


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, .. dimensions of each row, rounded up."""
    out = np.zeros((len(x), x.shape[1] + 1))
    np.cumsum(x * x, axis=1, out=out[:, 1:])
    return np.sqrt(out) * (1 + 1e-9)


class Block:
    """Rows of a tile, as an inverted index: their components by dimension."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.row, self.vec_id, self.label, self.x = row, vec_id, label, x
        self.by_dim = np.ascontiguousarray(x.T)
        self.norm = _norms(x)

    def reach(self, q: np.ndarray, q_norm: np.ndarray, least: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all allowed pairs with a score of at least the anchor's threshold."""
        width = self.x.shape[1]
        # dimensions below first[r] are not indexed: over them no anchor reaches the least threshold with row r
        first = (self.norm[:, 1:] * q_norm[:, -1].max() < least.min()).sum(axis=1)
        alive = np.flatnonzero(first < width)
        if not len(alive):
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.float64)
        alive = alive[np.argsort(first[alive], kind="stable")]
        first = first[alive]
        partial = np.zeros((len(q), len(alive)))
        down = np.full(len(alive), width)  # the last dimension that a row's partial scores hold
        keep, at = np.ones(partial.shape, bool), width
        while at > 0:
            posted = int(np.searchsorted(first, at))  # rows with an indexed dimension below
            if not posted:
                break
            hi, at = at, max(0, at - STEP)
            partial[:, :posted] += q[:, at:hi] @ self.by_dim[at:hi][:, alive[:posted]]
            down[:posted] = at
            keep = partial + q_norm[:, down] * self.norm[alive, down] >= least[:, None]
            if keep.mean() < 0.05:  # few are left: go on pair by pair
                break
        a, r = np.nonzero(keep)
        score, late, r = partial[a, r], down[r] > at, alive[r]
        ok = allowed(a, r)
        a, r, score, late = a[ok], r[ok], score[ok], late[ok]
        score[late] = np.einsum("ij,ij->i", q[a[late], at:], self.x[r[late], at:])
        while at > 0:
            hi, at = at, max(0, at - STEP)
            score = score + np.einsum("ij,ij->i", q[a, at:hi], self.x[r, at:hi])
            ok = score + q_norm[a, at] * self.norm[r, at] >= least[a]
            a, r, score = a[ok], r[ok], score[ok]
        ok = score >= least[a]
        return a[ok], r[ok], score[ok]


def _matrix(column, order: np.ndarray) -> np.ndarray:
    """Vectors as rows of whole numbers, their dimensions in the given order; what a shorter vector lacks is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) and len(size) and (size == len(order)).all():
        x = flat.reshape(len(size), len(order))
    else:
        x = np.zeros((len(size), len(order)))
        x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    x = x[:, order]
    if len(x) and float((x * x).sum(axis=1).max()) >= _SAFE:
        raise ValueError("components too large for exact scores: a vector's squared length, scaled, must stay below 2^53")
    return x


def _sorted_top(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The k best of each group: larger scores first, then smaller vec_id, then smaller row."""
    order = np.lexsort([row, vec_id, -score, group])
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    return order[np.arange(len(g)) - start < k]


def _tiles(batches, order: np.ndarray):
    """Of a partition sorted by tile and kind: each tile's blocks with batches of its anchors."""
    tile, blocks, closed = None, [], False
    for batch in batches:
        tiles, anchor = batch.column("tile").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate([[True], (tiles[1:] != tiles[:-1]) | (anchor[1:] != anchor[:-1]), [True]])) if len(tiles) else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1], edges[1:]):
            if tiles[lo] != tile or (closed and not anchor[lo]):
                tile, blocks, closed = tiles[lo], [], False
            part = batch.slice(lo, hi - lo)
            if not anchor[lo]:
                x = _matrix(part.column("v"), order)
                for i in range(0, len(x), BLOCK):
                    blocks.append(Block(*(part.column(c).to_numpy()[i:i + BLOCK] for c in ("row", "vec_id", "label")), x[i:i + BLOCK]))
                continue
            closed = True
            for i in range(0, hi - lo, ANCHORS):
                some = part.slice(i, min(ANCHORS, hi - lo - i))
                q = _matrix(some.column("v"), order)
                yield blocks, some, q, _norms(q)


def _positives(order: np.ndarray, k: int):
    def run(batches):
        for blocks, some, q, q_norm in _tiles(batches, order):
            own, label = some.column("row").to_numpy(), some.column("label").to_numpy()
            least = np.full(len(q), -np.inf)
            best = [np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # anchor, score, vec_id, row
            for b in blocks:
                a, r, score = b.reach(q, q_norm, least, lambda a, r: (b.label[r] == label[a]) & (b.row[r] != own[a]))  # noqa: B023
                best = [np.concatenate(x) for x in zip(best, (a, score, b.vec_id[r], b.row[r]))]
                keep = _sorted_top(*best, k)
                best = [x[keep] for x in best]
                full = np.bincount(best[0], minlength=len(q)) == k
                worst = np.full(len(q), np.inf)
                np.minimum.at(worst, best[0], best[1])
                least = np.where(full, worst, -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(own[best[0]]), pa.array(best[1].astype(np.int64)), pa.array(best[2]), pa.array(best[3])],
                                             names=["row", "score", "other_id", "other"])

    return run


def _negatives(order: np.ndarray, k: int):
    """Anchors come once per window that is not full, with its bounds: least (the round's threshold) and most."""
    def run(batches):
        for blocks, some, q, q_norm in _tiles(batches, order):
            label, window = some.column("label").to_numpy(), some.column("window").to_numpy()
            least, most = some.column("least").to_numpy().astype(np.float64), some.column("most").to_numpy()
            best = [np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            for b in blocks:
                a, r, score = b.reach(q, q_norm, least, lambda a, r: b.label[r] != label[a])  # noqa: B023
                ok = score <= most[a]
                a, r, score = a[ok], r[ok], score[ok]
                best = [np.concatenate(x) for x in zip(best, (a, score, b.vec_id[r], b.row[r]))]
                keep = _sorted_top(*best, k)
                best = [x[keep] for x in best]
            yield pa.RecordBatch.from_arrays([pa.array(window[best[0]]), pa.array(best[1].astype(np.int64)), pa.array(best[2]), pa.array(best[3])],
                                             names=["window", "score", "other_id", "other"])

    return run


_FOUND = "score long, other_id long, other long"


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   rounds: tuple[int, ...] = ROUNDS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (vec_id, embedding, label) with ``is_anchor``.

    Components x count as floor(256 x), scores are whole inner products, exact while a vector's scaled squared length stays below
    2^53 (beyond, the job raises). An anchor's positives are its best other rows of the same label; for each, the best rows of
    other labels whose score lies between ``low`` and ``high`` percent of the positive's. Ties go to the smaller vec_id.
    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; what a shorter vector lacks counts
    as 0. Repeated rows are rows of their own, also as anchors. A table without anchors, or an empty one, gives no rows. Other
    columns aren't read. ``rounds`` are the falling thresholds in percent of the positive's score before the lower end; they and
    ``tile_rows`` (rows that a task indexes) don't change the result. Only the dimensions' norms come to the driver.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    taken = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    taken = taken.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", odd))
    table = scratch_table(taken.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "asks", F.transform("e", lambda x: F.floor(x * 256).cast("double")).alias("v")), "vectors")
    n = table.count()
    dims = table.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x") * F.col("x")).alias("s")).orderBy("s", "dim").collect()  # one row a dimension
    order = np.array([r["dim"] for r in dims] or [0], np.int64)
    tiles = max(LEAST_TILES, -(-n // tile_rows))
    data = table.select(F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("long").alias("tile"), F.lit(False).alias("anchor"), "row", "vec_id", "label", "v")

    def join(anchors: DataFrame, extra: list[str], function, schema: str) -> DataFrame:
        """Every tile's rows, then all anchors, in one sorted partition."""
        kinds = dict(anchors.dtypes)
        every = anchors.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))).select("tile", F.lit(True).alias("anchor"), "row", "vec_id", "label", "v", *extra)
        both = data.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra]).union(every)
        return both.repartition(tiles, "tile").sortWithinPartitions("tile", "anchor").mapInArrow(function, schema)

    def best(found: DataFrame, by: str, k: int) -> DataFrame:
        line = W.partitionBy(by).orderBy(F.desc("score"), "other_id", "other")
        return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)

    anchors = table.filter("asks").select("row", "vec_id", "label", "v")
    near = best(join(anchors, [], _positives(order, positives), "row long, " + _FOUND), "row", positives)
    windows = scratch_table(near.select("row", F.col("rank").alias("p"), F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id"))
                            .withColumn("window", F.col("row") * positives + F.col("p") - 1), "windows")
    # low * positive <= 100 * score <= high * positive; with a negative positive nothing lies between
    up = lambda percent: -F.floor(-F.col("positive_score") * percent / F.lit(100).cast("decimal(3,0)")).cast("long")
    todo = windows.select("row", "window", "positive_score", up(low).alias("floor"), F.floor(F.col("positive_score") * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("most")).filter("floor <= most")
    done = []
    for percent in (*rounds, None):
        least = F.col("floor") if percent is None else F.greatest("floor", up(percent))
        asking = todo.withColumn("least", least).join(anchors, "row")
        found = scratch_table(best(join(asking, ["window", "least", "most"], _negatives(order, negatives), "window long, " + _FOUND), "window", negatives), "found", narrow=True)
        if percent is None:
            done.append(found)
            break
        full = found.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= negatives).select("window")
        done.append(found.join(full, "window", "left_semi"))
        todo = scratch_table(todo.join(full, "window", "left_anti"), "todo", narrow=True)
        if todo.isEmpty():
            break
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    names = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return found.join(windows, "window").join(names, "row") \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
                AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
     s AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
           FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
     p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, other_id, other) <= 5)
SELECT * EXCLUDE (rid, other) FROM (
    SELECT p.rid, p.other, p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.other_id, n.other)::INTEGER AS "rank",
           n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.rid = p.rid AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score) WHERE "rank" <= 5
"""
