"""Sharding by balanced label propagation; DataFrame operations only.

Documents that share a group value (here: equal texts) are linked. They start in the shard of a hash. In each round every
document sees in which shards its links lie, by a join with its group's bytes per shard, and moves to the shard that holds
most of them, as far as that shard's room goes. At last the shards' sizes are evened out: full shards release
documents (those without links first) which fill the others, in passes with smaller and smaller documents.
Sums over shards and hash buckets stand in for windows over all documents; only one number a shard comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.llm.common import read_table, scratch_table

BUCKETS = 256


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = dict(state.groupBy("shard").agg(F.sum("size")).collect())  # one row a shard
    return [int(found.get(k) or 0) for k in range(shards)]


def _at(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _before(rows: DataFrame, by: list[str], amount: str) -> DataFrame:
    """``rows`` with before: the sum of ``amount`` of the rows ahead within ``by``, in order of linked, bucket and draw."""
    sums = rows.groupBy(*by, "linked", "bucket").agg(F.sum(amount).alias("own"))
    line = W.partitionBy(*(by or [F.lit(0)])).orderBy("linked", "bucket").rowsBetween(W.unboundedPreceding, 0)
    ahead = sums.withColumn("ahead", F.sum("own").over(line) - F.col("own")).drop("own")
    inner = W.partitionBy(*by, "linked", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(ahead, [*by, "linked", "bucket"]).withColumn("before", F.col("ahead") + F.sum(amount).over(inner) - F.col(amount)).drop("ahead")


def _propagate(state: DataFrame, shards: int, slack: float) -> DataFrame:
    """One round: linked documents move to the shard with most of their links' bytes, while that shard has room."""
    loads = _loads(state, shards)
    room = [max(0, int(sum(loads) / shards * (1 + slack)) - x) for x in loads]
    key = ["grp", "text_crc32", "group_size"]
    near = state.filter("linked").groupBy(*key, "shard").agg(F.sum("size").alias("bytes"))
    # a shard without room counts only for those that are there
    best = near.groupBy(*key).agg(F.max_by("shard", F.struct("bytes", F.xxhash64("grp", "shard"))).alias("most"),
                                  F.max("bytes").alias("top"), F.sum("bytes").alias("total"), F.max_by("shard", F.when(_at(room, F.col("shard")) > 0, F.struct("bytes", F.xxhash64("grp", "shard")))).alias("free"))
    best = scratch_table(best, "best", narrow=True)
    # where most of them are, if the others fit; else all to another of their shards, or to any, with room for all; a
    # group that fits nowhere fills the room that its other shards have
    roomy = sorted(range(shards), key=lambda k: -room[k])[:max(1, shards // 4)]
    spare = _at(roomy, F.pmod(F.xxhash64("grp"), F.lit(len(roomy))))
    to = F.when(F.col("total") - F.col("top") <= _at(room, F.col("most")), F.col("most")) \
        .when(F.col("total") <= _at(room, F.col("free")), F.col("free")).when(F.col("total") <= _at(room, spare), spare) \
        .when(F.col("shard") == F.col("most"), F.col("shard")).otherwise(F.coalesce("free", "shard"))
    wish = scratch_table(state.filter("linked").join(best, key).withColumn("to", to).drop("most", "free", "top", "total"), "wishes", narrow=True)
    moves = _before(wish.filter("to <> shard"), ["to"], "size")
    moved = moves.withColumn("shard", F.when(F.col("before") + F.col("size") <= _at(room, F.col("to")), F.col("to")).otherwise(F.col("shard")))
    cols = state.columns
    return state.filter("not linked").union(wish.filter("to = shard").select(cols)).union(moved.select(cols))


def _even_out(state: DataFrame, loads: list[int], largest: float | None) -> DataFrame:
    """Full shards release documents of at most ``largest`` bytes, which go where there is room."""
    shards = len(loads)
    mean = sum(loads) / shards
    excess = [max(0.0, x - mean) for x in loads]
    room = [max(0.0, mean - x) for x in loads]
    movable = (_at(excess, F.col("shard")) > 0) & (F.lit(True) if largest is None else F.col("size") <= largest)
    marked = _before(state.filter(movable), ["shard"], "size")
    out = F.col("before") + F.col("size") / 2 <= _at(excess, F.col("shard"))
    marked = scratch_table(marked.withColumn("out", out).drop("before"), "released", narrow=True)
    pool = _before(marked.filter("out"), [], "size")
    upto = [sum(room[:k + 1]) for k in range(shards)]
    to = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*[F.lit(x) for x in upto]), lambda x: x <= F.col("before") + F.col("size") / 2)))
    # what is released beyond all room goes back to where it was
    moved = pool.withColumn("shard", F.when(F.col("before") + F.col("size") / 2 < upto[-1], to).otherwise(F.col("shard")))
    cols = state.columns
    return state.filter(~movable).union(marked.filter("not out").select(cols)).union(moved.select(cols))


def balanced_shards(docs: DataFrame, shards: int = 40, rounds: int = 4, slack: float = 0.25, even: float = 0.005, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text; other columns are ignored).

    size: UTF-8 bytes of the text plus 16, a null text having none and counting as equal to an empty one. Equal texts are
    linked and share a shard as far as no shard outgrows the mean by ``slack`` on the way; then sizes are brought within
    ``even`` of the mean, or as near as the documents' own sizes allow; a group larger than a shard spreads over several.
    slot numbers a shard's rows from 0 without gaps. Rows are placed one by one, repeated or not; a null doc_id is allowed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("grp"), (F.octet_length(text)).cast("long").alias("group_size"))
    rows = scratch_table(rows.withColumn("draw", F.xxhash64("doc_id", "grp", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("draw"), F.lit(BUCKETS))), "rows")
    key = ["grp", "text_crc32", "group_size"]
    groups = scratch_table(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("linked", F.lit(True)).drop("n"), "groups", narrow=True)
    state = rows.join(groups, key, "left").withColumn("linked", F.coalesce("linked", F.lit(False))) \
        .withColumn("shard", F.pmod("draw", F.lit(shards)).cast("int"))
    state = scratch_table(state, "state", narrow=True)
    for _ in range(rounds):
        state = scratch_table(_propagate(state, shards, slack), "state", narrow=True)
    for finer in (None, 4, 16, 64, 256, 1024):
        loads = _loads(state, shards)
        mean = sum(loads) / shards
        if max(abs(x - mean) for x in loads) <= even * mean:
            break
        state = scratch_table(_even_out(state, loads, None if finer is None else mean / finer), "state", narrow=True)
    per = state.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    line = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("first", F.sum("n").over(line) - F.col("n")).drop("n")
    inner = W.partitionBy("shard", "bucket").orderBy("draw", "doc_id", "size")
    return state.join(per, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(inner) - 1).cast("long").alias("slot"))


def op10_balanced_shards(spark, sf_dir: str) -> DataFrame:
    out = balanced_shards(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
