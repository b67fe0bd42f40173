"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets are one node. Each node has the minima of hash functions over its set, of which only
the low 8 bits are kept, packed into longs. Bands of 6 of the first 252 packed values give candidate buckets; nodes that
share a bucket get 2,048 values, and the bit count of two such signatures' difference, corrected for chance agreement,
estimates their similarity. The pairs that can reach the threshold are confirmed on the full sets.

A bucket is never expanded into its pairs. First every member is compared with the bucket's smallest one. Only
buckets whose members still lie in different components are looked at again, and there only members outside the
bucket's largest component meet the others, in blocks of about 256 against 256 whose estimates are computed in
one step. The best few estimates of each are confirmed first, then, where components still differ, all that are left.
A pair at the threshold shares no band with a chance of about 3 in a million (1 - 0.8^6)^42.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import flat_list, mix, read_table, scratch_table
from panelspark.llm.graph import connected_components
from panelspark.llm.shingles import shingle_sets

BITS, BAND, BANDS = 8, 6, 42
HASHES = 2048
BLOCK = 256
# the best estimates of a straggler that are confirmed first
FIRST = 8
# four and a half standard deviations of the estimate at a similarity of 0.8, measured as 0.0095 for sets of 5 to 500
MARGIN = 0.043

_A = np.random.Generator(np.random.PCG64(41)).integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = np.random.Generator(np.random.PCG64(43)).integers(0, 2**32, HASHES, dtype=np.uint32)


def _signature(values: np.ndarray, hashes: int) -> np.ndarray:
    """Low bits of the minima. a * x + b alone is not enough: whether the low bits of two of its values agree hardly depends
    on a, so all functions would agree or differ alike; a shift and a product after it bring the high bits down."""
    low = np.full(hashes, 0xFFFFFFFF, np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    a, b = _A[:hashes], _B[:hashes]
    # values of a block stay in the processor's cache
    step = (1 << 17) // hashes
    for at in range(0, len(x), step):
        h = x[at:at + step, None] * a
        h += b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(low, h.min(axis=0), out=low)
    return low.astype(np.uint8)


def signatures(docs: DataFrame, shingle_size: int = 5) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, set_a, set_b, bands); a null or wordless text has no bands."""
    weights = (np.arange(BAND, dtype=np.uint64) * np.uint64(BITS))
    tag = np.arange(BANDS, dtype=np.uint64) << np.uint64(BAND * BITS)

    def run(batches):
        for batch in batches:
            n, keys, bands, sizes = [], [], [], []
            for s in shingle_sets(batch.column("text"), shingle_size):
                n.append(len(s))
                keys.append((mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64),
                             np.bitwise_xor.reduce(mix(s + np.uint64(0x27D4EB2F))) if len(s) else np.uint64(0)))
                sizes.append(1 if len(s) else 0)
                if len(s):
                    slots = _signature(s, BAND * BANDS).reshape(BANDS, BAND).astype(np.uint64)
                    bands.append(((slots << weights).sum(axis=1, dtype=np.uint64) | tag).view(np.int64))
            k = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            sizes = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.array(n, np.int64)), pa.array(k[:, 0]), pa.array(k[:, 1]),
                flat_list(np.concatenate(bands) if bands else np.zeros(0, np.int64), sizes * BANDS, pa.int64()),
            ], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _features(docs: DataFrame, shingle_size: int) -> DataFrame:
    """(doc_id, text) -> (node, sig, members): packed signature and full set, for texts with words."""
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), shingle_size))
            sigs = [_signature(s, HASHES).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), flat_list(np.concatenate([np.zeros(0, np.int64), *sigs]), np.array([len(s) for s in sigs], np.int64), pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "sig", "members"])

    return docs.mapInArrow(run, "node long, sig array<long>, members binary")


def estimate(a: str, b: str):
    """Similarity from two packed signatures: slots that differ by chance agreement aside, half their bits differ."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1.0 - 2.0 * differing / (HASHES * BITS)


def _confirm(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """(u, v) candidates -> (u, v, linked): those whose estimate comes near the threshold, held against the full sets."""
    side = lambda k: features.select(F.col("node").alias(k), F.col("sig").alias(f"{k}_sig"), F.col("members").alias(f"{k}_members"))
    near = pairs.join(side("u"), "u").join(side("v"), "v").filter(estimate("u_sig", "v_sig") >= percent / 100 - MARGIN)

    def run(batches):
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("u_members"), batch.column("v_members")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])

    return near.select("u", "v", "u_members", "v_members").mapInArrow(run, "u long, v long, linked boolean")


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (key, node, comp, n, top, main) of the buckets that still hold several components; main is the largest one."""
    here = members.filter("n > 2").join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = here.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key") \
        .agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("comp", F.struct("n", "comp")).alias("main")) \
        .filter("comps > 1").drop("comps")
    return here.join(scratch_table(mixed, "mixed", narrow=True), "key")


def _across(rows: DataFrame, features: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Candidates (u, v, cut) between components inside a bucket: each straggler's ``most`` best estimates, or all.

    A pair is looked at in the first of the bands that it shares. cut: the straggler had more of them.
    """
    rows = scratch_table(rows.join(features.select("node", "sig"), "node"), "rows", narrow=True)
    blocks = lambda t, n, k: t.withColumn(k, F.pmod(F.xxhash64("node"), F.ceil(n / F.lit(BLOCK)))) \
        .groupBy("key", k).agg(F.collect_list(F.struct("node", "comp", "sig")).alias(f"{k}_rows"))
    xs = blocks(rows.filter("comp <> main"), F.col("n") - F.col("top"), "x")
    ys = blocks(rows, F.col("n"), "y")

    def run(batches):
        for batch in batches:
            out = []
            for key, xs, ys in zip(batch.column("key").to_pylist(), batch.column("x_rows"), batch.column("y_rows")):
                xs, ys = xs.values, ys.values
                node, comp = ([np.asarray(t.field(c)) for t in (xs, ys)] for c in ("node", "comp"))
                sig = [np.asarray(t.field("sig").flatten()).reshape(len(t), -1).view(np.uint64) for t in (xs, ys)]
                differ = np.zeros((len(xs), len(ys)), np.int64)
                for j in range(sig[0].shape[1]):
                    differ += np.bitwise_count(sig[0][:, j, None] ^ sig[1][None, :, j])
                est = 1 - 2 * differ / (HASHES * BITS)
                est[(comp[0][:, None] == comp[1][None, :]) | (est < percent / 100 - MARGIN)] = -1
                slots = [t.view(np.uint8).reshape(len(t), HASHES)[:, :BAND * BANDS].reshape(len(t), BANDS, BAND) for t in sig]
                for i in np.flatnonzero((est >= 0).any(axis=1)):
                    good = np.flatnonzero(est[i] >= 0)
                    good = good[(slots[1][good] == slots[0][i]).all(axis=2).argmax(axis=1) == key >> BAND * BITS]
                    best = good[np.lexsort((node[1][good], -est[i][good]))][:most and max(1, most // 4)]
                    out += [(int(node[0][i]), int(node[1][j]), float(est[i][j]), len(best) < len(good)) for j in best]
            x, y, e, cut = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(e, pa.float64()), pa.array(cut, pa.bool_())], names=["x", "y", "est", "cut"])

    found = xs.join(ys, "key").select("key", "x_rows", "y_rows").mapInArrow(run, "x long, y long, est double, cut boolean")
    if most is not None:
        line = W.partitionBy("x").orderBy(F.col("est").desc(), "y")
        found = found.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= most + 1) \
            .withColumn("cut", F.col("cut") | (F.col("place") > most))
    return found.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "cut")


def near_duplicates(docs: DataFrame, shingle_size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when their word-shingle sets satisfy 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable over links, kept marks the document that bears it.
    Null, empty and wordless texts have no shingles and are linked with nothing. Rows that share a doc_id are one
    document with each of their texts; a row without doc_id gets a null component, is linked with nothing and
    kept. Other columns of ``docs`` are ignored.
    """
    base = scratch_table(signatures(docs, shingle_size), "minhash")
    reps = scratch_table(base.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b")
                         .agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")), "reps", narrow=True)
    bands = reps.select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")) \
        .filter("low < high").drop("high")
    members = scratch_table(bands.join(scratch_table(buckets, "buckets", narrow=True), "key"), "members", narrow=True)
    near = members.select(F.col("node").alias("near")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = scratch_table(_features(text.join(near, text.doc_id == near.near, "left_semi"), shingle_size), "features", narrow=True)

    stars = members.filter("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct()
    tested = scratch_table(_confirm(stars, features, percent), "tested", narrow=True)
    comps = connected_components(tested.filter("linked"))
    for most in (FIRST, None):
        rows = scratch_table(_mixed(members, comps), "mixed", narrow=True)
        if rows.isEmpty():
            break
        found = scratch_table(_across(rows, features, percent, most), "across", narrow=True)
        fresh = scratch_table(_confirm(found.select("u", "v").distinct().join(tested, ["u", "v"], "left_anti"), features, percent), "tested", narrow=True)
        tested = tested.union(fresh)
        if not fresh.filter("linked").isEmpty():
            comps = connected_components(tested.filter("linked"))
        if found.filter("cut").isEmpty():
            break
    labels = scratch_table(reps.join(comps, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component")), "labels", narrow=True)
    return base.select("doc_id", "n_shingles", "set_a", "set_b").join(labels, ["set_a", "set_b"], "left") \
        .select("doc_id", "n_shingles",
                F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id"))
                       .otherwise(F.col("doc_id"))).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle_size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, and of rows that share it one.

    Rows without doc_id and documents without words are no one's duplicates and stay. Repeated rows of a kept document
    leave the one whose text has the smallest hash. Other columns are carried along whatever their names; an empty table
    gives an empty one.
    """
    found = scratch_table(near_duplicates(docs, shingle_size, percent), "groups", narrow=True)
    rows = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    out = rows.filter("not kept").select(F.col("doc_id").alias("out"))
    # the row as one struct, so that no column of docs can be taken for one of these
    once = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")) \
        .join(out, F.col("id") == F.col("out"), "left_anti")
    twice = rows.filter("kept and n > 1").select(F.col("doc_id").alias("twice"))
    if twice.isEmpty():
        return once.select("row.*")
    marked = once.join(twice, F.col("id") == F.col("twice"), "left")
    some = marked.filter("twice is not null").withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("hash"))).filter("n = 1")
    return marked.filter("twice is null").select("row.*").union(some.select("row.*"))


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_size=2)
