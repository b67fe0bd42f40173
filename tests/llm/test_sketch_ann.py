import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import words
from panelspark.llm import ann
from panelspark.llm import fingerprints as P


def shingles(b, size=P.SIZE):
    return {b[i:i + size] for i in range(max(1, len(b) - size + 1))} if b else set()


def test_sketch_estimates():
    rnd = random.Random(1)
    common = words(rnd, 300)
    a, b = (common + " " + words(rnd, 150)).encode(), (common + " " + words(rnd, 150)).encode()
    x, y = shingles(a), shingles(b)
    s, t = P.sketch(a, 1024), P.sketch(b, 1024)
    assert P.resemblance(s, t, 1024) == pytest.approx(len(x & y) / len(x | y), abs=0.06)
    assert P.containment(s, t, 1024) == pytest.approx(len(x & y) / len(x), abs=0.1)
    assert P.distinct_shingles(s, 1024) == pytest.approx(len(x), rel=0.12)
    assert np.array_equal(P.merge([s, t], 1024)[:64], P.merge([P.sketch(a), P.sketch(b)]))
    assert np.array_equal(P.from_text(P.to_text(s)), s)
    assert P.resemblance(P.sketch(b""), P.sketch(b"")) == 1.0 and P.resemblance(P.sketch(b""), P.sketch(b"a")) == 0.0


def test_parts_of_a_long_text_merge_to_the_whole(monkeypatch):
    text = words(random.Random(3), 5000).encode()
    whole = P.sketch(text)
    monkeypatch.setattr(P, "CHUNK_BYTES", 1000)
    assert np.array_equal(P.sketch(text), whole)
    assert P.distinct_shingles(P.sketch(b"abc")) == 1.0


@pytest.mark.parametrize("range_bytes", [16 << 20, 900])
def test_edited_texts_equal_brute_force(make_docs, range_bytes):
    rnd = random.Random(2)
    texts = [None, "", "é", "日本語テ", "x" * 30_000] + [words(rnd, rnd.randrange(0, 60)) for _ in range(60)]
    ids = rnd.sample(range(10 ** 12), len(texts))
    order = sorted(range(len(ids)), key=lambda i: -ids[i])
    got = {r["doc_id"]: r for r in P.edited_fingerprints(make_docs(texts, ids), range_bytes=range_bytes).collect()}
    assert len(got) == len(texts)
    for i, j in zip(order, order[1:] + order[:1]):
        t, n = texts[i] or "", texts[j] or ""
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        r = got[ids[i]]
        a, b = P.sketch(t.encode()), P.sketch(edited.encode())
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (P.to_text(a), P.to_text(b))
        assert r["near_edited"] == P.resemblance(a, b) and r["near_next"] == P.resemblance(a, P.sketch(n.encode()))


@pytest.mark.parametrize("range_bytes", [16 << 20, 60])
def test_rows_without_ids_and_repeated_rows_follow_each_other(make_docs, range_bytes):
    docs = make_docs(["aa", "aa", "bbbb", None, "cccc", "dd"], [1, 1, 1, None, None, 7])
    rows = P.edited_fingerprints(docs, range_bytes=range_bytes).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in rows) == [("1", 2), ("1", 2), ("1", 4), ("7", 2), ("None", 0), ("None", 4)]
    assert P.edited_fingerprints(make_docs([])).collect() == []
    one = P.edited_fingerprints(make_docs(["abcd"])).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    prints = {r["fingerprint"] for r in P.fingerprints(make_docs(["same text here", "same text here"])).collect()}
    assert len(prints) == 1


def vectors(spark, x, ids=None):
    rows = [(i, [float(v) for v in r], 3, "n") for i, r in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")


def brute(x, ids, q, k):
    x = np.asarray(x, np.float32).astype(np.float64)
    s = x @ x[q]
    order = [i for i in np.lexsort([ids, -s]) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    ids = rng.permutation(3000)[:1500]
    rows = ann.nearest(vectors(spark, x, ids.tolist()), F.col("vec_id") % 20 == 0, k=10, leaf_rows=32).collect()
    assert ann.nearest.report["leaves"] >= 40 and ann.nearest.report["visits"] < ann.nearest.report["leaves"]
    hits = 0
    queries = [i for i in range(1500) if ids[i] % 20 == 0]
    for q in queries:
        got = sorted((r for r in rows if r["query_id"] == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        want = brute(x, ids, q, 10)
        hits += len({r["vec_id"] for r in got} & {i for i, _ in want})
    assert hits / (10 * len(queries)) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile(rng.normal(size=4), (60, 1)), rng.normal(size=(30, 4))])
    docs = vectors(spark, x)
    odd = spark.createDataFrame([(100, None, 1, ""), (120, [0.0] * 4, 1, ""), (140, [1.0, None, 0.0, 0.0], 1, ""), (160, [1.0, float("nan"), 0.0, 0.0], 1, ""),
                                 (180, [float("inf"), 0.0, 0.0, 0.0], 1, ""), (200, [1.0, 2.0], 1, ""), (None, [1.0, 0.0, 0.0, 0.0], 1, ""),
                                 (0, [float(v) for v in x[0]], 1, "")], docs.schema)
    rows = ann.nearest(docs.union(odd), F.col("vec_id") % 20 == 0, k=5, wanted=1.0).collect()
    ids = np.arange(90)
    assert {r["query_id"] for r in rows} == {0, 20, 40, 60, 80}
    for q in (0, 20, 40, 60, 80):
        got = sorted(((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == q))
        assert [v for _, v in got] == [i for i, _ in brute(x, ids, q, 5)]


def test_few_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, F.lit(True)).collect() == []
    got = ann.nearest(vectors(spark, [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 0.5), (2, 2, 0.0)]
    assert ann.nearest(vectors(spark, [[1.0, 0.0]]), F.lit(True)).collect() == []


def test_visits_do_not_go_through_the_driver(spark, tmp_path):
    """The rows that meet a leaf hold every query once a visited leaf: Spark took the queries' size for them and broadcast them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    tree = ann.KMeansTree(x, 16)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:50])], "rep long, embedding array<float>")
    leaf = tree.place(x.astype(np.float64))
    rows = [(n, x[leaf == n].tobytes(), np.ones((leaf == n).sum(), np.int64).tobytes(), np.flatnonzero(leaf == n).astype(np.int64).tobytes()) for n in range(tree.leaves)]
    index = spark.createDataFrame([(n, bytearray(a), bytearray(b), bytearray(c)) for n, a, b, c in rows], "leaf long, vectors binary, sizes binary, ids binary")
    for name, df in (("queries", queries), ("index", index)):
        df.write.parquet(f"{tmp_path}/{name}")
    queries, index = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("queries", "index"))
    found = ann._search(queries, 50, index, tree, tree.leaves, 5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        scores = x.astype(np.float64) @ x[r["rep"]].astype(np.float64)
        assert r["ids"] == np.lexsort([np.arange(400), -scores])[:6].tolist()
