import math
import random

import numpy as np
import pytest

from panelspark.llm import hard_negatives as H


def brute(rows, k=5):
    rows = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (aid, al, av) in enumerate(rows):
        if aid % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, r, l) for r, (i, l, v) in enumerate(rows) if r != a)
        for ps, pid, _, _ in [x for x in scored if x[3] == al][:k]:
            hits = [x for x in scored if x[3] != al and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:k]
            out += [(aid, pid, rank, nid, -ps, -ns) for rank, (ns, nid, _, _) in enumerate(hits, 1)]
    return sorted(out)


def rows_of(seed=3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(12)] for _ in range(5)]
    rows = []
    for i in range(500):
        c = rnd.choice(centres)
        rows.append((i, rnd.randrange(4), [round(x + rnd.gauss(0, 0.05), 2) for x in c]))
    copy = [round(x, 2) for x in centres[0]]
    rows += [(600 + i, i % 2, copy) for i in range(120)]  # ties, also with anchors
    rows += [(700, 1, None), (701, 1, [float("nan")] * 12), (None, 1, copy), (800, None, copy), (900, 2, [0.0] * 12), (903, 2, [float("inf")] + [0.0] * 11), (904, 2, [None] + [0.0] * 11),
             (1000, 3, []), (1001, 3, [0.5, 0.5]), (1100, 1, copy), (1100, 1, copy), (-100, 0, [-x for x in copy]), (1200, 9, copy)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"tile_rows": 8, "rounds": ()}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(H, "LEAST_TILES", 2)
    rows = rows_of()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, v string, tile int").repartition(3)
    exact = [(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows]
    import pyspark.sql.functions as F
    got = sorted(tuple(r) for r in H.hard_negatives(table, F.col("vec_id") % 100 == 0, **sizes).collect())
    want = brute(exact)
    assert got == want and len(want) > 100 and len({r[0] for r in want}) > 4


def test_empty_tables(spark):
    import pyspark.sql.functions as F
    schema = "vec_id long, label int, embedding array<float>"
    assert H.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []
    assert H.hard_negatives(spark.createDataFrame([(1, 1, [0.5])], schema), F.col("vec_id") % 100 == 0).collect() == []
    assert H.hard_negatives(spark.createDataFrame([(100, 1, []), (1, 1, []), (2, 2, [])], schema), F.col("vec_id") % 100 == 0).collect() == [(100, 1, 1, 2, 0, 0)]


def test_reach_finds_every_pair_above_the_threshold():
    rnd = np.random.default_rng(1)
    for spread in (0.05, 1.0):
        x = np.floor(256 * (rnd.normal(0, 1, (300, 24)) * np.linspace(spread, 1, 24)))
        q = x[:40]
        exact = q @ x.T
        for least in (np.full(40, -np.inf), np.quantile(exact, 0.9, axis=1), np.full(40, exact.max() + 1), exact.max(axis=1)):
            b = H.Block(np.arange(300), np.arange(300), np.zeros(300, np.int64), x)
            a, r, s = b.reach(q, H._norms(q), least, lambda a, r: a != r)
            want = {(i, j) for i, j in zip(*np.nonzero(exact >= least[:, None])) if i != j}
            assert set(zip(a.tolist(), r.tolist())) == want and np.array_equal(s, exact[a, r])


def test_query_and_sql_agree(spark, tmp_path):
    import duckdb
    from panelspark.llm.queries import ORACLES, QUERIES
    rows = rows_of(5)
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").filter("size(embedding) = 12").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLES["op13_hard_negatives"]).fetchall()) and got
