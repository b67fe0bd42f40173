"""Mutual information from joint counts by tasks."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import stats as ST


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, float("nan"), rnd.gauss(0, 1), 0.5]), float(rnd.randint(0, 3)), rnd.choice([None, rnd.random()])) for _ in range(3000)]
    return spark.createDataFrame(rows, "u double, v double, y double").repartition(6)


def test_joint_counts_are_those_of_the_rows(frame):
    cuts = [[-0.3, 0.5], [1.0], []]
    got = {(r["k"], r["a"], r["b"]): r["n"] for r in ST._joint_counts(frame, cuts, [(0, 1), (1, 2), (2, 2)]).collect()}
    want = {}
    for row in frame.collect():
        at = [None if v is None or v != v else sum(c < v for c in cuts[i]) for i, v in enumerate(row)]
        for k, (i, j) in enumerate([(0, 1), (1, 2), (2, 2)]):
            if at[i] is not None and at[j] is not None:
                want[k, at[i], at[j]] = want.get((k, at[i], at[j]), 0) + 1
    assert got == want


def test_scores_are_counted_once_however_often_they_are_read(frame):
    """Tables made of the scores read the written counts, not the rows."""
    seen = frame.sparkSession.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    mi = ST.mi_scores(frame.mapInArrow(look, frame.schema), ["u", "v"], "y", bins=4)
    once = seen.value
    assert once == 3000
    rows = ST.importance_bands(mi).collect() + ST.top_features(mi, 1).collect() + ST.distribution(mi, "mi_score", 3).collect()
    assert len(rows) == 2 + 1 + 3 and seen.value == once
    assert "MapInArrow" not in mi._jdf.queryExecution().executedPlan().toString()
    assert mi.filter(F.col("mi_score") < -1e-12).isEmpty()


def test_the_target_is_written_once(frame, monkeypatch):
    written = []
    own = ST.cut_lineage
    monkeypatch.setattr(ST, "cut_lineage", lambda df, name=None: (written.append(df.columns), own(df, name))[1])
    ST.mi_scores(frame, ["u", "v"], "y", bins=4)
    assert written[0] == ["x0", "x1", "y"]
