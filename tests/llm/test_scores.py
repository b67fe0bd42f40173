import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import words
from panelspark.llm import quality as Q
from panelspark.llm import toxicity as T

BAD = ["grotbag", "snivelworm", "blatherskite", "numpty"]


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = ("the of and " if i % 2 else "der die und ") + words(rnd, rnd.randrange(5, 60), most=500)
        toxic = i % 4 == 0
        if toxic:
            text += " " + rnd.choice(BAD) + rnd.choice(["", "ly", "ish"]) + rnd.choice(["", ".", "!"]) + " " + words(rnd, 5, most=500)
        rows.append((i, text, int(toxic)))
    return rows


def test_network_separates_held_out_rows():
    fitted = T.fit_toxicity(toxic_rows(600, 1), steps=400)
    test = toxic_rows(300, 2)
    z = np.concatenate([fitted["model"].logits(s, d) - fitted["cuts"][lang] for s, d, lang in T.inputs(pa.array([r[1] for r in test]))])
    assert ((z >= 0) == np.array([r[2] for r in test])).mean() > 0.97


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    model = T.TextCNN(1)
    for p in [model.emb, *model.conv]:
        p *= 3
    slots = rng.integers(0, T.SLOTS, (9, 3)).astype(np.int32)
    docs = np.array([0, 9])
    before = model.logits(slots, docs)[0]
    model.fit([(slots, 1), (rng.integers(0, T.SLOTS, (7, 3)).astype(np.int32), 0)], 30, 0.05, 2, 0)
    assert model.logits(slots, docs)[0] > before


def test_language_comes_from_the_text():
    got = np.concatenate([lang for _, _, lang in T.inputs(pa.array(["the of and", "Der die und", "les des une", "el los por", "xyz", ""]))])
    assert got.tolist() == [0, 1, 2, 3, 4, 4]


def test_toxicity_of_odd_tables(spark, make_docs):
    rows = toxic_rows(200, 3)
    docs = make_docs([r[1] for r in rows] + [None, "", "x " * 50_000, rows[0][1]], [r[0] for r in rows] + [900, 901, None, 0])
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (5, 1, None), (7, None, 0), (10 ** 6, 0, 1)], "doc_id long, quality int, toxic int")
    out = T.toxicity(docs, labels, name="tox")
    assert out.columns == docs.columns + ["tox"]
    got = out.collect()
    assert len(got) == 204 and all(0 <= r["tox"] <= 1 for r in got)
    twin = [r["tox"] for r in got if r["text"] == rows[0][1]]
    assert len(twin) >= 2 and len(set(twin)) == 1
    none = [r["tox"] for r in got if not r["text"]]
    assert len(set(none)) == 1
    assert T.toxicity(docs.limit(0), labels).collect() == []
    assert {r["none"] for r in T.toxicity(docs, labels.limit(0), name="none").collect()} == {0.0}


def quality_texts(n, seed):
    rnd = random.Random(seed)
    good, junk = [], []
    for _ in range(n):
        good.append(". ".join(words(rnd, rnd.randrange(4, 15), most=5000).capitalize() for _ in range(rnd.randrange(2, 10))) + ".")
        junk.append(rnd.choice([lambda: " ".join([f"Spam{rnd.randrange(50)}"] * rnd.randrange(20, 80)),
                                lambda: " ".join(w.upper() + "!!" for w in words(rnd, 40).split()),
                                lambda: " | ".join(words(rnd, 40).split()) + " |"])())
    return good, junk


def test_positive_unlabelled_learning_on_held_out_texts():
    good, junk = quality_texts(400, 1)
    fitted = Q.fit_quality(good[:250], good[250:] + junk[:40], steps=800)
    assert 0.6 < fitted["prior"] <= 0.98
    a, b = quality_texts(150, 2)
    z = fitted["net"].logits(Q.features(pa.array(a + b))) - fitted["cut"]
    assert ((z >= 0) == np.array([True] * 150 + [False] * 150)).mean() > 0.95


@pytest.mark.parametrize("share", [0.02, 0.1, 0.3, 0.5, 0.9])
def test_any_share_of_good_texts(share):
    good, junk = quality_texts(800, 5)
    k = round(500 * share)
    fitted = Q.fit_quality(good[:300], good[300:300 + k] + junk[:500 - k], steps=800)
    assert fitted["prior"] == pytest.approx(share, abs=0.05)
    a, b = quality_texts(200, 6)
    z = fitted["net"].logits(Q.features(pa.array(a + b))) - fitted["cut"]
    assert (z[:200] >= 0).mean() > 0.95 and (z[200:] < 0).mean() > 0.95


def test_gradient_of_the_risk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 5))
    net = Q.Network(x, 0)
    slope = rng.normal(size=20)
    g = net.gradient(x, slope)
    for i in range(4):
        p = net.p[i]
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = (slope * net.logits(x)).sum()
        p[at] = old - 1e-5
        down = (slope * net.logits(x)).sum()
        p[at] = old
        assert g[i][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7)


def test_quality_of_odd_tables(spark, make_docs):
    good, junk = quality_texts(60, 4)
    texts = good + junk + [None, "", " ", "x" * 100_000, good[0]]
    docs = make_docs(texts, list(range(len(texts) - 1)) + [None])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(None, 1, 0), (3, None, 0), (70, 0, 0)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    out = Q.quality(docs, labels, F.lit(True))
    got = out.collect()
    assert out.columns == docs.columns + ["score"] or out.columns[-1] == "score"
    assert len(got) == len(texts)
    assert {r[-1] for r in Q.quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.7}
    assert Q.quality(docs.limit(0), labels, F.lit(True)).collect() == []
