import random
import re

import numpy as np
import pytest

from helpers import words
from panelspark.llm.graph import connected_components
from panelspark.llm.near_dup import BITS, HASHES, MARGIN, _signature, drop_near_duplicates, near_duplicates


def brute(texts, ids, size, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(make_docs, size):
    rnd = random.Random(size)
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE  two", "É é", "x" * 200_000 + " y"]
    for _ in range(12):
        base = words(rnd, rnd.randrange(3, 120)).split()
        texts.append(" ".join(base))
        for _ in range(5):  # chains of edits: neighbours are linked, ends often are not
            for _ in range(max(1, len(base) // 40)):
                base[rnd.randrange(len(base))] = f"e{rnd.randrange(10 ** 6)}"
            texts.append(" ".join(base))
    ids = rnd.sample(range(10 ** 12), len(texts))
    want = brute(texts, ids, size)
    got = {r["doc_id"]: r for r in near_duplicates(make_docs(texts, ids), size).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_a_large_group_of_near_copies(make_docs):
    rnd = random.Random(1)
    base = words(rnd, 100).split()
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    ids = list(range(300))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(texts, ids), 2).collect()}
    assert got == {i: c for i, (_, c) in brute(texts, ids, 2).items()}


def test_repeated_rows_and_missing_ids(make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f", "a b c d e f", None, "q r s t u v", "q r s t u v"], [5, 5, 3, 8, None, None])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (8, 8, True), (None, None, True), (None, None, True)], key=str)
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted([r["doc_id"] for r in out.collect()], key=str) == sorted([3, 8, None, None], key=str)
    twice = drop_near_duplicates(make_docs(["a b c d e f", "a b c d e f", "z"], [5, 5, 6]))
    assert sorted(r["doc_id"] for r in twice.collect()) == [5, 6]


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).collect() == []
    assert drop_near_duplicates(make_docs([])).collect() == []


def test_components_of_a_long_chain(spark):
    rnd = random.Random(3)
    ids = rnd.sample(range(10 ** 9), 60)
    links = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in zip(ids, ids[1:])] + [(7, 7), (None, 3), (10 ** 10, 10 ** 10 + 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    low = min(ids)
    assert got == {**{i: low for i in ids if i != low}, 10 ** 10 + 1: 10 ** 10}


@pytest.mark.parametrize("common, a, b", [(4, 1, 0), (8, 2, 0), (8, 1, 1)])
def test_estimates_of_small_sets_stay_within_the_margin(common, a, b):
    rng = np.random.default_rng(common + b)
    estimates = []
    for _ in range(6000):
        x = rng.integers(0, 2**64, common + a + b, dtype=np.uint64)
        u, v = _signature(x[:common + a], HASHES), _signature(np.concatenate([x[:common], x[common + a:]]), HASHES)
        estimates.append(1 - 2 * int(np.bitwise_count(u ^ v).sum(dtype=np.int64)) / (HASHES * BITS))
    estimates = np.array(estimates)
    assert (estimates < 0.8 - MARGIN).sum() == 0
    assert estimates.mean() == pytest.approx(0.8, abs=0.001)
    assert estimates.std() < MARGIN / 4.3


def test_short_texts_at_the_threshold_are_linked(make_docs):
    rnd = random.Random(11)
    texts = []
    for i in range(2000):
        base = words(rnd, 5, prefix=f"p{i}_", most=10 ** 6)  # 4 shingles of two words, 5 with one word more
        texts += [base, base + f" q{i}"]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(texts), 2).collect()}
    assert [i for i in range(0, 4000, 2) if got[i + 1] != i] == []
