import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from helpers import words
from panelspark.llm.mixing import draw_mix, quotas, source_mix, targets
from panelspark.llm.sharding import balanced_shards


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def corpus(n, seed=0):
    rnd = random.Random(seed)
    names = ["a", "b", "ä", "z", None, "hot", "c"]
    texts, sources = [None, "", " \n"], ["a", "b", None]
    for i in range(n):
        s = "hot" if rnd.random() < 0.4 else rnd.choice(names)
        texts.append(("\n " if i % 5 == 0 else "") + words(rnd, int(rnd.paretovariate(1.1) * 5) % 400 + 1) + " \t")
        sources.append(s)
    return texts, sources


def test_targets_are_shared_again_until_none_is_above(spark):
    for seed in range(5):
        rnd = random.Random(seed)
        sizes = {s: rnd.choice([0, 1, 10, 1000, 50]) for s in ["a", "b", "c", "d", "é", None]}
        got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = plain_targets(sizes)
        assert got == pytest.approx(want)


def test_tree_gives_every_block_to_one_shard(spark):
    units = [(s, i) for s, n in (("a", 37), ("b", 5), (None, 90)) for i in range(n)]
    rows = quotas(spark.createDataFrame(units, "source string, ordinal long"), 8, 3).collect()
    seen = Counter((r["source"], i) for r in rows for i in range(r["first"], r["last"] + 1))
    assert seen == Counter(units)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["last"] - r["first"] + 1
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 3
    with pytest.raises(ValueError):
        quotas(spark.createDataFrame(units, "source string, ordinal long"), 6, 3)


def test_splits_follow_the_hypergeometric_law(spark):
    units = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(10)], "source string, ordinal long")
    left = [sum(r["last"] - r["first"] + 1 for r in quotas(units, 2, seed).collect() if r["source"] == "a" and r["shard"] == 0) for seed in range(30)]
    assert 4 <= sum(left) / 30 <= 6 and len(set(left)) > 2  # mean 5, standard deviation 1.15


def test_mix_meets_its_targets(make_docs):
    texts, sources = corpus(300)
    docs = make_docs(texts, sources=sources)
    rows = source_mix(docs, shards=8).collect()
    assert len(rows) == len(texts)
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += count(t)
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == count(texts[r["doc_id"]]) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["shards"]) == -(-r["taken"] // r["size"] if r["size"] else 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in source_mix(docs.repartition(7), shards=8).collect()}


def test_drawn_rows_carry_the_words_taken(make_docs):
    texts, sources = corpus(120, seed=4)
    docs = make_docs(texts + [texts[5], texts[5]], list(range(len(texts))) + [5, None], sources + [sources[5], "hot"])
    plan, got = Counter(), Counter()
    for r in source_mix(docs, shards=4).collect():
        plan[r["doc_id"]] += r["taken"]
    out = draw_mix(docs, shards=4)
    assert out.columns == docs.columns + ["mix_shard"]
    for r in out.collect():
        got[r["doc_id"]] += count(r["text"])
        assert r["doc_id"] is None or texts[r["doc_id"]].startswith(r["text"])
    assert {k: v for k, v in plan.items() if v} == dict(got)


def test_mix_of_no_rows(make_docs):
    assert source_mix(make_docs([])).collect() == [] and draw_mix(make_docs([])).collect() == []
    assert [r["taken"] for r in source_mix(make_docs([None, ""])).collect()] == [0, 0]


def test_shards_are_even_and_keep_equal_texts_together(make_docs):
    rnd = random.Random(2)
    texts = [None, "", ""] + [words(rnd, rnd.randrange(1, 40)) for _ in range(700)]
    texts += [texts[rnd.randrange(3, 700)] for _ in range(80)] + ["a hot text"] * 300
    rows = balanced_shards(make_docs(texts), shards=8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    load, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[raw].add(r["shard"])
    mean = sum(load.values()) / 8
    assert len(load) == 8 and max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    together = Counter(t for t in texts if t)
    assert sum(len(groups[t.encode()]) == 1 for t, n in together.items() if n > 1) >= 0.9 * sum(n > 1 for n in together.values())


def test_shards_of_odd_tables(make_docs):
    assert balanced_shards(make_docs([])).collect() == []
    rows = balanced_shards(make_docs(["x", "x", None, "y" * 10_000], [None, None, 4, 4]), shards=3).collect()
    assert len(rows) == 4 and all(0 <= r["shard"] < 3 for r in rows)
