import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helpers import words
from panelspark.llm.packing import FreeSpace, first_fit_decreasing, pack_documents, word_tokenizer
from panelspark.llm.token_counts import _count, edited_counts, trees
from panelspark.llm.tokens import UnitTokenizer

ODD = [None, "", " ", "It's a test... don't!! ''quoted'' x'.", "Foo<|endoftext|>bar <|endoftext|>. a|>", "é. É, ç!", "a b. c　d",
       "naïve… “q”.", "é. x́.", "5.6 $5.00! (a)b).", "ΣΑΣ. Σ", ".'s 's.", "I'LL. WE'RE!", "a" * 30_000, "日本語。 テスト"]


@pytest.fixture(scope="module")
def model():
    return UnitTokenizer.of(word_tokenizer())


def whole(model, text):
    return model.model.encode(text or "", add_special_tokens=False).ids


def test_units_give_the_ids_of_whole_texts(model):
    texts = ODD + [words(random.Random(i), 300) for i in range(5)]
    got = []
    for ids, off in model.encode(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    assert got == [whole(model, t) for t in texts]


def test_cache_is_emptied_without_harm(model, monkeypatch):
    monkeypatch.setattr("panelspark.llm.tokens.MOST_UNITS", 50)
    test_units_give_the_ids_of_whole_texts(model)


@pytest.mark.parametrize("most", [1, 3, 20])
def test_a_text_with_more_units_than_the_cache_may_hold(monkeypatch, most):
    monkeypatch.setattr("panelspark.llm.tokens.MOST_UNITS", most)
    model = UnitTokenizer(word_tokenizer())
    texts = ["u1 u2", words(random.Random(5), 400), "u2 u3. u1", words(random.Random(6), 400), ""]
    for t in texts + texts[::-1]:  # the cache is warm from the second on
        (ids, off), = model.encode(pa.array([t]))
        assert ids.tolist() == whole(model, t) and off.tolist() == [0, len(ids)]
    assert _count(model, texts) == [len(whole(model, t)) for t in texts]


def test_spellings_of_a_special_token_in_any_order():
    texts = ["a <|endoftext|> b", "A <|ENDOFTEXT|> B", "x<|EndOfText|>y.", "X<|endoftext|>Y.", "<", "|>"]
    for order in (texts, texts[::-1]):
        fresh = UnitTokenizer(word_tokenizer())
        got = []
        for ids, off in fresh.encode(pa.array(order)):
            got += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
        assert got == [whole(fresh, t) for t in order]
        for t in order[::-1]:
            (ids, _), = fresh.encode(pa.array([t]))
            assert ids.tolist() == whole(fresh, t)


def test_first_fit_takes_the_first_bin_with_room():
    free = FreeSpace(3, 10)
    assert [free.take_first(n) for n in (6, 6, 4, 5, 4)] == [0, 1, 0, 2, 1]
    with pytest.raises(ValueError):
        free.take_first(6)


@pytest.mark.parametrize("seed", range(20))
def test_items_are_cut_only_into_gaps(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(0, 99), rnd.randint(0, 5), rnd.randint(70, 99)]) for _ in range(rnd.randint(0, 200))]
    bins = first_fit_decreasing(sizes, 100)
    parts = defaultdict(list)
    for b in bins:
        assert 0 < sum(n for _, _, n in b) <= 100
        for i, at, n in b:
            parts[i].append((at, n))
    for i, size in enumerate(sizes):
        at = 0
        for start, n in sorted(parts[i]):
            assert start == at and n > 0
            at += n
        assert at == size
    assert len(bins) == -(-sum(sizes) // 100)


@pytest.mark.parametrize("group_bytes", [8 << 20, 2000])
def test_packing_is_an_exact_round_trip(make_docs, model, group_bytes):
    texts = ODD + [words(random.Random(i), 10 ** (i % 4)) for i in range(30)]
    rows = pack_documents(make_docs(texts), word_tokenizer(), size=256, group_bytes=group_bytes, with_ids=True).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    for i, t in enumerate(texts):
        ids = whole(model, t) + [2]
        assert sum((r["ids"] for r in sorted(docs[i], key=lambda r: r["start"])), []) == ids
        assert {r["doc_tokens"] for r in docs[i]} == {len(ids)}
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len(seqs) * 256 - sum(r["length"] for r in rows) < 256 * len({s >> 32 for s in seqs})


def test_packing_repeated_rows_missing_ids_and_no_rows(make_docs):
    out = pack_documents(make_docs(["a b", "a b", None, "c"], [1, 1, None, None]), word_tokenizer())
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in out.collect()) == [("1", 3), ("1", 3), ("None", 1), ("None", 2)]
    assert pack_documents(make_docs([]), word_tokenizer()).collect() == []


def test_edits_equal_encoding_anew(model):
    rnd = random.Random(7)
    texts = [t or "" for t in ODD if t is None or len(t) < 1000] + [words(rnd, 80) for _ in range(5)] + ["  a b ", "x\n\ny"]
    for group in trees(model, pa.array(texts)):
        for tree in group:
            now = tree.text
            for _ in range(15):
                a = rnd.randint(0, len(now) + 2)
                b = a + rnd.choice([0, 0, 1, 3, 10, 60])
                new = rnd.choice(["", " ", "x", "foo bar", "\n", "é. ", "'s", "don't", "  ", now[:30]])
                first, last, text = tree.touch(a, b, new)
                tree.put(first, last, text, _count(model, [text])[0])
                at = min(a, len(now))
                now = now[:at] + new + now[max(at, min(b, len(now))):]
                assert (tree.current(), tree.tokens, tree.chars) == (now, len(whole(model, now)), len(now))


def test_edited_counts(spark, model):
    rows = [(1, "one two three", [(4, 7, "2 2"), (0, 0, "zero "), None, (10 ** 9, 10 ** 9, " end")]), (2, None, [(0, 5, "new")]), (3, "same", None), (None, "", []),
            (1, "one two three", [(None, None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,stop:long,insert:string>>")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["edited_chars"], r["edited_tokens"]) for r in edited_counts(docs, word_tokenizer()).collect())
    n = lambda t: len(whole(model, t))
    assert got == sorted([("1", n("one two three"), 22, n("zero one 2 2 three end")), ("2", 0, 3, n("new")), ("3", n("same"), 4, n("same")), ("None", 0, 0, 0),
                          ("1", n("one two three"), 13, n("one two three"))])
    assert edited_counts(docs.limit(0), word_tokenizer()).collect() == []
