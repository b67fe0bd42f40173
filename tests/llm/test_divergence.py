import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelspark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    df, hits, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = TERM.findall(text.translate(lower))
        groups.add((lang, source))
        df.update((lang, w) for w in set(words))
        hits[lang, source].update(words)
        hits[lang].update(words)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), n in df.items() if g == lang and n >= min_docs]

        def share(h):
            total = sum(h[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (h[w] + 5) // total for w in kept}

        q, sources = share(hits[lang]), [s for g, s in groups if g == lang]
        p = {s: share(hits[lang, s]) for s in sources}
        for s in sources:
            pair = sorted(((-sum(abs(p[s][w] - p[u][w]) for w in kept), u.encode()) for u in sources if u != s))
            term = sorted((q[w] - p[s][w], w.encode()) for w in kept if hits[lang, s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, found in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def rows_of(n=220):
    rnd = random.Random(4)
    vocab = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Äpfel", "éa", "文字", "K", "k", "x" * 300]
    rows = [(None, "en", "a"), ("", "en", "b"), ("1 2 3", None, None), ("lone text", "zz", "only"), ("tie tie", "en", None)]
    for i in range(n):
        lang = rnd.choice(["en", "en", "de", None])
        source = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c", "é", "z\U0001F600", ""])
        words = [rnd.choice(vocab[rnd.randrange(60):]) for _ in range(rnd.randrange(60))]
        rows.append((rnd.choice([" ", "-", "1", "\n"]).join(w.upper() if rnd.random() < 0.2 and w.isascii() else w for w in words), lang, source))
    return rows + rows[-4:] * 3


@pytest.mark.parametrize("sizes", [{}, {"shard_terms": 16, "bundle_bytes": 300, "tile": 2, "dense_slots": 64}])
def test_equals_brute_force(spark, sizes):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, p int, term string")
    got = sorted(tuple(r) for r in D.divergence(docs, min_docs=8, top=7, **sizes).collect())
    want = brute(rows, 8, 7)
    assert got == want and {r[2] for r in want} == {"pair", "term"}


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_equal_hashes_are_told_apart(monkeypatch):
    keys = [f"k{i}" for i in range(700)]
    hashes = D._term_hash([k.encode() for k in keys])
    few = hashes % np.uint64(64)  # most keys share their hash with others
    for h in (hashes, few):
        levels, slots = D.build_hash(h)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        bits = np.concatenate(levels)
        terms = [keys[i] for i in slots]
        found = D.TermSlots([("l", 0, 1, np.array([len(x) for x in levels], np.int64).tobytes(), np.packbits(bits).tobytes(), terms)])
        asked = keys + ["stranger", "k701", "k"]
        low = np.frombuffer("".join(asked).encode(), np.uint8)
        size = np.array([len(k) for k in asked])
        h = np.concatenate([h, h[:3]])  # strangers with a key's hash
        got = found.find(np.zeros(len(asked), np.int64), h, low, np.cumsum(size) - size, size)
        assert [terms[i] for i in got[:700]] == keys and (got[700:] == -1).all()


def test_terms_with_one_hash_are_counted_apart():
    low = np.frombuffer(b"aabbaabb", np.uint8)
    start, size = np.array([0, 2, 4, 6]), np.array([2, 2, 2, 2])
    term, first = D.distinct_terms(low, start, size, np.zeros(4, np.int64), np.zeros(4, np.uint64))
    assert term.tolist() == [0, 1, 0, 1] and first.tolist() == [0, 1]


def test_query_and_sql_agree(spark, tmp_path):
    import duckdb
    from panelspark.llm.queries import ORACLES, QUERIES
    rows = rows_of(400)
    spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["op11_divergence"](spark, str(tmp_path))
    want = con.execute(ORACLES["op11_divergence"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) == brute(rows, 30, 50)


def test_recount_sends_one_row_a_shard():
    """A task sent one row for every slot of every source, which cost more than the counting."""
    import types

    import pyarrow as pa

    from panelspark.llm import divergence as D
    texts = ["alpha beta gamma", "beta beta delta", "gamma alpha x"]
    built = [D._build((pa.scalar("en"), pa.scalar(sub)), pa.table({"term": terms})).to_pylist()[0] for sub, terms in enumerate([["alpha", "beta", "gamma", "delta"]])]
    shared = types.SimpleNamespace(value=[(r["lang"], r["sub"], 1, r["sizes"], r["bits"], r["terms"]) for r in built])
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a", "a", "b"], "text": texts})
    out = pa.Table.from_batches(list(D._recount(shared, 1 << 20)([batch])))
    assert out.num_rows == 2  # one shard, two sources
    terms = built[0]["terms"]
    found = {}
    for r in range(2):
        at, n = D._sum_of(out.slice(r, 1))
        found[out.column("source")[r].as_py()] = {terms[i]: int(k) for i, k in zip(at, n)}
    assert found == {"a": {"alpha": 1, "beta": 3, "gamma": 1, "delta": 1}, "b": {"alpha": 1, "gamma": 1}}
    # of one source, by two tasks
    at, n = D._sum_of(pa.concat_tables([out, out]).filter(pa.array([True, False, True, False]) if out.column("source")[0].as_py() == "a" else pa.array([False, True, False, True])))
    assert {terms[i]: int(k) for i, k in zip(at, n)} == {"alpha": 2, "beta": 6, "gamma": 2, "delta": 2}
