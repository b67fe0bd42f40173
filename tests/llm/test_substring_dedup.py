import hashlib
import random

import numpy as np
import pytest

from panelspark.llm.common import chunks
from panelspark.llm.substring_dedup import COVER, PERIOD, Net, _anchors, _Shape, _words, cover_ranks, remove_repeated_strings, sort_suffixes


def brute(rows, length=50):
    """rows: (doc_id or None, text) -> per row: removed byte ranges, kept bytes."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = {}, {}
    for i in order:
        d = float("inf") if rows[i][0] is None else rows[i][0]
        b = (rows[i][1] or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            seen[w] = min(d, seen.get(w, d))
    for i, (d, t) in enumerate(rows):
        d = float("inf") if d is None else d
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] < d:
                cover[s] += 1
                cover[s + length] -= 1
        c = np.cumsum(cover)[:-1] > 0
        edge = np.diff(np.concatenate([[0], c.astype(int), [0]]))
        out[i] = (list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())), np.frombuffer(b, np.uint8)[~c].tobytes())
    return out


def hard_rows():
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    texts = [None, "", "short", passage, passage, "The " * 200, "x" * 49, "x" * 50, "x" * 51, "y" + "The " * 100 + "z", "äöü" * 40, "ä" + "öäü" * 40]
    for _ in range(25):
        a = rnd.randrange(300)
        texts.append("".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(200))) + passage[a:a + rnd.randrange(100)]
                     + "a frequent line that many share, 40 b\n" + "".join(rnd.choice("abc") for _ in range(rnd.randrange(200))))
    return texts, rnd


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 700, "hot_pieces": 4, "sort_block": 600}, {"group_bytes": 500, "hot_pieces": 4, "fan": 3}])
def test_ranges_equal_brute_force(make_docs, sizes):
    texts, rnd = hard_rows()
    ids = rnd.sample(range(10 ** 12), len(texts))
    rows = list(zip(ids, texts)) + [(ids[3], texts[4]), (None, texts[3]), (None, "n" * 60), (None, "n" * 60)]
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    out = remove_repeated_strings(docs, **sizes)
    assert [c for c in out.columns if c not in ("removed_starts", "removed_ends", "kept")] == [c for c in docs.columns if c != "text"]
    got = sorted((str(r["doc_id"]), list(zip(r["removed_starts"], r["removed_ends"])), bytes(r["kept"])) for r in out.collect())
    want = brute(rows)
    assert got == sorted((str(d), *want[i]) for i, (d, _) in enumerate(rows))


def test_text_loses_whole_characters(make_docs):
    line = "äöü" * 30  # the shared strings may start and end inside a character
    docs = make_docs(["1" + line, "é" + line + "ß"], [1, 2])
    got = {r["doc_id"]: r["kept"] for r in remove_repeated_strings(docs, as_text=True).collect()}
    # the first byte of the closing letter goes with a shared string, so the letter goes
    assert got == {1: "1" + line, 2: "é"}


def test_empty_table(make_docs):
    assert remove_repeated_strings(make_docs([])).collect() == []


def test_suffix_order_is_complete_to_sixty_three_bytes():
    rnd = random.Random(2)
    raw = bytes(rnd.choice(b"ab") for _ in range(300)) + b"ab" * 100 + b"a" * 120
    data = np.frombuffer(raw, np.uint8)
    words = _words(np.concatenate([data, np.zeros(2 * PERIOD + 72, np.uint8)]))
    ranks = cover_ranks(words, len(data))
    padded = raw + b"\0" * 200
    got = sort_suffixes(words, ranks, np.arange(len(raw)), full=True).tolist()
    keys = [padded[i:i + 63] for i in got]
    assert keys == sorted(keys)
    assert all(any((a - b) % PERIOD == d for a in COVER for b in COVER) for d in range(PERIOD))


def test_chunks_cover_all_documents():
    off = np.array([0, 0, 5, 5, 100, 101, 101])
    assert [r for r in chunks(off, 10)] == [(0, 3), (3, 4), (4, 6)]


def test_query_digest(spark, tmp_path, make_docs):
    from panelspark.llm.queries import QUERIES
    texts, _ = hard_rows()
    make_docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op5_substring_dedup"](spark, str(tmp_path)).collect()}
    for i, (ranges, kept) in brute(list(enumerate(texts))).items():
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len((texts[i] or "").encode()), sum(b - a for a, b in ranges), len(ranges))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("fan", [3, 128])
def test_rows_grow_with_the_groups(fan):
    for groups in (60, 240):  # four times the groups: a task still sends at most fan rows, and tasks grow with the groups
        net = Net(groups, fan)
        g, b = (x.ravel() for x in np.meshgrid(np.arange(groups), np.arange(net.buckets)))
        assert np.array_equal(net.key(0, b, g), g) and np.array_equal(net.key(net.hops, b, g), b)
        for level in range(net.hops):
            pairs = np.unique(np.stack([net.key(level, b, g), net.key(level + 1, b, g)]), axis=1)
            tasks, sent = np.unique(pairs[0], return_counts=True)
            assert sent.max() <= fan and len(tasks) <= 2 * groups


def test_anchor_runs_do_not_depend_on_blocks():
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcd ") for _ in range(200_000)).encode()
    shape = _Shape(50)
    first, last, anchor, _ = _anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shape)
    assert first[0] == 0 and last[-1] == len(text) - 50 and np.array_equal(first[1:], last[:-1] + 1)
    # the same bytes elsewhere have the same anchors
    cut = 70_000
    f2, l2, a2, _ = _anchors(np.frombuffer(text[cut:], np.uint8), np.array([0, len(text) - cut]), shape)
    both = {(int(x) - cut, int(y) - cut, int(z)) for x, y, z in zip(first, last, anchor) if x >= cut}
    assert both <= set(zip(f2.tolist(), l2.tolist(), a2.tolist())) and len(both) > 5000
