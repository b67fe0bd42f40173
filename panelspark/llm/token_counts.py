"""Edit-aware token counts: a segment tree over each document's pre-tokens.

A leaf is one word with the white space before it; the tokenizer never joins characters across white space, so leaves are
counted alone. Every node has the characters and tokens below it. An edit finds its leaves by descending the character
sums, re-encodes only their text (and the leaf before, if the edit took the white space that parted them), and updates the
sums on the paths to the root. The replaced text stays in the first leaf touched; the others become empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import chunks, read_table, text_bytes, word_spans
from panelspark.llm.packing import word_tokenizer
from panelspark.llm.tokens import UnitTokenizer

_SPACE = " \t\n\x0b\x0c\r"


class PreTokenTree:
    """Levels of (characters, tokens) sums over leaves; ``texts`` holds the leaves that were edited."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        width = 1 << max(len(chars) - 1, 0).bit_length()
        self.text, self.texts = text, {}
        self.first = np.concatenate([[0], np.cumsum(chars)])
        base = np.zeros((2, width), np.int64)
        base[0, :len(chars)], base[1, :len(tokens)] = chars, tokens
        self.levels = [base]
        while base.shape[1] > 1:
            base = base[:, ::2] + base[:, 1::2]
            self.levels.append(base)

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][1, 0])

    def leaf(self, at: int) -> tuple[int, int]:
        """The leaf with the character ``at`` and the characters before that leaf; past the end, the last one with any."""
        at = max(0, min(at, self.chars - 1))
        node, before = 0, 0
        for level in self.levels[-2::-1]:
            node *= 2
            left = int(level[0, node])
            if at - before >= left:
                before += left
                node += 1
        return node, before

    def text_of(self, leaf: int) -> str:
        if leaf in self.texts or leaf >= len(self.first) - 1:
            return self.texts.get(leaf, "")
        return self.text[self.first[leaf]:self.first[leaf + 1]]

    def touch(self, start: int, stop: int, insert: str) -> tuple[int, int, str]:
        """Leaves (first, last) that the edit touches and the text that replaces theirs. Offsets past the end mean the end."""
        start = max(0, min(start, self.chars))
        stop = max(start, min(stop, self.chars))
        first, before = self.leaf(start)
        last = self.leaf(stop - 1)[0] if stop > start else first
        old = "".join(self.text_of(i) for i in range(first, last + 1))
        new = old[:start - before] + insert + old[stop - before:]
        while before and new[:1] not in _SPACE or before and not new:
            left, at = self.leaf(before - 1)
            new = self.text_of(left) + new
            first, before = left, at
            if new[:1] and new[:1] in _SPACE:
                break
        return first, max(first, last), new

    def put(self, first: int, last: int, text: str, tokens: int) -> None:
        """Replace the leaves by ``text`` and update the sums above them."""
        base = self.levels[0]
        base[:, first:last + 1] = 0
        base[:, first] = len(text), tokens
        for i in range(first, last + 1):
            self.texts[i] = ""
        self.texts[first] = text
        for below, level in zip(self.levels, self.levels[1:]):
            first, last = first // 2, last // 2
            level[:, first:last + 1] = below[:, 2 * first:2 * last + 2:2] + below[:, 2 * first + 1:2 * last + 2:2]

    def current(self) -> str:
        return "".join(self.text_of(i) for i in range(self.levels[0].shape[1]))


def trees(model: UnitTokenizer, column):
    """A tree for each text of an Arrow column, chunk by chunk (lists of trees)."""
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        part, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, docs = word_spans(part, off)
        unit_start, _, _, _, n = model.counts(part, off)
        sums = np.concatenate([[0], np.cumsum(n)])
        word_unit = np.searchsorted(unit_start, np.append(starts, len(part) + 1))
        tokens = np.diff(sums[word_unit])
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        out = []
        for d in range(hi - lo):
            a, b = docs[d], docs[d + 1]
            text = bytes(part[off[d]:off[d + 1]]).decode("utf-8", "replace")
            if b > a:
                edges = np.concatenate([[off[d]], ends[a:b - 1], [off[d + 1]]])
                sizes = np.diff(chars[edges])
                if sizes.sum() != len(text):  # bytes that are no UTF-8: count what the decoder made of them
                    text_words = [bytes(part[x:y]).decode("utf-8", "replace") for x, y in zip(edges[:-1], edges[1:])]
                    text, sizes = "".join(text_words), np.array([len(w) for w in text_words])
                out.append(PreTokenTree(text, sizes, tokens[a:b]))
            else:
                out.append(PreTokenTree(text, np.array([len(text)]), np.array([0])))
        yield out


def _count(model: UnitTokenizer, texts: list[str]) -> list[int]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    _, _, docs, _, n = model.counts(np.frombuffer(b"".join(raw), np.uint8), off)
    sums = np.concatenate([[0], np.cumsum(n)])
    return np.diff(sums[docs]).tolist()


def edited_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text, edits array<struct<start, stop, insert>>) -> doc_id, n_chars, n_tokens, n_segments (leaves), edited_chars,
    edited_tokens, reencoded_chars.

    Edits apply in order, each to the text as the ones before left it: the code points [start, stop) give way to insert.
    Offsets beyond the end mean the end; a null offset means 0, a null insert nothing, a null edit or null list no
    edit. Null texts are empty. Rows are counted one by one, repeated or not; a null doc_id stays null.
    """
    def run(batches):
        model = UnitTokenizer.of(tokenizer)
        for batch in batches:
            edits, at, rows = batch.column("edits").to_pylist(), 0, []
            for group in trees(model, batch.column("text")):
                todo = [[e for e in (edits[at + i] or []) if e is not None] for i in range(len(group))]
                was = [(t.chars, t.tokens, len(t.first) - 1) for t in group]
                again = [0] * len(group)
                # the n-th edits of all documents of a chunk are encoded together
                for k in range(max(map(len, todo), default=0)):
                    who = [i for i in range(len(group)) if len(todo[i]) > k]
                    places = [group[i].touch(todo[i][k]["start"] or 0, todo[i][k]["stop"] or 0, todo[i][k]["insert"] or "") for i in who]
                    for i, (first, last, text), n in zip(who, places, _count(model, [p[2] for p in places])):
                        group[i].put(first, last, text, n)
                        again[i] += len(text)
                rows += [(*w, t.chars, t.tokens, r) for w, t, r in zip(was, group, again)]
                at += len(group)
            cols = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(cols[:, c])) for c in range(6)]],
                                             names=["doc_id", "n_chars", "n_tokens", "n_segments", "edited_chars", "edited_tokens", "reencoded_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.col("edits").cast("array<struct<start:bigint,stop:bigint,insert:string>>").alias("edits"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_segments long, edited_chars long, edited_tokens long, reencoded_chars long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Three edits of every document: 20 code points at a quarter give way to 30 from the middle, 25 after the middle go, and
    a line break with the first 40 is added at the end."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = F.length("text")
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), t.alias("insert"))
    quarter, middle = F.floor(n / 4), F.floor(n / 2)
    edits = F.array(edit(quarter, quarter + 20, F.substring("text", (middle + 1).cast("int"), F.lit(30))), edit(middle, middle + 25, F.lit("")),
                    edit(F.lit(2**62), F.lit(2**62), F.concat(F.lit("\n"), F.substring("text", F.lit(1), F.lit(40)))))
    return edited_counts(docs.withColumn("edits", edits), word_tokenizer())
