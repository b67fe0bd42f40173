"""Packing of documents into sequences: first-fit decreasing on a tournament tree, in randomised groups.

Each group of documents (a few MB, dealt by a hash) is packed alone, so a group is the unit of work and of recovery. A
document's full sequences are cut off first. What remains of each, longest first, goes into the first sequence
with room, found by descending a tournament tree of the sequences' free space. At last the emptiest sequences
are poured, cut as needed, into the gaps of the others, so at most one sequence of a group is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import read_table
from panelspark.llm.tokens import UnitTokenizer

GROUP_BYTES = 8 << 20


class FreeSpace:
    """Tournament tree over bins: each inner node knows the largest free space below it."""

    def __init__(self, bins: int, space: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.tree = [0] * (2 * self.leaves)
        for i in range(bins):
            self.tree[self.leaves + i] = space
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def take_first(self, need: int) -> int:
        """Take ``need`` from the first bin that has it; the bin's number."""
        i = 1
        if self.tree[1] < need:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] >= need else 2 * i + 1
        bin_ = i - self.leaves
        self.tree[i] -= need
        while i > 1:
            i //= 2
            top = max(self.tree[2 * i], self.tree[2 * i + 1])
            if self.tree[i] == top:
                break
            self.tree[i] = top
        return bin_


def first_fit_decreasing(sizes: list[int], space: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) for items of at most ``space``; ties go by item number, gaps are filled by cutting."""
    free = FreeSpace(len(sizes), space)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i]:
            bins.setdefault(free.take_first(sizes[i]), []).append((i, 0, sizes[i]))
    out = list(bins.values())
    gaps = [space - sum(n for _, _, n in b) for b in out]
    order = sorted((k for k in range(len(out)) if gaps[k]), key=lambda k: (gaps[k], k))
    total = sum(gaps)
    lo = 0
    while len(order) - lo > 1:
        donor = order[-1]
        if total - gaps[donor] < space - gaps[donor]:
            break
        order.pop()
        total -= space
        for i, at, n in out[donor]:
            while n:
                while not gaps[order[lo]]:
                    lo += 1
                k = order[lo]
                put = min(n, gaps[k])
                out[k].append((i, at, put))
                gaps[k] -= put
                at, n = at + put, n - put
        out[donor] = []
    return [b for b in out if b]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, group_bytes: int = GROUP_BYTES,
                   seed: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids array<int>]) of all documents.

    A document is its ids by the tokenizer file (no special tokens added) and ``end_id``; a null text is empty, so it is
    the end id alone. Every id lies in exactly one piece; a sequence has at most ``size`` ids, its pieces without
    gaps from offset 0. Rows are packed one by one, repeated or not, and a null doc_id stays null. Groups and
    sequences depend on doc_id, text, ``seed`` and the number of groups, which the bytes of the whole table give; rows that
    agree in both doc_id and text share a group. sequence_id is the group's number times 2^32 plus a number within.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 8)).first()[0] or 0
    groups = max(1, -(-int(total) // group_bytes))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("g", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = UnitTokenizer.of(tokenizer)
        parts, counts = [], []
        for ids, off in model.encode(t.column("text")):
            n = np.diff(off)
            parts.append(np.insert(ids, off[1:], end_id).astype("<u4"))
            counts.append(n + 1)
        ids, n = np.concatenate(parts), np.concatenate(counts)
        first = np.cumsum(n) - n
        rows = []  # document, start, length, sequence, offset
        seq = 0
        for d in np.flatnonzero(n >= size).tolist():
            for k in range(int(n[d]) // size):
                rows.append((d, k * size, size, seq, 0))
                seq += 1
        whole = (n // size * size).tolist()
        for b in first_fit_decreasing((n % size).tolist(), size):
            at = 0
            for d, start, length in b:
                rows.append((d, whole[d] + start, length, seq, at))
                at += length
            seq += 1
        d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows))
        pieces = [ids[first[i] + s:first[i] + s + k] for i, s, k in zip(d, start, length)]
        base = t.column("g")[0].as_py() << 32
        cols = {"doc_id": t.column("doc_id").take(pa.array(d)), "start": pa.array(start), "length": pa.array(length),
                "ids_crc32": pa.array(np.array([zlib.crc32(p.tobytes()) for p in pieces], np.int64)), "doc_tokens": pa.array(n[d].astype(np.int64)),
                "sequence_id": pa.array(sequence + base), "offset": pa.array(offset)}
        if with_ids:
            cols["ids"] = pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))
        return pa.table(cols)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return table.groupBy("g").applyInArrow(run, ddl + (", ids array<int>" if with_ids else ""))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), word_tokenizer())
