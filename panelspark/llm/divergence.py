"""Source divergence audit: how far the words of each source lie from those of the other sources of its language.

1. Exact frequency filter: each task reports the documents per (lang, term) of its texts, equal bytes told apart from
   equal hashes; Spark adds them up and keeps the terms in ``min_docs`` documents or more.
2. The kept terms are dealt by hash into shards of a few thousand. Each shard's minimal perfect hash is a cascade of bit
   arrays: a key whose place in a level nobody else wants is settled there, the others try the next level; the rank of
   the set bit is the key's slot. Keys are stored by slot, as a perfect hash answers for strangers too.
3. Recount: bundles of shards, each of at most ``bundle_bytes``, are broadcast one after the other. A task looks up each
   distinct term of a chunk once, compares it with the stored key, and adds the occurrences to one dense array of slots
   per (lang, source). Slots that are not 0 leave the task as one row a (lang, source, shard); these are added up by groups.
4. Sources are compared in tiles of at most about 256 sources by one shard of terms; sums over shards are Spark's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import chunks, mix, prefix_hash, read_table, scratch_table, segments_of, span_hash, text_bytes, word_spans

SHARD_TERMS = 4096
BUNDLE_BYTES = 64 << 20
TILE = 256
PART_BYTES = 1 << 20
DENSE_SLOTS = 4 << 20
GAMMA = 1.5
MOST_LEVELS = 40

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- terms of a chunk of texts --------------------------------------------------------------------------------------

def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(start, size) + segments_of(size)]


def distinct_terms(low: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, first): the number of each occurrence's term among the distinct (code, bytes), and one occurrence of each.

    Hashes only sort: where one covers different bytes, the terms are told apart by their bytes.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = h + code.astype(np.uint64) * _STEP
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], np.diff(h[order]) != 0])
    first = order[new]
    term = np.empty(len(h), np.int64)
    term[order] = np.cumsum(new) - 1
    lead = first[term]
    same = bool((size == size[lead]).all() and (code == code[lead]).all())
    if same and np.array_equal(_gather(low, start, size), _gather(low, start[lead], size)):
        return term, first
    seen: dict = {}
    term = np.array([seen.setdefault((int(c), low[s:s + n].tobytes()), len(seen)) for c, s, n in zip(code, start, size)], np.int64)
    return term, np.unique(term, return_index=True)[1]


def _terms(texts, codes: np.ndarray):
    """Per chunk of texts: lower-cased bytes, start, size, text number and hash of every term."""
    data, offsets = text_bytes(texts)
    for lo, hi in chunks(offsets, PART_BYTES):
        part, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        s, e, words = word_spans(part, off, ~_LETTER)
        doc = lo + np.repeat(np.arange(hi - lo), np.diff(words))
        yield _LOWER[part], s, e - s, doc, codes[doc], span_hash(prefix_hash(part, lower=True), s, e)


def _strings(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    wide = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(_gather(low, start, size).tobytes())])
    return wide.cast(pa.string())


def _codes(column) -> tuple[np.ndarray, pa.Array]:
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _frequencies(batches):
    """(lang, term, docs) of each chunk: how many of its texts have the term."""
    for batch in batches:
        codes, langs = _codes(batch.column("lang"))
        for low, start, size, doc, code, h in _terms(batch.column("text"), codes):
            term, first = distinct_terms(low, start, size, code, h)
            order = np.argsort(term, kind="stable")  # texts ascend within a term
            t, d = term[order], doc[order]
            docs = np.bincount(t[np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])], minlength=len(first)) if len(t) else t
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(code[first])), _strings(low, start[first], size[first]), pa.array(docs, pa.int64())],
                                             names=["lang", "term", "docs"])


# ---- minimal perfect hashes -----------------------------------------------------------------------------------------

def _place(h: np.ndarray, level: int, size) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * int(_STEP) % 2**64)) % np.asarray(size, np.uint64)).astype(np.int64)


def build_hash(h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits for the key hashes, and the keys in order of their slots; keys of one hash come last, found by their bytes."""
    rest, levels, slots = np.arange(len(h)), [], []
    while len(rest) and len(levels) < MOST_LEVELS:
        size = max(8, int(np.ceil(GAMMA * len(rest))))
        at = _place(h[rest], len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        own = bits[at]
        slots.append(rest[own][np.argsort(at[own])])
        levels.append(bits)
        rest = rest[~own]
    return levels, np.concatenate([*slots, rest]) if len(h) else rest


def _term_hash(keys: list[bytes]) -> np.ndarray:
    size = np.array([len(k) for k in keys], np.int64)
    end = np.cumsum(size)
    return span_hash(prefix_hash(np.frombuffer(b"".join(keys), np.uint8)), end - size, end)


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row for a shard: its terms in order of their slots, and the levels' sizes and bits."""
    terms = sorted(set(table.column("term").to_pylist()))
    levels, slots = build_hash(_term_hash([t.encode() for t in terms]))
    terms = [terms[i] for i in slots]
    bits = np.concatenate([*levels, np.zeros(0, bool)])
    nbytes = sum(len(t.encode()) + 8 for t in terms) + len(bits)
    return pa.table({"lang": [key[0].as_py()], "sub": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([len(terms)], pa.int64()), "nbytes": pa.array([nbytes], pa.int64()),
                     "sizes": pa.array([np.array([len(x) for x in levels], np.int64).tobytes()], pa.binary()),
                     "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "terms": pa.array([terms], pa.list_(pa.string()))})


class TermSlots:
    """The perfect hashes of a bundle of shards, flat: (lang, term) -> number of the term in the bundle, -1 for others."""

    def __init__(self, shards: list[tuple[str, int, int, bytes, bytes, list[str]]]):
        """shards: (lang, sub, shards of the lang, sizes, bits, terms)."""
        self.first, self.of, sizes, bits, keys, counts = {}, {}, [], [], [], []
        for i, (lang, sub, subs, size, packed, terms) in enumerate(shards):
            self.of.setdefault(lang, (subs, {}))[1][sub] = i
            size = np.frombuffer(size, np.int64)
            sizes.append(size)
            bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=int(size.sum())))
            keys += [t.encode() for t in terms]
            counts.append(len(terms))
        self.levels = max((len(s) for s in sizes), default=0)
        self.size = np.zeros((len(shards), self.levels), np.int64)
        for i, s in enumerate(sizes):
            self.size[i, :len(s)] = s
        whole = np.cumsum([0, *[int(s.sum()) for s in sizes]])[:-1]
        self.start = whole[:, None] + np.cumsum(self.size, axis=1) - self.size if len(shards) else self.size
        self.bits = np.concatenate([*bits, np.zeros(0, np.uint8)])
        rank = np.cumsum(self.bits, dtype=np.int64) - self.bits
        self.base = np.cumsum([0, *counts])
        # the rank of a set bit within its shard, counted on from the shard's first term
        set_before = np.concatenate([rank, [int(self.bits.sum(dtype=np.int64))]])
        self.number = rank + np.repeat(self.base[:-1] - set_before[whole], [int(s.sum()) for s in sizes]) if len(shards) else rank
        self.key_size = np.array([len(k) for k in keys], np.int64)
        self.key_start = np.cumsum(self.key_size) - self.key_size
        self.keys = np.frombuffer(b"".join(keys), np.uint8)
        settled = self.base[:-1] + np.array([int(b.sum()) for b in bits], np.int64) if len(shards) else self.base[:-1]
        self.extra = {(i, keys[j]): j for i in range(len(shards)) for j in range(settled[i], self.base[i + 1])}

    def __len__(self):
        return int(self.base[-1])

    def shard(self, langs: list[str], code: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Each term's shard in the bundle, or -1."""
        out = np.full(len(h), -1, np.int64)
        for c, lang in enumerate(langs):
            if lang in self.of:
                subs, known = self.of[lang]
                table = np.full(subs, -1, np.int64)
                table[list(known)] = list(known.values())
                own = code == c
                out[own] = table[(h[own] % np.uint64(subs)).astype(np.int64)]
        return out

    def find(self, shard: np.ndarray, h: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(shard >= 0)
        for level in range(self.levels):
            left = left[self.size[shard[left], level] > 0]
            if not len(left):
                break
            at = self.start[shard[left], level] + _place(h[left], level, self.size[shard[left], level])
            hit = self.bits[at] > 0
            out[left[hit]] = self.number[at[hit]]
            left = left[~hit]
        # a stranger has a slot too: only the stored key counts
        found = np.flatnonzero(out >= 0)
        found = found[self.key_size[out[found]] == size[found]]
        n = size[found]
        if len(n):
            differ = _gather(low, start[found], n) != _gather(self.keys, self.key_start[out[found]], n)
            right = np.add.reduceat(differ, np.cumsum(n) - n) == 0
            found = found[right]
        kept = np.full(len(h), -1, np.int64)
        kept[found] = out[found]
        if self.extra:
            for i in np.flatnonzero((kept < 0) & (shard >= 0)):
                kept[i] = self.extra.get((int(shard[i]), low[start[i]:start[i] + size[i]].tobytes()), -1)
        return kept


_COUNTED = "lang string, source string, sub long, slots binary, ns binary"
ADDED_AT_ONCE = 64


def _counted(lang: list, source: list, sub: list, slots: list, ns: list) -> pa.RecordBatch:
    """One row a (lang, source, shard): the slots that occur and how often, as bytes."""
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(sub, pa.int64()),
                                       pa.array([x.astype(np.int32).tobytes() for x in slots], pa.binary()), pa.array([x.astype(np.int64).tobytes() for x in ns], pa.binary())],
                                      names=["lang", "source", "sub", "slots", "ns"])


def _sum_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Slots that occur in any of the rows (of one lang, source and shard), and the sums of their counts."""
    slots = [np.frombuffer(b, np.int32) for b in table.column("slots").to_pylist()]
    total = np.zeros(max(int(s[-1]) for s in slots) + 1, np.int64)  # slots ascend
    for s, n in zip(slots, table.column("ns").to_pylist()):
        total[s] += np.frombuffer(n, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    at, n = _sum_of(table)
    lang, source, sub = (k.as_py() for k in key[:3])
    return pa.Table.from_batches([_counted([lang], [source], [sub], [at], [n])])


def _add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    at, n = _sum_of(table)
    lang, source, sub = (pa.repeat(k, len(at)) for k in key)
    return pa.table({"lang": lang, "source": source, "sub": sub, "slot": pa.array(at.astype(np.int32)), "n": pa.array(n)})


def _recount(shared, dense_slots: int):
    def run(batches):
        slots = TermSlots(shared.value)
        sub_of = np.array([s[1] for s in shared.value], np.int64)
        where: dict = {}  # (lang, source) -> place of its array
        dense: list[np.ndarray] = []

        def flush():
            for (lang, source), i in where.items():
                at = np.flatnonzero(dense[i])
                cut = np.searchsorted(at, slots.base)
                some = np.flatnonzero(np.diff(cut))
                own = [at[cut[k]:cut[k + 1]] for k in some]
                yield _counted([lang] * len(some), [source] * len(some), sub_of[some].tolist(), [a - slots.base[k] for k, a in zip(some, own)], [dense[i][a] for a in own])
            where.clear()
            dense.clear()

        for batch in batches:
            codes, langs = _codes(batch.column("lang"))
            names, sources = langs.to_pylist(), batch.column("source")
            owners, source_names = _codes(sources)
            source_names = source_names.to_pylist()
            pair = codes * max(1, len(source_names)) + owners
            for low, start, size, doc, code, h in _terms(batch.column("text"), codes):
                term, first = distinct_terms(low, start, size, code, h)
                found = slots.find(slots.shard(names, code[first], h[first]), h[first], low, start[first], size[first])
                slot, owner = found[term], pair[doc]
                known = slot >= 0
                slot, owner = slot[known], owner[known]
                order = np.argsort(owner, kind="stable")
                cut = np.flatnonzero(np.diff(owner[order], prepend=-1, append=-1)) if len(order) else np.zeros(0, np.int64)
                for a, b in zip(cut[:-1], cut[1:]):
                    who = int(owner[order[a]])
                    key = (names[who // len(source_names)], source_names[who % len(source_names)])
                    if key not in where:
                        if len(where) and (len(where) + 1) * len(slots) > dense_slots:
                            yield from flush()
                        where[key] = len(dense)
                        dense.append(np.zeros(len(slots), np.int64))
                    np.add.at(dense[where[key]], slot[order[a:b]], 1)
        yield from flush()

    return run


# ---- comparison -----------------------------------------------------------------------------------------------------

_PAIRS = "lang string, source string, item string, value long"


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums of |p - q| over one shard's terms for the sources of two tiles (or of one), in both orders."""
    lang, _, left, right = (k.as_py() for k in key)
    names, tile = table.column("source").to_pylist(), table.column("tile").to_numpy()
    width = table.column("n")[0].as_py()
    p = np.repeat(table.column("base").to_numpy()[:, None], width, axis=1)
    for i, (at, values) in enumerate(zip(table.column("slots"), table.column("ps"))):
        if at.is_valid:
            p[i, at.values.to_numpy()] = values.values.to_numpy()
    a, b = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    source, item, value = [], [], []
    for i in a:
        others = b[b > i] if left == right else b
        f = np.abs(p[others] - p[i]).sum(axis=1)
        source += [names[i]] * len(others) + [names[j] for j in others]
        item += [names[j] for j in others] + [names[i]] * len(others)
        value += [f, f]
    return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()),
                     "value": pa.array(np.concatenate([*value, np.zeros(0, np.int64)]), pa.int64())})


def _share(n: str, total: str, terms: str):
    """1 + floor(1000000000 * (n + 5) / (total + 5 * terms)), in whole numbers."""
    return F.expr(f"1 + (cast(1000000000 as decimal(38,0)) * (cast({n} as decimal(20,0)) + 5)) div (cast({total} as decimal(20,0)) + 5 * cast({terms} as decimal(20,0)))")


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, shard_terms: int = SHARD_TERMS, bundle_bytes: int = BUNDLE_BYTES,
               tile: int = TILE, dense_slots: int = DENSE_SLOTS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source); null texts, langs and sources are ''.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a lang keeps those in ``min_docs`` of its
    documents. Each (lang, source) and each lang gives every kept term the share p = 1 + floor(10^9 (n + 5) / (N + 5 V)), n its
    occurrences there, N their sum over kept terms, V the lang's kept terms. Part ``pair``: for every other source of the lang
    the sum of the differences; part ``term``: the ``top`` terms that occur and exceed the lang's share most. Ranked by value,
    ties by the item's bytes. Repeated rows count again; a group without terms has pairs only; an empty table gives no rows.
    A very long text is one chunk of one task (about 60 bytes for each of its bytes); other parameters bound memory and don't
    change the result: terms of a shard, bytes broadcast at a time, sources compared at a time, slots counted in a task.
    Only one row a shard, and the shards of one bundle at a time, come to the driver.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    freq = docs.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, docs long")
    kept = scratch_table(freq.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term"), "terms", narrow=True)
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))

    def shard_of(batches):
        for b in batches:
            h = _term_hash([t.encode() for t in b.column("term").to_pylist()]) if b.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("term"), pa.array((h % b.column("subs").to_numpy().astype(np.uint64)).astype(np.int64))], names=["lang", "term", "sub"])

    dealt = kept.join(sizes.select("lang", F.ceil(F.col("v") / shard_terms).cast("long").alias("subs")), "lang").mapInArrow(shard_of, "lang string, term string, sub long")
    hashes = scratch_table(dealt.groupBy("lang", "sub").applyInArrow(_build, "lang string, sub long, n long, nbytes long, sizes binary, bits binary, terms array<string>"), "hashes")
    subs = {r["lang"]: -(-r["v"] // shard_terms) for r in sizes.collect()}
    plan = hashes.select("lang", "sub", "nbytes").orderBy("lang", "sub").collect()  # one row a shard
    bundles, filled = [], 0
    for r in plan:
        if not bundles or filled + r["nbytes"] > bundle_bytes:
            bundles.append([r, r])
            filled = 0
        bundles[-1][1] = r
        filled += r["nbytes"]
    counts = spark.createDataFrame([], "lang string, source string, sub long, slot int, n long")
    place = F.struct("lang", "sub")
    for lo, hi in bundles:
        inside = (place >= F.struct(F.lit(lo["lang"]), F.lit(lo["sub"]).cast("long"))) & (place <= F.struct(F.lit(hi["lang"]), F.lit(hi["sub"]).cast("long")))
        shared = spark.sparkContext.broadcast([(r["lang"], r["sub"], subs[r["lang"]], bytes(r["sizes"]), bytes(r["bits"]), r["terms"])
                                               for r in hashes.filter(inside).orderBy("lang", "sub").collect()])
        part = docs.filter(F.col("lang").between(lo["lang"], hi["lang"])).mapInArrow(_recount(shared, dense_slots), _COUNTED)
        # a group holds one row of each task and flush: first of some tasks at a time, then of these sums
        part = part.withColumn("some", F.floor(F.spark_partition_id() / ADDED_AT_ONCE)).groupBy("lang", "source", "sub", "some").applyInArrow(_add, _COUNTED)
        counts = counts.union(scratch_table(part.groupBy("lang", "source", "sub").applyInArrow(_add_up, counts.schema), "counts", narrow=True))
        shared.destroy()

    # a lang without kept terms has one shard of none
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    groups = scratch_table(groups.withColumn("base", F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(0)), "groups", narrow=True)
    shares = counts.join(groups.select("lang", "source", "total", "v"), ["lang", "source"]).withColumn("p", _share("n", "total", "v"))

    own = shares.groupBy("lang", "source", "sub").agg(F.array_sort(F.collect_list(F.struct("slot", "p"))).alias("own")) \
        .select("lang", "source", "sub", F.col("own.slot").alias("slots"), F.col("own.p").alias("ps"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("tiles"))
    grid = groups.join(tiles, "lang").join(hashes.select("lang", "sub", "n"), "lang", "left").na.fill(0, ["n"]).na.fill(-1, ["sub"]) \
        .join(own.hint("merge"), ["lang", "source", "sub"], "left") \
        .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = grid.select("lang", "sub", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile", "source", "base", "n", "slots", "ps") \
        .groupBy("lang", "sub", "left", "right").applyInArrow(_compare, _PAIRS) \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    whole = counts.groupBy("lang", "sub", "slot").agg(F.sum("n").alias("whole"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v"))
    # what grows with the terms is not broadcast, however small it looks
    named = hashes.select("lang", "sub", F.posexplode("terms").alias("slot", "item")).hint("merge").join(whole, ["lang", "sub", "slot"]).join(of_lang, "lang") \
        .select("lang", "sub", "slot", "item", _share("whole", "total", "v").alias("q"))
    terms = shares.join(named.hint("merge"), ["lang", "sub", "slot"]).filter("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(cols).union(terms.select(cols))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
              FROM documents),
     kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM docs) GROUP BY 1, 2 HAVING count(*) >= 30),
     grp AS (SELECT DISTINCT lang, source FROM docs),
     hits AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM docs) SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
     cells AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0)::HUGEINT AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN hits h USING (lang, source, term)),
     shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
     langs AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY 1, 2),
     whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM langs),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
               FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
     terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
     every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS "rank" FROM every)
WHERE part = 'pair' OR "rank" <= 50
"""
