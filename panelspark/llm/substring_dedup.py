"""Removal of byte strings that already start in an earlier document, by blockwise suffix sorting.

Every window of ``length`` bytes belongs to the leftmost smallest-hash k-mer in it (its anchor), which depends on the
window's bytes only, so equal windows have equal anchors. Neighbouring windows of one anchor are one piece of text.

1. Documents are dealt into groups of a few MB. Each group reports its distinct anchor hashes to hash buckets, which
   answer with those that occur in two documents or more: any other window is unique. Nothing is lost, as a chance
   agreement of hashes only adds work. Groups and buckets meet over as many exchanges as keep the rows of a task below
   a fixed number (``Net``), so rows grow in proportion to the groups.
2. Each group sends its distinct pieces of those anchors to suffix buckets, keyed by the anchor (or, for an anchor
   with very many pieces, by the window itself, so a frequent short line is spread out).
3. A suffix bucket sorts its windows block by block: by their first 32 bytes, long ties by the precomputed ranks of a
   difference-cover sample (residues {0, 1, 3, 8, 12, 18} modulo 31, ranked to 63 bytes). Equal windows are then
   neighbours, and each gets the smallest document it starts in.
4. The group marks the bytes of windows that start in a smaller document.

All three passes over the text read one and the same exchange. A group or bucket holds a few MB whatever the input.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from panelspark.llm.common import chunks, mix, powers, prefix_hash, read_table, span_hash, text_bytes

# A perfect difference set; every distance modulo 31 is a difference of two of its members.
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31
GROUP_BYTES = 8 << 20
FAN = 128
SORT_BLOCK = 1 << 20
HOT_PIECES = 512
LAST = np.iinfo(np.int64).max
_LOW48 = np.uint64((1 << 48) - 1)
_BLOCK = 1 << 16
_PLACE = np.uint64((1 << 17) - 1)  # a place in a block and its last window
_TO_SAMPLE = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])


# ---- suffix sorting -------------------------------------------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; the data must end in 8 spare bytes."""
    out = np.zeros(len(data) - 8, np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | data[j:len(data) - 8 + j].astype(np.uint64)
    return out


def _dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks by 63 bytes of the positions < n whose residue is in the cover (elsewhere 0, past the end -1)."""
    at = np.sort(np.concatenate([np.arange(c, n, PERIOD) for c in COVER]))
    keys = [words[at + 24], words[at + 16], words[at + 8], words[at]]
    first = np.zeros(n + PERIOD, np.int64) - 1
    first[at] = _dense(np.lexsort(keys), keys)
    keys = [first[at + PERIOD], first[at]]
    out = np.full(n + PERIOD, -1, np.int64)
    out[at] = _dense(np.lexsort(keys), keys)
    return out


def sort_suffixes(words: np.ndarray, ranks: np.ndarray, at: np.ndarray, full: bool = False) -> np.ndarray:
    """``at`` ordered by the suffixes' first 32 bytes, then, among equal residues, by the rank of their next sample.

    With ``full``, ties between different residues are put into suffix order too, each pair compared at the distance
    after which both stand on the cover. Equal windows of up to 63 bytes with equal residues are neighbours either way.
    """
    residue = at % PERIOD
    order = np.lexsort([ranks[at + _TO_SAMPLE[residue]], residue, words[at + 24], words[at + 16], words[at + 8], words[at]])
    at = at[order]
    if full:
        same = np.ones(max(len(at) - 1, 0), bool)
        for j in (0, 8, 16, 24):
            same &= words[at[1:] + j] == words[at[:-1] + j]
        edges = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        both = {(r, s): next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER)
                for r in range(PERIOD) for s in range(PERIOD)}

        def less(a, b):
            d = both[a % PERIOD, b % PERIOD]
            return int(ranks[a + d]) - int(ranks[b + d])

        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1 and len(set((at[a:b] % PERIOD).tolist())) > 1:
                at[a:b] = sorted(at[a:b].tolist(), key=cmp_to_key(less))
    return at


# ---- anchors and pieces of a group of documents ----------------------------------------------------------------

class _Shape:
    def __init__(self, length: int, hot_pieces: int = HOT_PIECES, sort_block: int = SORT_BLOCK):
        if not 8 <= length <= 63:
            raise ValueError("length must be from 8 to 63 bytes")
        self.length, self.hot_pieces, self.sort_block = length, hot_pieces, sort_block
        self.many = length // 2 + 2  # k-mers in a window
        self.k = length - self.many + 1


def _anchors(data: np.ndarray, offsets: np.ndarray, shape: _Shape):
    """Runs of windows of one anchor: first and last window start, anchor hash (48 bits), prefix hash of the data.

    Blocks of windows at a time: a k-mer's hash and its place in the block are one number, so a window's anchor is a minimum.
    """
    n = len(data) - shape.length + 1
    prefix = prefix_hash(data)
    firsts, lasts, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo, hi = offsets[:-1], offsets[1:] - shape.length
    ok = hi >= lo
    edge = np.zeros(max(n, 0) + 1, np.int8)
    edge[lo[ok]] += 1  # no two documents with a window start, or end, at one place
    edge[hi[ok] + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    for s in range(0, n, _BLOCK):
        e = min(n, s + _BLOCK)
        value = _kmers(prefix, s, e + shape.many - 1, shape.k)
        value &= ~_PLACE
        value |= np.arange(len(value), dtype=np.uint64)
        have = 1
        while have < shape.many:
            step = min(have, shape.many - have)
            value = np.minimum(value[step:], value[:-step])
            have += step
        start = np.flatnonzero(inside[s:e])
        if len(start):
            owner = (value[start] & _PLACE).astype(np.int64)
            cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
            firsts.append(s + start[np.concatenate([[0], cut])])
            lasts.append(s + start[np.concatenate([cut, [len(start)]]) - 1])
            owners.append(s + owner[np.concatenate([[0], cut])])
    first, last, owner = map(np.concatenate, (firsts, lasts, owners))
    if len(owner):  # a run that goes on in the next block is one run
        new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        first, last, owner = first[new], last[np.append(new[1:], len(owner)) - 1], owner[new]
    return first, last, span_hash(prefix, owner, owner + shape.k) & _LOW48, prefix


def _kmers(prefix: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray:
    """Hashes of the k-byte strings that start at lo .. hi - 1."""
    return mix((prefix[lo + k:hi + k] - prefix[lo:hi]) * powers(len(prefix))[1][lo:hi])


def _runs(text: pa.ChunkedArray, shape: _Shape):
    """(data, offsets, first, last, anchor, content prefix) of each chunk of documents, with the chunk's first document."""
    data, offsets = text_bytes(text)
    for lo, hi in chunks(offsets):
        part, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        yield lo, part, off, *_anchors(part, off, shape)


def _pieces(first, last, anchor, hot, prefix, shape: _Shape):
    """Pieces of the runs: (first, last, key, content hash); a hot anchor's windows are pieces of their own."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        split = hot[at] == anchor
        if split.any():
            many = np.where(split, last - first + 1, 1)
            run = np.repeat(np.arange(len(first)), many)
            step = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
            single = split[run]
            first, last = first[run] + step, np.where(single, first[run] + step, last[run])
            content = span_hash(prefix, first, last + shape.length)
            return first, last, np.where(single, content & _LOW48, anchor[run]), content
    return first, last, anchor, span_hash(prefix, first, last + shape.length)


def _planes(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unplanes(b: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(b.as_buffer(), np.uint8).reshape(6, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :6] = raw.T
    return out.view(np.uint64).reshape(-1)


def _bytes(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in column] or [np.zeros(0, kind)])


def _ids(column) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class Net:
    """How items travel between groups and buckets: in ``hops`` exchanges, each dealing the items of a task to ``fan`` others.

    After hop l a task holds, of ``fan**l`` groups, the items whose bucket begins with the same l digits (base fan), which is
    as much as one group has; so an exchange has ``groups * fan`` rows, not ``groups * buckets``. Answers go back likewise.
    """

    def __init__(self, groups: int, fan: int = FAN):
        self.groups, self.hops = groups, 1
        while fan ** self.hops < groups:
            self.hops += 1
        self.fan = next(f for f in range(1, fan + 1) if f ** self.hops >= groups)
        self.buckets = self.fan ** self.hops

    def key(self, level: int, bucket, g):
        """The task at a level (0: the group itself, ``hops``: the bucket itself) of an item between group g and a bucket."""
        return bucket // self.fan ** (self.hops - level) * -(-self.groups // self.fan ** level) + g // self.fan ** level


# Rows of items; a row without ``who`` is the list of frequent anchors of group ``own``, which travels to bucket own % buckets and back.
_ROWS = pa.schema([("key", pa.int64()), ("own", pa.int64()), ("who", pa.binary()), ("lens", pa.binary()), ("bucket", pa.binary()),
                   ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_DDL = ", ".join(f"{f.name} {({'int64': 'long', 'binary': 'binary'})[str(f.type)]}" for f in _ROWS)


def _by_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-2))
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(edges[:-1], edges[1:])] if len(order) else []


def _deal(net: Net, level: int, bucket: np.ndarray, g: np.ndarray, pack) -> list[tuple]:
    """Rows of items for the tasks of a level; ``pack(items)`` gives the columns a, b, c of the chosen items."""
    out = []
    for k, i in _by_bucket(net.key(level, bucket, g)):
        i = i[np.argsort(g[i], kind="stable")]
        at = np.flatnonzero(np.diff(g[i], prepend=-1))
        out.append((k, None, g[i[at]].tobytes(), np.diff(np.append(at, len(i))).astype(np.int32).tobytes(),
                    bucket[i].tobytes() if 0 < level < net.hops else None, *pack(i)))
    return out


def _items(table: pa.Table):
    """Of rows with items: the group of each item."""
    return np.repeat(_bytes(table.column("who"), np.int64), _bytes(table.column("lens"), np.int32))


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows with items, and rows with a group's frequent anchors."""
    own = table.column("own").is_valid()
    return table.filter(pc.invert(own)), table.filter(own)


def _lists(net: Net, level: int, table: pa.Table) -> list[tuple]:
    return [(net.key(level, own % net.buckets, own), own, None, None, None, a, None, None)
            for own, a in zip(table.column("own").to_pylist(), table.column("a").to_pylist())]


def _pack_hashes(h, n):
    return lambda i: (_planes(h[i]), n[i].tobytes(), None)


def _forward(net: Net, level: int):
    """A task between the hops: hashes of ``fan**level`` groups go on by the next digit of their bucket."""
    def run(table: pa.Table) -> pa.Table:
        h, n, g = _hashes(table)
        return _table(_ROWS, _deal(net, level + 1, (h % np.uint64(net.buckets)).astype(np.int64), g, _pack_hashes(h, n)))

    return run


def _forward_pieces(net: Net, level: int):
    def run(table: pa.Table) -> pa.Table:
        rows, lists = _split(table)
        out = _lists(net, level + 1, lists)
        if len(rows):
            doc, size, data = _unpack_pieces(rows)
            out += _deal(net, level + 1, _bytes(rows.column("bucket"), np.int64), _items(rows), _pack_pieces(doc, size, data, np.cumsum(size) - size))
        return _table(_ROWS, out)

    return run


def _back(net: Net, level: int, planes: bool):
    """A task between the hops on the way back: answers go on to the level below."""
    def run(table: pa.Table) -> pa.Table:
        rows, lists = _split(table)
        out = _lists(net, level - 1, lists)
        if len(rows):
            g, bucket = _items(rows), _bytes(rows.column("bucket"), np.int64)
            if planes:
                h, n, _ = _hashes(rows)
                out += _deal(net, level - 1, bucket, g, _pack_hashes(h, n))
            else:
                a, b = _bytes(rows.column("a"), np.uint64), _bytes(rows.column("b"), np.uint64)
                out += _deal(net, level - 1, bucket, g, lambda i: (a[i].tobytes(), b[i].tobytes(), None))
        return _table(_ROWS, out)

    return run


def _hashes(table: pa.Table):
    h = np.concatenate([np.zeros(0, np.uint64), *[_unplanes(b) for b in table.column("a")]])
    return h, _bytes(table.column("b"), np.uint8), _items(table)


def _pack_pieces(doc, size, data, where):
    squeeze = zstandard.ZstdCompressor(level=1)  # pieces overlap, so their bytes are most of what moves

    def pack(i):
        n = size[i]
        take = np.repeat(where[i] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return doc[i].tobytes(), n.astype(np.uint8).tobytes(), squeeze.compress(data[take].tobytes())

    return pack


def _unpack_pieces(table: pa.Table):
    grow = zstandard.ZstdDecompressor()
    data = np.concatenate([np.frombuffer(grow.decompress(b.as_buffer()), np.uint8) for b in table.column("c")])
    return _bytes(table.column("a"), np.int64), _bytes(table.column("b"), np.uint8).astype(np.int64), data


def _report(shape: _Shape, net: Net):
    """A group's distinct anchors: sorted hashes and occurrences (1 if in one document only, at most 255)."""
    def run(table: pa.Table) -> pa.Table:
        doc = _ids(table.column("doc"))
        anchors, docs = [], []
        for lo, _, off, first, _, anchor, _ in _runs(table.column("text"), shape):
            anchors.append(anchor)
            docs.append(doc[lo + np.searchsorted(off, first, "right") - 1])
        h, d = np.concatenate(anchors), np.concatenate(docs)
        if not len(h):
            return _table(_ROWS, [])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(at, len(h)))
        n[np.minimum.reduceat(d, at) == np.maximum.reduceat(d, at)] = 1
        h, n = h[at], np.minimum(n, 255).astype(np.uint8)
        g = np.full(len(h), table.column("g")[0].as_py(), np.int64)
        return _table(_ROWS, _deal(net, 1, (h % np.uint64(net.buckets)).astype(np.int64), g, _pack_hashes(h, n)))

    return run


def _share(shape: _Shape, net: Net):
    """A hash bucket's answers: each group's anchors that occur in two documents or more, and whether they are frequent."""
    def run(table: pa.Table) -> pa.Table:
        h, n, g = _hashes(table)
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        total = np.add.reduceat(n[order].astype(np.int64), at)
        count = np.empty(len(h), np.int64)
        count[order] = np.repeat(total, np.diff(np.append(at, len(h))))
        keep = count > 1
        bucket = (h[keep] % np.uint64(net.buckets)).astype(np.int64)
        return _table(_ROWS, _deal(net, net.hops - 1, bucket, g[keep], _pack_hashes(h[keep], (count[keep] > shape.hot_pieces).astype(np.uint8))))

    return run


def _send(shape: _Shape, net: Net):
    """A group's distinct pieces of shared anchors, each with its smallest document, by suffix bucket; and its frequent anchors."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right) or not len(left):
            return _table(_ROWS, [])
        shared, frequent, _ = _hashes(right)
        hot, shared = np.sort(shared[frequent > 0]), np.sort(shared)
        left = left.sort_by("doc")
        doc = _ids(left.column("doc"))
        keys, contents, docs, sizes, where, texts = [], [], [], [], [], []
        base = 0
        for lo, part, off, first, last, anchor, prefix in _runs(left.column("text"), shape):
            at = np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)
            own = shared[at] == anchor
            f, t, key, content = _pieces(first[own], last[own], anchor[own], hot, prefix, shape)
            keys.append(key)
            contents.append(content)
            docs.append(doc[lo + np.searchsorted(off, f, "right") - 1])
            sizes.append(t - f + shape.length)
            where.append(base + f)
            texts.append(part)
            base += len(part)
        keys, contents, docs, sizes, where = map(np.concatenate, (keys, contents, docs, sizes, where))
        _, one = np.unique(contents, return_index=True)  # documents ascend: the first is the smallest
        one = one[np.argsort(keys[one], kind="stable")]  # pieces of one anchor look alike
        own = left.column("g")[0].as_py()
        out = _deal(net, 1, (keys[one] % np.uint64(net.buckets)).astype(np.int64), np.full(len(one), own, np.int64),
                    _pack_pieces(docs[one], sizes[one], np.concatenate(texts), where[one]))
        if len(hot):
            out += [(net.key(1, own % net.buckets, own), own, None, None, None, _planes(hot), None, None)]
        return _table(_ROWS, out)

    return run


def smallest_documents(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int):
    """For pieces data[start:start + size] with a document each: per window of each piece, the smallest document with it.

    Returned flat, piece after piece. Pieces are laid out so that equal windows have equal residues.
    """
    many = size - length + 1
    piece = np.repeat(np.arange(len(size)), many)
    step = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    words = _words(np.concatenate([data, np.zeros(2 * PERIOD + 72, np.uint8)]))
    ranks = cover_ranks(words, len(data))
    at = start[piece] + step
    back = np.full(len(data), -1, np.int64)
    back[at] = np.arange(len(at))
    order = back[sort_suffixes(words, ranks, at)]
    a = at[order]
    same = (a[1:] % PERIOD) == (a[:-1] % PERIOD)
    for j in [*range(0, length - 7, 8), length - 8]:
        same &= words[a[1:] + j] == words[a[:-1] + j]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.minimum.reduceat(doc[piece[order]], head)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(head, len(at))))
    return out, many


def _sort_bucket(shape: _Shape, net: Net):
    """A suffix bucket's answers: for each group and piece, the windows that start in a smaller document."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("key")[0].as_py()
        table, lists = _split(table)
        passed = _lists(net, net.hops - 1, lists)
        if not len(table):
            return _table(_ROWS, passed)
        doc, size, data = _unpack_pieces(table)
        start = np.cumsum(size) - size
        content, key, lead = _identify(data, start, size, shape)
        g = _items(table)
        order = np.lexsort([doc, content, key])
        k, c = key[order], content[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
        one = order[new]  # a content's smallest document
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        mask = np.zeros(len(order), np.uint64)
        every = (np.uint64(1) << (size - shape.length + 1).astype(np.uint64)) - np.uint64(1)
        later = doc > doc[one][which]
        mask[later] = every[later]
        # keys with several contents: sort their windows, so many keys at a time as make a block
        ko = key[one]
        lone = np.concatenate([[True], ko[1:] != ko[:-1]]) & np.concatenate([ko[1:] != ko[:-1], [True]])
        todo = np.flatnonzero(~lone)
        if len(todo):
            kt = ko[todo]
            weight = np.cumsum(size[one[todo]])
            block = weight // shape.sort_block
            firsts = np.concatenate([[True], kt[1:] != kt[:-1]])
            block = block[np.maximum.accumulate(np.where(firsts, np.arange(len(kt)), 0))]  # a key stays whole
            low_at = np.full(len(one) + 1, -1, np.int64)
            lows, filled = [], 0
            for _, i in _by_bucket(block):
                t = todo[i]
                src, n = start[one[t]], size[one[t]]
                room = n + PERIOD
                to = np.cumsum(room) - room
                to += (-(to + lead[one[t]])) % PERIOD  # the anchors stand on multiples of the period
                flat = np.zeros(int(to[-1] + n[-1]) + PERIOD, np.uint8)
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(to, n) + step] = data[np.repeat(src, n) + step]
                low, many = smallest_documents(flat, to, n, doc[one[t]], shape.length)
                low_at[t] = filled + np.cumsum(many) - many
                lows.append(low)
                filled += len(low)
            low = np.concatenate(lows)
            need = np.flatnonzero(low_at[which] >= 0)
            many = size[need] - shape.length + 1
            row = np.repeat(np.arange(len(need)), many)
            step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            smaller = low[low_at[which[need]][row] + step] < doc[need][row]
            bits = np.where(smaller, np.uint64(1) << step.astype(np.uint64), np.uint64(0))
            mask[need] = np.bitwise_or.reduceat(bits, np.cumsum(many) - many)
        some = np.flatnonzero(mask)
        content, mask = content[some], mask[some]
        return _table(_ROWS, passed + _deal(net, net.hops - 1, np.full(len(some), bucket, np.int64), g[some], lambda i: (content[i].tobytes(), mask[i].tobytes(), None)))

    return run


def _identify(data, start, size, shape: _Shape):
    """Of each piece: content hash, anchor (the leftmost smallest k-mer of the first window, 48 bits) and where it stands."""
    content, key, lead = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64), np.zeros(len(start), np.int64)
    for lo, hi in chunks(np.append(start, len(data))):
        part = data[start[lo]:start[hi - 1] + size[hi - 1]]
        at = start[lo:hi] - start[lo]
        prefix = prefix_hash(part)
        content[lo:hi] = span_hash(prefix, at, at + size[lo:hi])
        best = span_hash(prefix, at, at + shape.k)
        place = np.zeros(hi - lo, np.int64)
        for j in range(1, shape.many):
            v = span_hash(prefix, at + j, at + j + shape.k)
            less = (v & ~_PLACE) < (best & ~_PLACE)
            best[less], place[less] = v[less], j
        key[lo:hi], lead[lo:hi] = best & _LOW48, place
    return content, key, lead


def _whole_characters(data: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """``removed`` widened to all bytes of each character that lost one."""
    first = (data & 0xC0) != 0x80
    first[:1] = True
    at = np.flatnonzero(first)
    return np.repeat(np.logical_or.reduceat(removed, at), np.diff(np.append(at, len(data))))


def _finish(shape: _Shape, as_text: bool):
    """A group's documents with the removed byte ranges and the bytes that stay."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, lists = _split(right)
        hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *[_unplanes(b) for b in lists.column("a")]]))
        answer, marks = _bytes(rows.column("a"), np.uint64), _bytes(rows.column("b"), np.uint64)
        order = np.argsort(answer, kind="stable")
        answer, marks = answer[order], marks[order]
        left = left.sort_by("doc")
        doc = _ids(left.column("doc"))
        runs, contents, docs = [], [], []
        for lo, part, off, first, last, anchor, prefix in _runs(left.column("text"), shape):
            f, t, _, content = _pieces(first, last, anchor, hot, prefix, shape)
            runs.append((lo, part, off, f, t))
            contents.append(content)
            docs.append(doc[lo + np.searchsorted(off, f, "right") - 1])
        every, owner = np.concatenate(contents), np.concatenate(docs)
        _, one, same = np.unique(every, return_index=True, return_inverse=True)
        later = owner > owner[one][same]  # the same piece stands in a smaller document of this group
        starts, ends, kept, at = [], [], [], 0
        for lo, part, off, f, t in runs:
            late = later[at:at + len(f)]
            content = every[at:at + len(f)]
            at += len(f)
            edge = np.zeros(len(part) + 1, np.int32)
            np.add.at(edge, f[late], 1)
            np.add.at(edge, t[late] + shape.length, -1)
            if len(answer):
                i = np.minimum(np.searchsorted(answer, content), len(answer) - 1)
                hit = np.flatnonzero((answer[i] == content) & ~late)
                mask = marks[i[hit]]
                for j in range(shape.many + 1):
                    w = f[hit[(mask >> np.uint64(j)) & np.uint64(1) > 0]] + j
                    np.add.at(edge, w, 1)
                    np.add.at(edge, w + shape.length, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for a, b in zip(off[:-1], off[1:]):
                c = covered[a:b]
                if c.any():
                    d = np.diff(np.concatenate([[0], c.view(np.int8), [0]]))
                    starts.append(np.flatnonzero(d == 1))
                    ends.append(np.flatnonzero(d == -1))
                    kept.append(part[a:b][~(_whole_characters(part[a:b], c) if as_text else c)].tobytes())
                else:
                    starts.append(np.zeros(0, np.int64))
                    ends.append(np.zeros(0, np.int64))
                    kept.append(part[a:b].tobytes())
        wide = lambda lists: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists).astype(np.int64)))
        return pa.table([left.column("rest"), wide(starts), wide(ends), pa.array(kept, pa.string() if as_text else pa.binary())],
                        names=["rest", "removed_starts", "removed_ends", "kept"])

    return run


def remove_repeated_strings(docs: DataFrame, length: int = 50, group_bytes: int = GROUP_BYTES,
                            hot_pieces: int = HOT_PIECES, sort_block: int = SORT_BLOCK, fan: int = FAN, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` but text, and: removed_starts, removed_ends (array<long>: the maximal byte ranges that
    ``length``-byte strings cover which also start in a document with a smaller doc_id), kept (binary: the other bytes).

    group_bytes, hot_pieces, sort_block and fan (bytes of a group, pieces from which an anchor counts as frequent, bytes sorted
    at a time, rows that a task sends at most) bound memory and rows and don't change the result.

    With ``as_text`` kept is a string without the characters that lost a byte.

    Texts are compared as UTF-8 bytes as they come in; a null text is empty; strings never cross documents. A row
    without doc_id counts as the largest document. Rows of one doc_id do not remove each other's bytes, and are dealt out
    by doc_id and text. Repeated rows give repeated results; an empty table gives an empty one. A very long text is held
    by one task, with about 40 bytes for each of its bytes. Columns other than doc_id and text are carried along whatever
    their names; one called like a result gives way to it.
    """
    shape = _Shape(length, hot_pieces, sort_block)
    others = [c for c in docs.columns if c.lower() not in ("text", "removed_starts", "removed_ends", "kept")]
    table = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    # a row counts for 64 bytes more than its text has
    groups = max(1, -(-int(docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0) // group_bytes))
    net = Net(groups, fan)
    table = table.withColumn("g", F.pmod(F.xxhash64("doc", "text"), F.lit(groups)))
    shared = table.groupBy("g").applyInArrow(_report(shape, net), _DDL)
    for level in range(1, net.hops):
        shared = shared.groupBy("key").applyInArrow(_forward(net, level), _DDL)
    shared = shared.groupBy("key").applyInArrow(_share(shape, net), _DDL)
    for level in range(net.hops - 1, 0, -1):
        shared = shared.groupBy("key").applyInArrow(_back(net, level, planes=True), _DDL)
    answers = table.groupBy("g").cogroup(shared.groupBy("key")).applyInArrow(_send(shape, net), _DDL)
    for level in range(1, net.hops):
        answers = answers.groupBy("key").applyInArrow(_forward_pieces(net, level), _DDL)
    answers = answers.groupBy("key").applyInArrow(_sort_bucket(shape, net), _DDL)
    for level in range(net.hops - 1, 0, -1):
        answers = answers.groupBy("key").applyInArrow(_back(net, level, planes=False), _DDL)
    out = StructType([StructField("rest", table.schema["rest"].dataType), StructField("removed_starts", ArrayType(LongType())),
                      StructField("removed_ends", ArrayType(LongType())), StructField("kept", StringType() if as_text else BinaryType())])
    done = table.groupBy("g").cogroup(answers.groupBy("key")).applyInArrow(_finish(shape, as_text), out)
    return done.select("rest.*", "removed_starts", "removed_ends", "kept")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_strings(docs)
    removed = F.aggregate(F.zip_with("removed_starts", "removed_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("removed_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
