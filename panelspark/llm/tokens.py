"""Token ids of many texts at once for a lower-casing word BPE that never joins characters across white space.

A text is cut into units: runs without ASCII white space, and of those the closing ASCII punctuation after a letter or
digit. Such a tokenizer encodes each unit alone as it does within the text, so each distinct unit is encoded once per
worker process and whole texts are assembled by array lookups. The cache is emptied at ``MOST_UNITS`` units, except that
it always holds the chunk at hand.
"""

from __future__ import annotations

import os

import numpy as np

from panelspark.llm.common import chunks, prefix_hash, span_hash, text_bytes, word_spans

MOST_UNITS = 1_500_000
# ASCII signs that only form runs of signs; apostrophes start contractions, <|> special tokens.
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,!?;:*$%&#()\"-"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORKERS: dict[str, "UnitTokenizer"] = {}


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of all documents and the documents' n + 1 unit offsets."""
    starts, ends, docs = word_spans(data, offsets)
    if not len(starts):
        return starts, ends, docs
    core = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data))))[ends - 1] + 1
    cut = (core > starts) & (core < ends)
    cut[cut] = _ALNUM[data[core[cut] - 1]]
    more = np.cumsum(cut) - cut
    at = np.arange(len(starts)) + more
    out = np.empty((2, len(starts) + int(cut.sum())), np.int64)
    out[0, at], out[1, at] = starts, np.where(cut, core, ends)
    out[0, at[cut] + 1], out[1, at[cut] + 1] = core[cut], ends[cut]
    return out[0], out[1], docs + np.concatenate([[0], np.cumsum(cut)])[docs]


class UnitTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self._clear()

    @classmethod
    def of(cls, path: str) -> "UnitTokenizer":
        if path not in _WORKERS:
            _WORKERS[path] = cls(path)
        return _WORKERS[path]

    def _clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        ids, n = [self.pool], []
        for lo in range(0, len(keys), 2048):
            strings = [bytes(data[i:j]).decode("utf-8", "replace") for i, j in zip(starts[lo:lo + 2048], ends[lo:lo + 2048])]
            found = self.model.encode_batch_fast(strings, add_special_tokens=False)
            ids.append(np.array([i for e in found for i in e.ids], np.uint32))
            n += [len(e) for e in found]
        n = np.array(n, np.int64)
        at = len(self.pool) + np.cumsum(n) - n
        self.pool = np.concatenate(ids)
        order = np.argsort(keys)
        to = np.searchsorted(self.keys, keys[order])
        self.at = np.insert(self.at, to, at[order])
        self.n = np.insert(self.n, to, n[order])
        self.keys = np.insert(self.keys, to, keys[order])

    def _find(self, data, starts, ends, keys, first):
        """Places of the keys in the cache, all encoded before. Where the cache would outgrow its limit, it is emptied and the
        whole chunk learnt anew; a chunk with more units than the limit has them all in the cache until the next emptying."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if known.all():
            return at
        if len(self.keys) + len(keys) - int(known.sum()) > MOST_UNITS:
            self._clear()
            known[:] = False
        new = np.flatnonzero(~known)
        self._learn(keys[new], data, starts[first[new]], ends[first[new]])
        return np.searchsorted(self.keys, keys)

    def counts(self, data: np.ndarray, offsets: np.ndarray):
        """Units (starts, ends, document offsets) and, per unit, its place in ``pool`` and number of ids."""
        starts, ends, docs = units(data, offsets)
        h = span_hash(prefix_hash(data, lower=True), starts, ends)
        # special tokens are matched before lower-casing: their units are known by their exact bytes
        mark = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(starts) else np.zeros(0, np.int64)
        if len(mark):
            exact = np.unique(np.searchsorted(starts, mark, "right") - 1)
            h[exact] = span_hash(prefix_hash(data), starts[exact], ends[exact])
        keys, first, same = np.unique(h, return_index=True, return_inverse=True)
        at = self._find(data, starts, ends, keys, first) if len(keys) else np.zeros(0, np.int64)
        return starts, ends, docs, self.at[at][same], self.n[at][same]

    def encode(self, column):
        """Per chunk of an Arrow text column: the ids of its documents in one array, and their n + 1 offsets."""
        data, offsets = text_bytes(column)
        for lo, hi in chunks(offsets):
            part, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            _, _, docs, at, n = self.counts(part, off)
            ends = np.concatenate([[0], np.cumsum(n)])
            take = np.repeat(at - ends[:-1], n) + np.arange(ends[-1])
            yield self.pool[take], ends[docs]
