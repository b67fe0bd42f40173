"""Toxicity score of whole texts by a convolutional network over hashed word embeddings, trained in numpy.

A word's vector is the sum of three hashed embeddings: the word, its first 4 and its first 6 bytes (lower-cased A-Z). Filters one, two and three words wide run over the text, each keeps its largest value, and a logistic unit
reads those. Decision thresholds are calibrated on validation rows for each language, as told from the text's own
function words, and moved into the score, so 0.5 is the threshold everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelspark.llm.common import chunks, prefix_hash, read_table, span_hash, text_bytes
from panelspark.llm.tokens import units

SLOTS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
BLANKS = max(WIDTHS)
SAMPLE_BYTES = 1 << 28
# Frequent function words of four languages, each in one list only.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with on be at this are or from by an have not they",
    "de": "der die und das ist von zu mit den im dem nicht ein eine sich auf des auch als es werden",
    "fr": "le les des et une est que du pour dans qui sur pas au par ce il plus avec aux",
    "es": "el los las y por con para se una su al del lo como más pero sus ha muy",
}


def _known(words: dict[str, str]):
    h, tag = [], []
    for i, text in enumerate(words.values()):
        data = np.frombuffer(text.encode(), np.uint8)
        start, end, _ = units(data, np.array([0, len(data)]))
        h.append(span_hash(prefix_hash(data, lower=True), start, end))
        tag.append(np.full(len(start), i))
    h, tag = np.concatenate(h), np.concatenate(tag)
    order = np.argsort(h)
    return h[order], tag[order]


_HASHES, _TAGS = _known(FUNCTION_WORDS)
_SALTS = (0, 0x51ED270B, 0x2545F491)


def inputs(column):
    """Per chunk of texts: slots (words + 3 blanks a document, 3), the documents' n + 1 offsets, their languages.

    Language: the list with most hits; its place in FUNCTION_WORDS, or their number if none has a hit.
    """
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        part, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        start, end, docs = units(part, off)
        prefix = prefix_hash(part, lower=True)
        word = span_hash(prefix, start, end)
        views = [word, span_hash(prefix, start, np.minimum(start + 4, end)), span_hash(prefix, start, np.minimum(start + 6, end))]
        n = hi - lo
        slots = np.full((len(start) + BLANKS * n, 3), SLOTS, np.int32)
        owner = np.repeat(np.arange(n), np.diff(docs))
        at = np.arange(len(start)) + BLANKS * owner
        for j, (h, salt) in enumerate(zip(views, _SALTS)):
            slots[at, j] = ((h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int32)
        i = np.minimum(np.searchsorted(_HASHES, word), len(_HASHES) - 1)
        hit = _HASHES[i] == word
        votes = np.zeros((n, len(FUNCTION_WORDS)), np.int64)
        np.add.at(votes, (owner[hit], _TAGS[i[hit]]), 1)
        language = np.where(votes.any(axis=1), votes.argmax(axis=1), len(FUNCTION_WORDS))
        yield slots, docs + BLANKS * np.arange(n + 1), language


class TextCNN:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.emb = np.concatenate([rng.normal(0, 0.01, (SLOTS, DIM)), np.zeros((1, DIM))]).astype(np.float32)
        self.conv = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def pooled(self, slots, docs, places: bool = False):
        """Largest value of every filter in each document (documents, filters), with ``places`` also where it stands."""
        x = self.emb[slots[:, 0]]
        for j in range(1, slots.shape[1]):
            x += self.emb[slots[:, j]]
        xt = x.T
        tops, ats = [], []
        for conv, bias in zip(self.conv, self.bias):
            z = conv[0].T @ xt
            for j in range(1, len(conv)):
                z[:, :-j] += (conv[j].T @ xt)[:, j:]
            # the last places would look into the next document; a blank before them stands for "no word"
            for j in range(1, len(conv)):
                z[:, docs[1:] - j] = -np.inf
            if places:
                at = np.stack([a + z[:, a:b].argmax(axis=1) for a, b in zip(docs[:-1], docs[1:])])
                ats.append(at)
                tops.append(z[np.arange(FILTERS), at] + bias)
            else:
                tops.append(np.maximum.reduceat(z, docs[:-1], axis=1).T + bias)
        p = np.concatenate(tops, axis=1)
        return (p, x, ats) if places else p

    def logits(self, slots, docs):
        return np.maximum(self.pooled(slots, docs), 0) @ self.out + self.out_bias[0]

    def fit(self, texts: list[tuple[np.ndarray, int]], epochs: int, rate: float, batch: int, seed: int):
        """texts: (slots, label). Log loss with both classes weighing the same, adaptive gradient steps."""
        rng = np.random.default_rng(seed)
        params = [self.emb, *self.conv, *self.bias, self.out, self.out_bias]
        sums = [np.full_like(p, 1e-6) for p in params]
        labels = np.array([y for _, y in texts], np.float32)
        share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
        weigh = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo:lo + batch]
                slots = np.concatenate([texts[i][0] for i in pick])
                docs = np.cumsum([0, *[len(texts[i][0]) for i in pick]])
                p, x, ats = self.pooled(slots, docs, places=True)
                act = np.maximum(p, 0)
                logit = act @ self.out + self.out_bias[0]
                err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) * weigh[pick] / len(pick)
                grad_p = err[:, None] * self.out[None, :] * (p > 0)
                grads = {len(params) - 2: act.T @ err}
                rows, values = [], []
                for k, (conv, at) in enumerate(zip(self.conv, ats)):
                    g = grad_p[:, k * FILTERS:(k + 1) * FILTERS]
                    dw = np.empty_like(conv)
                    for j in range(len(conv)):
                        dw[j] = np.einsum("df,dfe->ef", g, x[at + j])
                        rows.append((at + j).ravel())
                        values.append((g[:, :, None] * conv[j].T[None]).reshape(-1, DIM))
                    grads[1 + k] = dw
                    grads[1 + len(self.conv) + k] = g.sum(axis=0)
                grads[len(params) - 1] = err.sum(keepdims=True)
                rows, values = np.concatenate(rows), np.concatenate(values)
                used, to = np.unique(slots[rows].ravel(), return_inverse=True)
                step = np.zeros((len(used), DIM), np.float32)
                np.add.at(step, to, np.repeat(values, slots.shape[1], axis=0))
                step[used == SLOTS] = 0
                sums[0][used] += step * step
                self.emb[used] -= rate * step / np.sqrt(sums[0][used])
                for i, g in grads.items():
                    sums[i] += g * g
                    params[i] -= rate * g / np.sqrt(sums[i])
        return self


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of the gap it lies in."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(z[1:] < z[:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def fit_toxicity(rows: list[tuple[int, str, int]], steps: int = 1000, rate: float = 0.05, batch: int = 32, seed: int = 0) -> dict:
    """rows: (doc_id, text, label). One row in five is kept for calibration. Without both labels every score is the rate."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    y = np.array([r[2] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return {"rate": float(y.mean()) if len(y) else 0.0}
    texts, language = [], []
    for slots, docs, lang in inputs(pa.array([r[1] or "" for r in rows], pa.large_string())):
        texts += [slots[a:b] for a, b in zip(docs[:-1], docs[1:])]
        language.append(lang)
    language = np.concatenate(language)
    hold = np.zeros(len(rows), bool)
    for label in (0, 1):
        hold[np.flatnonzero(y == label)[4::5]] = True
    train = [(texts[i], int(y[i])) for i in np.flatnonzero(~hold)]
    epochs = max(2, -(-steps * batch // len(train)))
    model = TextCNN(seed).fit(train, epochs, rate, batch, seed)
    z = np.array([model.logits(t, np.array([0, len(t)]))[0] for t in texts])
    use = hold if len(set(y[hold].tolist())) == 2 else np.ones(len(rows), bool)
    every = _best_cut(z[use], y[use])
    cuts = []
    for k in range(len(FUNCTION_WORDS) + 1):
        own = use & (language == k)
        n1, n0 = int(y[own].sum()), int((1 - y[own]).sum())
        # a language with few rows keeps mostly to the common threshold
        weight = min(n1, n0) / (min(n1, n0) + 10)
        cuts.append(weight * _best_cut(z[own], y[own]) + (1 - weight) * every if n1 and n0 else every)
    return {"model": model, "cuts": np.array(cuts)}


def score_texts(docs: DataFrame, fitted: dict, name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name``: 0 to 1, at least 0.5 if toxic. Null texts are scored as empty ones."""
    shape = StructType([StructField("row", docs.select(F.struct("*").alias("r")).schema["r"].dataType), StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            if "rate" in fitted:
                score = np.full(len(batch), fitted["rate"])
            else:
                score = np.zeros(0)
                for slots, docs_, language in inputs(batch.column("text")):
                    z = fitted["model"].logits(slots, docs_) - fitted["cuts"][language]
                    # rounded, so that a text's score doesn't hang on what it is batched with
                    score = np.append(score, np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), 5))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.struct("*").alias("row"), text).mapInArrow(run, shape) \
        .select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() != name.lower()], F.col("score").alias(name))


def texts_of(docs: DataFrame, ids: DataFrame, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``ids`` (doc_id, y; a bounded table) with their texts: one text a doc_id, that of the smallest hash where rows share it,
    none longer than a 32nd of ``max_bytes``, and in order of the doc_ids' hashes at most ``max_bytes`` of each y."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    # as many ids as their limit allows
    one = own.filter(size <= max_bytes // 32).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    line = W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    return one.withColumn("bytes", F.sum(size).over(line)).filter(F.col("bytes") <= max_bytes).drop("bytes")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], learn, max_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str, int]]:
    """At most ``most[label]`` (doc_id, text, label) rows of each label, those with the smallest hash of doc_id, and at most
    ``max_bytes`` of their texts.

    ``learn`` is the condition on doc_id that allows a label to be used. A document's label is the largest it has, its text
    one of its rows' texts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = None
    for y, n in most.items():
        part = own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)
    return [(r[0], r[1], r[2]) for r in texts_of(docs, picked, max_bytes).select("doc_id", "text", "y").collect()]


def toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_clean: int = 6000, folds: int = 5, name: str = "score") -> DataFrame:
    """``docs`` with a toxicity score, learned from labels of rows whose crc32(doc_id) modulo ``folds`` is not 0.

    The network is fitted on a bounded sample of labelled rows: at most ``max_toxic``
    rows of label 1 and ``max_clean`` of label 0, one a doc_id, and 256 MB of each (SAMPLE_BYTES). Every row is scored,
    repeated or not, in batches; a very long text is held with about 100 bytes for each of its bytes. An empty table
    gives an empty one; a column called ``name`` gives way to the score.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % folds == 0
    return score_texts(docs, fit_toxicity(labelled_rows(docs, labels, "toxic", {1: max_toxic, 0: max_clean}, ~held)), name)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
