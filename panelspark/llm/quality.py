"""Quality score by positive-unlabelled learning: non-negative unbiased risk over trusted positives and unlabelled web text.

Each text becomes a few dozen numbers about its whole bytes: shares of letters, capitals, digits, signs and white
space, length and repetition of words and lines, how much of it a compressor saves. A small network on the
standardised numbers is trained in numpy by the non-negative risk estimator (Kiryo et al., 2017): the positives' loss
times the class prior, plus the part of the unlabelled texts' negative loss that the positives don't explain, never
below zero. The prior is estimated from held-back halves of both samples, ranked by a classifier of positives against
unlabelled texts: the least ratio of the shares above a score (Garg et al., 2021).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelspark.llm.common import chunks, prefix_hash, read_table, span_hash, text_bytes, word_spans
from panelspark.llm.toxicity import labelled_rows, texts_of

HIDDEN = 24
THRESHOLD = 0.7
_KIND = np.zeros((8, 256), np.float32)
for _i, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 11, 12, 13), (10,), [ord(c) for c in ".,;:!?"],
                             [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?"], range(128, 256))):
    _KIND[_i, list(_bytes)] = 1


def features(column) -> np.ndarray:
    """One row of numbers for each text; an empty one has zeros."""
    data, offsets = text_bytes(column)
    out = []
    for lo, hi in chunks(offsets):
        part, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        n = hi - lo
        size = np.diff(off)
        safe = np.maximum(size, 1)[:, None]
        some = size > 0
        kinds = np.zeros((n, 8))
        for i in range(8):
            c = np.concatenate([[0], np.cumsum(_KIND[i][part], dtype=np.float64)])
            kinds[:, i] = (c[off[1:]] - c[off[:-1]])
        start, end, docs = word_spans(part, off)
        words = np.diff(docs)
        h = span_hash(prefix_hash(part, lower=True), start, end) if len(start) else np.zeros(0, np.uint64)
        length = end - start
        first_upper = _KIND[1][part[start]] if len(start) else np.zeros(0)
        last_sign = _KIND[5][part[end - 1]] + 2 * _KIND[6][part[end - 1]] if len(start) else np.zeros(0)
        alone_sign = (length == 1) & (last_sign > 0)
        same_next = np.append(h[1:] == h[:-1], False) if len(h) else np.zeros(0, bool)
        extra = np.zeros((n, 16))
        for d in range(n):
            a, b = docs[d], docs[d + 1]
            text = part[off[d]:off[d + 1]]
            if b > a:
                w = h[a:b]
                m = b - a
                _, count = np.unique(w, return_counts=True)
                pair = w[:-1] * np.uint64(31) + w[1:]
                _, pairs = np.unique(pair, return_counts=True) if m > 1 else (0, np.array([1]))
                extra[d, :9] = (len(count) / m, count.max() / m, len(pairs) / max(m - 1, 1), same_next[a:b - 1].mean() if m > 1 else 0, length[a:b].mean(),
                                length[a:b].std(), first_upper[a:b].mean(), (last_sign[a:b] == 1).mean(), (last_sign[a:b] == 2).mean())
                extra[d, 9] = alone_sign[a:b].mean()
                extra[d, 15] = np.log1p(m)
            if len(text):
                lines = np.flatnonzero(text == 10)
                edges = np.concatenate([[-1], lines, [len(text)]])
                gap = np.diff(edges) - 1
                raw = text.tobytes().split(b"\n")
                extra[d, 10] = len(set(raw)) / len(raw)
                extra[d, 11] = np.log1p(gap.mean())
                extra[d, 12] = np.log1p(gap.std())
                # whole text, in pieces of bounded size
                extra[d, 13] = sum(len(zlib.compress(text[i:i + (1 << 16)].tobytes(), 1)) for i in range(0, len(text), 1 << 16)) / (len(text) + 20)
                extra[d, 14] = np.bincount(np.minimum(text, 128), minlength=129).max() / len(text)
        letters = kinds[:, 0] + kinds[:, 1] + kinds[:, 7]
        own = np.column_stack([kinds / safe, np.log1p(size), kinds[:, 1] / np.maximum(letters, 1), words / safe[:, 0], kinds[:, 4] / np.maximum(words, 1),
                               kinds[:, 5] / np.maximum(words, 1), kinds[:, 6] / np.maximum(words, 1), extra])
        own[~some] = 0
        out.append(own)
    return np.concatenate(out) if out else np.zeros((0, 30))


class Network:
    """One hidden layer on standardised inputs; a logit."""

    def __init__(self, x: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        d = x.shape[1]
        self.p = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]

    def _input(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._input(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of sum(slope * logit)."""
        x = self._input(x)
        a = np.tanh(x @ self.p[0] + self.p[1])
        back = slope[:, None] * self.p[2] * (1 - a * a)
        return [x.T @ back, back.sum(axis=0), a.T @ slope, np.array([slope.sum()])]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, batch: int, seed: int) -> Network:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss; where the second part of a batch
    is below zero, its gradient is turned round. Without a prior, R_p(+) + R_u(-): positives against unlabelled texts."""
    net = Network(unlabelled, seed)
    rng = np.random.default_rng(seed + 1)
    m = [np.zeros_like(p) for p in net.p]
    v = [np.zeros_like(p) for p in net.p]
    for t in range(1, steps + 1):
        xp, xu = positive[rng.integers(0, len(positive), batch)], unlabelled[rng.integers(0, len(unlabelled), batch)]
        zp, zu = net.logits(xp), net.logits(xu)
        share = 0.0 if prior is None else prior
        rest = np.logaddexp(0, zu).mean() - share * np.logaddexp(0, zp).mean()
        gp_neg, gu_neg = -share * _sigmoid(zp) / batch, _sigmoid(zu) / batch
        if rest >= 0:
            grads = [a + b for a, b in zip(net.gradient(xp, -(prior or 1.0) * _sigmoid(-zp) / batch + gp_neg), net.gradient(xu, gu_neg))]
        else:
            grads = [a + b for a, b in zip(net.gradient(xp, -gp_neg), net.gradient(xu, -gu_neg))]
        for i, g in enumerate(grads):
            g = g + 1e-4 * net.p[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            net.p[i] -= 0.01 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """Share of positives among the unlabelled. Above any score lie at least prior * (the positives' share above it) of the
    unlabelled, so the ratio of the two shares is at least the prior, and nearest to it where no others are left; it is
    taken where the ratio and its error bound (of samples of this size) are least together."""
    net = train(positive[::2], unlabelled[::2], None, 400, 256, seed)
    zp, zu = (np.sort(net.logits(x[1::2] if len(x) > 1 else x)) for x in (positive, unlabelled))
    above = [1 - np.searchsorted(z, zp, "left") / len(z) for z in (zp, zu)]
    error = sum(np.sqrt(np.log(40) / 2 / len(z)) for z in (zp, zu))
    ratio = above[1] / above[0]
    # the network's odds need both classes
    return float(np.clip(ratio[np.argmin(ratio + 1.01 * error / above[0])], 0.001, 0.999))


def even_odds(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The logit at which texts are told apart with the least risk at ``prior``: that times the positives' share below, plus
    the unlabelled share above that the positives don't explain. Of all cuts within one standard error of the least risk,
    the middle of the widest gap between neighbouring unlabelled logits."""
    zp, zu = np.sort(np.clip(zp, -12, 12)), np.sort(np.clip(zu, -12, 12))
    if len(zu) < 2:
        return 0.0
    middle = (zu[1:] + zu[:-1]) / 2
    found, above = 1 - np.searchsorted(zp, middle, "left") / len(zp), 1 - np.arange(1, len(zu)) / len(zu)
    risk = prior * (1 - found) + np.maximum(0, above - prior * found)
    least = int(np.argmin(risk))
    error = np.sqrt(prior ** 2 * found[least] * (1 - found[least]) / len(zp) + above[least] * (1 - above[least]) / len(zu))
    return float(middle[np.argmax(np.where(risk <= risk[least] + error, np.diff(zu), -1))])


def fit_quality(positives: list[str], unlabelled: list[str], steps: int = 3000, batch: int = 256, seed: int = 0) -> dict:
    """Network, prior and cut; without positives or unlabelled texts every score is the 0.7 that asks for no decision."""
    if not positives or not unlabelled:
        return {"rate": THRESHOLD}
    xp, xu = features(pa.array(positives, pa.large_string())), features(pa.array(unlabelled, pa.large_string()))
    prior = estimate_prior(xp, xu, seed)
    net = train(xp, xu, prior, steps, batch, seed)
    return {"net": net, "prior": prior, "cut": even_odds(net.logits(xp), net.logits(xu), prior)}


def score_quality(docs: DataFrame, fitted: dict, name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name``: 0 to 1; 0.7 stands for even odds. Null texts are scored as empty ones."""
    shape = StructType([StructField("row", docs.select(F.struct("*").alias("r")).schema["r"].dataType), StructField("score", DoubleType())])
    shift = np.log(THRESHOLD / (1 - THRESHOLD))

    def run(batches):
        for batch in batches:
            score = np.full(len(batch), fitted["rate"]) if "rate" in fitted else np.round(_sigmoid(fitted["net"].logits(features(batch.column("text"))) - fitted["cut"] + shift), 9)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .mapInArrow(run, shape) \
        .select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() != name.lower()], F.col("score").alias(name))


def quality(docs: DataFrame, labels: DataFrame, learn, max_positives: int = 3000, max_unlabelled: int = 6000) -> DataFrame:
    """``docs`` with a quality score. Fitted on at most ``max_positives`` trusted texts (label 1 where ``learn`` allows its
    use) and ``max_unlabelled`` texts without regard to labels, those with the smallest hashes of doc_id,
    one text a doc_id and 256 MB of each (toxicity.SAMPLE_BYTES). Every row is scored, repeated or not; a very long text is
    held by one task. An empty table gives an empty one; a column called score gives way to the score."""
    positives = labelled_rows(docs, labels, "quality", {1: max_positives}, learn)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct() \
        .orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(max_unlabelled)
    some = texts_of(docs, ids.withColumn("y", F.lit(0))).select("doc_id", "text").collect()
    order = lambda rows: [r[1] or "" for r in sorted(rows, key=lambda r: (r[0], r[1] or ""))]
    return score_quality(docs, fit_quality(order(positives), order(some)))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = quality(docs, read_table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
