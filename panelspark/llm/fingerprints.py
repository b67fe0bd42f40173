"""Document fingerprints: bottom-k sketches of byte-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles (runs of ``size`` bytes; a shorter text is one
shingle). Sketches merge: that of a whole is the k smallest of its parts' hashes. Two sketches estimate resemblance
(shared among the k smallest of the union), containment, and one alone the number of distinct shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import CHUNK_BYTES, mix, prefix_hash, read_table, scratch_table, span_hash

K, SIZE = 64, 9
RANGE_BYTES, MOST_RANGES = 4 << 20, 20_000


def _smallest(h: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, ascending; looks first at those below a bound that about 4 k of them pass."""
    if len(h) > 16 * k:
        some = np.unique(h[h <= np.uint64(int(2**64 * (4 * k / len(h))))])
        if len(some) >= k:
            return some[:k]
    return np.unique(h)[:k]


def sketch(text: bytes, k: int = K, size: int = SIZE) -> np.ndarray:
    """Bottom-k sketch of a whole text; a long one is sketched in overlapping parts that are merged. Empty: no hashes."""
    if not text:
        return np.zeros(0, np.uint64)
    if len(text) < size:
        data = np.frombuffer(text, np.uint8)
        return mix(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)])) + np.uint64(len(data)))
    parts = []
    for lo in range(0, len(text) - size + 1, CHUNK_BYTES):
        data = np.frombuffer(text, np.uint8)[lo:lo + CHUNK_BYTES + size - 1]
        start = np.arange(len(data) - size + 1)
        parts.append(_smallest(span_hash(prefix_hash(data), start, start + size), k))
    return parts[0] if len(parts) == 1 else merge(parts, k)


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """Sketch of the union of the shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))[:k]


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Exact below k; above, from the k-th smallest hash."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated intersection over union; 1 for two empty sketches, exact when the union has at most k hashes."""
    if not len(a) and not len(b):
        return 1.0
    union = merge([a, b], k)
    return float(len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_shingles(merge([a, b], k), k)
    return float(min(1.0, both / distinct_shingles(a, k)))


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) of every row; equal texts have equal fingerprints, null and empty texts the empty string."""
    def run(batches):
        for batch in batches:
            prints = [to_text(sketch((t.as_py() or "").encode("utf-8", "replace"), k, size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def follow(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """Documents in descending order of doc_id, dealt into ranges: rows (g, doc_id, text, h, own), and the number of ranges.

    Each range also holds, with own false and last, the one document that follows its last. There are at most
    MOST_RANGES of them, so the table of their first documents is small; a range itself is only ever streamed. Rows
    without doc_id come last, in ranges of their texts' hashes h; equal doc_ids in descending order of h.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stats = docs.agg(F.sum(F.octet_length("text").cast("long") + 16), F.count("doc_id"), F.count(F.lit(1))).first()
    wanted = min(MOST_RANGES, max(1, -(-int(stats[0] or 0) // range_bytes)))
    cuts = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.2 / wanted) if wanted > 1 and stats[1] else []
    cuts = sorted({int(c) for c in cuts})
    nulls = 1 if stats[1] == stats[2] else wanted
    steps = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # how many cuts lie at or above the id; rows without id go on behind, by descending h
    above = F.size(F.filter(steps, lambda c: c >= F.col("doc_id")))
    tail = len(cuts) + 1 + F.floor((F.lit(2.0**63) - 1 - F.col("h").cast("double")) / F.lit(2.0**64) * nulls).cast("int")
    keyed = docs.withColumn("h", F.xxhash64("text")).withColumn("g", F.when(F.col("doc_id").isNull(), F.least(tail, F.lit(len(cuts) + nulls))).otherwise(above))
    heads = scratch_table(keyed.groupBy("g").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("head")), "heads")
    every = W.partitionBy(F.lit(0))
    heads = heads.select("g", F.coalesce(F.lead("g").over(every.orderBy(F.col("g").desc())), F.max("g").over(every)).alias("to"),
                         F.col("head.doc_id").alias("head_id"), F.col("head.h").alias("head_h"))
    heads = heads.withColumnRenamed("g", "from")
    borders = keyed.join(F.broadcast(heads), (keyed["g"] == heads["from"]) & keyed["doc_id"].eqNullSafe(heads["head_id"]) & (keyed["h"] == heads["head_h"])) \
        .groupBy(F.col("to").alias("g"), "doc_id", "h").agg(F.first("text").alias("text"))
    cols = ["g", "doc_id", "text", "h", "own"]
    rows = keyed.withColumn("own", F.lit(True)).select(cols).union(borders.withColumn("own", F.lit(False)).select(cols))
    return rows, len(cuts) + nulls


def edited_fingerprints(docs: DataFrame, k: int = K, size: int = SIZE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and of the same kind
    distinct (estimated shingles) and contained (estimated share of the document's shingles in the edited text).

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document, by
    descending doc_id, after the last the first. Null texts are empty; a lone document is its own next one. Rows
    without doc_id come after all others; rows with one doc_id follow each other in order of their texts' hashes.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct", "contained"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def run(batches):
        last = None  # (g, doc_id, text, sketch) of the document that waits for its next one
        for batch in batches:
            rows = []
            for g, doc, text, own in zip(*(batch.column(c).to_pylist() for c in ("g", "doc_id", "text", "own"))):
                a = sketch(text.encode("utf-8", "replace"), k, size)
                if last is not None and last[0] == g:
                    half = len(last[2]) // 2
                    edited = (last[2][:len(last[2]) - half] + text[:half]).encode("utf-8", "replace")
                    b = sketch(edited, k, size)
                    rows.append((last[1], len(last[2]), hashlib.sha256(edited).hexdigest(), to_text(last[3]), to_text(b), resemblance(last[3], b, k),
                                 resemblance(last[3], a, k), distinct_shingles(last[3], k), containment(last[3], b, k)))
                last = (g, doc, text, a) if own else None
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    rows, ranges = follow(docs, range_bytes)
    rows = rows.repartition(ranges, "g").sortWithinPartitions("g", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return rows.select("g", "doc_id", "text", "own").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
             "distinct double, contained double")


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))
