"""Helpers shared by the operators: scratch tables, byte views of Arrow text, word and substring hashes.

Hashes of substrings come from prefix sums modulo 2^64 over a fixed table of random byte values, so one
pass over the bytes of many documents gives the hash of every word or k-byte string in them.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelspark.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def scratch_table(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: cuts lineage, survives executors.

    ``narrow`` rows (ids and hashes) are written by four tasks a core at most, not one a shuffle partition.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(16, 4 * spark.sparkContext.defaultParallelism))
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and its n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (lo, hi) of documents with about ``most`` bytes together; one long document is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_P, _P_INV):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """n + 1 prefix sums; ``span_hash`` turns two of them into the hash of the bytes between."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and the n + 1 word offsets of the documents; ``between``: bytes of no word."""
    n = len(data)
    sep = np.ones(n + 2, bool)
    sep[1:-1] = between[data]
    inside = offsets[1:-1]
    begins = sep[:-1] & ~sep[1:]
    ends = ~sep[:-1] & sep[1:]
    # a document's first byte opens a word even when the byte before it, in another document, is no separator
    cut = inside[(inside > 0) & (inside < n)]
    cut = cut[~sep[cut] & ~sep[cut + 1]]
    begins[cut] = True
    ends[cut] = True
    starts = np.flatnonzero(begins[:n])
    stops = np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def segments_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths, all runs in one array."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(counts) - counts, counts)


def flat_list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "panelspark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
