"""Incremental ingest of raw price files with Structured Streaming.

The reference has no streaming path; its loader is a one-off glob. A file
always arrives whole in one micro-batch, so each micro-batch runs exactly the
batch rules (``files.ingest_rows``: header names, file-level rejects, key check
within the batch) and writes its own ``batch=N`` folder, overwritten when the
batch is replayed: exactly-once together with the checkpoint. ``availableNow``
processes everything present and stops, which is how a scheduled job uses it.
Keys that repeat across batches are checked on the sink (``set_panel_key``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import checkpoint_dir
from panelspark.sources.files import ingest_rows, parse_lines, read_lines


def stream_ingest(spark: SparkSession, path: str, sink: str, glob: str = "*.us.txt",
                  checkpoint: str | None = None, available_now: bool = True, max_files: int | None = None,
                  key_policy: str = "fail"):
    """Start the streaming ingest into ``sink`` (Parquet, partitioned by batch
    and year). Returns the StreamingQuery (already finished with ``available_now``)."""
    def write(lines: DataFrame, batch: int) -> None:
        rows = ingest_rows(parse_lines(lines), strict_dates=False, key_policy=key_policy)
        rows.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(f"{sink}/batch={batch}")

    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "streams", os.path.basename(sink.rstrip("/")))
    w = read_lines(spark, path, glob, streaming=True, max_files=max_files).writeStream \
        .foreachBatch(write).option("checkpointLocation", ckpt)
    q = w.trigger(availableNow=True).start() if available_now else w.trigger(processingTime="1 minute").start()
    if available_now:
        q.awaitTermination()
    return q
