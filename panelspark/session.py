"""Session defaults and the lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: ANSI arithmetic (every division and log is
# guarded explicitly), AQE for runtime re-planning and skew splitting, UTC dates.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "panelspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster ``master`` stays unset so the launcher decides; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when it is unset (local tests)
    a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        # Only local tests leave it unset; on a cluster a machine-local folder would lose data.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="panelspark-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a statement's shuffle files go when it ends; otherwise they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame, name: str | None = None, compression: str = "snappy") -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut its lineage.

    With a ``name`` the frame is written as Parquet under the checkpoint folder
    and read back (column statistics and pruning stay available), and the files
    of its shuffles go at once. Where fits draw rows at random, their draws hang
    on the files' sizes, hence on ``compression``. Otherwise a reliable ``checkpoint()`` is used.
    ``localCheckpoint`` is never used: its blocks die with the executor that
    holds them.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if name:
        path = os.path.join(base, "tables", name)
        with shuffles_dropped(spark):
            df.write.mode("overwrite").option("compression", compression).parquet(path)
        return spark.read.parquet(path)
    return df.checkpoint(eager=True)


def drop_table(spark: SparkSession, name: str) -> None:
    """Delete a table that ``cut_lineage`` wrote under ``name`` and that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint_dir(spark), "tables", name))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
