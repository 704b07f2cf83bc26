"""Session helpers shared by all operators: tables, scratch storage and parallelism."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}
#: Paths of the tables written by materialize, by the identity of the DataFrame that reads them.
_WRITTEN: dict[int, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test-data table as a DataFrame; only the columns used later are scanned."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share. spark.checkpoint.dir if the session has it, else a local one (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        root = _SCRATCH.setdefault("root", "file://" + tempfile.mkdtemp(prefix="quernstone-"))
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone by then
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, of this application."""
    app = spark.sparkContext.applicationId
    base = f"{checkpoint_root(spark).rstrip('/')}/quernstone-{app}"
    if _SCRATCH.get("base") != base:
        _SCRATCH["base"] = base
        atexit.register(_remove, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one task and not a chain of stages, and lets two
    readers share one computation. Columnar and compressed, so smaller than checkpoint() of rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(table)] = path
    weakref.finalize(table, _WRITTEN.pop, id(table), None)
    return table


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize has written and nothing reads any more, so that loops keep no more than they use."""
    path = _WRITTEN.pop(id(df), None) if df is not None else None
    if path:
        _remove(df.sparkSession, path)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to any more: shuffle files stay on disk until it does, which loops can't wait for."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slots(spark: SparkSession) -> int:
    """Task slots of the cluster."""
    return max(1, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df in at least `least` partitions (task slots by default), for costly Python stages over few files.

    A scan that already has enough splits, the case at scale, is returned as it is, without a shuffle.
    """
    least = least or slots(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= least else df.repartition(2 * least)
