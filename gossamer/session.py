"""Session factory and the shared-scratch rules every operator follows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "gossamer", master: str | None = None, shuffle: int = 8) -> SparkSession:
    """A UTC, AQE-enabled session. What the submitter has set (also the master) wins."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    mine = {
        "spark.master": master or f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("GOSSAMER_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder
    for key, value in unset(mine, submitted()).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def submitted() -> dict[str, str]:
    """The settings that spark-submit hands to this process, if it runs under it."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return dict(active.sparkContext.getConf().getAll())
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return {}
    from pyspark import SparkConf, SparkContext

    SparkContext._ensure_initialized()
    return dict(SparkConf().getAll())


def unset(mine: dict[str, str], theirs: dict[str, str]) -> dict[str, str]:
    """What of ``mine`` is not in ``theirs``."""
    return {k: v for k, v in mine.items() if k not in theirs}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where one machine is all there is (a local master) a temporary one is set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if root is None:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gossamer-")
        sc.setCheckpointDir(root)
    return root


def is_local(master: str) -> bool:
    """Do driver and executors run in one process (local, local[...])?"""
    return master == "local" or master.startswith("local[")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Sides of joins with more rows than this are not broadcast, however small their files are.
BROADCAST_ROWS = 500_000
#: Rows of a partition where a task holds all its rows.
TASK_ROWS = 1_000_000


def side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as the small side of a join: Spark may broadcast it only up to a counted number of rows
    (it goes by the size of compressed files), beyond it both sides are shuffled and this one is hashed."""
    return df if df.count() <= rows else df.hint("shuffle_hash")


def spread(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by its keys to as many partitions as its rows need, and not fewer than the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Keep Arrow batches of whole texts small in rows and bytes, so that a worker's memory does not
    follow their length. A session that has set smaller ones keeps them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower()
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def trimmed(run):
    """Wrap a batch function so that a reused worker gives freed memory back after each task."""

    def wrapped(batches):
        import ctypes

        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not glibc: nothing to give back

    return wrapped
