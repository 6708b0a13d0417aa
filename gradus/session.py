"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: HotSpot's limit (HugeMethodLimit) for methods that it compiles
JIT_BYTES = 8000
#: of one batch between the JVM and a Python worker, where rows are large
BATCH_BYTES = 8 << 20


def get_spark(master: str | None = None, app: str = "gradus",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators assume.

    On a cluster the master and sizing come from spark-submit; the local
    defaults here only apply when nothing else is configured.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("GRADUS_DRIVER_MEMORY", "16g"))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    local run (one JVM, as in tests) gets a fresh local folder; any other master
    is an error, since executors would not share the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: master {sc.master} needs a folder "
                               "that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="gradus-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def compiled(df: DataFrame) -> DataFrame:
    """``df``, in a session that leaves no generated method to the bytecode interpreter.

    HotSpot compiles no method above 8,000 bytes.  A long chain of projections in one stage
    makes a larger one; with this limit Spark runs them one by one, each compiled.  A lower
    limit of the user's stays.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.codegen.hugeMethodLimit")) > JIT_BYTES:
        conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_BYTES))
    return df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose batches for Python workers have ``BATCH_BYTES`` at most.

    A task holds a batch in the JVM, outside its heap, and once more in its worker.  A lower
    limit of the user's stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", conf.get(key).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    As ``checkpoint()`` it cuts the lineage for lost executors, but it computes the rows
    once and leaves Spark their size, so that joins with small tables are planned as such.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
