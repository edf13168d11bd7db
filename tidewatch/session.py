"""One place for session settings, table access and tables written to the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
#: Rows and bytes handed to Python at once. Whole texts travel in these batches, and what a worker makes of
#: one batch is the memory that it keeps, so both are low; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Folders made by ``shared_dir`` and not yet cleared.
_MADE: list[str] = []


def session(app: str = "tidewatch", cpus: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's settings win."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", f"local[{n}]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; whatever reads one hands its rows to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors see.

    Where the setting is missing (plain local runs), the driver's temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_dir()
    path = f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Removes the folders of tables that this process wrote between its stages, and says how many.

    A query's result reads them until it has been saved, so whoever saves it calls this afterwards; the command
    line and the bench do.
    """
    hadoop, conf, n = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), len(_MADE)
    while _MADE:
        path = hadoop.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and a lost executor costs no recomputation."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
