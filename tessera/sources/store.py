"""Tables between the steps of one computation, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and driver and executors are one process, as in tests."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tessera-")
    return _own


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, an execution's shuffle files go as it ends; nothing reads them again once its table is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, which ends its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path  # type: ignore[attr-defined]
    return out


def stored_with_count(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stored``, and how many rows that were, counted as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    delete(df.sparkSession, df.stored_at)  # type: ignore[attr-defined]


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
