"""Weighted rows in stored tables by a hash of their key: a new set of files for each change, folded when ``FOLD`` have gathered, and read by the folders of the keys that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import delete, new_path
from tessera.streaming import zset as z

BUCKETS = 64
FOLD = 16


def _bucket(by: list[str]) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int") if by else F.lit(0)


class Arrangement:
    """Weighted rows by the columns ``by``."""

    def __init__(self, spark: SparkSession, by: list[str], rows: DataFrame) -> None:
        self.spark, self.by, self.schema = spark, by, rows.schema
        self.folders: list[str] = []
        self.add(z.compact(rows))

    def add(self, rows: DataFrame) -> None:
        path = new_path(self.spark, "arrangement")
        rows.select(*self.schema.names).withColumn("_bucket", _bucket(self.by)).write.partitionBy("_bucket").parquet(path)
        self.folders.append(path)
        if len(self.folders) > FOLD:
            old, self.folders = self.folders, []
            self.add(z.compact(self._read(old)))
            for gone in old:
                delete(self.spark, gone)

    def _read(self, folders: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        parts = [self.spark.read.schema(schema).option("basePath", f).parquet(f) for f in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("_bucket") if not self.by else out

    def rows(self) -> DataFrame:
        return self._read(self.folders).select(*self.schema.names)

    def touched(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among those of ``keys``."""
        if not self.by:
            return self.rows()
        return z.touched(self._read(self.folders).where(F.col("_bucket").isin(self.wanted(keys))).select(*self.schema.names), keys, self.by)

    def wanted(self, keys: DataFrame) -> list[int]:
        """The folders that the keys are in; at most BUCKETS numbers go to the driver."""
        return [r[0] for r in keys.select(_bucket(self.by)).distinct().collect()]
