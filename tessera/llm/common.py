"""What the operators share: reading tables, the order of documents, and bounded batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import discard, new_path, shuffles_deleted, stored

__all__ = ["arrow_map", "bucket_of", "cut_points", "discard", "least_hashed", "longs", "new_path", "pieces", "shuffles_deleted", "stored", "table", "texts_of", "trim", "typed"]

MAX_BUCKETS = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as a long, text and ``more`` columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def cut_points(docs: DataFrame, per_bucket: int) -> list[int]:
    """Ascending doc_ids, each present in the table, the least first, that split it into buckets of about ``per_bucket`` rows.

    At most ``MAX_BUCKETS``; an empty table, or one of null ids only, has none.
    """
    low, n = docs.agg(F.min("doc_id"), F.count("doc_id")).first()
    if not n:
        return []
    k = min(MAX_BUCKETS, -(-n // per_bucket))
    if k <= 1:
        return [low]
    at = [i / k for i in range(1, k)]
    marks = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * k))).first()[0]
    return sorted({low, *marks})


def least_hashed(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """(group, key): of each ``group`` at most ``most`` keys, those of the least hash, each once.

    One count for each group goes to the driver. By it a bound on the hash is set that about twice as many rows pass, so no task gets more than those, however many tasks there are.
    """
    h = F.xxhash64(key)
    sizes = {g: n for g, n in rows.groupBy(group).count().collect()}
    every = (1 << 64) - 1
    bounds = {g: min(every, (2 * most + 200) * every // n) - (1 << 63) for g, n in sizes.items()}
    near = F.lit(False)
    for g, top in sorted(bounds.items(), key=lambda x: str(x[0])):
        near = near | (F.col(group).eqNullSafe(F.lit(g)) & (h <= F.lit(top)))
    order = Window.partitionBy(group).orderBy(h, key)
    return rows.where(near).select(group, key).distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(group, key)


def longs(values: list[int]) -> Column:
    """An array literal, sent as one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(doc_id: Column, cuts: list[int]) -> Column:
    """The index of the last cut that is not above ``doc_id``; null ids go to the first bucket. Two short scans, by groups of cuts and within one."""
    if len(cuts) <= 1:
        return F.lit(0)
    width = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = longs([g[0] for g in groups])
    g = F.greatest(F.lit(0), F.size(F.filter(heads, lambda c: c <= doc_id)) - 1)
    inner = F.get(F.array(*map(longs, groups)), g)
    return F.when(doc_id.isNull(), 0).otherwise(F.greatest(F.lit(0), g * width + F.size(F.filter(inner, lambda c: c <= doc_id)) - 1)).cast("int")


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose ``column`` holds about ``limit`` bytes at most, or one row."""
    col = batch.column(column)
    size = col.get_total_buffer_size() if len(col) else 0
    if size <= limit:
        if len(col):
            yield batch
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0))
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    yield batch.slice(at)


def arrow_map(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with bounded slices of the text column ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, "text"):
                yield from fn(part)
        trim()

    return df.mapInArrow(run, schema)


def typed(df: DataFrame, keep: Iterable[str], more: str) -> T.StructType:
    """The schema of ``df``'s columns ``keep``, whatever their names, and of the columns that ``more`` declares."""
    return T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keep), *(T.DataType.fromDDL(more).fields if more else ())])


def trim() -> None:
    """Give memory that a task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it keeps
        ctypes.CDLL("libc.so.6").malloc_trim(0)
