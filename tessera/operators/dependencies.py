"""Functional dependencies, relations as finite measures, and the driver's small closures over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def determines(df: DataFrame, x: dict[str, Column], y: dict[str, Column]) -> DataFrame:
    """(holds, classes, broken): whether equal X have equal Y, among how many classes of X, and how many break it.

    Pairs are made distinct first with map-side partials, so a hot class is as many rows as it has different Y.
    """
    pairs = df.select(F.struct(*[c.alias(n) for n, c in x.items()]).alias("x"), F.struct(*[c.alias(n) for n, c in y.items()]).alias("y")).distinct()
    by = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return by.agg((F.count_if(F.col("n") > 1) == 0).alias("holds"), F.count(F.lit(1)).alias("classes"), F.count_if(F.col("n") > 1).alias("broken"))


def closure(columns: Iterable[str], dependencies: Iterable[tuple[frozenset[str], frozenset[str]]]) -> frozenset[str]:
    """All columns that ``columns`` determine."""
    out, rules = set(columns), list(dependencies)
    while True:
        more = {c for a, b in rules if a <= out for c in b} - out
        if not more:
            return frozenset(out)
        out |= more


def still_holds(before: DataFrame, after: DataFrame, x: dict[str, Column], y: dict[str, Column]) -> bool:
    """Whether the dependency holds on both sides of a change."""
    return all(determines(df, x, y).first()["holds"] for df in (before, after))


def measure(df: DataFrame, keys: dict[str, Column], mass: Column | None = None) -> DataFrame:
    """Classes and their masses: rows, or the sum of ``mass``."""
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg((F.count(F.lit(1)) if mass is None else F.sum(mass)).alias("mass"))


def fibers(measured: DataFrame, over: list[str]) -> DataFrame:
    """For each class over some of the coordinates: its mass and how many joint classes lie above it."""
    return measured.groupBy(*over).agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("classes"))


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, distinct, nulls): one scan; distinct counts are within a few percent."""
    aggs = [a for c in columns for a in (F.approx_count_distinct(c).alias(f"{c}_d"), F.count_if(F.col(c).isNull()).alias(f"{c}_n"))]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"{c}_d").alias("distinct"), F.col(f"{c}_n").alias("nulls")) for c in columns])).alias("s")).select("s.*")
