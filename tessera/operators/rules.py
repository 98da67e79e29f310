"""Declarative rules as queries for what breaks them: rows (rule, witness, mass), none where a rule holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import Pattern, matches
from tessera.operators.exact import exact_sum, order_statistic


def _broken(df: DataFrame, rule: str, witness: Column, mass: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), witness.cast("string").alias("witness"), mass.cast("double").alias("mass"))


# conditions on one row


def in_range(c: Column, low: int | None = None, high: int | None = None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (c >= low)
    return out if high is None else out & (c <= high)


def text_length(c: Column, low: int | None = None, high: int | None = None) -> Column:
    """By Unicode characters."""
    return in_range(F.length(c), low, high)


def one_of(c: Column, *values: str) -> Column:
    return c.isin(*values)


def text_matches(c: Column, pattern: Pattern) -> Column:
    return matches(c, pattern)


def rows(df: DataFrame, rule: str, key: str, holds: Column) -> DataFrame:
    """A row of mass 1 for each row of ``df`` for which ``holds`` is not true."""
    return _broken(df.where(~F.coalesce(holds, F.lit(False))), rule, F.col(key), F.lit(1))


def unless_none(c: Column, holds: Column) -> Column:
    return c.isNull() | holds


# conditions on all rows, or on each group that has a row


def _outside(x: Column, low: float | None, high: float | None) -> Column:
    zero = F.lit(0).cast("double")
    below = F.lit(low).cast("double") - x if low is not None else zero
    above = x - F.lit(high).cast("double") if high is not None else zero
    return F.greatest(zero, below, above)


def _measured(df: DataFrame, rule: str, by: list[str], measure: str, low: float | None, high: float | None) -> DataFrame:
    mass = _outside(F.col(measure).cast("double"), low, high)
    witness = F.concat_ws("|", *[F.col(b).cast("string") for b in by]) if by else F.lit("all")
    return _broken(df.withColumn("_m", mass).where("_m > 0"), rule, witness, F.col("_m"))


def count_range(df: DataFrame, rule: str, where: Column | None = None, low: int | None = None, high: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows that satisfy ``where``, in all or by group; a group without any still counts with 0. The mass is the distance from the range."""
    n = F.count_if(where) if where is not None else F.count(F.lit(1))
    return _measured(df.groupBy(*by).agg(n.alias("_x")), rule, list(by), "_x", low, high)


def exists(df: DataFrame, rule: str, where: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    return count_range(df, rule, where, low=1, by=by)


def every(df: DataFrame, rule: str, holds: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return count_range(df, rule, ~F.coalesce(holds, F.lit(False)), high=0, by=by)


def sum_range(df: DataFrame, rule: str, value: str, where: Column | None = None, low: float | None = None, high: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The exact sum of ``value`` over rows that satisfy ``where``; 0.0 for none."""
    v = F.when(where, F.col(value)) if where is not None else F.col(value)
    return _measured(exact_sum(df, {b: F.col(b) for b in by}, v, {}, "_x"), rule, list(by), "_x", low, high)


def statistic_range(df: DataFrame, rule: str, value: str, statistic: str, at: float = 0, where: Column | None = None, low: float | None = None, high: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """An order statistic; without a value at that place the rule holds."""
    kept = df.where(where) if where is not None else df
    return _measured(order_statistic(kept, list(by), value, F.col(value), statistic, at, "_x"), rule, list(by), "_x", low, high)


def compare(left: DataFrame, right: DataFrame, rule: str, holds: Callable[[Column, Column], Column]) -> DataFrame:
    """Two one-row, one-column measures, possibly of different relations; the mass is how far they are apart."""
    a, b = left.toDF("_a"), right.toDF("_b")
    both = a.withColumn("_j", F.lit(1)).join(b.withColumn("_j", F.lit(1)), "_j")
    gap = F.abs(F.col("_a").cast("double") - F.col("_b").cast("double"))
    return _broken(both.where(~holds(F.col("_a"), F.col("_b"))), rule, F.lit("all"), F.greatest(gap, F.lit(1.0)))


def unique(df: DataFrame, rule: str, *keys: Column) -> DataFrame:
    """Mass: how many rows of a key there are beyond the first."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    found = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _broken(found, rule, F.concat_ws("|", *[F.col(f"k{i}").cast("string") for i in range(len(keys))]), F.col("_n") - 1)


def dangling(df: DataFrame, rule: str, key: str, ref: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference leads nowhere; an absent reference is none."""
    ids = target.select(F.col(target_key).alias("_t"))
    return _broken(df.where(F.col(ref).isNotNull()).join(ids, F.col(ref) == F.col("_t"), "left_anti"), rule, F.col(key), F.lit(1))


def severity(violations: DataFrame) -> DataFrame:
    """Total mass of each broken rule."""
    return violations.groupBy("rule").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("witnesses"))
