"""Sums of doubles that are exact until one rounding at the end, and order statistics.

A finite double is a whole number of 2**-1074. It is split into a signed 53-bit mantissa and an exponent, the exponent into a window of
``STEP`` bits and a shift within it, and the shifted mantissa is cut into 32-bit limbs whose sums are kept by window and limb as 64-bit integers. Integer addition is
associative, so partial sums in any order give the same limbs; all of that is built-in aggregation with map-side partials. The last step rebuilds the big
integer of each group from at most ``MOST_WINDOWS`` x 4 limb sums and rounds it once to a double.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.errors import QueryError
from tessera.sources.store import stored

STEP = 32
#: Windows of the exponent of a double, from that of the least subnormal on.
MOST_WINDOWS = 2098 // STEP + 1


def _finite(c: Column) -> Column:
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("NON_FINITE_SUM: only finite values have an exact sum")).cast("double")).otherwise(c)


def exponent(c: Column) -> Column:
    """e such that 2**e <= |c| < 2**(e+1); -1074 for 0. The logarithm is a guess that comparisons correct."""
    a = F.abs(c)
    guess = F.when(a > 0, F.floor(F.log2(a))).otherwise(F.lit(-1074)).cast("int")
    guess = F.greatest(F.lit(-1074), F.least(F.lit(1023), guess))
    return F.when(_power(guess) > a, guess - 1).when((guess < 1023) & (_power(guess + 1) <= a), guess + 1).otherwise(guess)


def _power(e: Column) -> Column:
    """2.0**e for whole e from -1074 to 1024, from a table. It goes to Spark as one string: a literal for each entry would cost a call each."""
    table = ",".join(repr(math.ldexp(1.0, k)) if k < 1024 else "Infinity" for k in range(-1074, 1025))
    return F.element_at(F.split(F.lit(table), ",").cast("array<double>"), e + 1075)


def low_bit(c: Column) -> Column:
    """k such that c is a whole number of 2**(k - 1074) and at most 53 bits wide."""
    return F.greatest(F.lit(0), exponent(c) + 1074 - 52)


def mantissa(c: Column, low: Column) -> Column:
    """c * 2**(1074 - low) as a whole number, in two steps whose factors are powers of two, so that neither rounds."""
    up = 1074 - low
    part = F.shiftright(up, 1)
    return (c * _power(part) * _power(up - part)).cast("long")


def limbs(c: Column, low: Column | None = None, m: Column | None = None) -> Column:
    """struct(w, l0, l1, l2): c = (l0 + l1 * 2**32 + l2 * 2**64) * 2**(STEP * w - 1074)."""
    low = low_bit(c) if low is None else low
    m = mantissa(c, low) if m is None else m
    w = F.shiftright(low, 5)
    shift = low - w * STEP
    sign, a = F.when(m < 0, -1).otherwise(1).cast("long"), F.abs(m)
    lo, hi = a.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(a, 32)  # hi has 21 bits at most
    mul = F.element_at(F.lit([1 << k for k in range(STEP)]), shift + 1)
    x, y = lo * mul, hi * mul  # at most 63 and 52 bits
    x0, x1 = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    y0, y1 = y.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(y, 32)
    return F.struct(w.alias("w"), (sign * x0).alias("l0"), (sign * (x1 + y0)).alias("l1"), (sign * y1).alias("l2"))


@F.pandas_udf(DoubleType())
def _rounded(windows: pd.Series) -> pd.Series:
    return pd.Series([to_double([(x["w"], x["s0"], x["s1"], x["s2"]) for x in w]) for w in windows], dtype=float)


def to_double(windows: list[tuple[int, int, int, int]]) -> float:
    """The double nearest to the sum of the windows, ties to even; beyond the greatest, infinity."""
    total = 0
    for w, a, b, c in windows:
        total += (int(a) + (int(b) << 32) + (int(c) << 64)) << (STEP * int(w))
    if not total:
        return 0.0
    try:
        return float(Fraction(total, 1 << 1074))
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def exact_sum(df: DataFrame, by: dict[str, Column], value: Column, shown: dict[str, Column], name: str, weight: Column | None = None) -> DataFrame:
    """The ``by`` columns, the least of each of ``shown``, and the exact sum of ``value``; a single row with 0.0 for no keys and no rows.

    Values that are null don't count. A limb's sum stays within 64 bits for 2**31 rows of one group and window; ANSI mode raises beyond.
    With ``weight`` each row counts so many times, and a group whose weights sum to 0 has no row.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    held = df.select(*[c.alias(n) for n, c in by.items()], *[c.alias(n) for n, c in shown.items()], _finite(value).alias("_v"), w.alias("_times"))
    # a step for each part, so that none is computed again for every use
    held = held.withColumn("_low", low_bit(F.col("_v"))).withColumn("_m", mantissa(F.col("_v"), F.col("_low")))
    held = held.select(*by, *shown, "_times", limbs(F.col("_v"), F.col("_low"), F.col("_m")).alias("_x"))
    least = [F.min(n).alias(n) for n in shown]
    parts = held.groupBy(*by, F.col("_x.w").alias("w")).agg(*[F.sum(F.col(f"_x.l{k}") if weight is None else F.col(f"_x.l{k}") * F.col("_times")).alias(f"s{k}") for k in range(3)], F.sum("_times").alias("_times"), *least)
    windows = F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "s0", "s1", "s2"))).alias("_w")  # MOST_WINDOWS at most
    sums = parts.groupBy(*by).agg(windows, F.sum("_times").alias("_times"), *least)
    if weight is not None and by:
        sums = sums.where("_times <> 0")
    return sums.select(*by, *shown, _rounded("_w").alias(name))


def decimal_sum(df: DataFrame, by: list[str], value: str, scale: int, name: str) -> DataFrame:
    """Exact sums of doubles that stand for decimals of ``scale`` places; a value that is none of them is an error."""
    c = F.col(value)
    d = c.cast(f"decimal(38,{scale})")
    kept = F.when(d.cast("double") == c, d).when(c.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit(f"{value} has more than {scale} places")).cast(f"decimal(38,{scale})"))
    return df.groupBy(*by).agg(F.coalesce(F.sum(kept), F.lit(0)).cast(f"decimal(38,{scale})").alias(name))


# order statistics: of a multiset in its order, with places from 0


def order_statistic(df: DataFrame, by: list[str], value: str, key: Column, statistic: str, at: float | int = 0, name: str = "stat", spread: bool | None = None) -> DataFrame:
    """One of ``min``, ``max``, ``kth_start``, ``kth_end`` (places from 0) and ``lower_quantile`` (place floor(p * (n - 1))) by group.

    Groups without such a place have no row. Values are counted first, so what is sorted are a group's distinct values. With ``spread``, as always without
    groups, no task holds all of a group: values are dealt by ranges, and only the range that has the place, told by the ranges' totals, is looked at again.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.struct(key.alias("o")).alias("_o")).agg(F.min(value).alias("_v"), F.count(F.lit(1)).alias("_c"))
    if statistic in ("min", "max"):
        pick = F.min_by if statistic == "min" else F.max_by
        return counted.groupBy(*by).agg(pick("_v", "_o").alias(name)).where(F.col(name).isNotNull())
    n = F.col("_n")
    place = {"kth_start": F.lit(int(at) if statistic != "lower_quantile" else 0), "kth_end": n - 1 - F.lit(int(at) if statistic != "lower_quantile" else 0), "lower_quantile": F.floor(F.lit(float(at)) * (n - 1).cast("double"))}.get(statistic)
    if place is None or statistic == "lower_quantile" and not 0 <= at <= 1:
        raise QueryError(f"no order statistic {statistic} at {at}")
    if spread is False or spread is None and by:
        w = Window.partitionBy(*by)
        placed = counted.withColumns({"_hi": F.sum("_c").over(w.orderBy("_o")), "_n": F.sum("_c").over(w)})
        return placed.where((place >= F.col("_hi") - F.col("_c")) & (place < F.col("_hi"))).select(*by, F.col("_v").alias(name))
    dealt = stored(counted.repartitionByRange(*by, "_o").withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "_range").agg(F.sum("_c").alias("_t"))  # a row for each range, and group that is in it
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    found = totals.withColumns({"_upto": F.sum("_t").over(w.orderBy("_range")), "_n": F.sum("_t").over(w)})
    found = found.where((place >= F.col("_upto") - F.col("_t")) & (place < F.col("_upto"))).withColumn("_left", place - F.col("_upto") + F.col("_t"))
    found = found.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), "_left")
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    near = dealt.join(found, same).withColumn("_hi", F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy("_o")))
    return near.where((F.col("_left") >= F.col("_hi") - F.col("_c")) & (F.col("_left") < F.col("_hi"))).select(*by, F.col("_v").alias(name))


def rank_below(df: DataFrame, by: list[str], key: Column, bound: Column, name: str = "rank") -> DataFrame:
    """How many of each group's rows are below ``bound``."""
    return df.groupBy(*by).agg(F.count_if(key < bound).alias(name))
