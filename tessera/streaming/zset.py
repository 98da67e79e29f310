"""Changes as weighted rows: a frame with a column ``_w``, how often a row comes (positive) or goes (negative).

Each rule takes what has changed, and of the state before only what the operator needs, and gives how the operator's result changes. Touched keys
are picked out of the state by semi-joins on the change's keys, so the work follows the change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.operators.exact import exact_sum

W = "_w"


def rows_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != W]


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(W, F.lit(weight).cast("long"))


def change(inserted: DataFrame, removed: DataFrame) -> DataFrame:
    return compact(weighted(inserted).unionByName(weighted(removed, -1)))


def compact(z: DataFrame) -> DataFrame:
    """Each row once, rows whose weights cancel gone."""
    return z.groupBy(*rows_of(z)).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def plus(*zs: DataFrame) -> DataFrame:
    out = zs[0]
    for z in zs[1:]:
        out = out.unionByName(z)
    return compact(out)


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(W, -F.col(W))


def scale(z: DataFrame, k: int) -> DataFrame:
    return z.withColumn(W, F.col(W) * k)


def expand(z: DataFrame) -> DataFrame:
    """The rows as a bag; a negative weight is an error."""
    n = F.when(F.col(W) < 0, F.raise_error(F.lit("NEGATIVE_MULTIPLICITY")).cast("long")).otherwise(F.col(W))
    return z.where(F.col(W) != 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop(W, "_i")


def split(z: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserted, removed) as bags."""
    c = compact(z)
    return expand(c.where(F.col(W) > 0)), expand(negate(c.where(F.col(W) < 0)))


# linear operators: the change goes through them alone


def filtered(dz: DataFrame, condition: Column) -> DataFrame:
    return dz.where(condition)


def projected(dz: DataFrame, *columns: str) -> DataFrame:
    return compact(dz.select(*columns, W))


def unioned(da: DataFrame, db: DataFrame) -> DataFrame:
    return plus(da, db)


# a bilinear one


def matched(x: DataFrame, y: DataFrame, on: list[str], optional: bool = False) -> DataFrame:
    """The natural join on ``on`` of weighted rows; weights multiply. ``optional``: keys may be null, and null meets null."""
    r = y.withColumnsRenamed({W: "_w2"} | {c: f"_r{i}" for i, c in enumerate(on)})
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & (x[c].eqNullSafe(r[f"_r{i}"]) if optional else x[c] == r[f"_r{i}"])
    return x.join(r, same).withColumn(W, F.col(W) * F.col("_w2")).drop("_w2", *[f"_r{i}" for i in range(len(on))])


def joined(a: DataFrame, b: DataFrame, da: DataFrame, db: DataFrame, on: list[str], optional: bool = False) -> DataFrame:
    """Change of the natural join on ``on``: da x b, a x db and da x db, with a and b before the change."""
    return plus(matched(da, touched(b, da, on), on, optional), matched(touched(a, db, on), db, on, optional), matched(da, db, on, optional))


# operators that look at the state of touched keys


def touched(state: DataFrame, dz: DataFrame, by: list[str]) -> DataFrame:
    keys = dz.select(*by).distinct()
    if not by:
        return state
    renamed = keys.toDF(*[f"_t{i}" for i in range(len(by))])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_t{i}"))
    return state.join(renamed, on, "left_semi")


def _by_state(z: DataFrame, dz: DataFrame, by: list[str], result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """result(after) - result(before), over the keys that the change touches."""
    before = touched(z, dz, by)
    return plus(result(plus(before, dz)), negate(result(compact(before))))


def distincted(z: DataFrame, dz: DataFrame) -> DataFrame:
    """A row comes when its weight rises from 0 and goes when it falls to 0."""
    return _by_state(z, dz, rows_of(z), lambda s: s.withColumn(W, F.lit(1).cast("long")))


def counted(z: DataFrame, dz: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Group counts: the old row goes and the new one comes; a key whose count is 0 has none, but without keys there is always one."""

    def result(s: DataFrame) -> DataFrame:
        out = s.groupBy(*by).agg(F.coalesce(F.sum(W), F.lit(0)).cast("long").alias(name))
        return weighted(out.where(F.col(name) != 0) if by else out)

    return _by_state(z, dz, by, result)


def summed(z: DataFrame, dz: DataFrame, by: list[str], value: str, scale_: int, name: str = "s") -> DataFrame:
    """Exact group sums of decimals with ``scale_`` places; a key without rows has none."""

    def result(s: DataFrame) -> DataFrame:
        v = F.col(value).cast(f"decimal(38,{scale_})")
        out = s.groupBy(*by).agg(F.coalesce(F.sum(v * F.col(W).cast("decimal(18,0)")), F.lit(0)).cast(f"decimal(38,{scale_})").alias(name), F.coalesce(F.sum(W), F.lit(0)).alias("_n"))
        return weighted((out.where("_n <> 0") if by else out).drop("_n"))

    return _by_state(z, dz, by, result)


def exact_summed(z: DataFrame, dz: DataFrame, by: list[str], value: str, name: str = "s") -> DataFrame:
    """Exact group sums of doubles, of the keys that the change touches; a key without rows has none."""

    def result(s: DataFrame) -> DataFrame:
        return weighted(exact_sum(s, {f"_g{i}": F.col(c) for i, c in enumerate(by)}, F.col(value), {}, name, F.col(W)).withColumnsRenamed({f"_g{i}": c for i, c in enumerate(by)}))

    return _by_state(z, dz, by, result)


def first_keys(s: DataFrame, key: str, descending: bool, k: int) -> DataFrame:
    """(key, _n): the first ``k`` values of ``key`` that rows have, in order, with how many rows have each."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    return s.groupBy(key).agg(F.sum(W).alias("_n")).where("_n > 0").orderBy(order).limit(k)


def top_rows(s: DataFrame, key: str, descending: bool, k: int) -> DataFrame:
    """The first ``k`` rows by weight, with all that tie with the last: rows are counted by key, and the bounded sort picks the edge."""
    if k == 0:
        return s.limit(0)
    # at most k rows: their running count finds the k-th
    edge = first_keys(s, key, descending, k).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("v"), "_n")), asc=not descending).alias("a")).select(
        F.aggregate("a", F.struct(F.lit(0).cast("long").alias("n"), F.get(F.col("a"), F.lit(0)).getField("v").alias("v")), lambda acc, x: F.when(acc.getField("n") >= k, acc).otherwise(F.struct((acc.getField("n") + x.getField("_n")).alias("n"), x.getField("v").alias("v")))).getField("v").alias("_edge")
    )
    inside = F.col(key) >= F.col("_edge") if descending else F.col(key) <= F.col("_edge")
    return compact(s).where(F.col(W) > 0).join(F.broadcast(edge), inside).drop("_edge")  # one row is broadcast


def topped(z: DataFrame, dz: DataFrame, key: str, descending: bool, k: int) -> DataFrame:
    """Top-k with ties, before and after."""
    return plus(top_rows(z.unionByName(dz), key, descending, k), negate(top_rows(z, key, descending, k)))


def differenced(a: DataFrame, b: DataFrame, da: DataFrame, db: DataFrame, as_set: bool = False) -> DataFrame:
    """Bags: the weight by which a exceeds b. Sets: a's rows that b lacks."""
    by = rows_of(a)

    def result(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.withColumns({"_a": F.col(W), "_b": F.lit(0).cast("long")}).unionByName(y.withColumns({"_a": F.lit(0).cast("long"), "_b": F.col(W)})).groupBy(*by).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        w = F.when((F.col("_a") > 0) & (F.col("_b") <= 0), 1).otherwise(0) if as_set else F.greatest(F.col("_a") - F.greatest(F.col("_b"), F.lit(0)), F.lit(0))
        return both.select(*by, w.cast("long").alias(W)).where(F.col(W) > 0)

    keys = da.select(*by).unionByName(db.select(*by)).distinct()
    ta, tb = touched(a, keys, by), touched(b, keys, by)
    return plus(result(plus(ta, da), plus(tb, db)), negate(result(compact(ta), compact(tb))))


def anti_joined(a: DataFrame, b: DataFrame, da: DataFrame, db: DataFrame, on: str) -> DataFrame:
    """Rows of a without a row of b of the same key; b has only the key."""

    def result(x: DataFrame, y: DataFrame) -> DataFrame:
        blocked = y.groupBy(on).agg(F.sum(W).alias("_n")).where("_n > 0").select(F.col(on).alias("_k"))
        return x.join(blocked, F.col(on).eqNullSafe(F.col("_k")), "left_anti")

    keys = da.select(on).unionByName(db.select(on)).distinct()
    ta, tb = touched(a, keys, [on]), touched(b, keys, [on])
    return plus(result(plus(ta, da), plus(tb, db)), negate(result(compact(ta), compact(tb))))


# recomputation, for any query and as the rules' check


def recomputed(before: DataFrame, after: DataFrame) -> DataFrame:
    """What has come and gone between two results."""
    return plus(weighted(after), weighted(before, -1))


def impacted(before: DataFrame, after: DataFrame) -> bool:
    return not recomputed(before, after).isEmpty()


def observation(df: DataFrame) -> DataFrame:
    """(rows, key): a key of a result as a bag, the same for any order of its rows."""
    cols = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]
    h = F.xxhash64(*cols)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("key"))


def require_nonnegative(z: DataFrame) -> DataFrame:
    if not compact(z).where(F.col(W) < 0).isEmpty():
        raise QueryError("a change removes rows that are not there")
    return z
