"""Plans to DataFrames. Columns are named c0, c1, ... by position; keys are added where a column's equality is not Spark's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import types as ty
from tessera.functions.equality import Eq, Order, eq_key, literal, order_key
from tessera.operators.exact import exact_sum
from tessera.plans.nodes import (
    AntiJoin, Difference, Distinct, FilterEqColumns, FilterEqConst, FilterOrderConst, Fixpoint, Group, JoinEq, Plan, Project, PromoteToBag, Scan, TopKWithTies, Union,
)
from tessera.schema import SET, RelType, Schema


@dataclass
class Lowering:
    """``source`` gives the rows of a relation, ``leaves`` those of fixpoint leaves by name."""

    schema: Schema
    source: Callable[[str], DataFrame]
    leaves: dict[str, DataFrame] = field(default_factory=dict)

    def run(self, plan: Plan) -> DataFrame:
        """Typecheck and lower."""
        plan.type(self.schema)
        return self._lower(plan)

    def _lower(self, p: Plan) -> DataFrame:
        match p:
            case Scan(name):
                rel = self.schema.relation(name)
                df = self.source(name)
                return df.select(*[F.col(f"`{n}`").cast(t.spark()).alias(f"c{i}") for i, (n, t) in enumerate(rel.columns)])
            case Fixpoint(name):
                return _positional(self.leaves[name])
            case FilterEqConst(i, c, value, eq):
                t = i.type(self.schema).columns[c]
                return self._lower(i).where(_equal(F.col(f"c{c}"), literal(value, t), eq, t))
            case FilterOrderConst(i, c, value, order, comparison):
                t = i.type(self.schema).columns[c]
                return self._lower(i).where(compare(F.col(f"c{c}"), value, order, comparison, t))
            case FilterEqColumns(i, a, b, eq):
                t = i.type(self.schema).columns[a]
                return self._lower(i).where(_equal(F.col(f"c{a}"), F.col(f"c{b}"), eq, t))
            case Project(i, columns):
                out = self._lower(i).select(*[F.col(f"c{c}").alias(f"c{k}") for k, c in enumerate(columns)])
                t = p.type(self.schema)
                # a set stays a set: equal rows of the projection become one, unless all columns are still there
                return distinct(out, t) if t.kind == SET and not set(range(len(i.type(self.schema).columns))) <= set(columns) else out
            case PromoteToBag(i):
                return self._lower(i)
            case JoinEq(a, b, ca, cb, eq):
                left, right = self._lower(a), self._lower(b)
                n, ta = len(left.columns), a.type(self.schema).columns[ca]
                right = right.toDF(*[f"c{n + k}" for k in range(len(right.columns))])
                x, y = eq_key(F.col(f"c{ca}"), eq, ta), eq_key(F.col(f"c{n + cb}"), eq, ta)
                # without an option on the key there are no nulls, and plain equality plans best
                return left.join(right, x.eqNullSafe(y) if isinstance(ta, ty.Option) else x == y)
            case AntiJoin(a, b, ca, cb, eq):
                ta = a.type(self.schema).columns[ca]
                return anti(self._lower(a), self._lower(b), ca, cb, eq, ta)
            case Union(a, b):
                t = p.type(self.schema)
                out = self._lower(a).unionByName(self._lower(b))
                return distinct(out, t) if t.kind == SET else out
            case Difference(a, b):
                return difference(self._lower(a), self._lower(b), p.type(self.schema))
            case Distinct(i, eqs):
                t = p.type(self.schema)
                inner = i.type(self.schema)
                df = self._lower(i)
                return df if inner.kind == SET and inner.eqs == eqs else distinct(df, t)
            case Group(i, columns, eqs, value):
                return group(self._lower(i), i.type(self.schema), columns, eqs, value)
            case TopKWithTies(i, c, order, descending, k):
                return top_k(self._lower(i), order_key(F.col(f"c{c}"), order, i.type(self.schema).columns[c]), descending, k)
        raise TypeError(p)


def _positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _equal(a: Column, b: Column, eq: Eq, t: ty.Type) -> Column:
    x, y = eq_key(a, eq, t), eq_key(b, eq, t)
    return x.eqNullSafe(y) if isinstance(t, ty.Option) or not eq.plain() else x == y


def compare(c: Column, value: object, order: Order, comparison: str, t: ty.Type) -> Column:
    """``c`` compared with a constant under ``order``."""
    lit = literal(value, t)
    if order.name == "f64_total" and isinstance(value, float) and value != 0:
        a, b = c, lit  # only zeros need the sign's key, and a plain comparison reaches the scan
    else:
        a, b = order_key(c, order, t), order_key(lit, order, t)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[comparison]


def keys(t: RelType, columns: list[int] | None = None, name: str = "k") -> dict[str, Column]:
    """Key columns for those whose equality is not Spark's; the others are their own key."""
    at = range(len(t.columns)) if columns is None else columns
    return {f"{name}{i}": eq_key(F.col(f"c{i}"), t.eqs[i], t.columns[i]) for i in at if not t.eqs[i].plain()}


def distinct(df: DataFrame, t: RelType) -> DataFrame:
    """One row of each class: the least, so that the choice doesn't depend on how rows are spread."""
    extra = keys(t)
    if not extra:
        return df.distinct()
    names = df.columns
    by = [F.col(f"k{i}") if f"k{i}" in extra else F.col(f"c{i}") for i in range(len(names))]
    coarse = [i for i in range(len(names)) if f"k{i}" in extra]
    if all(t.eqs[i].name == "f64_bits" for i in coarse):
        # the key says all of the value
        return df.withColumns(extra).groupBy(*by).agg(*[F.first(f"c{i}").alias(f"c{i}") for i in coarse]).select(*names)
    return df.withColumns(extra).groupBy(*by).agg(F.min(F.struct(*[_sortable(F.col(f"c{i}"), t.columns[i]).alias(f"c{i}") for i in coarse], *[F.col(f"c{i}").alias(f"v{i}") for i in coarse if _has_map(t.columns[i])])).alias("_r")).select(
        *[F.col(f"_r.{'v' if _has_map(t.columns[i]) else 'c'}{i}").alias(f"c{i}") if i in coarse else F.col(f"c{i}") for i in range(len(names))]
    )


def _has_map(t: ty.Type) -> bool:
    return isinstance(t, ty.MapOf)


def _sortable(c: Column, t: ty.Type) -> Column:
    return F.array_sort(F.map_entries(c)) if _has_map(t) else c


def anti(left: DataFrame, right: DataFrame, ca: int, cb: int, eq: Eq, t: ty.Type) -> DataFrame:
    held = right.select(eq_key(F.col(f"c{cb}"), eq, t).alias("_k"))
    x = eq_key(F.col(f"c{ca}"), eq, t)
    return left.join(held, x.eqNullSafe(F.col("_k")) if isinstance(t, ty.Option) else x == F.col("_k"), "left_anti")


def semi(left: DataFrame, right: DataFrame, ca: int, cb: int, eq: Eq, t: ty.Type) -> DataFrame:
    held = right.select(eq_key(F.col(f"c{cb}"), eq, t).alias("_k"))
    x = eq_key(F.col(f"c{ca}"), eq, t)
    return left.join(held, x.eqNullSafe(F.col("_k")) if isinstance(t, ty.Option) else x == F.col("_k"), "left_semi")


def difference(left: DataFrame, right: DataFrame, t: RelType) -> DataFrame:
    """Sets: rows without an equal one on the right. Bags: of each class as many as the left has more, the greatest rows first to go."""
    names, extra = left.columns, keys(t)
    by = [f"k{i}" if f"k{i}" in extra else f"c{i}" for i in range(len(names))]
    if not extra:
        # both of Spark's operators are null-safe and count by group on either side
        return left.exceptAll(right) if t.kind != SET else left.join(right.toDF(*[f"r{i}" for i in range(len(names))]), _all_equal(by, [f"r{i}" for i in range(len(names))]), "left_anti")
    l, r = left.withColumns(extra), right.withColumns(extra).select(*by).toDF(*[f"r{i}" for i in range(len(by))])
    match = _all_equal(by, r.columns)
    if t.kind == SET:
        return l.join(r, match, "left_anti").select(*names)
    counts = r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*[_sortable(F.col(n), c) for n, c in zip(names, t.columns, strict=True)]))
    joined = l.withColumn("_p", place).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*by))).join(counts, match, "left")
    return joined.where(F.col("_p") <= F.col("_m") - F.coalesce("_n", F.lit(0))).select(*names)


def _all_equal(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def group(df: DataFrame, t: RelType, columns: tuple[int, ...], eqs: tuple[Eq, ...], value: int | None) -> DataFrame:
    """Keys (the least of each class), then the count or the exact sum."""
    by = {f"k{j}": eq_key(F.col(f"c{c}"), e, t.columns[c]) for j, (c, e) in enumerate(zip(columns, eqs, strict=True))}
    shown = {f"v{j}": F.col(f"c{c}") for j, (c, e) in enumerate(zip(columns, eqs, strict=True)) if not e.plain()}
    n = len(columns)
    out = [F.col(f"v{j}" if f"v{j}" in shown else f"k{j}").alias(f"c{j}") for j in range(n)]
    if value is not None:
        return exact_sum(df, by, F.col(f"c{value}"), shown, "_a").select(*out, F.col("_a").alias(f"c{n}"))
    held = df.select(*[c.alias(k) for k, c in by.items()], *[c.alias(k) for k, c in shown.items()])
    return held.groupBy(*by).agg(*[F.min(k).alias(k) for k in shown], F.count(F.lit(1)).alias("_a")).select(*out, F.col("_a").alias(f"c{n}"))


def top_k(df: DataFrame, key: Column, descending: bool, k: int) -> DataFrame:
    """Rows up to the k-th and its ties. The k-th value comes from a bounded sort in each task; rows are then filtered by it, so no task sorts them all."""
    if k == 0:
        return df.limit(0)
    order = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    marked = df.withColumn("_o", F.struct(key.alias("o")))
    first = marked.select("_o").orderBy(order(F.col("_o"))).limit(k)
    edge = first.agg((F.min if descending else F.max)("_o").alias("_edge"))
    inside = F.col("_o") >= F.col("_edge") if descending else F.col("_o") <= F.col("_edge")
    return marked.join(F.broadcast(edge), inside).select(*df.columns)  # one row is broadcast
