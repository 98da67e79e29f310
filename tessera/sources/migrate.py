"""Schema changes: relations filled by a query or row by row, read bridges, identity maps, and writable views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import types as ty
from tessera.errors import ReadOnlyView, TypeMismatch
from tessera.functions.equality import literal
from tessera.functions.scalar import Expr
from tessera.plans import nodes as n
from tessera.plans.lower import Lowering
from tessera.schema import SET, Relation, Schema
from tessera.sources.catalog import Catalog
from tessera.streaming import zset as z
from tessera.streaming.watch import Delta


@dataclass(frozen=True)
class FromQuery:
    """The target's rows are a query's result."""

    target: Relation
    plan: n.Plan


@dataclass(frozen=True)
class FromRows:
    """Each of the source's rows becomes one of the target's, column by column."""

    source: str
    target: Relation
    columns: tuple[Expr, ...]


def migrate(catalog: Catalog, steps: list[FromQuery | FromRows]) -> Catalog:
    """A catalog with the targets beside what it had; lazy, so nothing is computed before it is read."""
    out = Catalog(catalog.spark, catalog.schema, dict(catalog.readers))
    for s in steps:
        if isinstance(s, FromQuery):
            have = s.plan.type(catalog.schema)
            if have.columns != s.target.type.columns:
                raise TypeMismatch(f"{have.columns} for {s.target.name}")
            df = Lowering(catalog.schema, catalog.read).run(s.plan).toDF(*[c for c, _ in s.target.columns])
        else:
            row = ty.Product(catalog.schema.relation(s.source).columns)
            for e, (name, t) in zip(s.columns, s.target.columns, strict=True):
                if e.type(row) != t:
                    raise TypeMismatch(f"{name} is {t}, its rule gives {e.type(row)}")
            df = catalog.read(s.source).select(*[e.column(row).cast(t.spark()).alias(name) for e, (name, t) in zip(s.columns, s.target.columns, strict=True)])
        out.add(s.target, lambda df=df: df)
    return out


@dataclass(frozen=True)
class Bridge:
    """Old relations by their names, each a plan over the new schema; queries over the old schema run on the new data."""

    old: Schema
    views: dict[str, n.Plan]

    def translate(self, p: n.Plan, new: Schema) -> n.Plan:
        if isinstance(p, n.Scan) and p.relation in self.views:
            view = self.views[p.relation]
            if view.type(new) != self.old.relation(p.relation).type:
                raise TypeMismatch(f"the view for {p.relation} has another type")
            return view
        return p.with_inputs(*(self.translate(i, new) for i in p.inputs()))


def renamed_ids(df: DataFrame, columns: list[str], ids: DataFrame) -> DataFrame:
    """Identities in ``columns`` by a map (old, new); those that it lacks stay."""
    for c in columns:
        m = ids.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        df = df.join(m, F.col(c) == F.col("_o"), "left").withColumn(c, F.coalesce("_n", c)).drop("_o", "_n")
    return df


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """The identity map of one map after another."""
    a, b = first.select("old", F.col("new").alias("_m")), second.select(F.col("old").alias("_m"), "new")
    both = a.join(b, "_m", "left").select("old", F.coalesce("new", "_m").alias("new"))
    return both.unionByName(second.join(first.select(F.col("new").alias("old")), "old", "left_anti").join(first.select("old"), "old", "left_anti"))


def inverse(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("new").alias("old"), F.col("old").alias("new"))


def bijective(ids: DataFrame) -> bool:
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("old").alias("a"), F.count_distinct("new").alias("b")).first()
    return row["n"] == row["a"] == row["b"]


# views that can be written


def writable(p: n.Plan) -> bool:
    return isinstance(p, n.Scan | n.Project | n.PromoteToBag | n.FilterEqConst | n.FilterEqColumns | n.JoinEq) and all(map(writable, p.inputs()))


def put_back(schema: Schema, p: n.Plan, change: DataFrame, read: Callable[[str], DataFrame], fill: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """Changes of base relations after which the view ``p`` has changed by exactly ``change`` (c0, c1, ..., _w); refused where there is none to be told.

    Rows that would not be in the view are an error. A projection that drops columns finds removed rows in its input and fills inserted ones from
    ``fill``, by base column name; of several rows that it can't tell apart it removes all or, where they are equal, some. A join passes each side its part;
    inserted parts that are there already are left alone, removed ones leave the left side, or else the right. The change that this makes of the view
    is derived and held against the one asked for, so that no other row of the view comes or goes with it.
    """
    if not writable(p):
        raise ReadOnlyView(type(p).__name__)
    asked = z.compact(change)
    for side in ("left", "right") if any(isinstance(x, n.JoinEq) for x in p.walk()) else ("left",):
        out = {name: z.compact(c) for name, c in _pushed(schema, p, asked, read, fill or {}, side).items()}
        made = Delta(schema, read, out).of(p).toDF(*asked.columns)
        if z.plus(made, z.negate(asked)).isEmpty():
            return out
    raise ReadOnlyView("no change of the base relations gives just this change of the view")


def _pushed(schema: Schema, p: n.Plan, change: DataFrame, read: Callable[[str], DataFrame], fill: dict[str, object], side: str) -> dict[str, DataFrame]:
    low = Lowering(schema, read)
    match p:
        case n.Scan(name):
            names = [c for c, _ in schema.relation(name).columns]
            return {name: change.toDF(*names, z.W)}
        case n.FilterEqConst() | n.FilterEqColumns() | n.PromoteToBag():
            return _pushed(schema, p.input, change, read, fill, side)
        case n.Project(i, columns):
            t = i.type(schema)
            kept = {c: k for k, c in reversed(list(enumerate(columns)))}
            missing = [c for c in range(len(t.columns)) if c not in kept]
            come, gone = change.where(F.col(z.W) > 0), change.where(F.col(z.W) < 0)
            base = _base_names(schema, i)
            lacking = [base[c] for c in missing if base[c] not in fill]
            if lacking and not come.isEmpty():
                raise ReadOnlyView(f"no value for {', '.join(lacking)}")
            new = come.select(*[F.col(f"c{kept[c]}").alias(f"c{c}") if c in kept else (literal(fill.get(base[c]), t.columns[c]) if base[c] in fill else F.lit(None).cast(t.columns[c].spark())).alias(f"c{c}") for c in range(len(t.columns))], z.W)
            held = z.compact(z.weighted(low.run(i)))
            asked = gone.select(*[F.col(f"c{kept[c]}").alias(f"r{c}") for c in kept], F.col(z.W).alias("asked"))
            on = F.lit(True)
            for c in kept:
                on = on & F.col(f"c{c}").eqNullSafe(F.col(f"r{c}"))
            found = held.join(asked, on)
            alike = Window.partitionBy(*asked.columns)
            found = found.withColumns({"all": F.sum(z.W).over(alike), "kinds": F.count(F.lit(1)).over(alike)})
            whole = (F.col("all") == -F.col("asked")) | F.lit(t.kind == SET)
            take = F.when(whole, -F.col(z.W)).when(F.col("kinds") == 1, F.col("asked")).otherwise(F.lit(0))
            old = found.select(*[f"c{c}" for c in range(len(t.columns))], take.cast("long").alias(z.W))
            return _pushed(schema, i, z.compact(new.unionByName(old)), read, fill, side)
        case n.JoinEq(a, b):
            k, m = len(a.type(schema).columns), len(b.type(schema).columns)
            parts = {"left": [F.col(f"c{j}") for j in range(k)], "right": [F.col(f"c{k + j}").alias(f"c{j}") for j in range(m)]}
            come, gone = change.where(F.col(z.W) > 0), change.where(F.col(z.W) < 0)
            out: dict[str, DataFrame] = {}
            for which, of in (("left", a), ("right", b)):
                rows = come.select(*parts[which]).distinct()
                d = z.weighted(rows.exceptAll(rows.intersect(low.run(of))))
                if which == side:
                    d = d.unionByName(z.weighted(gone.select(*parts[which]).distinct(), -1))
                for name, c in _pushed(schema, of, d, read, fill, side).items():
                    out[name] = z.plus(out[name], c) if name in out else c
            return out
    raise ReadOnlyView(type(p).__name__)


def _base_names(schema: Schema, p: n.Plan) -> list[str]:
    match p:
        case n.Scan(name):
            return [c for c, _ in schema.relation(name).columns]
        case n.Project(i, columns):
            names = _base_names(schema, i)
            return [names[c] for c in columns]
        case n.JoinEq(a, b):
            return _base_names(schema, a) + _base_names(schema, b)
    return _base_names(schema, p.inputs()[0])


def renamed(relation: Relation, name: str, columns: dict[str, str] | None = None) -> Relation:
    return replace(relation, name=name, columns=tuple(((columns or {}).get(c, c), t) for c, t in relation.columns))
