"""Queries whose state is kept in stored tables, so that a change's work follows the change.

What an operator has to know of the past is an arrangement: weighted rows dealt to folders by a hash of the operator's key. A step reads the folders of its own keys only and adds the change's rows.
Equal parts of several queries are one: their changes are derived once a step and their arrangements are shared.

A group's arrangement holds its keys and values, a join's both inputs by the join's key, a distinct's, difference's and anti-join's theirs by row or key. A top-k keeps the
rows up to some row beyond the k-th and looks at its input again only when too many of them have gone. Plans without a rule are recomputed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.api.query import Query
from tessera.functions.equality import order_key
from tessera.plans import nodes as n
from tessera.schema import Schema
from tessera.sources.arranged import Arrangement
from tessera.sources.store import stored
from tessera.streaming import zset as z
from tessera.streaming.watch import Delta

class _Step(Delta):
    """One step of a ``Maintained``: changes are stored as they are derived, states come from its arrangements."""

    def __init__(self, owner: Maintained, changed: dict[str, DataFrame]) -> None:
        super().__init__(owner.schema, None, changed, owner.relation)
        self.owner = owner
        self.after: list[Callable[[], None]] = []
        self.inputs: dict[n.Plan, DataFrame] = {}

    def fixed(self, d: DataFrame) -> DataFrame:
        return stored(d, "change")

    def input(self, p: n.Plan) -> DataFrame:
        if p not in self.inputs:
            self.inputs[p] = self.of(p) if self.untouched(p) else stored(self.of(p), "change")
        return self.inputs[p]

    def held(self, slot: tuple, rows: Callable[[], DataFrame], own: DataFrame | None, asked: DataFrame, by: list[str], needed: bool = True) -> DataFrame:
        kept = self.owner.arrangements
        if slot not in kept:
            if not needed:
                return super().held(slot, rows, own, asked, by, needed)
            kept[slot] = Arrangement(self.owner.spark, by, rows())
        if own is not None:
            self.after.append(lambda: kept[slot].add(own))
        return kept[slot].touched(asked) if needed else kept[slot].rows().where(F.lit(False))

    def _change(self, p: n.Plan) -> DataFrame:
        if isinstance(p, n.TopKWithTies) and not self.untouched(p):
            return self._top(p)
        return super()._change(p)

    def _top(self, p: n.TopKWithTies) -> DataFrame:
        t = p.input.type(self.schema)
        marked = lambda d: d.withColumn("_o", F.struct(order_key(F.col(f"c{p.column}"), p.order, t.columns[p.column]).alias("o")))
        heads, k = self.owner.heads, p.k
        if p not in heads:
            heads[p] = _Head.of(marked(self.old(p.input)), p.descending, k)
        before, own = heads[p], marked(self.input(p.input))
        after = before.advanced(own) or _Head.of(z.plus(marked(self.old(p.input)), own), p.descending, k)
        self.after.append(lambda: heads.__setitem__(p, after))
        return z.plus(after.top(), z.negate(before.top())).drop("_o")


class _Head:
    """The first rows of an order, with all that tie with the last of them: ``edge`` is its place, or None if that is every row."""

    def __init__(self, rows: DataFrame, edge: T.Row | None, descending: bool, k: int) -> None:
        self.rows, self.edge, self.descending, self.k = rows, edge, descending, k

    @classmethod
    def of(cls, rows: DataFrame, descending: bool, k: int) -> _Head:
        first = z.first_keys(rows, "_o", descending, 2 * k + 16)
        keys = first.collect()  # 2 k + 16 at most
        edge = keys[-1]["_o"] if len(keys) == 2 * k + 16 else None
        inside = rows if edge is None else rows.where(_within(rows, edge, descending))
        return cls(stored(z.compact(inside), "head"), edge, descending, k)

    def advanced(self, change: DataFrame) -> _Head | None:
        """The head after ``change``; None if fewer than k rows are left of a head that isn't everything."""
        near = change if self.edge is None else change.where(_within(change, self.edge, self.descending))
        rows = stored(z.plus(self.rows, near), "head")
        if self.edge is not None and (rows.agg(F.sum(z.W)).first()[0] or 0) < self.k:
            return None
        return _Head(rows, self.edge, self.descending, self.k)

    def top(self) -> DataFrame:
        return z.top_rows(self.rows, "_o", self.descending, self.k)


def _within(rows: DataFrame, edge: T.Row, descending: bool) -> Column:
    spark, kind = rows.sparkSession, rows.schema["_o"].dataType
    bound = spark.createDataFrame([(edge,)], T.StructType([T.StructField("o", kind)])).select(F.to_json("o", {"ignoreNullFields": "false"})).first()[0]
    value = F.from_json(F.lit(bound), kind)
    return F.col("_o") >= value if descending else F.col("_o") <= value


class Maintained:
    """Several queries by name, advanced together. ``read`` gives each relation's weighted rows at the start."""

    def __init__(self, queries: dict[str, Query], read: Callable[[str], DataFrame]) -> None:
        catalog = None
        for q in queries.values():
            q.type
            catalog = q.catalog if catalog is None or q.catalog is catalog else catalog.joined(q.catalog)
        self.queries, self.spark = queries, catalog.spark  # type: ignore[union-attr]
        self.schema: Schema = catalog.schema  # type: ignore[union-attr]
        self.base, self.changes = read, dict[str, list[DataFrame]]()
        self.arrangements: dict[tuple, Arrangement] = {}
        self.heads: dict[n.Plan, _Head] = {}

    def relation(self, name: str) -> DataFrame:
        """The relation's rows so far, in parts; only what has no state yet, or none that suffices, reads them."""
        out = self.base(name)
        for c in self.changes.get(name, ()):
            out = out.unionByName(c.select(*out.columns))
        return out

    def advance(self, changed: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Weighted rows by which each query's result changes, under its column names; states move on once all are stored."""
        changed = {name: stored(c, "change") for name, c in changed.items()}
        step = _Step(self, changed)
        out = {name: step.fixed(step.of(q.plan)).toDF(*q.names, z.W) for name, q in self.queries.items()}
        for move in step.after:
            move()
        for name, c in changed.items():
            self.changes.setdefault(name, []).append(c)
        return out


__all__ = ["Maintained"]
