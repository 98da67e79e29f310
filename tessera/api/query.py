"""Queries by column name over one catalog: a thin layer that builds plans."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row

from tessera import types as ty
from tessera.errors import Cardinality, UnknownRelation
from tessera.functions.equality import Eq, Order, default_order
from tessera.plans import nodes as n
from tessera.plans.lower import Lowering
from tessera.schema import BAG, SET, RelType
from tessera.sources.catalog import Catalog


@dataclass(frozen=True)
class Pred:
    """A condition on rows: ``apply`` adds it to a plan. Conditions combine as relations do, see ``Query.where``."""

    op: str
    args: tuple[Any, ...]

    def __and__(self, other: Pred) -> Pred:
        return Pred("and", (self, other))

    def __or__(self, other: Pred) -> Pred:
        return Pred("or", (self, other))

    def __invert__(self) -> Pred:
        return Pred("not", (self,))


@dataclass(frozen=True, eq=False)
class Col:
    """A named column in a condition; ``ci`` compares text without regard to ASCII case."""

    name: str
    folded: bool = False

    def ci(self) -> Col:
        return replace(self, folded=True)

    def __eq__(self, other: object) -> Pred:  # type: ignore[override]
        return Pred("eq_columns" if isinstance(other, Col) else "eq", (self, other))

    def __ne__(self, other: object) -> Pred:  # type: ignore[override]
        return ~(self == other)  # type: ignore[operator]

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, v: Any) -> Pred:
        return Pred("order", (self, "<", v))

    def __le__(self, v: Any) -> Pred:
        return Pred("order", (self, "<=", v))

    def __gt__(self, v: Any) -> Pred:
        return Pred("order", (self, ">", v))

    def __ge__(self, v: Any) -> Pred:
        return Pred("order", (self, ">=", v))

    def between(self, low: Any, high: Any) -> Pred:
        return (self >= low) & (self <= high)

    def is_none(self) -> Pred:
        return Pred("eq", (self, None))

    def is_some(self) -> Pred:
        return ~self.is_none()


def col(name: str) -> Col:
    return Col(name)


def _folded(e: Eq) -> Eq:
    return Eq("text_ci") if e.name == "text" else Eq(e.name, tuple(map(_folded, e.parts)))


@dataclass(frozen=True)
class Query:
    catalog: Catalog
    plan: n.Plan
    names: tuple[str, ...]

    @property
    def type(self) -> RelType:
        return self.plan.type(self.catalog.schema)

    def _at(self, name: str) -> int:
        if name not in self.names:
            raise UnknownRelation(f"column {name}")
        return self.names.index(name)

    def _next(self, plan: n.Plan, names: tuple[str, ...] | None = None) -> Query:
        out = Query(self.catalog, plan, self.names if names is None else names)
        out.type  # a query that can't be typed is refused where it is built
        return out

    def _beside(self, other: Query) -> Query:
        """This query over both catalogs."""
        return self if other.catalog is self.catalog else replace(self, catalog=self.catalog.joined(other.catalog))

    def _eq(self, c: Col) -> Eq:
        e = self.type.eqs[self._at(c.name)]
        return _folded(e) if c.folded else e

    def _order(self, name: str, folded: bool = False) -> Order:
        i = self._at(name)
        return Order("text_ci") if folded or self.type.eqs[i].name == "text_ci" else default_order(self.type.columns[i])

    def _filter(self, plan: n.Plan, p: Pred) -> n.Plan:
        match p.op:
            case "eq":
                c, v = p.args
                return n.FilterEqConst(plan, self._at(c.name), v, self._eq(c))
            case "eq_columns":
                a, b = p.args
                return n.FilterEqColumns(plan, self._at(a.name), self._at(b.name), self._eq(a) if a.folded == b.folded and self._eq(a) == self._eq(b) else _folded(self._eq(a)))
            case "order":
                c, comparison, v = p.args
                return n.FilterOrderConst(plan, self._at(c.name), v, self._order(c.name, c.folded), comparison)
            case "and":
                return self._filter(self._filter(plan, p.args[0]), p.args[1])
            case "or":
                return n.Union(self._filter(plan, p.args[0]), self._filter(plan, p.args[1]))
            case "not":
                return n.Difference(plan, self._filter(plan, p.args[0]))
        raise TypeError(p.op)

    def where(self, p: Pred) -> Query:
        """Rows for which ``p`` holds. In a bag an *or* adds both sides' rows, so a row that satisfies both is there twice."""
        return self._next(self._filter(self.plan, p))

    def project(self, *names: str) -> Query:
        """Columns by name; of a set, the set of their values."""
        return self._next(n.Project(self.plan, tuple(map(self._at, names))), names)

    def select(self, *names: str) -> Query:
        """Columns by name, every row with them."""
        return self._next(n.Project(n.PromoteToBag(self.plan), tuple(map(self._at, names))), names)

    def to_bag(self) -> Query:
        return self._next(n.PromoteToBag(self.plan))

    def rename(self, **names: str) -> Query:
        return replace(self, names=tuple(names.get(x, x) for x in self.names))

    def join(self, other: Query, *on: tuple[str, str], ci: bool = False) -> Query:
        """Rows of both with equal columns ``on``; columns of both, so their names must differ."""
        (a, b), *more = on
        clash = set(self.names) & set(other.names)
        if clash:
            raise UnknownRelation(f"both sides have {sorted(clash)}; rename one")
        eq = self._eq(Col(a, ci))
        out = self._beside(other)._next(n.JoinEq(self.plan, other.plan, self._at(a), other._at(b), eq), self.names + other.names)
        for x, y in more:
            out = out.where(Col(x, ci) == Col(y, ci))
        return out

    def anti_join(self, other: Query, a: str, b: str, ci: bool = False) -> Query:
        return self._beside(other)._next(n.AntiJoin(self.plan, other.plan, self._at(a), other._at(b), self._eq(Col(a, ci))))

    def semi_join(self, other: Query, a: str, b: str, ci: bool = False) -> Query:
        """Rows with a match: those that the rows without one leave."""
        return self._beside(other)._next(n.Difference(self.plan, self.anti_join(other, a, b, ci).plan))

    def union(self, other: Query) -> Query:
        return self._beside(other)._next(n.Union(self.plan, other.plan))

    def difference(self, other: Query) -> Query:
        return self._beside(other)._next(n.Difference(self.plan, other.plan))

    def intersect(self, other: Query) -> Query:
        return self.difference(self.difference(other))

    def distinct(self, ci: tuple[str, ...] = ()) -> Query:
        eqs = tuple(_folded(e) if x in ci else e for x, e in zip(self.names, self.type.eqs, strict=True))
        return self._next(n.Distinct(self.plan, eqs))

    def group(self, *names: str, ci: tuple[str, ...] = ()) -> Grouped:
        return Grouped(self, names, tuple(self._eq(Col(x, x in ci)) for x in names))

    def count(self) -> int:
        return self.group().count("n").frame().first()[0]

    def top(self, k: int, name: str) -> Query:
        return self._next(n.TopKWithTies(self.plan, self._at(name), self._order(name), True, k))

    def bottom(self, k: int, name: str) -> Query:
        return self._next(n.TopKWithTies(self.plan, self._at(name), self._order(name), False, k))

    def frame(self) -> DataFrame:
        """The rows, lazily, under the query's column names."""
        from tessera.plans.simplify import simplified

        low = Lowering(self.catalog.schema, self.catalog.read)
        self.plan.type(self.catalog.schema)
        return simplified(low, self.plan).toDF(*self.names)

    def all(self) -> list[Row]:
        return self.frame().collect()

    def first_or_none(self) -> Row | None:
        return self.frame().first()

    def one(self) -> Row:
        rows = self.frame().take(2)
        if len(rows) != 1:
            raise Cardinality("no row" if not rows else "more than one row")
        return rows[0]

    def one_or_none(self) -> Row | None:
        rows = self.frame().take(2)
        if len(rows) > 1:
            raise Cardinality("more than one row")
        return rows[0] if rows else None

    def footprint(self) -> n.Footprint:
        return n.footprint(self.plan, self.catalog.schema)


@dataclass(frozen=True)
class Grouped:
    query: Query
    names: tuple[str, ...]
    eqs: tuple[Eq, ...]

    def _plan(self, value: str | None, name: str) -> Query:
        q = self.query
        at = tuple(map(q._at, self.names))
        return q._next(n.Group(q.plan, at, self.eqs, None if value is None else q._at(value)), (*self.names, name))

    def count(self, name: str = "count") -> Query:
        return self._plan(None, name)

    def exact_sum(self, value: str, name: str = "sum") -> Query:
        return self._plan(value, name)


def scan(catalog: Catalog, relation: str) -> Query:
    r = catalog.schema.relation(relation)
    return Query(catalog, n.Scan(relation), tuple(x for x, _ in r.columns))


__all__ = ["BAG", "SET", "Col", "Grouped", "Pred", "Query", "col", "scan", "ty"]
