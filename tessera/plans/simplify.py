"""Lowering with the shapes that Spark would otherwise plan by extra shuffles.

``Difference(p, filter(p))`` is a filter, ``Union(f(p), g(p))`` of sets too, and ``Difference(p, AntiJoin(p, q))`` is a semi-join: each of p's rows
is decided by itself, so neither side needs counting against the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import lower as low
from tessera.plans.nodes import AntiJoin, Difference, FilterEqColumns, FilterEqConst, FilterOrderConst, Plan, Union
from tessera.schema import SET

_FILTERS = (FilterEqConst, FilterOrderConst, FilterEqColumns)


def _condition(ctx: low.Lowering, p: Plan) -> Column:
    t = p.input.type(ctx.schema)  # type: ignore[attr-defined]
    match p:
        case FilterEqConst(_, c, v, eq):
            return low._equal(F.col(f"c{c}"), low.literal(v, t.columns[c]), eq, t.columns[c])
        case FilterOrderConst(_, c, v, order, comparison):
            return low.compare(F.col(f"c{c}"), v, order, comparison, t.columns[c])
        case FilterEqColumns(_, a, b, eq):
            return low._equal(F.col(f"c{a}"), F.col(f"c{b}"), eq, t.columns[a])
    raise TypeError(p)


def split(ctx: low.Lowering, p: Plan) -> tuple[Plan, Column | None]:
    """(plan, condition) such that p is the plan's rows for which the condition holds."""
    if isinstance(p, _FILTERS):
        base, c = split(ctx, p.input)
        own = _condition(ctx, p)
        return base, own if c is None else c & own
    if isinstance(p, Difference):
        (a, ca), (b, cb) = split(ctx, p.left), split(ctx, p.right)
        if cb is not None and a == b:
            # rows on the right are rows of the same relation, so each left row falls with its own
            not_b = ~F.coalesce(cb, F.lit(False))
            if p.type(ctx.schema).kind == SET or ca is None or _implied(p.left, p.right):
                return a, not_b if ca is None else ca & not_b
    if isinstance(p, Union) and p.type(ctx.schema).kind == SET:
        (a, ca), (b, cb) = split(ctx, p.left), split(ctx, p.right)
        if a == b and ca is not None and cb is not None:
            return a, ca | cb
    return p, None


def _implied(whole: Plan, part: Plan) -> bool:
    """Whether ``part`` is made of ``whole`` by filters, differences and (of sets) unions only."""
    if whole == part:
        return True
    if isinstance(part, _FILTERS):
        return _implied(whole, part.input)
    return isinstance(part, Difference) and _implied(whole, part.left)


class _Simplifying(low.Lowering):
    def _lower(self, p: Plan) -> DataFrame:
        base, c = split(self, p)
        if c is not None:
            return self._lower(base).where(c)
        if isinstance(p, Difference) and isinstance(p.right, AntiJoin) and p.right.left == p.left:
            a = p.right
            t = a.left.type(self.schema).columns[a.left_column]
            return low.semi(self._lower(a.left), self._lower(a.right), a.left_column, a.right_column, a.eq, t)
        return super()._lower(p)


def simplified(ctx: low.Lowering, plan: Plan) -> DataFrame:
    return _Simplifying(ctx.schema, ctx.source, ctx.leaves).run(plan)
