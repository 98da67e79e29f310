"""Cursor paging of an ordered view: rows in a declared order, equal ones by their whole row, repeated ones by occurrence."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidCursor, LimitExceeded
from tessera.functions.equality import Order, eq_key, order_key
from tessera.schema import RelType


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the last row's order class, its row key, and which of its repetitions it was."""

    order: object
    row: object
    occurrence: int


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next: Cursor | None


@dataclass(frozen=True)
class OrderedView:
    """``df`` by column ``column`` under ``order``. Within an order class rows ascend by row key, whatever the direction; repeated rows are counted, not sorted.

    With ``weight``, a column of ``df`` tells how often a row is there, maybe in parts.
    """

    df: DataFrame
    type: RelType
    column: int
    order: Order
    descending: bool = False
    weight: str | None = None

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != self.weight]

    def advanced(self, change: DataFrame) -> OrderedView:
        """The view after a change, weighted rows (_w) that come and go; cursors hold as long as their row is there."""
        now = self.df if self.weight else self.df.withColumn("_w", F.lit(1).cast("long"))
        return replace(self, df=now.unionByName(change.withColumnRenamed("_w", self.weight or "_w")), weight=self.weight or "_w")

    def page_change(self, change: DataFrame, limit: int, after: Cursor | None = None) -> DataFrame:
        """Weighted rows by which a page's rows change with the view: 2 x ``limit`` rows at most."""
        page = lambda v, w: v.frame(limit, after).select(*self.names, F.lit(w).cast("long").alias("_w"))
        both = page(self.advanced(change), 1).unionByName(page(self, -1))
        return both.groupBy(*self.names).agg(F.sum("_w").alias("_w")).where("_w <> 0")

    def _runs(self) -> DataFrame:
        names = self.names
        key = F.struct(*[eq_key(F.col(n), e, t).alias(f"k{i}") for i, (n, e, t) in enumerate(zip(names, self.type.eqs, self.type.columns, strict=True))])
        o = F.struct(order_key(F.col(names[self.column]), self.order, self.type.columns[self.column]).alias("o"))
        marked = self.df.withColumns({"_o": o, "_k": key})
        runs = marked.groupBy("_o", "_k").agg(F.min(F.struct(*names)).alias("_r"), (F.sum(self.weight) if self.weight else F.count(F.lit(1))).alias("_n"))
        return runs.where("_n > 0") if self.weight else runs

    def _after(self, cursor: Cursor, kinds) -> Column:
        o, k = F.from_json(F.lit(cursor.order), kinds["_o"].dataType), F.from_json(F.lit(cursor.row), kinds["_k"].dataType)
        beyond = (F.col("_o") < o) if self.descending else (F.col("_o") > o)
        same = F.col("_o").eqNullSafe(o)
        return beyond | (same & (F.col("_k") > k)) | (same & F.col("_k").eqNullSafe(k))

    def frame(self, limit: int, after: Cursor | None = None) -> DataFrame:
        """The page's rows, lazily and in order; what is sorted are ``limit`` distinct rows of each task."""
        if limit < 1:
            raise LimitExceeded("a page holds at least one row")
        runs = self._runs()
        start = F.lit(0)
        if after is not None:
            kinds = {f.name: f for f in runs.schema.fields}
            k = F.from_json(F.lit(after.row), kinds["_k"].dataType)
            runs = runs.where(self._after(after, kinds))
            start = F.when(F.col("_k").eqNullSafe(k), F.lit(after.occurrence + 1)).otherwise(F.lit(0))
        first = F.col("_o").desc() if self.descending else F.col("_o").asc()
        runs = runs.withColumn("_s", start).where(F.col("_s") < F.col("_n")).orderBy(first, F.col("_k").asc()).limit(limit)
        each = runs.withColumn("_occ", F.explode(F.sequence(F.col("_s"), F.least(F.col("_n"), F.col("_s") + limit) - 1)))
        out = each.orderBy(first, F.col("_k").asc(), F.col("_occ").asc()).limit(limit)
        return out.select("_r.*", "_o", "_k", "_occ")

    def page(self, limit: int, after: Cursor | None = None) -> Page:
        """A page and the cursor to go on from, if there is more. A cursor whose row isn't there is refused."""
        if after is not None:
            runs = self._runs()
            kinds = {f.name: f for f in runs.schema.fields}
            o, k = F.from_json(F.lit(after.order), kinds["_o"].dataType), F.from_json(F.lit(after.row), kinds["_k"].dataType)
            if runs.where(F.col("_o").eqNullSafe(o) & F.col("_k").eqNullSafe(k) & (F.col("_n") > after.occurrence)).isEmpty():
                raise InvalidCursor("the cursor's row is not in the view")
        found = self.frame(limit + 1, after).withColumns({"_o": F.to_json("_o", {"ignoreNullFields": "false"}), "_k": F.to_json("_k", {"ignoreNullFields": "false"})}).collect()
        names = self.names
        rows = [Row(**{n: r[n] for n in names}) for r in found[:limit]]
        last = found[limit - 1] if len(found) > limit else None
        return Page(rows, Cursor(last["_o"], last["_k"], last["_occ"]) if last is not None else None)


def ranked(df: DataFrame, by: list[str], key: Column) -> DataFrame:
    """Places from 0 within groups, by ``key``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1)
