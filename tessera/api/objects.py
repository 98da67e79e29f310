"""Objects: rows with a key, references to other objects, and to-many relationships held in relations of (source, target) pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.api.query import Pred, Query, col, scan
from tessera.errors import Cardinality, TypeMismatch
from tessera.operators.exact import order_statistic
from tessera.schema import Entity
from tessera.sources.catalog import Catalog


@dataclass(frozen=True)
class Objects:
    """A query over one entity's rows, its key first among equals: results are objects, told apart by key."""

    catalog: Catalog
    entity: Entity
    query: Query

    @classmethod
    def of(cls, catalog: Catalog, name: str) -> Objects:
        e = catalog.schema.entity(name)
        return cls(catalog, e, scan(catalog, e.relation))

    def _with(self, q: Query) -> Objects:
        return Objects(self.catalog, self.entity, q)

    def where(self, p: Pred) -> Objects:
        return self._with(self.query.where(p))

    def _target(self, path: str) -> tuple[str, Objects]:
        f = self.entity.field(path)
        if f.target is None:
            raise TypeMismatch(f"{path} is no reference")
        return f.name, Objects.of(self.catalog, f.target)

    def where_ref(self, path: str, p: Pred) -> Objects:
        """Objects whose reference (``a.b.c``: through several) leads to one for which ``p`` holds: a semi-join for each step, the last first."""
        head, _, rest = path.partition(".")
        name, target = self._target(head)
        inner = target.where_ref(rest, p) if rest else target.where(p)
        return self._with(self.query.semi_join(inner.query, name, inner.entity.key))

    def _edges(self, many: str, p: Pred | None, negate: bool = False) -> tuple[Query, str]:
        f = self.entity.field(many)
        if f.many is None or f.target is None:
            raise TypeMismatch(f"{many} is no relationship")
        edges, target = scan(self.catalog, f.many), Objects.of(self.catalog, f.target)
        source, to = edges.names[:2]
        if p is not None:
            edges = edges.semi_join(target.where(~p if negate else p).query, to, target.entity.key)
        return edges, source

    def any(self, many: str, p: Pred | None = None) -> Objects:
        edges, source = self._edges(many, p)
        return self._with(self.query.semi_join(edges, self.entity.key, source))

    def none(self, many: str, p: Pred | None = None) -> Objects:
        edges, source = self._edges(many, p)
        return self._with(self.query.anti_join(edges, self.entity.key, source))

    def all(self, many: str, p: Pred) -> Objects:
        """Objects none of whose related objects fail ``p``; those without any are among them."""
        edges, source = self._edges(many, p, negate=True)
        return self._with(self.query.anti_join(edges, self.entity.key, source))

    def where_count(self, many: str, comparison: str, k: int, high: int | None = None) -> Objects:
        """Objects by how many they relate to: ``=``, ``!=``, ``<``, ``<=``, ``>``, ``>=`` or ``between``. None counts as 0."""
        edges, source = self._edges(many, None)
        counts = edges.group(source).count("_n")
        holds = {"=": lambda n: n == k, "!=": lambda n: n != k, "<": lambda n: n < k, "<=": lambda n: n <= k, ">": lambda n: n > k, ">=": lambda n: n >= k, "between": lambda n: k <= n <= (high if high is not None else k)}[comparison]
        n = col("_n")
        pred = {"=": n == k, "!=": n != k, "<": n < k, "<=": n <= k, ">": n > k, ">=": n >= k, "between": n.between(k, high if high is not None else k)}[comparison]
        if holds(0):
            bad = counts.where(~pred)
            return self._with(self.query.anti_join(bad, self.entity.key, source))
        return self._with(self.query.semi_join(counts.where(pred), self.entity.key, source))

    def ids(self) -> Query:
        return self.query.project(self.entity.key)

    def count(self) -> int:
        return self.query.count()

    def top(self, k: int, name: str) -> Objects:
        return self._with(self.query.top(k, name))

    def bottom(self, k: int, name: str) -> Objects:
        return self._with(self.query.bottom(k, name))

    def group_by(self, *names: str):
        return self.query.group(*names)

    def order_statistic(self, by: tuple[str, ...], value: str, statistic: str, at: float = 0) -> DataFrame:
        t = self.query
        from tessera.functions.equality import order_key

        i = t._at(value)
        return order_statistic(t.frame(), list(by), value, order_key(F.col(value), t._order(value), t.type.columns[i]), statistic, at)

    def frame(self) -> DataFrame:
        return self.query.frame()

    def get(self, key: object) -> Row | None:
        return self.where(col(self.entity.key) == key).query.one_or_none()

    def require(self, key: object) -> Row:
        row = self.get(key)
        if row is None:
            raise Cardinality(f"no {self.entity.name} {key}")
        return row


def patched(df: DataFrame, key: str, ids: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns set for the rows whose key is in ``ids``."""
    hit = ids.select(F.col(ids.columns[0]).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(hit, F.col(key).eqNullSafe(F.col("_id")), "left")
    return joined.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
