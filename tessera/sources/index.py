"""Persisted indexes: a relation's weighted rows dealt to folders by a hash of columns under their equalities.

A lookup or join reads the folders of its own keys and none else; a change adds files to the folders of its keys. Whether to go through the index or
through the relation is chosen by the number of folders that would have to be read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.equality import Eq, eq_key
from tessera.schema import Relation
from tessera.sources.arranged import BUCKETS, Arrangement
from tessera.streaming import zset as z


@dataclass
class Index:
    """Rows of ``relation`` by ``columns``; ``eqs`` are coarser or equal to the columns' own, which they are by default."""

    relation: Relation
    columns: tuple[str, ...]
    rows: DataFrame
    eqs: tuple[Eq, ...] | None = None
    _kept: Arrangement = field(init=False)

    def __post_init__(self) -> None:
        kind = self.relation.type
        self._at = [self.relation.index(c) for c in self.columns]
        self._own = tuple(kind.eqs[i] for i in self._at) if self.eqs is None else self.eqs
        self._types = [kind.columns[i] for i in self._at]
        self._by = [f"_key{i}" for i in range(len(self.columns))]
        self._kept = Arrangement(self.rows.sparkSession, self._by, self._keyed(z.weighted(self.rows), self.columns))

    def _keyed(self, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return rows.withColumns({k: eq_key(F.col(f"`{c}`"), e, t) for k, c, e, t in zip(self._by, columns, self._own, self._types, strict=True)})

    def change(self, rows: DataFrame) -> None:
        """Weighted rows that come and go."""
        self._kept.add(self._keyed(rows, self.columns))

    def all(self) -> DataFrame:
        """The weighted rows as they are now, in parts."""
        return self._kept.rows().drop(*self._by)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among ``keys`` (columns of the index), as a bag."""
        asked = self._keyed(keys, self.columns).select(*self._by)
        return z.expand(z.compact(self._kept.touched(asked).drop(*self._by)))

    def folders(self, keys: DataFrame) -> int:
        """How many of the BUCKETS folders a lookup of ``keys`` reads."""
        return len(self._kept.wanted(self._keyed(keys, self.columns)))

    def pays(self, keys: DataFrame, share: float = 0.5) -> bool:
        """Whether a lookup reads less than ``share`` of the index; beyond, the relation itself is scanned as well."""
        return self.folders(keys) < share * BUCKETS

    def join(self, other: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """Rows of ``other`` with the index's rows of equal keys; the index reads the folders of the keys that ``other`` has."""
        asked = self._keyed(other, columns)
        mine = z.expand(z.compact(self._kept.touched(asked.select(*self._by))))
        theirs = asked.withColumnsRenamed({k: f"_o{k}" for k in self._by})
        same = F.lit(True)
        for k in self._by:
            same = same & F.col(f"_o{k}").eqNullSafe(F.col(k))
        return theirs.join(mine, same).drop(*self._by, *[f"_o{k}" for k in self._by])
