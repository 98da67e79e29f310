"""Where relations come from: Parquet directories, tables, and frames in memory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import UnknownRelation
from tessera.schema import BAG, Relation, Schema
from tessera.types import I64, Option, Type, type_of_spark


@dataclass
class Catalog:
    """Named relations and how to read each. Reading is lazy, with the declared schema; a relation without data is empty."""

    spark: SparkSession
    schema: Schema = field(default_factory=Schema)
    readers: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def add(self, relation: Relation, reader: Callable[[], DataFrame] | None = None) -> Relation:
        self.schema = self.schema.with_relation(relation)
        if reader:
            self.readers[relation.name] = reader
        return relation

    def frame(self, relation: Relation, df: DataFrame) -> Relation:
        return self.add(relation, lambda: df)

    def parquet(self, relation: Relation, path: str) -> Relation:
        return self.add(relation, lambda: self.spark.read.parquet(path))

    def table(self, relation: Relation, name: str) -> Relation:
        return self.add(relation, lambda: self.spark.table(name))

    def declare(self, name: str, df: DataFrame, kind: str = BAG, options: tuple[str, ...] = ()) -> Relation:
        """A relation with the columns of ``df``; those in ``options`` may be absent, all others are taken to be present."""
        columns: list[tuple[str, Type]] = []
        for f in df.schema.fields:
            t = type_of_spark(f.dataType)
            columns.append((f.name, Option(t) if f.name in options else t))
        return self.frame(Relation(name, tuple(columns), kind), df)

    def read(self, name: str) -> DataFrame:
        relation = self.schema.relation(name)
        if name in self.readers:
            return self.readers[name]()
        return self.spark.createDataFrame([], relation.spark())

    def joined(self, other: Catalog) -> Catalog:
        """The relations of both; one name is one relation."""
        for name in self.schema.relations.keys() & other.schema.relations.keys():
            if self.schema.relations[name] != other.schema.relations[name]:
                raise UnknownRelation(f"{name} is declared in two ways")
        schema = replace(self.schema, relations=self.schema.relations | other.schema.relations, entities=self.schema.entities | other.schema.entities)
        return Catalog(self.spark, schema, other.readers | self.readers)

    def with_rows(self, changed: dict[str, DataFrame]) -> Catalog:
        """The same relations with other rows for some: a candidate state."""
        for name in changed:
            if name not in self.schema.relations:
                raise UnknownRelation(name)
        return Catalog(self.spark, self.schema, self.readers | {n: (lambda d=d: d) for n, d in changed.items()})


#: The driver's tables by name, with their keys where rows have one.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}


def star(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """A catalog of tables ``sf_dir/NAME.parquet``."""
    out = Catalog(spark)
    for name in names:
        out.declare(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return out


__all__ = ["Catalog", "I64", "KEYS", "star"]
