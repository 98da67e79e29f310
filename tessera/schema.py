"""Declared relations: column types, their equalities, and whether a relation is a set or a bag."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from tessera import types as ty
from tessera.errors import UnknownRelation
from tessera.functions.equality import Eq, check_eq, default_eq, refines

SET, BAG = "set", "bag"


@dataclass(frozen=True)
class RelType:
    """What is known of a relation's rows. ``unique``: a set's rows are known to be distinct as they stand."""

    kind: str
    columns: tuple[ty.Type, ...]
    eqs: tuple[Eq, ...]

    def __post_init__(self) -> None:
        for e, t in zip(self.eqs, self.columns, strict=True):
            check_eq(e, t)


@dataclass(frozen=True)
class Relation:
    name: str
    columns: tuple[tuple[str, ty.Type], ...]
    kind: str = BAG
    eqs: tuple[Eq, ...] | None = None

    @property
    def type(self) -> RelType:
        kinds = tuple(t for _, t in self.columns)
        return RelType(self.kind, kinds, self.eqs or tuple(default_eq(t) for t in kinds))

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark(), True) for n, t in self.columns])

    def index(self, name: str) -> int:
        return [n for n, _ in self.columns].index(name)


@dataclass(frozen=True)
class Field:
    """A field of an entity: a column, or ``many``: a relation of (source id, target id) pairs."""

    name: str
    type: ty.Type | None = None
    target: str | None = None
    many: str | None = None
    owned: bool = False
    orphan: str = "keep"


@dataclass(frozen=True)
class Entity:
    """An object type: rows of ``relation`` told apart by ``key``."""

    name: str
    relation: str
    key: str
    fields: tuple[Field, ...] = ()

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise UnknownRelation(f"{self.name}.{name}")


@dataclass(frozen=True)
class Schema:
    relations: dict[str, Relation] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)
    version: int = 0

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise UnknownRelation(name)
        return self.relations[name]

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise UnknownRelation(name)
        return self.entities[name]

    def with_relation(self, *new: Relation) -> Schema:
        return replace(self, relations=self.relations | {r.name: r for r in new}, version=self.version + 1)

    def with_entity(self, *new: Entity) -> Schema:
        return replace(self, entities=self.entities | {e.name: e for e in new}, version=self.version + 1)

    def with_equalities(self, relation: str, eqs: tuple[Eq, ...]) -> Schema:
        """The relation under other equalities, each at least as coarse as before."""
        old = self.relation(relation)
        if not all(map(refines, old.type.eqs, eqs)):
            raise ValueError("equalities may only become coarser; migrate the relation otherwise")
        return self.with_relation(replace(old, eqs=eqs))
