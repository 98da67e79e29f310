"""Value types and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tessera.errors import TypeMismatch, UnsupportedType


@dataclass(frozen=True)
class Type:
    def spark(self) -> T.DataType:
        raise NotImplementedError


@dataclass(frozen=True)
class Scalar(Type):
    name: str

    def spark(self) -> T.DataType:
        return _SCALARS[self.name]


_SCALARS: dict[str, T.DataType] = {
    "unit": T.BooleanType(),
    "bool": T.BooleanType(),
    "i64": T.LongType(),
    "f64": T.DoubleType(),
    "text": T.StringType(),
    "timestamp": T.TimestampNTZType(),
}
UNIT, BOOL, I64, F64, TEXT, TIMESTAMP = (Scalar(n) for n in _SCALARS)


@dataclass(frozen=True)
class Ref(Type):
    """Identity of a live entity; ``live`` False: of one that may be gone. Ids are stored as they are in the entity's table."""

    entity: str
    live: bool = True

    def spark(self) -> T.DataType:
        return T.LongType()


@dataclass(frozen=True)
class Product(Type):
    fields: tuple[tuple[str, Type], ...]

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField(n, t.spark(), isinstance(t, Option)) for n, t in self.fields])


@dataclass(frozen=True)
class Sum(Type):
    """Tagged variants: a struct of the tag and one nullable member for each variant."""

    variants: tuple[tuple[str, Type], ...]

    def spark(self) -> T.DataType:
        return T.StructType([T.StructField("tag", T.StringType(), False), *(T.StructField(n, t.spark(), True) for n, t in self.variants)])


@dataclass(frozen=True)
class Option(Type):
    item: Type

    def spark(self) -> T.DataType:
        if isinstance(self.item, Option):
            raise UnsupportedType("an option of an option has no column type; wrap the inner one in a product")
        return self.item.spark()


@dataclass(frozen=True)
class Seq(Type):
    item: Type

    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark(), True)  # files rarely say that items are never null


@dataclass(frozen=True)
class SetOf(Type):
    item: Type

    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark(), True)  # files rarely say that items are never null


@dataclass(frozen=True)
class BagOf(Type):
    """Entries (v, n): a value and how often it occurs."""

    item: Type

    def spark(self) -> T.DataType:
        return T.ArrayType(T.StructType([T.StructField("v", self.item.spark()), T.StructField("n", T.LongType())]))


@dataclass(frozen=True)
class MapOf(Type):
    key: Type
    value: Type

    def spark(self) -> T.DataType:
        return T.MapType(self.key.spark(), self.value.spark())


@dataclass(frozen=True)
class Var(Type):
    """The type that the enclosing Mu stands for."""

    name: str


@dataclass(frozen=True)
class Mu(Type):
    """A recursive type; columns hold it unrolled ``depth`` times, below which only its variants without recursion remain."""

    name: str
    body: Type
    depth: int = 4

    def unrolled(self) -> Type:
        if not _guarded(self.body, self.name):
            raise TypeMismatch(f"recursion of {self.name} is not guarded by a sum, option or collection")
        t: Type | None = None
        for _ in range(self.depth + 1):
            t = _substitute(self.body, self.name, t)
        if t is None:
            raise UnsupportedType(f"{self.name} has no value without recursion")
        return t

    def spark(self) -> T.DataType:
        return self.unrolled().spark()


def _guarded(t: Type, name: str, under: bool = False) -> bool:
    match t:
        case Var(n):
            return under or n != name
        case Product(fields):
            return all(_guarded(f, name, under) for _, f in fields)
        case Sum(variants):
            return all(_guarded(v, name, True) for _, v in variants)
        case Option(i) | Seq(i) | SetOf(i) | BagOf(i):
            return _guarded(i, name, True)
        case MapOf(k, v):
            return _guarded(k, name, True) and _guarded(v, name, True)
        case Mu(n, body):
            return n == name or _guarded(body, name, under)
    return True


def _substitute(t: Type, name: str, to: Type | None) -> Type | None:
    """``t`` with ``to`` for the variable; None where nothing without it remains."""
    match t:
        case Var(n) if n == name:
            return to
        case Product(fields):
            out = [(n, _substitute(f, name, to)) for n, f in fields]
            return None if any(f is None for _, f in out) else Product(tuple(out))  # type: ignore[arg-type]
        case Sum(variants):
            left = [(n, f) for n, v in variants if (f := _substitute(v, name, to)) is not None]
            return Sum(tuple(left)) if left else None
        case Option(i):
            inner = _substitute(i, name, to)
            return Option(inner) if inner is not None else UNIT
        case Seq(i) | SetOf(i) | BagOf(i):
            inner = _substitute(i, name, to)
            return type(t)(inner) if inner is not None else UNIT
        case MapOf(k, v):
            a, b = _substitute(k, name, to), _substitute(v, name, to)
            return MapOf(a, b) if a is not None and b is not None else UNIT
    return t


def item(t: Type) -> Type:
    """The type inside an option, else the type."""
    return t.item if isinstance(t, Option) else t


def type_of_spark(t: T.DataType, nullable: bool = False) -> Type:
    """The type a Spark column is read as: whole numbers as i64, floats as f64."""
    match t:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            out: Type = I64
        case T.FloatType() | T.DoubleType():
            out = F64
        case T.StringType():
            out = TEXT
        case T.BooleanType():
            out = BOOL
        case T.TimestampNTZType() | T.TimestampType():
            out = TIMESTAMP
        case T.ArrayType():
            out = Seq(type_of_spark(t.elementType))
        case T.StructType():
            out = Product(tuple((f.name, type_of_spark(f.dataType)) for f in t.fields))
        case T.MapType():
            out = MapOf(type_of_spark(t.keyType), type_of_spark(t.valueType))
        case _:
            raise UnsupportedType(t.simpleString())
    return Option(out) if nullable else out
