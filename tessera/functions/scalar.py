"""Row-local expressions: fields, constants, checked integer sums, sequences, conditionals, and widening of sum types."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import types as ty
from tessera.errors import TypeMismatch
from tessera.functions.equality import literal


@dataclass(frozen=True)
class Expr:
    def type(self, row: ty.Product) -> ty.Type:
        raise NotImplementedError

    def column(self, row: ty.Product, at: Column | None = None) -> Column:
        """As a Spark column; ``at`` is the input struct, by default the row's own columns."""
        raise NotImplementedError


@dataclass(frozen=True)
class Input(Expr):
    def type(self, row):
        return row

    def column(self, row, at=None):
        return at if at is not None else F.struct(*[F.col(f"`{n}`").alias(n) for n, _ in row.fields])


@dataclass(frozen=True)
class Const(Expr):
    value: Any
    of: ty.Type

    def type(self, row):
        return self.of

    def column(self, row, at=None):
        return literal(self.value, self.of)


@dataclass(frozen=True)
class Get(Expr):
    input: Expr
    field: str

    def type(self, row):
        t = self.input.type(row)
        if not isinstance(t, ty.Product) or self.field not in dict(t.fields):
            raise TypeMismatch(f"no field {self.field} in {t}")
        return dict(t.fields)[self.field]

    def column(self, row, at=None):
        if isinstance(self.input, Input) and at is None:
            return F.col(f"`{self.field}`")
        return self.input.column(row, at).getField(self.field)


def field(name: str) -> Expr:
    return Get(Input(), name)


@dataclass(frozen=True)
class Length(Expr):
    input: Expr

    def type(self, row):
        if not isinstance(self.input.type(row), ty.Seq):
            raise TypeMismatch("length of what is no sequence")
        return ty.I64

    def column(self, row, at=None):
        return F.size(self.input.column(row, at)).cast("long")


@dataclass(frozen=True)
class SumI64(Expr):
    """Sum of a sequence of i64; past 64 bits is an error."""

    input: Expr

    def type(self, row):
        if self.input.type(row) != ty.Seq(ty.I64):
            raise TypeMismatch("sum of what is no sequence of i64")
        return ty.I64

    def column(self, row, at=None):
        return F.aggregate(self.input.column(row, at), F.lit(0).cast("long"), lambda a, x: a + x)


@dataclass(frozen=True)
class Add(Expr):
    """Sum of two i64; past 64 bits is an error."""

    left: Expr
    right: Expr

    def type(self, row):
        if (self.left.type(row), self.right.type(row)) != (ty.I64, ty.I64):
            raise TypeMismatch("only i64 are added")
        return ty.I64

    def column(self, row, at=None):
        return self.left.column(row, at) + self.right.column(row, at)


@dataclass(frozen=True)
class ToF64(Expr):
    input: Expr

    def type(self, row):
        if self.input.type(row) != ty.I64:
            raise TypeMismatch("only i64 become f64")
        return ty.F64

    def column(self, row, at=None):
        return self.input.column(row, at).cast("double")


@dataclass(frozen=True)
class If(Expr):
    condition: Expr
    then: Expr
    other: Expr

    def type(self, row):
        a, b = self.then.type(row), self.other.type(row)
        if self.condition.type(row) != ty.BOOL or a != b:
            raise TypeMismatch("a condition is bool and both cases are of one type")
        return a

    def column(self, row, at=None):
        return F.when(self.condition.column(row, at), self.then.column(row, at)).otherwise(self.other.column(row, at))


@dataclass(frozen=True)
class Widen(Expr):
    """A value of a sum type as one of a sum type with more variants."""

    input: Expr
    to: ty.Sum

    def type(self, row):
        t = self.input.type(row)
        if not isinstance(t, ty.Sum) or not set(t.variants) <= set(self.to.variants):
            raise TypeMismatch(f"{t} doesn't widen to {self.to}")
        return self.to

    def column(self, row, at=None):
        c, have = self.input.column(row, at), dict(self.input.type(row).variants)
        members = [(c.getField(n) if n in have else F.lit(None).cast(t.spark())).alias(n) for n, t in self.to.variants]
        return F.struct(c.getField("tag").alias("tag"), *members)


# values inside a row: get and put


def put(c: Column, path: tuple[str, ...], value: Column) -> Column:
    """The struct ``c`` with ``value`` at a path of fields."""
    return c.withField(".".join(f"`{p}`" for p in path), value) if path else value


def get(c: Column, path: tuple[str, ...]) -> Column:
    for p in path:
        c = c.getField(p)
    return c


# changes of collections


def splice(seq: Column, start: int, remove: int, insert: Column) -> Column:
    """A sequence with ``remove`` items at ``start`` replaced by the array ``insert``."""
    size = F.size(seq)
    ok = (F.lit(start + remove) <= size) & F.lit(start >= 0 and remove >= 0)
    head = F.slice(seq, 1, start) if start else F.slice(seq, 1, F.lit(0))
    out = F.concat(head, insert, F.slice(seq, F.lit(start + remove + 1), size - start - remove))
    return F.when(ok, out).otherwise(F.raise_error(F.lit("SPLICE_OUT_OF_BOUNDS")))


def splice_sum(old_sum: Column, seq: Column, start: int, remove: int, insert: Column) -> Column:
    """The sum after ``splice``, from the sum before and what changes."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    return old_sum - F.aggregate(F.slice(seq, start + 1, remove), zero, add) + F.aggregate(insert, zero, add)
