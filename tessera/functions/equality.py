"""Equalities and orderings that a column can be declared with, and the key columns that stand for them.

Spark's own comparison takes 0.0 and -0.0 for one, and its case folding is not ASCII's, so grouping, joining and sorting go
through a key of the column wherever its equality isn't Spark's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import types as ty
from tessera.errors import TypeMismatch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The scalar equalities and orderings by name, and the type each is of.
EQUALITIES = {"unit": "unit", "bool": "bool", "i64": "i64", "f64_bits": "f64", "text": "text", "text_ci": "text", "timestamp": "timestamp", "live_id": "live", "past_id": "past"}
ORDERINGS = {
    "unit": "unit", "bool": "bool", "i64": "i64", "f64_total": "f64", "text": "text", "text_ci": "text", "text_ci_then_binary": "text", "timestamp": "timestamp", "live_id": "live", "past_id": "past",
}
#: Fixed values: (ordering, equality) such that equal values are never told apart by the ordering in a way that matters.
CONGRUENT = {("i64", "i64"), ("f64_total", "f64_bits"), ("text", "text"), ("text_ci", "text"), ("text_ci_then_binary", "text"), ("text_ci", "text_ci"), ("timestamp", "timestamp")}


@dataclass(frozen=True)
class Eq:
    """Equality of values of one type; ``parts`` are those of a compound type's members, in their order."""

    name: str
    parts: tuple[Eq, ...] = ()

    def plain(self) -> bool:
        """Whether Spark's own comparison is this equality."""
        return self.name in ("unit", "bool", "i64", "text", "timestamp", "live_id", "past_id") or self.name in ("option", "product", "seq") and all(p.plain() for p in self.parts)


@dataclass(frozen=True)
class Order:
    """Ordering of one type. Compound: ``product`` by members as listed in ``fields``, ``sum`` by rank of the tags in ``fields``, ``option`` with ``none_first``, ``seq`` member by member."""

    name: str
    parts: tuple[Order, ...] = ()
    fields: tuple[str, ...] = ()
    none_first: bool = True


def default_eq(t: ty.Type) -> Eq:
    match t:
        case ty.Scalar("f64"):
            return Eq("f64_bits")
        case ty.Scalar(n):
            return Eq(n)
        case ty.Ref(_, live):
            return Eq("live_id" if live else "past_id")
        case ty.Option(i):
            return Eq("option", (default_eq(i),))
        case ty.Product(fields):
            return Eq("product", tuple(default_eq(f) for _, f in fields))
        case ty.Sum(variants):
            return Eq("sum", tuple(default_eq(v) for _, v in variants))
        case ty.Seq(i):
            return Eq("seq", (default_eq(i),))
        case ty.SetOf(i):
            return Eq("set", (default_eq(i),))
        case ty.BagOf(i):
            return Eq("bag", (default_eq(i),))
        case ty.MapOf(k, v):
            return Eq("map", (default_eq(k), default_eq(v)))
        case ty.Mu():
            return default_eq(t.unrolled())
    raise TypeMismatch(str(t))


def default_order(t: ty.Type) -> Order:
    match t:
        case ty.Scalar("f64"):
            return Order("f64_total")
        case ty.Scalar(n):
            return Order(n)
        case ty.Ref(_, live):
            return Order("live_id" if live else "past_id")
        case ty.Option(i):
            return Order("option", (default_order(i),))
        case ty.Product(fields):
            return Order("product", tuple(default_order(f) for _, f in fields), tuple(n for n, _ in fields))
        case ty.Sum(variants):
            return Order("sum", tuple(default_order(v) for _, v in variants), tuple(n for n, _ in variants))
        case ty.Seq(i):
            return Order("seq", (default_order(i),))
    raise TypeMismatch(f"no ordering for {t}")


def _members(t: ty.Type) -> tuple[ty.Type, ...]:
    match t:
        case ty.Option(i) | ty.Seq(i) | ty.SetOf(i) | ty.BagOf(i):
            return (i,)
        case ty.Product(fields):
            return tuple(f for _, f in fields)
        case ty.Sum(variants):
            return tuple(v for _, v in variants)
        case ty.MapOf(k, v):
            return (k, v)
    return ()


_SHAPES = {"option": ty.Option, "product": ty.Product, "sum": ty.Sum, "seq": ty.Seq, "set": ty.SetOf, "bag": ty.BagOf, "map": ty.MapOf}


def _domain(t: ty.Type) -> str:
    return t.name if isinstance(t, ty.Scalar) else ("live" if t.live else "past") if isinstance(t, ty.Ref) else ""


def check_eq(e: Eq, t: ty.Type) -> None:
    """Raise TypeMismatch unless ``e`` is an equality of ``t``."""
    if isinstance(t, ty.Mu):
        return check_eq(e, t.unrolled())
    if e.name in _SHAPES:
        members = _members(t)
        if not isinstance(t, _SHAPES[e.name]) or len(members) != len(e.parts):
            raise TypeMismatch(f"{e.name} equality on {t}")
        for p, m in zip(e.parts, members, strict=True):
            check_eq(p, m)
    elif EQUALITIES.get(e.name) != _domain(t):
        raise TypeMismatch(f"{e.name} equality on {t}")


def check_order(o: Order, t: ty.Type) -> None:
    if isinstance(t, ty.Mu):
        return check_order(o, t.unrolled())
    if o.name in ("option", "product", "sum", "seq"):
        if not isinstance(t, _SHAPES[o.name]):
            raise TypeMismatch(f"{o.name} ordering on {t}")
        members = dict(t.fields if isinstance(t, ty.Product) else t.variants if isinstance(t, ty.Sum) else [("", t.item)])  # type: ignore[union-attr]
        if o.fields and set(o.fields) != set(members):
            raise TypeMismatch("an ordering has to name every field or tag")
        for n, p in zip(o.fields or ("",), o.parts, strict=True):
            check_order(p, members[n])
    elif ORDERINGS.get(o.name) != _domain(t):
        raise TypeMismatch(f"{o.name} ordering on {t}")


def refines(finer: Eq, coarser: Eq) -> bool:
    """Whether values equal under ``finer`` are equal under ``coarser``."""
    if finer == coarser or (finer.name, coarser.name) == ("text", "text_ci"):
        return True
    return finer.name == coarser.name and len(finer.parts) == len(coarser.parts) > 0 and all(map(refines, finer.parts, coarser.parts))


def congruent(o: Order, e: Eq) -> bool:
    """Whether ``o`` may order a column whose equality is ``e``."""
    if o.parts:
        return o.name == e.name and len(o.parts) == len(e.parts) and all(map(congruent, o.parts, e.parts)) if o.name != "product" else e.name == "product" and len(o.parts) == len(e.parts)
    return (o.name, e.name) in CONGRUENT


def fold(c: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def minus_zero(c: Column) -> Column:
    return (c == 0) & (F.when(c == 0, c.cast("string")) == "-0.0")


def eq_key(c: Column, e: Eq, t: ty.Type) -> Column:
    """A column equal, null-safely and by Spark's comparison, just where ``c`` is equal under ``e``."""
    if e.plain():
        return c
    if isinstance(t, ty.Mu):
        return eq_key(c, e, t.unrolled())
    match e.name:
        case "f64_bits":
            return F.when(c.isNotNull(), F.struct(c.alias("x"), F.coalesce(minus_zero(c), F.lit(False)).alias("m")))
        case "text_ci":
            return fold(c)
        case "option":
            return eq_key(c, e.parts[0], t.item)  # type: ignore[union-attr]
        case "product":
            return F.struct(*[eq_key(c.getField(n), p, f).alias(n) for (n, f), p in zip(t.fields, e.parts, strict=True)])  # type: ignore[union-attr]
        case "sum":
            return F.struct(c.getField("tag").alias("tag"), *[eq_key(c.getField(n), p, f).alias(n) for (n, f), p in zip(t.variants, e.parts, strict=True)])  # type: ignore[union-attr]
        case "seq":
            return F.transform(c, lambda x: eq_key(x, e.parts[0], t.item))  # type: ignore[union-attr]
        case "set":
            return F.array_sort(F.array_distinct(F.transform(c, lambda x: eq_key(x, e.parts[0], t.item))))  # type: ignore[union-attr]
        case "bag":
            keys = F.transform(c, lambda x: F.struct(eq_key(x.getField("v"), e.parts[0], t.item).alias("v"), x.getField("n").alias("n")))  # type: ignore[union-attr]
            classes = F.array_sort(F.array_distinct(F.transform(keys, lambda x: x.getField("v"))))
            mass = lambda k: F.aggregate(F.filter(keys, lambda x: x.getField("v").eqNullSafe(k)), F.lit(0).cast("long"), lambda a, x: a + x.getField("n"))
            return F.filter(F.transform(classes, lambda k: F.struct(k.alias("v"), mass(k).alias("n"))), lambda x: x.getField("n") > 0)
        case "map":
            pair = lambda x: F.struct(eq_key(x.getField("key"), e.parts[0], t.key).alias("k"), eq_key(x.getField("value"), e.parts[1], t.value).alias("v"))  # type: ignore[union-attr]
            return F.array_sort(F.transform(F.map_entries(c), pair))
    raise TypeMismatch(e.name)


def order_key(c: Column, o: Order, t: ty.Type) -> Column:
    """A column whose Spark order is ``o``'s."""
    match o.name:
        case "f64_total":
            # NaN sorts last in Spark too; -0.0 before 0.0
            return F.when(c.isNotNull(), F.struct(c.alias("x"), (~F.coalesce(minus_zero(c), F.lit(False))).alias("p")))
        case "text_ci":
            return fold(c)
        case "text_ci_then_binary":
            return F.struct(fold(c).alias("f"), c.alias("b"))
        case "option":
            return F.struct((c.isNotNull() if o.none_first else c.isNull()).alias("n"), order_key(c, o.parts[0], t.item).alias("v"))  # type: ignore[union-attr]
        case "product":
            kinds = dict(t.fields)  # type: ignore[union-attr]
            return F.struct(*[order_key(c.getField(n), p, kinds[n]).alias(f"f{i}") for i, (n, p) in enumerate(zip(o.fields, o.parts, strict=True))])
        case "sum":
            kinds = dict(t.variants)  # type: ignore[union-attr]
            rank = F.array_position(F.lit(list(o.fields)), c.getField("tag"))
            return F.struct(rank.alias("r"), *[order_key(c.getField(n), p, kinds[n]).alias(f"v{i}") for i, (n, p) in enumerate(zip(o.fields, o.parts, strict=True))])
        case "seq":
            return F.transform(c, lambda x: order_key(x, o.parts[0], t.item))  # type: ignore[union-attr]
    return c


def literal(value: object, t: ty.Type) -> Column:
    """A constant of type ``t``. Products are dicts, sums (tag, value), bags lists of (value, count)."""
    if isinstance(t, ty.Mu):
        return literal(value, t.unrolled())
    if isinstance(t, ty.Option):
        return F.lit(None).cast(t.spark()) if value is None else literal(value, t.item)
    if value is None:
        raise TypeMismatch(f"no value for {t}")
    match t:
        case ty.Product(fields):
            return F.struct(*[literal(value[n], f).alias(n) for n, f in fields])  # type: ignore[index]
        case ty.Sum(variants):
            tag, inner = value  # type: ignore[misc]
            if tag not in dict(variants):
                raise TypeMismatch(f"no variant {tag}")
            return F.struct(F.lit(tag).alias("tag"), *[(literal(inner, f) if n == tag else F.lit(None).cast(f.spark())).alias(n) for n, f in variants])
        case ty.Seq(i) | ty.SetOf(i):
            return F.array(*[literal(x, i) for x in value]).cast(t.spark())  # type: ignore[union-attr]
        case ty.BagOf(i):
            return F.array(*[F.struct(literal(x, i).alias("v"), F.lit(n).cast("long").alias("n")) for x, n in value]).cast(t.spark())  # type: ignore[union-attr]
        case ty.MapOf(k, v):
            return F.create_map(*[c for a, b in value.items() for c in (literal(a, k), literal(b, v))]).cast(t.spark())  # type: ignore[union-attr]
        case ty.Scalar("i64") | ty.Ref():
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeMismatch(f"{value!r} for {t}")
        case ty.Scalar("f64"):
            if isinstance(value, bool) or not isinstance(value, float):
                raise TypeMismatch(f"{value!r} for {t}")
        case ty.Scalar("text"):
            if not isinstance(value, str):
                raise TypeMismatch(f"{value!r} for {t}")
        case ty.Scalar("bool") | ty.Scalar("unit"):
            if not isinstance(value, bool):
                raise TypeMismatch(f"{value!r} for {t}")
    return F.lit(value).cast(t.spark())
