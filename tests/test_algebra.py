"""Each operator on small relations, and what it refuses."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera import errors as er
from tessera import types as ty
from tessera.api.query import Query, col, scan
from tessera.functions.equality import Eq, Order, congruent, eq_key, refines
from tessera.operators import exact
from tessera.operators.paging import OrderedView
from tessera.plans import nodes as n
from tessera.plans import wire
from tessera.plans.lower import Lowering
from tessera.schema import BAG, SET, Relation
from tessera.sources.catalog import Catalog

CI = Eq("text_ci")


@pytest.fixture
def cat(spark):
    c = Catalog(spark)
    pair = (("t", ty.TEXT), ("i", ty.I64))
    df = lambda rows: spark.createDataFrame(rows, "t string, i long")
    c.frame(Relation("left", pair, BAG, (CI, Eq("i64"))), df([("A", 1), ("a", 2), ("B", 3)]))
    c.frame(Relation("right", pair, BAG, (CI, Eq("i64"))), df([("b", 1), ("B", 4)]))
    c.frame(Relation("nums", (("x", ty.I64),)), spark.createDataFrame([(2,), (3,), (1,), (2,)], "x long"))
    c.frame(Relation("set", pair, SET), df([("a", 1), ("b", 1), ("c", 2)]))
    c.frame(Relation("bag", pair), df([("a", 1), ("a", 1), ("b", 2), ("c", 2)]))
    c.frame(Relation("f", (("g", ty.I64), ("x", ty.F64))), spark.createDataFrame([(1, 1e16), (1, 1.0), (1, -1e16), (2, 0.0), (2, -0.0)], "g long, x double"))
    c.add(Relation("empty", (("g", ty.I64), ("x", ty.F64))))
    return c


def rows(q):
    df = q.frame() if isinstance(q, Query) else q
    return sorted(map(tuple, df.collect()), key=repr)


def run(cat, plan):
    return rows(Lowering(cat.schema, cat.read).run(plan))


def test_set_projection_dedups_and_bag_keeps(cat):
    assert rows(scan(cat, "set").project("i")) == [(1,), (2,)]
    assert rows(scan(cat, "set").select("i")) == [(1,), (1,), (2,)]
    assert rows(scan(cat, "bag").project("i")) == [(1,), (1,), (2,), (2,)]


def test_or_adds_in_bags_and_joins_in_sets(cat):
    p = (col("i") == 1) | (col("t") == "a")
    assert rows(scan(cat, "bag").where(p)) == [("a", 1)] * 4
    assert rows(scan(cat, "set").where(p)) == [("a", 1), ("b", 1)]
    assert rows(scan(cat, "bag").where(~p)) == [("b", 2), ("c", 2)]


def test_top_k_keeps_ties(cat):
    assert rows(scan(cat, "nums").bottom(2, "x")) == [(1,), (2,), (2,)]
    assert rows(scan(cat, "nums").top(2, "x")) == [(2,), (2,), (3,)]
    assert rows(scan(cat, "nums").top(0, "x")) == []
    assert rows(scan(cat, "nums").top(99, "x")) == [(1,), (2,), (2,), (3,)]


def test_case_insensitive_keys(cat):
    q = scan(cat, "left")
    assert sorted((k.lower(), c) for k, c in rows(q.group("t").count("n"))) == [("a", 2), ("b", 1)]
    j = n.JoinEq(n.Scan("left"), n.Scan("right"), 0, 0, CI)
    assert len(run(cat, j)) == 2
    assert run(cat, n.AntiJoin(n.Scan("left"), n.Scan("right"), 0, 0, CI)) == [("A", 1), ("a", 2)]
    assert run(cat, n.FilterEqConst(n.Scan("left"), 0, "a", CI)) == [("A", 1), ("a", 2)]
    assert len(run(cat, n.Distinct(n.Project(n.Scan("left"), (0,)), (CI,)))) == 2


def test_case_folding_is_ascii_only(spark):
    df = spark.createDataFrame([("Ä",), ("ä",), ("Z",), ("z",)], "t string")
    assert df.select(eq_key(F.col("t"), CI, ty.TEXT)).distinct().count() == 3


def test_coarse_bag_difference_is_monus(cat):
    d = n.Difference(n.Project(n.Scan("left"), (0,)), n.Project(n.Scan("right"), (0,)))
    assert [t for (t,) in run(cat, d)] == ["A", "a"]
    assert rows(scan(cat, "bag").difference(scan(cat, "bag").where(col("i") == 2))) == [("a", 1), ("a", 1)]


def test_doubles_are_told_apart_by_bits(cat, spark):
    q = scan(cat, "f").where(col("g") == 2)
    assert len(rows(q.group("x").count("n"))) == 2
    assert len(rows(q.where(col("x") == 0.0))) == 1
    assert len(rows(q.where(col("x") < 0.0))) == 1
    df = spark.createDataFrame([(x,) for x in (math.nan, math.inf, 0.0, -0.0, -math.inf)], "x double")
    c = Catalog(spark)
    c.declare("d", df)
    assert rows(scan(c, "d").bottom(2, "x")) == [(-0.0,), (-math.inf,)]
    assert math.isnan(rows(scan(c, "d").top(1, "x"))[0][0])


def test_sums_are_exact(cat):
    assert dict(rows(scan(cat, "f").group("g").exact_sum("x", "s"))) == {1: 1.0, 2: 0.0}
    assert rows(scan(cat, "empty").group().exact_sum("x", "s")) == [(0.0,)]
    assert rows(scan(cat, "empty").group().count("n")) == [(0,)]
    assert rows(scan(cat, "empty").group("g").count("n")) == []


def test_limbs_hold_every_double(spark):
    import random

    rng = random.Random(4)
    values = [0.0, 5e-324, -5e-324, 1.7976931348623157e308, 2.0**-1022, 0.1] + [rng.choice((-1, 1)) * rng.random() * 2.0 ** rng.randint(-1080, 1023) for _ in range(300)]
    for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", exact.limbs(F.col("x")).alias("l")).collect():
        total = (r.l.l0 + (r.l.l1 << 32) + (r.l.l2 << 64)) << (exact.STEP * r.l.w)
        assert Fraction(total, 1 << 1074) == Fraction(r.x)


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_sums_refuse_non_finite(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "x double")
    with pytest.raises(Exception, match="NON_FINITE"):
        exact.exact_sum(df, {}, F.col("x"), {}, "s").collect()


def test_order_statistics(spark):
    df = spark.createDataFrame([(v,) for v in (10, 20, 30)], "v long")
    stat = lambda s, at=0: [r[0] for r in exact.order_statistic(df, [], "v", F.col("v"), s, at).collect()]
    assert stat("min") == [10] and stat("max") == [30]
    assert stat("kth_start", 1) == [20] and stat("kth_end", 0) == [30] and stat("kth_end", 3) == []
    assert stat("lower_quantile", 0.4) == [10]


def test_refusals(cat):
    s = cat.schema
    with pytest.raises(er.UnknownRelation):
        n.Scan("nowhere").type(s)
    with pytest.raises(er.ColumnOutOfBounds):
        n.Project(n.Scan("left"), (7,)).type(s)
    with pytest.raises(er.TypeMismatch):
        n.JoinEq(n.Scan("left"), n.Scan("right"), 0, 1, CI).type(s)
    with pytest.raises(er.TypeMismatch):
        n.FilterEqConst(n.Scan("nums"), 0, "x", Eq("i64")).type(s)
    with pytest.raises(er.EquivalenceNotCongruent):
        n.FilterEqConst(n.Scan("left"), 0, "a", Eq("text")).type(s)
    with pytest.raises(er.EquivalenceArityMismatch):
        n.Distinct(n.Scan("left"), (CI,)).type(s)
    with pytest.raises(er.OrderingNotCongruent):
        n.TopKWithTies(n.Scan("left"), 0, Order("text"), True, 1).type(s)
    with pytest.raises(er.TypeMismatch):
        n.Union(n.Scan("set"), n.Scan("bag")).type(s)
    with pytest.raises(er.TypeMismatch):
        n.Group(n.Scan("nums"), (), (), 0).type(s)


def test_congruence_and_refinement():
    assert congruent(Order("text_ci"), Eq("text")) and congruent(Order("text_ci"), CI)
    assert not congruent(Order("bool"), Eq("bool")) and not congruent(Order("live_id"), Eq("live_id"))
    assert refines(Eq("text"), CI) and not refines(CI, Eq("text"))
    assert refines(Eq("seq", (Eq("text"),)), Eq("seq", (CI,)))


def test_options_equal_themselves(spark):
    c = Catalog(spark)
    c.declare("o", spark.createDataFrame([(1, None), (2, 5), (3, None)], "k long, v long"), options=("v",))
    q = scan(c, "o")
    assert rows(q.where(col("v").is_none()).select("k")) == [(1,), (3,)]
    assert len(rows(q.select("v").distinct())) == 2
    assert len(rows(q.join(q.rename(k="k2", v="v2"), ("v", "v2")))) == 5
    assert rows(q.where(~(col("v") == 5)).select("k")) == [(1,), (3,)]


def test_pages_cover_the_view_once(spark):
    c = Catalog(spark)
    c.declare("p", spark.createDataFrame([(x % 3, f"s{x % 5}") for x in range(30)], "a long, b string"))
    q = scan(c, "p")
    for descending in (False, True):
        v, at, got = OrderedView(q.frame(), q.type, 0, Order("i64"), descending), None, []
        while True:
            page = v.page(7, at)
            got += page.rows
            if page.next is None:
                break
            at = page.next
        want = sorted(((x % 3, f"s{x % 5}") for x in range(30)), key=lambda r: (-r[0] if descending else r[0], r[1]))
        assert [tuple(r) for r in got] == want
    with pytest.raises(er.LimitExceeded):
        v.frame(0)
    with pytest.raises(er.InvalidCursor):
        v.page(3, type(at)('{"o":99}', at.row, 0))


def test_order_statistics_by_ranges(spark):
    df = spark.createDataFrame([(g, x % 37) for g in (1, 2, None) for x in range(200 if g else 50)], "g long, x long").repartition(6)
    for statistic, at in (("kth_start", 0), ("kth_start", 60), ("kth_end", 3), ("kth_end", 199), ("lower_quantile", 0.0), ("lower_quantile", 0.37), ("lower_quantile", 1.0), ("kth_start", 10_000)):
        for by in ([], ["g"]):
            one, many = (exact.order_statistic(df, by, "x", F.col("x"), statistic, at, spread=s).collect() for s in (False, True))
            key = lambda r: tuple((v is not None, v) for v in r)
            assert sorted(map(tuple, one), key=key) == sorted(map(tuple, many), key=key), (statistic, at, by)


def test_pages_move_with_the_view(spark):
    c = Catalog(spark)
    c.declare("p", spark.createDataFrame([(x, f"s{x}") for x in (1, 2, 2, 3, 5)], "a long, b string"))
    q = scan(c, "p")
    v = OrderedView(q.frame(), q.type, 0, Order("i64"))
    at = v.page(2).next
    change = spark.createDataFrame([(2, "s2", -1), (3, "s3", -1), (4, "s4", 2)], "a long, b string, _w long")
    assert sorted(map(tuple, v.page_change(change, 2, v.page(1).next).collect())) == [(2, "s2", -1), (4, "s4", 1)]
    moved = v.advanced(change).advanced(spark.createDataFrame([(9, "s9", 1)], "a long, b string, _w long"))
    assert [tuple(r) for r in moved.page(9).rows] == [(1, "s1"), (2, "s2"), (4, "s4"), (4, "s4"), (5, "s5"), (9, "s9")]
    assert [tuple(r) for r in moved.page(2, at).rows] == [(4, "s4"), (4, "s4")]
    with pytest.raises(er.InvalidCursor):
        moved.advanced(spark.createDataFrame([(2, "s2", -1)], "a long, b string, _w long")).page(2, at)


def test_nested_equalities(spark):
    t = ty.SetOf(ty.TEXT)
    df = spark.createDataFrame([(["a", "B"],), (["b", "A", "a"],), (["c"],)], "s array<string>")
    assert df.select(eq_key(F.col("s"), Eq("set", (CI,)), t).alias("k")).distinct().count() == 2
    bag = ty.BagOf(ty.TEXT)
    df = spark.createDataFrame([([Row(v="a", n=1), Row(v="A", n=2)],), ([Row(v="a", n=3)],)], "s array<struct<v:string,n:long>>")
    assert df.select(eq_key(F.col("s"), Eq("bag", (CI,)), bag).alias("k")).distinct().count() == 1


def test_recursive_types_unroll():
    tree = ty.Mu("t", ty.Sum((("leaf", ty.I64), ("node", ty.Product((("l", ty.Var("t")), ("r", ty.Var("t"))))))), depth=2)
    assert "leaf" in tree.spark().simpleString()
    with pytest.raises(er.TypeMismatch):
        ty.Mu("t", ty.Product((("next", ty.Var("t")),))).unrolled()


def test_wire_round_trip(cat):
    plan = n.TopKWithTies(n.Group(n.FilterEqConst(n.Scan("left"), 0, "a", CI), (0,), (CI,)), 1, Order("i64"), True, 3)
    assert wire.from_dict(wire.to_dict(plan), remote=True) == plan
    with pytest.raises(er.TypeMismatch):
        wire.from_dict(wire.to_dict(n.Union(n.Scan("left"), n.Scan("left"))), remote=True)
    deep = n.Scan("left")
    for _ in range(200):
        deep = n.PromoteToBag(deep)
    with pytest.raises(er.LimitExceeded):
        wire.from_dict(wire.to_dict(deep))


def test_footprint_and_retarget(cat):
    plan = n.Project(n.JoinEq(n.Scan("bag"), n.Scan("nums"), 1, 0, Eq("i64")), (0,))
    assert n.footprint(plan, cat.schema).columns == (("bag", frozenset({0, 1})), ("nums", frozenset({0})))
    assert n.retarget(plan, {"bag": "set"}).input.left == n.Scan("set")


def test_metamorphic_laws(cat):
    a, b = scan(cat, "bag"), scan(cat, "bag").where(col("i") == 1)
    assert rows(a.difference(a.difference(b))) == rows(a.intersect(b)) == rows(b)
    assert rows(a.union(b)) == rows(b.union(a))
    assert rows(scan(cat, "set").to_bag().project("i")) == rows(scan(cat, "set").select("i"))
