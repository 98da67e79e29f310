"""Delta rules against recomputation, history, watches, writable views, rules, recursion, scalars and access."""

import itertools
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera import errors as er
from tessera import types as ty
from tessera.api import access
from tessera.api.query import col, scan
from tessera.functions import scalar as sc
from tessera.functions import text
from tessera.functions.equality import Eq
from tessera.operators import dependencies, fixpoint, rules
from tessera.plans import nodes as n
from tessera.schema import SET, Relation
from tessera.sources import arranged
from tessera.sources import footprints as fp
from tessera.sources import migrate
from tessera.sources.catalog import Catalog
from tessera.sources.changelog import Store, added, moved, orphans, removed
from tessera.sources.index import Index
from tessera.streaming import watch
from tessera.streaming import zset as z
from tessera.streaming.maintained import Maintained
from tessera.streaming.watch import Forest, Watch, delta, stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


BAGS = [list(c) for k in range(3) for c in itertools.combinations_with_replacement([("a", 1), ("b", 2)], k)]


def shapes(q, fixed):
    return {
        "filter": q.where(col("t") == "a"),
        "project": q.select("i"),
        "distinct": q.distinct(),
        "group": q.group("t").count("n"),
        "global": q.group().count("n"),
        "top": q.top(1, "i"),
        "join": q.join(fixed, ("t", "u")),
        "anti": q.anti_join(fixed, "t", "u"),
        "difference": q.select("t").difference(fixed.select("u").rename(u="t")),
    }


def test_every_delta_rule_agrees_with_recomputation(spark):
    """All changes between bags of up to two rows over two values, at once: each pair of states is a scenario of its own key."""
    pairs = list(itertools.product(range(len(BAGS)), repeat=2))
    frame = lambda which: spark.createDataFrame([(f"{s}:{t}", i, s) for s, p in enumerate(pairs) for t, i in BAGS[p[which]]], "t string, i long, s long")
    before, after = frame(0), frame(1)
    change = z.recomputed(before, after)
    c = Catalog(spark)
    c.declare("r", before)
    c.declare("fixed", spark.createDataFrame([(f"{s}:a",) for s in range(len(pairs))], "u string"))
    q, fixed = scan(c, "r"), scan(c, "fixed")
    shapes_of, wanted = {}, {}
    for name, shape in {
        "filter": q.where(col("i") == 1),
        "project": q.select("i", "s"),
        "distinct": q.distinct(),
        "group": q.group("t").count("n"),
        "join": q.join(fixed, ("t", "u")),
        "anti": q.anti_join(fixed, "t", "u"),
        "difference": q.select("t").difference(fixed.select("u").rename(u="t")),
        "global": q.group().count("n"),
        "top": q.top(3, "s"),
        "not": q.where(~(col("i") == 1)),
        "set": q.distinct().select("i"),
        "self join": q.join(q.rename(t="t2", i="i2", s="s2"), ("t", "t2")),
    }.items():
        shapes_of[name] = shape
        got = delta(shape, c.read, {"r": change})
        want = z.recomputed(shape.frame(), type(shape)(c.with_rows({"r": after}), shape.plan, shape.names).frame())
        wanted[name] = rows(want)
        assert rows(got) == wanted[name], name
        parts = z.weighted(before).unionByName(z.weighted(before)).unionByName(z.weighted(before, -1))  # weights in parts
        assert rows(delta(shape, None, {"r": change}, lambda n, p=parts: p if n == "r" else z.weighted(c.read(n)))) == wanted[name], name
    kept = Maintained(shapes_of, lambda n: z.weighted(c.read(n)))
    assert {k: rows(d) for k, d in kept.advance({"r": change}).items()} == wanted
    back = kept.advance({"r": z.negate(change)})
    assert {k: rows(d) for k, d in back.items()} == {k: rows(z.negate(spark.createDataFrame(w, d.schema))) if w else [] for (k, w), d in zip(wanted.items(), back.values(), strict=True)}


def test_changes_of_optional_keys_and_exact_sums(spark):
    c = Catalog(spark)
    c.declare("a", spark.createDataFrame([(None, 1e16), (1, 0.1), (None, 1.0)], "k long, x double"), options=("k",))
    c.declare("b", spark.createDataFrame([(None, "n"), (1, "o")], "k2 long, t string"), options=("k2",))
    change = {"a": spark.createDataFrame([(None, -1e16, 1), (1, 0.1, -1), (2, 5.0, 2), (7, 7.0, 1)], "k long, x double, _w long"), "b": spark.createDataFrame([(None, "m", 1), (2, "p", 1)], "k2 long, t string, _w long")}
    after = c.with_rows({k: z.expand(z.plus(z.weighted(c.read(k)), d)) for k, d in change.items()})
    shapes_ = {"join": scan(c, "a").join(scan(c, "b"), ("k", "k2")), "sums": scan(c, "a").group("k").exact_sum("x", "s"), "total": scan(c, "a").group().exact_sum("x", "s"), "top": scan(c, "a").top(2, "x"), "anti": scan(c, "a").anti_join(scan(c, "b"), "k", "k2")}
    kept = Maintained(shapes_, lambda n: z.weighted(c.read(n))).advance(change)
    for name, q in shapes_.items():
        want = rows(z.recomputed(q.frame(), type(q)(after, q.plan, q.names).frame()))
        assert want and rows(delta(q, c.read, change)) == want == rows(kept[name]), name


def test_maintained_state_over_many_steps(spark, monkeypatch):
    """A head that runs out, foldings, and states that are shared: after each step the sum of all changes is the result."""
    monkeypatch.setattr(arranged, "FOLD", 3)
    c = Catalog(spark)
    c.declare("r", spark.createDataFrame([(i % 5, i) for i in range(60)], "k long, v long"))
    c.declare("s", spark.createDataFrame([(i,) for i in range(4)], "k2 long"))
    both = scan(c, "r").join(scan(c, "s"), ("k", "k2"))
    q = {"top": scan(c, "r").top(2, "v"), "count": both.group("k").count("n"), "rows": both.select("v")}
    kept = Maintained(q, lambda n: z.weighted(c.read(n)))
    total, now = {k: x.frame().collect() for k, x in q.items()}, c.read("r")
    for step in range(5):
        gone = now.orderBy(F.desc("v")).limit(14)
        change = z.plus(z.weighted(gone, -1), z.weighted(spark.createDataFrame([(step, 5 + step)], "k long, v long")))
        now = spark.createDataFrame(z.expand(z.plus(z.weighted(now), change)).collect(), "k long, v long")
        for k, d in kept.advance({"r": change}).items():
            held = spark.createDataFrame(total[k], d.drop(z.W).schema)
            total[k] = z.expand(z.plus(z.weighted(held), d)).collect()
            assert sorted(map(tuple, total[k]), key=repr) == rows(type(q[k])(c.with_rows({"r": now}), q[k].plan, q[k].names).frame()), (step, k)
    assert len([p for p, side in kept.arrangements if side == "left"]) == 1 or len({p for p, _ in kept.arrangements if isinstance(p, n.JoinEq)}) == 1


def test_a_change_reads_only_what_it_touches(spark, tmp_path):
    """The state's rows are picked by the change's keys before anything is grouped."""
    spark.range(1000).selectExpr("id % 100 as k", "id as v", "1L as _w").write.parquet(str(tmp_path / "state"))
    c = Catalog(spark)
    c.declare("r", spark.createDataFrame([], "k long, v long"))
    q = scan(c, "r").group("k").count("n")
    d = delta(q, None, {"r": spark.createDataFrame([(3, 5, 1)], "k long, v long, _w long")}, lambda _: spark.read.parquet(str(tmp_path / "state")))
    plan = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan):
        if "Relation" in line and "parquet" in line:
            above = [x for j, x in enumerate(plan[:i]) if at(x) < at(line) and not any(at(y) <= at(x) for y in plan[j + 1 : i])]
            nearest = next(x for x in reversed(above) if "Aggregate" in x or "LeftSemi" in x)
            assert "LeftSemi" in nearest
    assert rows(d) == [(3, 10, -1), (3, 11, 1)]


def test_zset_algebra(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1), ("x", -2)], "r string, _w long")
    assert rows(z.compact(a)) == [("y", 1)]
    assert rows(z.plus(a, z.negate(a))) == []
    assert rows(z.scale(z.compact(a), 3)) == [("y", 3)]
    come, gone = z.split(spark.createDataFrame([("x", 2), ("y", -1)], "r string, _w long"))
    assert rows(come) == [("x",), ("x",)] and rows(gone) == [("y",)]
    with pytest.raises(Exception, match="NEGATIVE"):
        z.expand(spark.createDataFrame([("x", -1)], "r string, _w long")).collect()
    assert rows(z.observation(come)) == rows(z.observation(come.orderBy("r")))


def test_history_and_watches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    df = lambda *r: spark.createDataFrame(list(r), "t string, i long")
    store.create("r", df(("a", 1), ("b", 2)))
    c = Catalog(spark)
    c.declare("r", store.at("r"))
    grouped = scan(c, "r").group("t").count("n")
    w = Watch(store, grouped)
    forest = Forest(store, one=grouped, two=grouped)
    assert store.commit("t1", {"r": added(df(("a", 5)))}).revision.number == 1
    assert store.commit("t1", {"r": added(df(("a", 5)))}).already
    store.commit("t2", {"r": z.plus(removed(df(("b", 2))), added(df(("c", 3))))})
    store.commit("t3", {"r": z.plus(removed(df(("c", 3))), added(df(("c", 4))))})
    assert rows(store.at("r", 0)) == [("a", 1), ("b", 2)]
    assert rows(store.at("r", 1)) == [("a", 1), ("a", 5), ("b", 2)]
    events = w.drain()
    assert [(e.revision, rows(e.inserted), rows(e.removed)) for e in events] == [(1, [("a", 2)], [("a", 1)]), (2, [("c", 1)], [("b", 1)])]
    assert w.status() == "current" and w.try_recv() is None
    assert len(forest.shared) == 1 and [len(x) for x in forest.advance().values()] == [2, 2]
    back = w.rewind()
    assert rows(back.inserted) == [] and w.revision == 2
    with pytest.raises(er.Conflict):
        store.commit("t4", {"r": removed(df(("zz", 1)))})
    with pytest.raises(er.Conflict):
        store.commit("t5", {"r": removed(df(("c", 4)))}, seen=2)
    assert store.undo_latest().revision.undoes == 3
    assert rows(store.at("r")) == [("a", 1), ("a", 5), ("c", 3)]
    with pytest.raises(er.NonReversible):
        store.undo(99)
    assert rows(store.candidate("r", added(df(("q", 9)))))[-1] == ("q", 9)
    store.pin("keep", 2)
    assert store.compacted("r") == 2 and rows(store.at("r")) == [("a", 1), ("a", 5), ("c", 3)]
    with pytest.raises(er.NonReversible):
        store.at("r", 1)
    store.release("keep")
    assert store.pins() == {} and store.copy_to(str(tmp_path / "copy")).same_as(store)
    assert [e.by_key("t").collect() for e in events][0][0].asDict(recursive=True) == {"t": "a", "before": {"n": 1}, "after": {"n": 2}}


def test_commits_are_rebased_by_their_effects(spark, tmp_path):
    store, a = Store(spark, str(tmp_path / "db")), fp.Action
    df = lambda *r: spark.createDataFrame(list(r), "t string, i long")
    store.create("r", df(("a", 1)))
    plus_one = lambda c: fp.Effects(frozenset(), {("r", c): a("add", "+")})
    store.commit("t1", {"r": added(df(("a", 1)))}, effects=plus_one("a"))
    assert store.commit("t2", {"r": added(df(("a", 1)))}, seen=0, effects=plus_one("a")).revision.number == 2  # the same rows, but additions commute
    with pytest.raises(er.Conflict):
        store.commit("t3", {"r": added(df(("a", 1)))}, seen=0)
    store.commit("t4", {"r": added(df(("z", 1)))}, effects=fp.Effects(frozenset(), {("r", "z"): a("assign", 1)}))
    with pytest.raises(er.Conflict):
        store.commit("t5", {"r": added(df(("y", 1)))}, seen=2, effects=fp.Effects(frozenset(), {("r", "z"): a("assign", 2)}))
    e = fp.Effects(frozenset({"x", ("r", 1)}), {("r", "z"): a("assign", 2)}, frozenset({"rule"}))
    assert fp.from_shown(fp.shown(e)) == e


def test_indexes(spark):
    r = Relation("r", (("t", ty.TEXT), ("i", ty.I64)), "bag", (Eq("text_ci"), Eq("i64")))
    df = spark.createDataFrame([("a", 1), ("A", 2), ("b", 3), ("b", 3)], "t string, i long")
    index, keys = Index(r, ("t",), df), spark.createDataFrame([("A",)], "t string")
    assert rows(index.lookup(keys)) == [("A", 2), ("a", 1)] and index.folders(keys) == 1 and index.pays(keys)
    index.change(z.plus(removed(df.where("i = 3").limit(1)), added(spark.createDataFrame([("B", 4)], "t string, i long")), removed(df.where("i = 2"))))
    assert rows(index.lookup(spark.createDataFrame([("B",), ("a",), ("zz",)], "t string"))) == [("B", 4), ("a", 1), ("b", 3)]
    assert rows(index.join(spark.createDataFrame([("x", "B"), ("y", "q")], "k string, u string"), ("u",))) == [("x", "B", "B", 4), ("x", "B", "b", 3)]
    assert rows(Index(r, ("t",), df, (Eq("text"),)).lookup(keys)) == [("A", 2)]


def test_a_commit_wakes_a_waiting_watch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    df = lambda *r: spark.createDataFrame(list(r), "t string, i long")
    store.create("r", df(("a", 1)))
    c = Catalog(spark)
    c.declare("r", store.at("r"))
    w = Watch(store, scan(c, "r").group("t").count("n"))
    writer = threading.Thread(target=lambda: (time.sleep(1), Store(spark, str(tmp_path / "db")).commit("t1", {"r": added(df(("a", 2), ("b", 3)))})))
    began = time.monotonic()
    writer.start()
    event = w.recv(timeout=100, every=90)
    writer.join()
    assert event and rows(event.inserted) == [("a", 2), ("b", 1)] and time.monotonic() - began < 80
    store.commit("t2", {"r": z.plus(removed(df(("a", 2))), added(df(("a", 9))))})
    assert store.prerequisites(2) == [1] and store.prerequisites(1) == []


def test_writers_race_for_a_revision(spark, tmp_path):
    """Another writer takes the revision after this one has looked: it looks again."""
    root = str(tmp_path / "db")
    ours, theirs = Store(spark, root), Store(spark, root)
    df = lambda *r: spark.createDataFrame(list(r), "t string, i long")
    ours.create("r", df(("a", 1)))
    create = ours.files.create

    def late(value, *name):
        if name[0] == "commits" and theirs.head() == 0:
            theirs.commit("theirs", {"r": removed(df(("a", 1)))})
        return create(value, *name)

    ours.files.create = late
    with pytest.raises(er.Conflict):
        ours.commit("ours", {"r": removed(df(("a", 1)))})
    assert ours.commit("more", {"r": added(df(("b", 1)))}).revision.number == 2
    assert rows(ours.at("r")) == [("b", 1)] and [r.txn for r in ours.history()] == ["theirs", "more"]
    left = ours.recover()
    assert len(left) == 1 and left[0].startswith("log/r/") and rows(ours.at("r")) == [("b", 1)]
    with pytest.raises(er.Conflict):
        theirs.create("r", df())


@pytest.mark.parametrize("when", ["before the switch", "after it"])
def test_interrupted_folding_loses_nothing(spark, tmp_path, when):
    store = Store(spark, str(tmp_path / "db"))
    df = lambda *r: spark.createDataFrame(list(r), "t string, i long")
    store.create("r", df(("a", 1)))
    store.commit("t1", {"r": added(df(("a", 1), ("b", 2)))})
    create = store.files.create

    def stops(value, *name):
        if when == "after it":
            create(value, *name)
        raise KeyboardInterrupt

    store.files.create = stops
    with pytest.raises(KeyboardInterrupt):
        store.compacted("r")
    again = Store(spark, str(tmp_path / "db"))
    assert rows(again.at("r")) == [("a", 1), ("a", 1), ("b", 2)]
    again.recover()
    assert again.compacted("r") == 1 and rows(again.at("r")) == [("a", 1), ("a", 1), ("b", 2)]


def test_rules_and_previews(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    df = lambda *r: spark.createDataFrame(list(r), "t string, i long")
    store.create("r", df(("a", 1), ("b", 2)))
    store.create("other", df())
    store.require("small", ("r",), lambda read: rules.rows(read("r"), "small", "t", F.col("i") < 10))
    with pytest.raises(er.RuleBroken):
        store.require("one", ("r",), lambda read: rules.count_range(read("r"), "one", high=1))
    with pytest.raises(er.RuleBroken):
        store.commit("t1", {"r": added(df(("c", 10)))})
    seen = store.preview({"r": z.plus(added(df(("c", 10))), removed(df(("z", 1))))})
    assert seen.broken() == ["small"] and not seen.ready() and rows(seen.missing("r")) == [("z", 1, -1)]
    assert [rows(x) for x in seen.effects("r")] == [[("c", 10)], [("z", 1)]]
    assert store.preview({"r": added(df(("c", 9)))}).ready() and store.head() == 0
    assert store.commit("t2", {"other": added(df(("x", 99)))}).revision.number == 1
    store.update("t3", "r", F.col("t") == "a", {"i": F.col("i") + 4})
    store.delete("t4", "r", F.col("t") == "b")
    assert rows(store.at("r")) == [("a", 5)] and rows(store.at("r", 1)) == [("a", 1), ("b", 2)]
    with pytest.raises(er.RuleBroken):
        store.update("t5", "r", F.lit(True), {"i": F.lit(50)})


def test_a_stream_folds_its_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "FOLD", 2)
    schema, folder = "t string, i long, _w long", tmp_path / "in"
    base = spark.createDataFrame([("a", 1)], "t string, i long")
    c = Catalog(spark)
    c.declare("r", base)
    q = scan(c, "r").group("t").count("n")
    for k in range(7):
        spark.createDataFrame([("a", k, 1)], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream(q, "r", spark.readStream.schema(schema).parquet(str(folder)), base, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out" / "out")).where("batch = 6").select("t", "n", z.W)) == [("a", 7, -1), ("a", 8, 1)]
    assert sorted(p.name for p in (tmp_path / "out" / "state").iterdir() if not p.name.startswith(".") and p.name != "upto=-1") == ["batch=4", "batch=5", "batch=6", "upto=3", "upto=5"]


def test_stream_of_changes(spark, tmp_path):
    schema = "t string, i long, _w long"
    spark.createDataFrame([("a", 3, 1), ("b", 2, -1)], schema).write.parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("a", 1), ("b", 2)], "t string, i long")
    c = Catalog(spark)
    c.declare("r", base)
    q = scan(c, "r").group("t").count("n")
    s = stream(q, "r", spark.readStream.schema(schema).parquet(str(tmp_path / "in")), base, str(tmp_path / "out"), str(tmp_path / "check"))
    s.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out" / "out")).select("t", "n", z.W)) == [("a", 1, -1), ("a", 2, 1), ("b", 1, -1)]


def test_writable_views(spark):
    c = Catalog(spark)
    c.frame(Relation("r", (("t", ty.TEXT), ("i", ty.I64)), SET), spark.createDataFrame([("a", 1), ("b", 2)], "t string, i long"))
    view = n.FilterEqConst(n.Scan("r"), 0, "a", Eq("text"))
    up = spark.createDataFrame([("a", 7, 1)], "c0 string, c1 long, _w long")
    assert rows(migrate.put_back(c.schema, view, up, c.read)["r"]) == [("a", 7, 1)]
    with pytest.raises(er.ReadOnlyView):
        migrate.put_back(c.schema, view, spark.createDataFrame([("b", 7, 1)], "c0 string, c1 long, _w long"), c.read)
    names = n.Project(n.Scan("r"), (0,))
    gone = spark.createDataFrame([("b", -1), ("z", 1)], "c0 string, _w long")
    assert rows(migrate.put_back(c.schema, names, gone, c.read, {"i": 0})["r"]) == [("b", 2, -1), ("z", 0, 1)]
    with pytest.raises(er.ReadOnlyView):
        migrate.put_back(c.schema, n.Group(n.Scan("r"), (), ()), up, c.read)


def test_views_change_as_asked_or_not_at_all(spark):
    c = Catalog(spark)
    c.frame(Relation("bag", (("t", ty.TEXT), ("i", ty.I64))), spark.createDataFrame([("a", 1), ("a", 2), ("b", 7), ("b", 7)], "t string, i long"))
    c.frame(Relation("l", (("k", ty.I64), ("x", ty.I64)), SET), spark.createDataFrame([(1, 10), (2, 20)], "k long, x long"))
    c.frame(Relation("m", (("k", ty.I64), ("y", ty.I64)), SET), spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "k long, y long"))
    names, put = n.Project(n.Scan("bag"), (0,)), lambda p, df: migrate.put_back(c.schema, p, df, c.read, {"i": 0})
    one = lambda t, w: spark.createDataFrame([(t, w)], "c0 string, _w long")
    with pytest.raises(er.ReadOnlyView):
        put(names, one("a", -1))  # one of two rows that the view can't tell apart
    assert rows(put(names, one("a", -2))["bag"]) == [("a", 1, -1), ("a", 2, -1)]
    assert rows(put(names, one("b", -1))["bag"]) == [("b", 7, -1)]
    with pytest.raises(er.ReadOnlyView):
        put(names, one("zz", -1))
    both, row = n.JoinEq(n.Scan("l"), n.Scan("m"), 0, 0, Eq("i64")), "c0 long, c1 long, c2 long, c3 long, _w long"
    # the left row would take another pair along, the right one doesn't
    assert {k: rows(d) for k, d in put(both, spark.createDataFrame([(1, 10, 1, 7, -1)], row)).items() if rows(d)} == {"m": [(1, 7, -1)]}
    assert {k: rows(d) for k, d in put(both, spark.createDataFrame([(2, 20, 2, 9, -1)], row)).items() if rows(d)} == {"l": [(2, 20, -1)]}
    assert {k: rows(d) for k, d in put(both, spark.createDataFrame([(3, 5, 3, 6, 1)], row)).items()} == {"l": [(3, 5, 1)], "m": [(3, 6, 1)]}
    with pytest.raises(er.ReadOnlyView):
        put(both, spark.createDataFrame([(1, 11, 1, 7, 1)], row))  # (1, 11, 1, 8) would come too


def test_rules(spark):
    df = spark.createDataFrame([(1, "ab", 5.0), (2, "A\n", -1.0), (3, None, 2.0)], "k long, s string, v double")
    p = text.literal_text("A") + text.ANY.many()
    assert [r.witness for r in rules.rows(df, "p", "k", rules.text_matches(F.col("s"), p)).collect()] == ["1", "3"]
    assert [r.mass for r in rules.sum_range(df, "s", "v", high=4.0).collect()] == [2.0]
    assert rules.statistic_range(df.where("k > 9"), "m", "v", "max", high=0.0).count() == 0
    assert rows(rules.exists(df, "e", F.col("v") > 100)) == [("e", "all", 1.0)]
    assert rows(rules.unique(df, "u", F.lit(1))) == [("u", "1", 2.0)]


def test_patterns(spark):
    lit, any_ = text.literal_text, text.ANY
    df = spark.createDataFrame([("",), ("a",), ("a\n",), ("ab",), ("abab",), (".*",)], "s string")
    ok = lambda p: [r.s for r in df.where(text.matches(F.col("s"), p)).collect()]
    assert ok(text.EMPTY) == [""] and ok(text.NEVER) == [] and ok(lit("a")) == ["a"] and ok(lit(".*")) == [".*"]
    assert ok((lit("a") | lit("b") | lit("\n")).many()) == ["", "a", "a\n", "ab", "abab"] and ok((lit("ab") | text.NEVER).many() + text.EMPTY) == ["", "ab", "abab"] and ok(any_.many() + lit("b") + any_.many()) == ["ab", "abab"]
    long = spark.createDataFrame([("ab" * 500_000,), ("ab" * 500_000 + "x",), ("abc" * 333_333,), (None,)], "s string")
    either = (lit("ab") | lit("c")).many()
    assert [r[0] for r in long.select(text.matches(F.col("s"), either)).collect()] == [True, False, True, None]
    assert [r[0] for r in long.select(text.matches(F.col("s"), any_.many() + lit("x"))).collect()] == [False, True, False, None]
    assert ok(lit("ab").many()) == ["", "ab", "abab"] and ok(lit("a") + any_) == ["a\n", "ab"] and ok(lit("a") | lit("ab")) == ["a", "ab"]


def test_recursion(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 10)], "src long, dst long")
    s = spark.createDataFrame([(1,)], "node long")
    found = fixpoint.reachability(s, e)
    assert rows(found) == [(1, 0, None), (2, 1, 1), (3, 2, 2), (4, 3, 3)]
    assert fixpoint.certificate_faults(found, s, e).count() == 0
    assert fixpoint.certificate_faults(found.where("node <> 3"), s, e).count() > 0
    r = fixpoint.BagRule
    inf = fixpoint.INFINITE
    assert fixpoint.bag_fixpoint("abc", {"a": 1}, [r("b", ("a",)), r("a", ("b",)), r("c", ("b",))]) == {"a": inf, "b": inf, "c": inf}
    assert fixpoint.bag_fixpoint("ab", {}, [r("b", ("a",)), r("a", ("b",))]) == {"a": 0, "b": 0}
    assert fixpoint.bag_fixpoint("ab", {"a": 3}, [r("b", ("a", "a"), 2)]) == {"a": 3, "b": 18}
    with pytest.raises(er.NonFiniteMultiplicity):
        fixpoint.require_finite({"a": inf})
    with pytest.raises(er.AtomOutsideCarrier):
        fixpoint.bag_fixpoint("a", {"z": 1}, [])
    facts, rule = spark.createDataFrame([("a",)], "atom string"), spark.createDataFrame([(1, "b", ["a"]), (2, "c", ["a", "b"]), (3, "d", ["x"])], "rule long, head string, body array<string>")
    assert rows(fixpoint.horn_closure(facts, rule)) == [("a",), ("b",), ("c",)]
    assert rows(fixpoint.horn_after(facts, rule, spark.createDataFrame([("x",)], "atom string"), facts)) == [("d",), ("x",)]
    atoms, by = spark.createDataFrame([("a",), ("b",), ("c",)], "atom string"), spark.createDataFrame([("b", "a"), ("c", "c")], "atom string, by string")
    assert rows(fixpoint.supported(atoms, by, facts)) == [("a",), ("b",), ("c",)]
    assert rows(fixpoint.supported(atoms, by, facts.where("false"))) == [("c",)]
    assert fixpoint.common_ancestors({3: (1, 2), 4: (2,), 2: (0,), 1: (0,)}, 3, 4) == [2]
    assert fixpoint.merge_live({1, 2}, {1, 3}, {1, 2, 4}) == {1, 3, 4}


def test_scalars(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "s array<long>")
    row = ty.Product((("s", ty.Seq(ty.I64)),))
    assert df.select(sc.SumI64(sc.field("s")).column(row)).first()[0] == 6
    assert df.select(sc.splice(F.col("s"), 1, 1, F.lit([9, 9]))).first()[0] == [1, 9, 9, 3]
    assert df.select(sc.splice_sum(F.lit(6), F.col("s"), 1, 1, F.lit([9, 9]))).first()[0] == 22
    with pytest.raises(Exception, match="OVERFLOW"):
        df.select(sc.Add(sc.Const(2**63 - 1, ty.I64), sc.Const(1, ty.I64)).column(row)).collect()
    with pytest.raises(er.TypeMismatch):
        sc.ToF64(sc.field("s")).type(row)


def test_dependencies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "x long, y string")
    assert tuple(dependencies.determines(df, {"x": F.col("x")}, {"y": F.col("y")}).first()) == (False, 2, 1)
    assert dependencies.closure("a", [(frozenset("a"), frozenset("b")), (frozenset("ab"), frozenset("c"))]) == frozenset("abc")


def test_pair_law():
    e = lambda *w, reads=(), need=(): fp.Effects(frozenset(reads), dict(w), frozenset(need))
    a = fp.Action
    assert fp.pair(e(("x", a("assign", 1))), e(("y", a("assign", 1)))) == fp.COMMUTE
    assert fp.pair(e(("x", a("assign", 1))), e(("x", a("assign", 1)))) == fp.IDEMPOTENT
    assert fp.pair(e(("x", a("assign", 1))), e(("x", a("assign", 2)))) == fp.CONFLICT
    assert fp.pair(e(("x", a("present"))), e(("x", a("absent")))) == fp.CONFLICT
    assert fp.pair(e(("x", a("add", "+"))), e(("x", a("add", "+")))) == fp.COMMUTE
    assert fp.pair(e(("x", a("add", "+"))), e(("x", a("assign", 1)))) == fp.UNKNOWN
    assert fp.pair(e(("x", a("present"))), e(reads=["x"])) == fp.UNKNOWN
    assert fp.pair(e(need=["rule"]), e()) == fp.UNKNOWN
    assert fp.Change("replace", 1).then(fp.Change("fine", lambda x: x + 1)).apply(0) == 2


def test_edges_and_orphans(spark):
    e = spark.createDataFrame([(1, 10), (2, 20)], "s long, t long")
    d = moved(e, "s", "t", spark.createDataFrame([(10, 2)], "t long, s long"))
    assert rows(d) == [(1, 10, -1), (2, 10, 1)]
    kids = spark.createDataFrame([(10,), (20,), (30,)], "k long")
    assert rows(orphans(kids, "k", e, "t")) == [(30,)]


def test_access():
    p = access.Permission
    roles = {"a": access.Role("a", frozenset({p("read", "r", 0)}), ("b",)), "b": access.Role("b", frozenset({p("read", "s")}))}
    have = access.flattened(roles, "a")
    access.authorize(n.Footprint((("r", frozenset({0})), ("s", frozenset({0, 3})))), have)
    with pytest.raises(er.AccessDenied):
        access.authorize(n.Footprint((("r", frozenset({1})),)), have)
    with pytest.raises(er.AccessDenied):
        access.flattened(roles | {"b": access.Role("b", includes=("a",))}, "a")
    assert access.no_new_flows({"a": frozenset()}, {"a": frozenset({p("read", "new")})}, {("new", 0): frozenset({("r", 1)})}) == ["a: new.0 from r.1"]
