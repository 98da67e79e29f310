"""Watches: a query's result and, for each later revision, exactly which rows come and go.

Over a ``Store`` a watch reads each revision's changes from the log. A plan of filters, projections and joins is advanced by its delta rules from the
change alone (and, for joins, the matching rows of the other side); other operators look at the keys that the change touches. Where no rule applies the
result is recomputed and compared. Over a stream of change files the same step runs in ``foreachBatch``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types as ty
from tessera.api.query import Query
from tessera.plans import nodes as n
from tessera.plans.lower import Lowering, compare, distinct
from tessera.plans.lower import literal as lit
from tessera.plans.lower import _equal
from tessera.functions.equality import order_key
from tessera.schema import SET, Schema
from tessera.sources.changelog import Store
from tessera.sources.store import delete, stored
from tessera.streaming import zset as z


@dataclass(frozen=True)
class Event:
    revision: int
    inserted: DataFrame
    removed: DataFrame

    def by_key(self, *keys: str) -> DataFrame:
        """(keys..., before, after): for a result with one row for each key, as of groups or objects, the key's old and new row as structs, null for none."""
        row = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
        return row(self.removed, "before").join(row(self.inserted, "after"), list(keys), "full_outer")


@dataclass
class Delta:
    """Derives how a plan's result changes. ``changed`` has weighted rows that come and go, by relation.

    ``weighted`` gives a relation's rows before the change as weighted rows, a row maybe in parts, ``before`` as plain rows; one of them is enough. Filters,
    projections of bags and joins take weighted rows as they are, so a semi-join on touched keys reaches the state's files and nothing groups all of it.
    """

    schema: Schema
    before: Callable[[str], DataFrame] | None
    changed: dict[str, DataFrame]
    weighted: Callable[[str], DataFrame] | None = None
    _old: dict[n.Plan, DataFrame] = field(default_factory=dict)
    _new: dict[n.Plan, DataFrame] = field(default_factory=dict)

    def untouched(self, p: n.Plan) -> bool:
        return not any(isinstance(x, n.Scan) and x.relation in self.changed for x in p.walk())

    def rows(self, name: str) -> DataFrame:
        return self.before(name) if self.before else z.expand(z.compact(self.weighted(name)))  # type: ignore[misc]

    def _columns(self, name: str, df: DataFrame) -> DataFrame:
        r = self.schema.relation(name)
        return df.select(*[F.col(f"`{c}`").cast(k.spark()).alias(f"c{i}") for i, (c, k) in enumerate(r.columns)], z.W)

    def old(self, p: n.Plan) -> DataFrame:
        """The plan's rows before the change, weighted; a row's weight may come in parts."""
        if p not in self._old:
            self._old[p] = self._state(p)
        return self._old[p]

    def _state(self, p: n.Plan) -> DataFrame:
        t = p.type(self.schema)
        match p:
            case n.Scan(name):
                return self._columns(name, self.weighted(name) if self.weighted else z.weighted(self.before(name)))  # type: ignore[misc]
            case n.FilterEqConst(i, c, v, eq):
                return self.old(i).where(_equal(F.col(f"c{c}"), lit(v, t.columns[c]), eq, t.columns[c]))
            case n.FilterOrderConst(i, c, v, order, comparison):
                return self.old(i).where(compare(F.col(f"c{c}"), v, order, comparison, t.columns[c]))
            case n.FilterEqColumns(i, a, b, eq):
                return self.old(i).where(_equal(F.col(f"c{a}"), F.col(f"c{b}"), eq, t.columns[a]))
            case n.PromoteToBag(i):
                return self.old(i)
            case n.Project(i, columns) if t.kind != SET:
                return self.old(i).select(*[F.col(f"c{c}").alias(f"c{k}") for k, c in enumerate(columns)], z.W)
            case n.Union(a, b) if t.kind != SET:
                return self.old(a).unionByName(self.old(b))
            case n.JoinEq(a, b, ca, cb, eq) if eq.plain():
                left, right, names = self._sides(p, self.old(a), self.old(b))
                return z.matched(left, right, ["_k"], isinstance(a.type(self.schema).columns[ca], ty.Option)).select(*names, z.W)
            case n.Distinct(i) if self._exact(t):
                return z.weighted(z.compact(self.old(i)).drop(z.W))
        return z.weighted(Lowering(self.schema, self.rows).run(p))

    def _sides(self, p: n.JoinEq, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        k = len(p.left.type(self.schema).columns)
        right = b.toDF(*[f"c{k + j}" for j in range(len(b.columns) - 1)], z.W).withColumn("_k", F.col(f"c{k + p.right_column}"))
        return a.withColumn("_k", F.col(f"c{p.left_column}")), right, [f"c{j}" for j in range(len(p.type(self.schema).columns))]

    def fixed(self, d: DataFrame) -> DataFrame:
        """A change that is used more than once."""
        return d

    def input(self, p: n.Plan) -> DataFrame:
        """The change of an operator's input that is used more than once."""
        return self.of(p)

    def held(self, slot: tuple, rows: Callable[[], DataFrame], own: DataFrame | None, asked: DataFrame, by: list[str], needed: bool = True) -> DataFrame:
        """What an operator has to know of its input before the change: ``rows``, of which it looks only at those whose columns ``by`` occur in ``asked``, if any are ``needed``.
        ``slot`` names the operator's input and ``own`` is that input's change, None without one. Here they are derived from the relations."""
        return rows() if needed else rows().where(F.lit(False))

    def nothing(self, p: n.Plan) -> DataFrame:
        return self.old(p).where(F.lit(False))

    def of(self, p: n.Plan) -> DataFrame:
        """Weighted rows by which the plan's result changes; derived once for equal plans."""
        if p not in self._new:
            self._new[p] = self._change(p)
        return self._new[p]

    def _change(self, p: n.Plan) -> DataFrame:
        if self.untouched(p):
            return self.nothing(p)
        t = p.type(self.schema)
        match p:
            case n.Scan(name):
                return z.compact(self._columns(name, self.changed[name]))
            case n.FilterEqConst(i, c, v, eq):
                return self.of(i).where(_equal(F.col(f"c{c}"), lit(v, t.columns[c]), eq, t.columns[c]))
            case n.FilterOrderConst(i, c, v, order, comparison):
                return self.of(i).where(compare(F.col(f"c{c}"), v, order, comparison, t.columns[c]))
            case n.FilterEqColumns(i, a, b, eq):
                return self.of(i).where(_equal(F.col(f"c{a}"), F.col(f"c{b}"), eq, t.columns[a]))
            case n.PromoteToBag(i):
                return self.of(i)
            case n.Project(i, columns):
                picked = [F.col(f"c{c}").alias(f"c{k}") for k, c in enumerate(columns)]
                d = z.compact(self.of(i).select(*picked, z.W))
                if t.kind != SET:
                    return d
                return self._distinct(p, lambda: self.old(i).select(*picked, z.W), d) if self._exact(t) else self._recomputed(p)
            case n.Union(a, b):
                d = z.plus(self.of(a), self.of(b))
                if t.kind != SET:
                    return d
                return self._distinct(p, lambda: self.old(a).unionByName(self.old(b)), d) if self._exact(t) else self._recomputed(p)
            case n.Distinct(i) if self._exact(t):
                return self._distinct(p, lambda: self.old(i), self.of(i))
            case n.JoinEq(a, b, ca, cb, eq) if eq.plain():
                da, db, names = self._sides(p, self.input(a), self.input(b))
                still, fixed = self.untouched(a), self.untouched(b)
                left = self.held((p, "left"), lambda: self._sides(p, self.old(a), self.nothing(b))[0], None if still else da, db, ["_k"], not fixed)
                right = self.held((p, "right"), lambda: self._sides(p, self.nothing(a), self.old(b))[1], None if fixed else db, da, ["_k"], not still)
                return z.joined(left, right, da, db, ["_k"], isinstance(a.type(self.schema).columns[ca], ty.Option)).select(*names, z.W)
            case n.Group(i, columns, eqs, value) if all(e.plain() for e in eqs):
                by = [f"c{c}" for c in columns]
                keys = list(dict.fromkeys(by))
                picked = [*map(F.col, keys), *([F.col(f"c{value}").alias("_x")] if value is not None else []), F.col(z.W)]
                own = self.fixed(z.compact(self.of(i).select(*picked)))
                state = self.held((p, "input"), lambda: self.old(i).select(*picked), own, own, keys)
                out = z.counted(state, own, keys, "_n") if value is None else z.exact_summed(state, own, keys, "_x", "_n")
                return out.select(*[F.col(c).alias(f"g{j}") for j, c in enumerate(by)], F.col("_n").alias(f"g{len(by)}"), z.W).toDF(*[f"c{j}" for j in range(len(by) + 1)], z.W)
            case n.TopKWithTies(i, c, order, descending, k):
                key = order_key(F.col(f"c{c}"), order, t.columns[c])
                mark = lambda d: d.withColumn("_o", F.struct(key.alias("o")))
                return z.topped(mark(self.old(i)), mark(self.of(i)), "_o", descending, k).drop("_o")
            case n.Difference(a, b) if self._exact(t):
                da, db = self.input(a), self.input(b)
                names = z.rows_of(da)
                asked = da.select(*names).unionByName(db.select(*names))
                left, right = (self.held((p, side), lambda i=i: self.old(i), None if self.untouched(i) else d, asked, names) for side, i, d in (("left", a, da), ("right", b, db)))
                return z.differenced(left, right, da, db, t.kind == SET)
            case n.AntiJoin(a, b, ca, cb, eq) if eq.plain():
                only = lambda d: d.select(F.col(f"c{cb}").alias("_k2"), z.W)
                whole = lambda d: d.withColumn("_k2", F.col(f"c{ca}"))
                da, db = whole(self.input(a)), only(self.input(b))
                asked = da.select("_k2").unionByName(db.select("_k2"))
                left = self.held((p, "left"), lambda: whole(self.old(a)), None if self.untouched(a) else da, asked, ["_k2"])
                right = self.held((p, "right"), lambda: only(self.old(b)), None if self.untouched(b) else db, asked, ["_k2"])
                return z.anti_joined(left, right, da, db, "_k2").drop("_k2")
        return self._recomputed(p)

    def _distinct(self, p: n.Plan, rows: Callable[[], DataFrame], d: DataFrame) -> DataFrame:
        d = self.fixed(d)
        return z.distincted(self.held((p, "rows"), rows, d, d, z.rows_of(d)), d)

    @staticmethod
    def _exact(t) -> bool:
        return all(e.plain() for e in t.eqs)

    def _recomputed(self, p: n.Plan) -> DataFrame:
        before, after = (Lowering(self.schema, source).run(p) for source in (self.rows, self._after))
        return z.recomputed(before, after)

    def _after(self, name: str) -> DataFrame:
        b = self.rows(name)
        return z.expand(z.plus(z.weighted(b), self.changed[name].select(*b.columns, z.W))) if name in self.changed else b


def delta(query: Query, before: Callable[[str], DataFrame] | None, changed: dict[str, DataFrame], weighted: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Weighted rows, under the query's column names, by which its result changes."""
    query.type
    return Delta(query.catalog.schema, before, changed, weighted).of(query.plan).toDF(*query.names, z.W)


class Watch:
    """Follows a query over a store from one revision on."""

    def __init__(self, store: Store, query: Query, since: int | None = None) -> None:
        self.store, self.query = store, query
        self.revision = store.head() if since is None else since
        self.closed = False
        self.relations = sorted({p.relation for p in query.plan.walk() if isinstance(p, n.Scan)})

    def initial(self) -> DataFrame:
        return self._at(self.revision)

    def _at(self, revision: int) -> DataFrame:
        return Lowering(self.query.catalog.schema, lambda name: self.store.at(name, revision)).run(self.query.plan).toDF(*self.query.names)

    def _step(self) -> Event | None:
        before, now = self.revision, self.revision + 1
        changed = {name: c for name in self.relations if (c := self.store.changes(name, before, now)) is not None}
        self.revision = now
        if not changed:
            return None
        d = stored(delta(self.query, None, changed, lambda name: self.store.weighted_at(name, before, compacted=False)), "change")
        come, gone = z.split(d)
        return None if come.isEmpty() and gone.isEmpty() else Event(now, come, gone)

    def try_recv(self) -> Event | None:
        """The next revision that changes the result, among those committed; None without one."""
        while not self.closed and self.revision < self.store.head():
            e = self._step()
            if e:
                return e
        return None

    def recv(self, timeout: float = 60, every: float = 2) -> Event | None:
        """The next event. Commits of this process wake it; those of others are looked for ``every`` so many seconds."""
        end = time.monotonic() + timeout
        while not self.closed:
            with self.store.committed:
                if self.revision >= self.store.head():
                    self.store.committed.wait(max(0, min(every, end - time.monotonic())))
            e = self.try_recv()
            if e or time.monotonic() >= end:
                return e
        return None

    def drain(self, most: int | None = None) -> list[Event]:
        out = []
        while (most is None or len(out) < most) and (e := self.try_recv()):
            out.append(e)
        return out

    def __iter__(self) -> Iterator[Event]:
        while e := self.try_recv():
            yield e

    def cancel(self) -> None:
        self.closed = True

    def status(self) -> str:
        return "cancelled" if self.closed else "behind" if self.revision < self.store.head() else "current"

    def rewind(self) -> Event:
        """Back by one revision: what came goes, what went comes."""
        now, before = self.revision, self.revision - 1
        d = z.recomputed(self._at(now), self._at(before))
        self.revision = before
        return Event(before, *z.split(d))

    def migrated(self, names: dict[str, str], query: Query) -> Watch:
        """The same watch after relations were renamed; any other change of the query is refused."""
        if n.retarget(self.query.plan, names) != query.plan:
            raise ValueError("only renamed relations carry a watch over")
        return Watch(self.store, query, self.revision)


class Forest:
    """Several watches of one store advanced together: equal parts of their plans are derived once for each revision and share their state, see ``Maintained``."""

    def __init__(self, store: Store, **queries: Query) -> None:
        from tessera.streaming.maintained import Maintained

        self.store, self.queries, self.revision = store, queries, store.head()
        start = self.revision
        self.state = Maintained(queries, lambda name: store.weighted_at(name, start, compacted=False))
        self.relations = sorted({p.relation for q in queries.values() for p in q.plan.walk() if isinstance(p, n.Scan)})
        self.shared = {q.plan for q in queries.values()}

    def advance(self) -> dict[str, list[Event]]:
        """Each query's events up to the newest revision."""
        out: dict[str, list[Event]] = {name: [] for name in self.queries}
        while self.revision < self.store.head():
            now = self.revision + 1
            changed = {name: c for name in self.relations if (c := self.store.changes(name, now - 1, now)) is not None}
            if changed:
                for name, d in self.state.advance(changed).items():
                    come, gone = z.split(d)
                    if not d.isEmpty():
                        out[name].append(Event(now, come, gone))
            self.revision = now
        return out


#: Batches after which a stream's state is folded into one table.
FOLD = 64


def stream(query: Query, relation: str, changes: DataFrame, base: DataFrame, folder: str, checkpoint: str):
    """A started streaming query over a stream of weighted rows of ``relation``; each batch's result change is written to ``folder/batch=N``.

    The relation's state is its base and a table for each batch, folded into one every ``FOLD`` batches; what a folding has made needless goes with the next one. A
    batch that is run again overwrites its own tables, so results are exactly once.
    """
    spark = base.sparkSession
    schema = T.StructType([*base.schema.fields, T.StructField(z.W, T.LongType())])
    z.weighted(base).write.mode("overwrite").parquet(f"{folder}/state/upto=-1")

    def step(batch: DataFrame, number: int) -> None:
        floor = number // FOLD * FOLD - 1
        parts = [f"{folder}/state/upto={floor}", *(f"{folder}/state/batch={k}" for k in range(floor + 1, number))]
        before = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*parts)
        d = delta(query, None, {relation: batch}, lambda name: before if name == relation else z.weighted(query.catalog.read(name)))
        d.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        batch.select(*before.columns).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        if number % FOLD == FOLD - 1:
            z.plus(before, batch.select(*before.columns)).write.mode("overwrite").parquet(f"{folder}/state/upto={number}")
            for old in [f"upto={floor - FOLD}", *(f"batch={k}" for k in range(floor - FOLD + 1, floor + 1) if k >= 0)] if floor > 0 else []:
                delete(spark, f"{folder}/state/{old}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["Delta", "Event", "Forest", "Watch", "delta", "distinct", "stream"]
