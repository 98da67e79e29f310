"""Revisioned relations: a base and an append-only log of weighted changes in Parquet, one transaction for each revision.

    base/NAME/FOLDER    a relation's rows up to some revision, weighted
    marks/NAME/NUMBER   which of its base folders holds, and up to what revision; the highest number counts
    log/NAME/FOLDER     one transaction's changes of a relation
    commits/NUMBER      a revision: its transaction's id and folder

Whatever a reader follows is switched by the creation of one small file that must not be there before, so a stop at any point leaves the old state or the
new one; folders that no file names are left over and go by ``recover``. Creating a file only where there is none is atomic on local file systems (a hard link) and
on HDFS (a rename without overwriting); a store without such an operation is not fit for the commits of several writers.

A reader opens the log folders after its base only, by the names in the commits; commits never change, so each is read once. The same transaction id again changes nothing.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import Conflict, NonReversible, RuleBroken, UnknownRelation
from tessera.sources.footprints import COMMUTE, CONFLICT, IDEMPOTENT, Effects, from_shown, rebase, shown
from tessera.streaming.zset import W, compact, expand, negate, plus, rows_of, split, touched, weighted


class Files:
    """Small files and folders by Hadoop's file systems, on whatever store the path is in."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = lambda *p: self.jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *p]))
        self.fs = self.path().getFileSystem(self.conf)

    def names(self, *folder: str) -> list[str]:
        p = self.path(*folder)
        return sorted(n for s in self.fs.listStatus(p) if not (n := s.getPath().getName()).startswith(".")) if self.fs.exists(p) else []

    def read(self, *name: str) -> dict | None:
        p = self.path(*name)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def create(self, value: dict, *name: str) -> bool:
        """Write a new file, whole or not at all; False if it is there already."""
        temp, final = self.path(*name[:-1], f".{uuid.uuid4().hex}"), self.path(*name)
        stream = self.fs.create(temp)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        try:
            if self.fs.getScheme() == "file":
                there = [self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, temp)]
                self.jvm.java.nio.file.Files.createLink(*there)
            else:
                none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf).rename(temp, final, options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.fs.delete(temp, False)

    def delete(self, *name: str) -> None:
        self.fs.delete(self.path(*name), True)


@dataclass(frozen=True)
class Revision:
    number: int
    txn: str
    undoes: int | None = None


@dataclass(frozen=True)
class Committed:
    revision: Revision
    already: bool = False


#: By a store's folder: who waits in this process for its next commit.
_WAITING: dict[str, threading.Condition] = {}


#: A rule: from a reader of relations to the rows (rule, witness, mass) that break it.
Rule = Callable[[Callable[[str], DataFrame]], DataFrame]


@dataclass(frozen=True)
class Candidate:
    """What a change would make of the newest revision, before it is committed."""

    store: Store
    changes: dict[str, DataFrame]

    def weighted(self, name: str) -> DataFrame:
        now = self.store.weighted_at(name)
        return plus(now, self.changes[name]) if name in self.changes else now

    def rows(self, name: str) -> DataFrame:
        return expand(self.weighted(name))

    def effects(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(rows that come, rows that go)."""
        return split(self.changes[name])

    def missing(self, name: str) -> DataFrame:
        """Rows that the change removes though they are not there; only rows like those that go are looked at."""
        gone = self.changes[name].where(F.col(W) < 0)
        there = touched(self.store.weighted_at(name, compacted=False), gone, rows_of(gone))
        return plus(there, gone).where(F.col(W) < 0)

    def broken(self) -> list[str]:
        """Names of the rules that would not hold."""
        return [r for r, (relations, rule) in self.store.rules.items() if relations & self.changes.keys() and not rule(self.rows).isEmpty()]

    def ready(self) -> bool:
        return all(self.missing(name).isEmpty() for name in self.changes) and not self.broken()


class Store:
    """Relations by name under one folder, their history, what holds old revisions, and rules that every commit has to keep."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.rules: dict[str, tuple[frozenset[str], Rule]] = {}
        self._commits: dict[str, dict] = {}
        self.committed = _WAITING.setdefault(self.root, threading.Condition())

    # history

    def _commit(self, number: str) -> dict:
        if number not in self._commits:
            self._commits[number] = self.files.read("commits", number)
        return self._commits[number]

    def history(self) -> list[Revision]:
        found = ((name, self._commit(name)) for name in self.files.names("commits"))
        return [Revision(int(name), c["txn"], c.get("undoes")) for name, c in found]

    def head(self) -> int:
        names = self.files.names("commits")
        return int(names[-1]) if names else 0

    def relations(self) -> list[str]:
        return self.files.names("marks")

    def _mark(self, name: str) -> dict:
        names = self.files.names("marks", name)
        if not names:
            raise UnknownRelation(name)
        return self.files.read("marks", name, names[-1]) | {"number": int(names[-1])}

    def _hold(self, name: str, rows: DataFrame, revision: int, number: int) -> bool:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/base/{name}/{folder}")
        return self.files.create({"revision": revision, "folder": folder}, "marks", name, f"{number:012d}")

    def create(self, name: str, rows: DataFrame) -> None:
        if name in self.relations() or not self._hold(name, weighted(rows), -1, 0):
            raise Conflict(f"{name} is there already")

    def changes(self, name: str, after: int = -1, upto: int | None = None) -> DataFrame | None:
        """Log rows of committed revisions in (after, upto]; None without any."""
        upto = self.head() if upto is None else upto
        found = [self._commit(c) for c in self.files.names("commits") if after < int(c) <= upto]
        paths = [f"{self.root}/log/{name}/{c['folder']}" for c in found if name in c["relations"]]
        return self.spark.read.schema(self._base(name).schema).parquet(*paths) if paths else None

    def _base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/base/{name}/{self._mark(name)['folder']}")

    def weighted_at(self, name: str, revision: int | None = None, compacted: bool = True) -> DataFrame:
        """Weighted rows as of a revision. Not ``compacted``, they are as the files have them, a row maybe in parts, and filters reach the files."""
        floor = self._mark(name)["revision"]
        if revision is not None and revision < floor:
            raise NonReversible(f"revision {revision} of {name} has been folded into {floor}")
        base, log = self._base(name), self.changes(name, floor, revision)
        out = base if log is None else base.unionByName(log)
        return compact(out) if compacted else out

    def at(self, name: str, revision: int | None = None) -> DataFrame:
        """The relation's rows as of a revision, by default the newest."""
        return expand(self.weighted_at(name, revision))

    def candidate(self, name: str, change: DataFrame) -> DataFrame:
        """The rows as they would be after ``change``."""
        return self.preview({name: change}).rows(name)

    def preview(self, changes: dict[str, DataFrame]) -> Candidate:
        return Candidate(self, {n: compact(c) for n, c in changes.items()})

    def require(self, rule: str, relations: tuple[str, ...], broken: Rule) -> None:
        """From now on refuse commits to ``relations`` after which ``broken`` has a row; refused itself if it has one now."""
        if not broken(self.at).isEmpty():
            raise RuleBroken(rule)
        self.rules[rule] = (frozenset(relations), broken)

    # transactions

    def commit(self, txn: str, changes: dict[str, DataFrame], seen: int | None = None, undoes: int | None = None, effects: Effects | None = None) -> Committed:
        """Append ``changes``, weighted rows by relation, as one revision. With ``seen``, refuse if a later revision touched the same rows; where this and all
        later ones state their ``effects``, those that commute go on top of each other whatever their rows, and those that conflict don't.

        What is checked is checked against the revision that the commit follows: if another writer is first, everything is looked at again.
        """
        folder, written = uuid.uuid4().hex, False
        while True:
            head = self.head()
            for r in self.history():
                if r.txn == txn:
                    return Committed(r, already=True)
            if seen is not None and seen < head and not self._commutes(effects, seen, head):
                for name, z in changes.items():
                    other = self.changes(name, seen, head)
                    rows = [c for c in z.columns if c != W]
                    if other is not None and not z.select(*rows).intersect(other.select(*rows)).isEmpty():
                        raise Conflict(f"revisions after {seen} touch the same rows of {name}")
            if not written:
                for name, z in changes.items():
                    compact(z).select(self._base(name).columns).write.parquet(f"{self.root}/log/{name}/{folder}")
                written = True
            held = {name: self.spark.read.schema(self._base(name).schema).parquet(f"{self.root}/log/{name}/{folder}") for name in changes}
            next_ = Candidate(self, held)
            for name in changes:
                if not next_.missing(name).isEmpty():
                    raise Conflict(f"the change removes rows of {name} that are not there")
            if broken := next_.broken():
                raise RuleBroken(", ".join(broken))
            if self.files.create({"txn": txn, "folder": folder, "undoes": undoes, "relations": sorted(changes), "effects": shown(effects) if effects else None}, "commits", f"{head + 1:012d}"):
                with self.committed:
                    self.committed.notify_all()
                return Committed(Revision(head + 1, txn, undoes))

    def _commutes(self, mine: Effects | None, seen: int, head: int) -> bool:
        later = [self._commit(c).get("effects") for c in self.files.names("commits") if seen < int(c) <= head]
        if mine is None or not all(later):
            return False
        law = rebase(mine, [from_shown(x) for x in later])
        if law == CONFLICT:
            raise Conflict(f"the effects of revisions after {seen} conflict with these")
        return law in (COMMUTE, IDEMPOTENT)

    def update(self, txn: str, name: str, where: Column, values: dict[str, Column]) -> Committed:
        """Rows that satisfy ``where`` with new ``values``; a commit in between that touches them is refused."""
        seen = self.head()
        rows = self.at(name, seen).where(where)
        return self.commit(txn, {name: updated(rows, rows.select(*[values[c].cast(rows.schema[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in rows.columns]))}, seen)

    def delete(self, txn: str, name: str, where: Column) -> Committed:
        seen = self.head()
        return self.commit(txn, {name: removed(self.at(name, seen).where(where))}, seen)

    def prerequisites(self, revision: int) -> list[int]:
        """Earlier revisions that brought rows which this one takes away."""
        found: set[int] = set()
        for name in self.relations():
            own = self.changes(name, revision - 1, revision)
            earlier = [c.withColumn("_rev", F.lit(r)) for r in range(self._mark(name)["revision"] + 1, revision) if (c := self.changes(name, r - 1, r)) is not None]
            if own is None or not earlier:
                continue
            log = earlier[0]
            for c in earlier[1:]:
                log = log.unionByName(c)
            gone = own.where(F.col(W) < 0)
            found |= {r[0] for r in touched(log.where(F.col(W) > 0), gone, rows_of(gone)).select("_rev").distinct().collect()}  # revision numbers
        return sorted(found)

    def undo(self, revision: int, txn: str | None = None) -> Committed:
        """A new revision with the inverse of an old one; refused where a row it brought is no longer there."""
        if revision < 1 or revision > self.head():
            raise NonReversible(f"no revision {revision}")
        inverse = {n: negate(c) for n in self.relations() if (c := self.changes(n, revision - 1, revision)) is not None}
        try:
            return self.commit(txn or f"undo-{revision}-{uuid.uuid4().hex}", inverse, undoes=revision)
        except Conflict as e:
            raise NonReversible(str(e)) from e

    def undo_latest(self, txn: str | None = None) -> Committed:
        history = self.history()
        done = {r.undoes for r in history}
        open_ = [r.number for r in history if r.undoes is None and r.number not in done]
        if not open_:
            raise NonReversible("nothing to undo")
        return self.undo(open_[-1], txn)

    # retention

    def pin(self, name: str, revision: int) -> None:
        self.files.create({"revision": revision}, "pins", name)

    def pins(self) -> dict[str, int]:
        return {n: self.files.read("pins", n)["revision"] for n in self.files.names("pins")}

    def release(self, name: str) -> None:
        self.files.delete("pins", name)

    def compacted(self, name: str) -> int:
        """Fold the log into a new base up to the oldest pin, or the head; earlier revisions can't be read then. Readers and writers may go on meanwhile."""
        upto, mark = min([self.head(), *self.pins().values()]), self._mark(name)
        if upto > mark["revision"] and not self._hold(name, self.weighted_at(name, upto), upto, mark["number"] + 1):
            raise Conflict(f"{name} has been folded by another writer")
        return max(upto, mark["revision"])

    def recover(self) -> list[str]:
        """Delete folders that no commit or mark names: what interrupted writers and earlier foldings have left. For a time when nobody else reads or writes."""
        gone = []
        kept = {self._commit(c)["folder"] for c in self.files.names("commits")}
        for name in self.relations():
            gone += [("log", name, f) for f in self.files.names("log", name) if f not in kept]
            gone += [("base", name, f) for f in self.files.names("base", name) if f != self._mark(name)["folder"]]
        gone += [("base", name) for name in self.files.names("base") if name not in self.relations()]
        for path in gone:
            self.files.delete(*path)
        return ["/".join(p) for p in gone]

    def copy_to(self, root: str) -> Store:
        """A backup or fork: the same base, log and commits under another folder."""
        util = self.files.jvm.org.apache.hadoop.fs.FileUtil
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for part in ("base", "log", "commits", "pins", "marks"):
            if self.files.fs.exists(self.files.path(part)):
                other = Files(self.spark, root)
                util.copy(self.files.fs, self.files.path(part), other.fs, other.path(part), False, conf)
        return Store(self.spark, root)

    def same_as(self, other: Store) -> bool:
        return [(r.number, r.txn) for r in self.history()] == [(r.number, r.txn) for r in other.history()] and all(self.at(n).exceptAll(other.at(n)).isEmpty() and other.at(n).exceptAll(self.at(n)).isEmpty() for n in self.relations())


# changes of objects and edges, as weighted rows


def added(rows: DataFrame) -> DataFrame:
    return weighted(rows)


def removed(rows: DataFrame) -> DataFrame:
    return weighted(rows, -1)


def updated(before: DataFrame, after: DataFrame) -> DataFrame:
    return plus(removed(before), added(after))


def moved(edges: DataFrame, source: str, target: str, pairs: DataFrame) -> DataFrame:
    """Edges to the targets of ``pairs`` (target, new source) leave their sources and go to the new ones."""
    new = pairs.toDF("_t", "_s")
    old = edges.join(new.select("_t"), F.col(target) == F.col("_t"), "left_semi")
    come = new.select(F.col("_s").alias(source), F.col("_t").alias(target))
    return updated(old, come.select(*edges.columns))


def orphans(children: DataFrame, key: str, edges_after: DataFrame, target: str) -> DataFrame:
    """Children that no edge leads to: those to delete with their last owner."""
    return children.join(edges_after.select(F.col(target).alias("_t")), F.col(key) == F.col("_t"), "left_anti")
