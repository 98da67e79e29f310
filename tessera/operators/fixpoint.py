"""Recursion to a fixpoint: reachability with ranks and witnesses, Horn closure, support from both sides, bag multiplicities."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import AtomOutsideCarrier, LimitExceeded, NonFiniteMultiplicity
from tessera.sources.store import discard, stored, stored_with_count

INFINITE = None


def reachability(seeds: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, rank, parent): every node that ``edges`` (src, dst) reach from ``seeds`` (node), the least number of steps, and the least node before it at that distance.

    Each round joins the newest nodes with the edges and leaves out what is known, by tables in the shared folder, so the plan doesn't grow.
    """
    front = stored(seeds.select("node").where("node is not null").distinct().select("node", F.lit(0).alias("rank"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")), "front")
    levels, known = [front], front
    for rank in range(1, most_rounds + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        new = step.where("node is not null").join(known.select("node"), "node", "left_anti").select("node", F.lit(rank).alias("rank"), "parent")
        front, n = stored_with_count(new, "front")
        if not n:
            break
        levels.append(front)
        known = known.unionByName(front)
        if len(levels) % 16 == 0:  # one table again instead of a union of many
            known = stored(known, "known")
            for old in levels[:-1]:
                discard(old)
            levels = [known]
    else:
        raise LimitExceeded("reachability has not ended")
    return known


def certificate_faults(found: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, fault) that show a reachability result to be wrong; none if it is right."""
    n = found.select("node", "rank", "parent")
    missing_seed = seeds.select("node").distinct().join(n.where("rank = 0"), "node", "left_anti").select("node", F.lit("seed not at rank 0").alias("fault"))
    extra = n.where("rank = 0").join(seeds.select("node").distinct(), "node", "left_anti").select("node", F.lit("rank 0 without a seed").alias("fault"))
    to = edges.join(n.select(F.col("node").alias("src"), F.col("rank").alias("r")), "src")
    open_ = to.join(n.select(F.col("node").alias("dst"), F.col("rank").alias("r2")), "dst", "left").where("r2 is null or r2 > r + 1").select(F.col("dst").alias("node"), F.lit("not closed under edges").alias("fault"))
    step = n.where("rank > 0").alias("a").join(n.alias("p"), F.col("a.parent") == F.col("p.node"), "left").join(edges.distinct().alias("e"), (F.col("e.src") == F.col("a.parent")) & (F.col("e.dst") == F.col("a.node")), "left")
    bad = step.where("p.rank is null or p.rank <> a.rank - 1 or e.src is null").select(F.col("a.node").alias("node"), F.lit("no witness").alias("fault"))
    return missing_seed.unionByName(extra).unionByName(open_).unionByName(bad)


def live(entities: DataFrame, roots: DataFrame, keeps: DataFrame) -> DataFrame:
    """The rows of ``entities`` (id, ...) that ``keeps`` (src, dst) reach from ``roots`` (node)."""
    return entities.join(reachability(roots, keeps).select(F.col("node").alias("id")), "id", "left_semi")


def prune_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose ends are there."""
    ids = entities.select("id")
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def horn_closure(facts: DataFrame, rules: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(atom): what follows from ``facts`` (atom) by ``rules`` (rule, head, body array): a head holds when all of its body does."""
    known = stored(facts.select("atom").distinct(), "known")
    need = stored(rules.select("rule", "head", F.explode_outer(F.array_distinct("body")).alias("atom")), "need")
    size = stored(need.groupBy("rule", "head").agg(F.count("atom").alias("n")), "size")
    for _ in range(most_rounds):
        met = need.join(known, "atom").groupBy("rule").agg(F.count(F.lit(1)).alias("m"))
        ready = size.join(met, "rule", "left").where("coalesce(m, 0) = n").select(F.col("head").alias("atom"))
        new, n = stored_with_count(ready.distinct().join(known, "atom", "left_anti"), "new")
        if not n:
            return known
        after = stored(known.unionByName(new), "known")
        discard(known)
        known = after
    raise LimitExceeded("the closure has not ended")


def horn_after(facts: DataFrame, rules: DataFrame, inserted: DataFrame, removed: DataFrame) -> DataFrame:
    """The closure after facts are removed and inserted."""
    left = facts.select("atom").join(removed.select("atom"), "atom", "left_anti")
    return horn_closure(left.unionByName(inserted.select("atom")), rules)


def supported(atoms: DataFrame, supports: DataFrame, grounded: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(atom): the greatest set in which every atom is grounded or has a supporter in the set. ``supports``: (atom, by); atoms die when all their supporters have died."""
    held = stored(atoms.select("atom").distinct(), "held")
    for _ in range(most_rounds):
        backed = supports.join(held.select(F.col("atom").alias("by")), "by", "left_semi").select("atom").unionByName(grounded.select("atom")).distinct()
        after = stored(held.join(backed, "atom", "left_semi"), "held")
        same = after.count() == held.count()
        discard(held)
        held = after
        if same:
            return held
    raise LimitExceeded("support has not settled")


@dataclass(frozen=True)
class BagRule:
    """``head`` gains coef x the product of the body's multiplicities."""

    head: str
    body: tuple[str, ...]
    coef: int = 1


def bag_fixpoint(atoms: Iterable[str], seeds: dict[str, int], rules: Iterable[BagRule], most: int = 100_000) -> dict[str, int | None]:
    """Least multiplicities, ``INFINITE`` for atoms that a productive cycle feeds, 0 for those that nothing grounds.

    The program is explicit and finite by its definition and runs on the driver; ``most`` bounds its atoms and rules.
    """
    carrier, rules = set(atoms), list(rules)
    if len(carrier) + len(rules) > most:
        raise LimitExceeded(f"more than {most} atoms and rules")
    for a in [*seeds, *(r.head for r in rules), *(b for r in rules for b in r.body)]:
        if a not in carrier:
            raise AtomOutsideCarrier(a)
    positive = {a for a, n in seeds.items() if n > 0}
    waiting = [(r, set(r.body)) for r in rules if r.coef > 0]
    grew = True
    while grew:
        grew = False
        for r, body in waiting:
            if r.head not in positive and body <= positive:
                positive.add(r.head)
                grew = True
    active = [r for r, body in waiting if body <= positive]
    feeds: dict[str, set[str]] = {a: set() for a in positive}
    for r in active:
        for b in r.body:
            feeds[b].add(r.head)
    order, low = _components(positive, feeds)
    out: dict[str, int | None] = dict.fromkeys(carrier, 0)
    for group in order:
        cyclic = len(group) > 1 or any(a in feeds[a] for a in group)
        for a in group:
            total: int | None = seeds.get(a, 0)
            for r in active:
                if r.head == a and total is not INFINITE:
                    if any(low[b] == low[a] for b in r.body) or any(out[b] is INFINITE for b in r.body):
                        total = INFINITE
                        break
                    product = r.coef
                    for b in r.body:
                        product *= out[b]  # type: ignore[operator]
                    total += product
            out[a] = INFINITE if cyclic else total
    return out


def _components(nodes: set[str], feeds: dict[str, set[str]]) -> tuple[list[list[str]], dict[str, int]]:
    """Strongly connected groups, those that feed others first, and each node's group."""
    seen: set[str] = set()
    done: list[str] = []
    for root in sorted(nodes):
        stack = [(root, iter(sorted(feeds[root])))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                done.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(feeds[nxt]))))
    back: dict[str, set[str]] = {a: set() for a in nodes}
    for a, bs in feeds.items():
        for b in bs:
            back[b].add(a)
    group: dict[str, int] = {}
    out: list[list[str]] = []
    for root in reversed(done):
        if root in group:
            continue
        members, todo = [], [root]
        group[root] = len(out)
        while todo:
            a = todo.pop()
            members.append(a)
            for b in back[a]:
                if b not in group:
                    group[b] = len(out)
                    todo.append(b)
        out.append(members)
    return out, group


def require_finite(found: dict[str, int | None]) -> dict[str, int]:
    endless = sorted(a for a, n in found.items() if n is INFINITE)
    if endless:
        raise NonFiniteMultiplicity(", ".join(endless))
    return found  # type: ignore[return-value]


def chain(df: DataFrame, by: list[str], order: str, name: str = "next") -> DataFrame:
    """Edges from each row's ``order`` to the following one's within groups."""
    return df.withColumn(name, F.lead(order).over(Window.partitionBy(*by).orderBy(order)))


def common_ancestors(parents: dict[int, tuple[int, ...]], a: int, b: int) -> list[int]:
    """The latest revisions that both come from: common ancestors that are no ancestor of another common one."""

    def up(x: int) -> set[int]:
        seen, todo = set(), [x]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += parents.get(n, ())
        return seen

    both = up(a) & up(b)
    return sorted(x for x in both if not any(x != y and x in up(y) for y in both))


def merge_live(base: set, ours: set, theirs: set) -> set:
    """Three-way merge of which entities are there: what one side removed goes, what one side added comes."""
    return (ours & theirs) | (ours - base) | (theirs - base)
