"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine of ``LEAST`` or more are within squared distance 2 - 2 * LEAST. They are rotated to the principal axes of a bounded sample
and split into blocks of ``WIDTH`` axes, and in at least one block their squared distance is within that block's share of the budget. Each block is
range-joined: the rows of a label are one task, and a task of more than ``CHUNK`` rows is split along the block's next axis into cells of the block's radius, as far as
its axes go. A cell's rows meet each other in one task and those of the next cell in another, so a split makes three copies of a row, without its vector, and two rows
within the radius come together in exactly one task. What is still too large, where many vectors are near each other in a whole block, is cut into chunks that meet in pairs.

In a task all block distances are taken at once by matrix products; pairs within the budget are verified by cosine in double
precision, each only in the first of its blocks that admits it, so that links are counted once. Tasks return counts and a spanning
forest of their links, not pairs. Equal vectors of a label are one node with a number of copies.

Rows link only within a label and among vectors of equal length. Vectors that are null, zero, or hold a null or non-finite component, and
rows without a label link with nothing. Rows that repeat are linked like any other; a null vec_id is no component's id unless it has no other. An empty
table gives no rows. Extra columns are dropped. The sample is of ``SAMPLE`` vectors for each of the ``LENGTHS`` most frequent lengths; others keep their axes, which
changes the work and not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, typed
from tessera.llm.components import connected_components

LEAST = 0.93
WIDTH = 8
CHUNK = 8_192
#: Rows of a task that meet the others at once.
STRIP = 512
SAMPLE = 4_096
LENGTHS = 16
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row's result doesn't depend on the others."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(sample: np.ndarray, size: int) -> np.ndarray:
    """Axes as columns, dealt so that each block leads with one of the widest."""
    if not len(sample):
        return np.eye(size)
    u = unit(sample)
    u = u - u.mean(0)
    _, axes = np.linalg.eigh(u.T @ u)
    axes = axes[:, ::-1]
    n = -(-size // WIDTH)
    return axes[:, np.concatenate([np.arange(b, size, n) for b in range(n)])]


def blocks(size: int) -> list[tuple[int, int, float]]:
    """(first axis, end, squared distance budget) of each block."""
    n = -(-size // WIDTH)
    cuts = np.cumsum([0, *(len(range(b, size, n)) for b in range(n))])
    return [(int(a), int(e), (2 - 2 * LEAST) * (e - a) / size + SLACK) for a, e in zip(cuts, cuts[1:], strict=False)]


def turned(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rotated rows, each summed in the same order wherever it is computed."""
    out = np.empty_like(u)
    cols = np.ascontiguousarray(axes.T)
    for i in range(0, len(u), 256):
        out[i : i + 256] = (u[i : i + 256, None, :] * cols).sum(axis=2)
    return out


def _block_distances(d: np.ndarray, shape: list[tuple[int, int, float]]) -> np.ndarray:
    return np.stack([(d[:, a:e] * d[:, a:e]).sum(1) for a, e, _ in shape], axis=1)


def pairs(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs linked between ``x`` and ``y`` (within ``x``, each once, if y is None) whose first block within budget is ``block``."""
    shape = blocks(x.shape[1])
    a, e, most = shape[block]
    ux = unit(x)
    uy = ux if y is None else unit(y)
    rx = turned(ux, axes)
    ry = rx if y is None else turned(uy, axes)
    bx, by = rx[:, a:e], ry[:, a:e]
    length, budget, found = (by * by).sum(1), np.array([b for _, _, b in shape]), []
    for at in range(0, len(bx), STRIP):
        part, later = bx[at : at + STRIP], at if y is None else 0
        far = (part * part).sum(1)[:, None] + length[later:] - 2 * part @ by[later:].T
        i, j = np.nonzero(far <= most + 1e-7)
        i, j = i + at, j + later
        if y is None:
            i, j = i[i < j], j[i < j]
        for lo in range(0, len(i), 1 << 15):
            s, t = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            within = _block_distances(rx[s] - ry[t], shape) <= budget
            ok = within.any(1) & (within.argmax(1) == block) & ((ux[s] * uy[t]).sum(1) >= LEAST)
            found.append((s[ok], t[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([t for _, t in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def nodes(vectors: DataFrame) -> DataFrame:
    """(node, label, v, copies, least): distinct vectors of each label that can link."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v")).where("label is not null and v is not null").where(fine)
    return v.groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")).withColumn("node", _name("label", "v"))


def _name(label: str, v: str):
    part = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.concat(part(F.col(label), F.col(v)), part(F.lit(11), F.col(label), F.col(v)))


def _axes(each: DataFrame) -> dict[int, np.ndarray]:
    out = {}
    for s, _ in each.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(LENGTHS).collect():
        rows = each.where(F.size("v") == s).orderBy("node").select("v").limit(SAMPLE).collect()
        out[s] = rotation(np.array([r[0] for r in rows], dtype=np.float64).reshape(-1, s), s)
    return out


def _located(each: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(label, path, own, first, node, cells): each node in each block, with its cells along the block's axes. ``path`` names the task: here vectors of one length in one block."""

    def locate(batches):
        for b in batches:
            size = np.asarray(pc.list_value_length(b.column("v")))
            out = []
            for s in np.unique(size).tolist():
                mine = np.flatnonzero(size == s)
                r = turned(unit(np.array(b.column("v").take(pa.array(mine)).to_pylist(), dtype=np.float64)), axes.get(s, np.eye(s)))
                for k, (a, e, most) in enumerate(blocks(s)):
                    cells = np.floor(r[:, a:e] / (np.sqrt(most) * (1 + SLACK))).astype(np.int32)
                    out.append((mine, np.full((len(mine), 2), (s, k), dtype=np.int32), cells))
            for mine, path, cells in out:
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (path, cells)]
                yield pa.RecordBatch.from_arrays([b.column("label").take(pa.array(mine)), lists[0], b.column("node").take(pa.array(mine)), lists[1]], names=["label", "path", "node", "cells"])

    found = each.select("node", "label", "v").mapInArrow(locate, typed(each, ["label"], "path array<int>, node string, cells array<int>"))
    return found.select("label", "path", F.lit(True).alias("own"), F.lit(True).alias("first"), "node", "cells")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of tasks that can have a pair, with the number of rows on either side; all rows of a task of its own are on the first."""
    task = ["label", "path", "own"]
    n = rows.groupBy(*task).agg(F.count_if("first").alias("a"), F.count_if(~F.col("first")).alias("b"))
    return rows.join(n.where("own and a > 1 or a > 0 and b > 0"), task)


def _divided(rows: DataFrame, axis: int) -> DataFrame:
    """The tasks of ``rows`` split along an axis: a path gets the cell of the first side and, as another number, what it meets."""
    c = F.get("cells", F.lit(axis))
    to = lambda cell, kind, own, first: F.struct(F.concat("path", F.array(cell, F.lit(kind))).alias("path"), F.lit(own).alias("own"), F.lit(first).alias("first"))
    alone = F.array(to(c, 0, True, True), to(c, 1, False, True), to(c - 1, 1, False, False))  # among themselves, with the next cell's, with those of the cell before
    left = F.array(*[to(c, 3 + d, False, True) for d in (-1, 0, 1)])
    right = F.array(*[to(c - d, 3 + d, False, False) for d in (-1, 0, 1)])
    spots = F.when(F.col("own"), alone).when(F.col("first"), left).otherwise(right)
    return rows.select("label", F.explode(spots).alias("t"), "node", "cells").select("label", "t.path", "t.own", "t.first", "node", "cells")


def _dealt(each: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(label, path, own, i, j, first, node): who meets in which task."""
    todo, out = _located(each, axes), []
    for axis in range(WIDTH):
        held = stored(_sized(todo), "tasks")
        large = (F.col("a") + F.col("b") > CHUNK) & (F.size("cells") > axis)
        out.append(held.where(~large))
        if held.where(large).isEmpty():
            break
        todo = _divided(held.where(large), axis)
    else:
        out.append(stored(_sized(todo), "tasks"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    many = lambda n: F.greatest(F.lit(1), F.ceil(n / CHUNK)).cast("int")
    ka, kb = many(F.col("a")), many(F.col("b"))
    p = F.pmod(F.xxhash64("node"), F.when(F.col("first"), ka).otherwise(kb)).cast("int")
    every = lambda k: F.sequence(F.lit(0), k - 1)
    spot = lambda i, j, first: F.struct(i.alias("i"), j.alias("j"), first.alias("first"))
    own = F.transform(every(ka), lambda t: spot(F.least(p, t), F.greatest(p, t), p <= t))
    across = F.when(F.col("first"), F.transform(every(kb), lambda t: spot(p, t, F.lit(True)))).otherwise(F.transform(every(ka), lambda t: spot(t, p, F.lit(False))))
    return rows.select("label", "path", "own", F.explode(F.when(F.col("own"), own).otherwise(across)).alias("t"), "node").select("label", "path", "own", "t.i", "t.j", "t.first", "node")


def links(each: DataFrame) -> DataFrame:
    """(node, links, root): for nodes with links, in parts, how many vectors of other nodes are linked, and another node of its component."""
    axes = _axes(each)
    dealt = _dealt(each, axes).join(each.select("node", "v", "copies"), "node")

    def meet(key, t):
        _, path, own, i, j = (k.as_py() for k in key)
        size, block = path[:2]
        node, copies = np.array(t.column("node").to_pylist(), dtype=object), np.asarray(t.column("copies"))
        v = np.asarray(t.column("v").combine_chunks().flatten()).astype(np.float64).reshape(-1, size)
        is_left = np.asarray(t.column("first"))
        a, turn = np.flatnonzero(is_left), axes.get(size, np.eye(size))
        if own and i == j:
            s, e = pairs(v, None, turn, block)
        else:
            b = np.flatnonzero(~is_left)
            if not len(a) or not len(b):
                s = e = np.zeros(0, np.int64)
            else:
                s, e = pairs(v[a], v[b], turn, block)
                s, e = a[s], b[e]
        count = np.zeros(len(node), dtype=np.int64)
        np.add.at(count, s, copies[e])
        np.add.at(count, e, copies[s])
        root = forest(len(node), s, e)
        hit = np.flatnonzero(count)
        return pa.table({"node": pa.array(node[hit], pa.string()), "links": pa.array(count[hit], pa.int64()), "root": pa.array(node[root[hit]], pa.string())})

    return dealt.groupBy("label", "path", "own", "i", "j").applyInArrow(meet, "node string, links long, root string")


def components(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each vector."""
    each = stored(nodes(vectors), "nodes")
    found = stored(links(each), "links")
    linked = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_node = each.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    count = found.groupBy("node").agg(F.sum("links").alias("links"))
    least = by_node.groupBy("component").agg(F.min("least").alias("component_id"))
    known = by_node.join(count, "node", "left").join(least, "component")
    known = known.select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.col("component_id").alias("c"))
    out = vectors.select("vec_id", "label", "embedding").join(known, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_v")), "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
