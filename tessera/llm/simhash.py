"""SimHash near-duplicates: pigeonring filtering of 64-bit fingerprints, then the full Hamming check.

A fingerprint is taken as a ring of eight 8-bit segments with a budget of two differing bits in all. If two differ by two bits or
fewer, some chain that starts at one of the eight segments keeps every prefix of k segments within floor(2k/8) bits: three equal
segments, then at most one bit up to the seventh, then two. Fingerprints meet by the 24 bits of those three segments; the rest of
the chain is checked before the full distance. Equal fingerprints are one node, so copies make no pairs.

A bucket of more than ``BUCKET`` distinct fingerprints is split by the same argument before any pairs are made: of three parts of the bits that
its fingerprints need not share, one holds no difference, so each goes to three narrower buckets, by the bits of one part each. That goes on
until at most ``FREE`` bits are left to differ, so no bucket has more than 2**FREE fingerprints, however many share their first 24 bits.

A null or empty text, or one without words, has fingerprint zero. Rows that repeat are each returned; a null doc_id is never a
component id unless all of its component are null. ``one_of_each`` keeps one row of a component, also of repeated rows and null ids. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, longs, stored, typed
from tessera.llm.components import connected_components

WORDS = 3
SEED = 42
SEGMENTS = 8
BITS = 64 // SEGMENTS
MOST_BITS = 2
EQUAL = SEGMENTS // MOST_BITS - 1
BUCKET = 48
FREE = 8


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    h = np.array([xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp long): fingerprints as signed 64-bit integers."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(x) for x in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *keep)), pa.array(fp)], names=["doc_id", *keep, "fp"])

    return arrow_map(docs.select("doc_id", "text", *keep), run, typed(docs, ("doc_id", *keep), "fp long"))


def _turned(fp: Column, by: int) -> Column:
    return F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by)) if by else fp


def _known(depth: int) -> list[int]:
    """Which bits of a turned fingerprint all of a bucket share, by the bucket's path: which of the three parts was taken at each split so far."""
    paths = [list(range(EQUAL * BITS))]
    for _ in range(depth):
        after = []
        for shared in paths:
            free = [b for b in range(64) if b not in shared]
            after += [shared + free[len(free) * k // 3 : len(free) * (k + 1) // 3] for k in range(3)]
        paths = after
    masks = [sum(1 << b for b in shared) for shared in paths]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _depths() -> int:
    """Splits after which every bucket has at most FREE bits left."""
    free, n = 64 - EQUAL * BITS, 0
    while free > FREE:
        free -= free // 3
        n += 1
    return n


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, between the distinct values of ``fp`` within ``MOST_BITS`` bits; an edge may come again."""
    rest = F.lit((1 << ((SEGMENTS - 1) * BITS)) - 1)
    turned = F.array(*[F.struct(F.lit(i).alias("i"), _turned(F.col("fp"), i * BITS).alias("r")) for i in range(SEGMENTS)])
    ring = fps.select("fp", F.explode(turned).alias("s")).select("fp", F.col("s.i").alias("i"), F.col("s.r").alias("r"), F.lit(0).alias("path"))
    out, bucket = None, ["i", "path", "key"]
    for depth in range(_depths() + 1):
        placed = ring.withColumn("key", F.col("r").bitwiseAND(F.get(longs(_known(depth)), F.col("path"))))
        size = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        held = stored(placed.join(size, bucket), "ring")
        few = held if depth == _depths() else held.where(F.col("n") <= BUCKET)
        other = few.select(*bucket, F.col("fp").alias("fp2"), F.col("r").alias("r2"))
        apart = F.col("r").bitwiseXOR(F.col("r2"))
        near = few.join(other, bucket).where((F.col("fp") < F.col("fp2")) & (F.bit_count(apart.bitwiseAND(rest)) <= (SEGMENTS - 1) * MOST_BITS // SEGMENTS) & (F.bit_count(apart) <= MOST_BITS))
        near = near.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
        out = near if out is None else out.unionByName(near)
        many = held.where(F.col("n") > BUCKET)
        if depth == _depths() or many.isEmpty():
            break
        ring = many.select("fp", "i", "r", F.explode(F.array(*[F.col("path") * 3 + k for k in range(3)])).alias("path"))
    return out


def _nodes(fps: DataFrame, key: Column) -> DataFrame:
    """(fp, least, component): each fingerprint with the least ``key`` of its rows."""
    nodes = fps.groupBy("fp").agg(F.min(key).alias("least"))
    linked = connected_components(links(nodes.select("fp")))
    by_node = nodes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return stored(by_node, "nodes")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each document."""
    fps = stored(fingerprints(docs), "fingerprints")
    by_node = _nodes(fps, F.col("doc_id"))
    least = by_node.groupBy("component").agg(F.min("least").alias("component_id"))
    out = fps.join(by_node.join(least, "component").select("fp", "component_id"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row (all columns) of each component: that of the least doc_id, null ids last, then the least hashes of the text, then the least other columns."""
    key = ["no_id", "id", "t1", "t2"]  # without nulls, so that the join and the choice below share a shuffle
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # under one name, so that no column of the input clashes
    marks = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")]
    keyed = docs.select("doc_id", "text", *marks, row.alias("row"), (F.to_json(F.struct(*others)) if others else F.lit("")).alias("others"))
    fps = stored(fingerprints(keyed.select("doc_id", "text", *key), tuple(key)), "fingerprints")
    kept = _nodes(fps, F.struct(*key)).groupBy("component").agg(F.min("least").alias("least")).select("least.*")
    first = F.row_number().over(Window.partitionBy(*key).orderBy("others"))
    one = keyed.join(kept, key, "left_semi").withColumn("place", first).where("place = 1")
    return one.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
