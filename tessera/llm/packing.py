"""Best-two-fit packing of token sequences, planned on the histogram of their lengths.

Lengths are whole numbers up to the capacity, so a bin's filling is a short list of lengths and how many bins are filled that way
depends on counts alone. The driver gets one count for each length (2048 numbers for 2048 tokens, whatever the input), fills
a bin greedily with the longest that fits, replaces its smallest length by the two unpacked ones that fill
the widened gap best, and repeats that filling while the counts allow it. Pieces of the whole capacity are sequences by themselves and go nowhere.
The others find their places by their rank among pieces of their length; a length is cut into chunks of about ``CHUNK`` pieces, whose
ranks follow from the counts of the chunks before, so no task holds more than a chunk, however many pieces there are.

A null or empty text is a document of the end id alone. Rows that repeat are separate documents. An empty table packs to no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, longs, stored, texts_of, typed
from tessera.llm.wordbpe import chunks

CHUNK = 1 << 16


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(lengths in a bin with how often each, bins so filled)] for ``counts[length]`` items; lengths over half fill bins first."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []
    while True:
        longest = np.where(left[: capacity + 1] > 0, np.arange(capacity + 1), 0)
        longest = np.maximum.accumulate(longest)  # the longest item left that is no longer than the index
        if not longest[capacity]:
            return out
        bin_: dict[int, int] = {}
        gap = capacity
        while gap:
            size = int(longest[gap])
            while size and bin_.get(size, 0) >= left[size]:
                size = int(longest[size - 1])
            if not size:
                break
            bin_[size] = bin_.get(size, 0) + 1
            gap -= size
        if gap:
            small = min(bin_)
            room = gap + small
            free = left[: capacity + 1].copy()
            for size, k in bin_.items():
                free[size] -= k
            free[0] = 0
            ready = np.where(free > 0, np.arange(capacity + 1), 0)
            best = np.maximum.accumulate(ready)
            first = np.flatnonzero(ready[:room])
            if len(first):
                second = best[room - first]
                alone = (second == first) & (free[first] < 2)
                second = np.where(alone, best[np.maximum(first - 1, 0)], second)
                total = np.where(second > 0, first + second, 0)
                k = int(total.argmax())
                if total[k] > small:
                    bin_[small] -= 1
                    for size in (int(first[k]), int(second[k])):
                        bin_[size] = bin_.get(size, 0) + 1
                    bin_ = {s: c for s, c in bin_.items() if c}
        times = min(int(left[s]) // c for s, c in bin_.items())
        for s, c in bin_.items():
            left[s] -= c * times
        out.append((sorted(bin_.items(), reverse=True), times))


def places(filled: list[tuple[list[tuple[int, int]], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks and where they go: rank r from ``lo`` on is in bin ``seq + (r - lo) // each``, at ``off`` and that many lengths more."""
    rows, seq = [], 0
    used = np.zeros(capacity + 1, dtype=np.int64)
    for items, times in filled:
        off = 0
        for size, each in items:
            rows.append((size, int(used[size]), seq, each, off))
            used[size] += each * times
            off += size * each
        seq += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("size", "lo", "seq", "each", "off"), a.T.copy(), strict=True))


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each text's ids with the end id."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for d, x in zip(b.column("doc_id").to_pylist(), chunks(vocabulary).encode(b.column("text").to_pylist()), strict=True):
            x += end
            rows += [(d, i, at // 4, (len(p := x[at : at + 4 * capacity])) // 4, zlib.crc32(p)) for i, at in enumerate(range(0, len(x), 4 * capacity))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    return arrow_map(texts_of(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (with a whole-number column ``length`` of 1 to ``capacity``) with sequence_id and offset."""
    names = items.columns
    item = F.struct(*[F.col(f"`{c}`") for c in names]).alias("item")  # under one name, so that no column of the input clashes
    held = stored(items.select(item, F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("id")), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in held.groupBy("length").count().collect():  # one row for each length, capacity at most
        counts[size] = n
    whole, counts[capacity] = int(counts[capacity]), 0
    filled = plan(counts, capacity)
    at, bins = places(filled, capacity), sum(k for _, k in filled)
    alone = held.where(F.col("length") == capacity).select("item.*", (F.lit(bins) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = longs(np.maximum(1, -(-counts // CHUNK)).tolist())
    some = held.where(F.col("length") < capacity).withColumn("chunk", F.pmod(F.xxhash64("id"), F.get(parts, F.col("length").cast("int"))))
    by = some.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = by.select("length", "chunk", F.coalesce(ahead, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("id")) - 1
    ranked = some.withColumn("own", own).join(before, ["length", "chunk"]).select("item", "length", (F.col("own") + F.col("before")).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.int64(1) << 40
        keys = at["size"] * far + at["lo"]
        for b in batches:
            size, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            i = np.searchsorted(keys, size * far + rank, side="right") - 1
            q = rank - at["lo"][i]
            seq, off = at["seq"][i] + q // at["each"][i], at["off"][i] + q % at["each"][i] * size
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(seq), pa.array(off)], names=["item", "sequence_id", "offset"])

    packed = ranked.mapInArrow(run, typed(held, ["item"], "sequence_id long, offset long")).select("item.*", "sequence_id", "offset")
    return packed.unionByName(alone) if whole else packed


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document, in as few sequences as the fit finds."""
    return assign(cut(docs, vocabulary, end_id, capacity), capacity)
