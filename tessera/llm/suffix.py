"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too goes. To find them over any number of documents:

1. Each window of LENGTH bytes is keyed by the least hash of the 64-byte strings in it (the first of ``GRAMS``). Equal windows have equal keys, and neighbouring
   windows mostly share one, so documents fall into runs: a key and the segment of bytes that its windows cover.
2. A key with one run that has its hashed string once cannot hold a repeat. For the others each distinct segment, by the 128-bit xxh3 of its bytes, is fetched once, with
   how often it occurs (two is all that counts: such a segment is repeated throughout, and stays for others to match), and dealt by key.
3. A key with more than ``MOST_BYTES`` of distinct segments, as of a phrase that many texts share, is split: its windows are keyed again by the least hash of longer
   strings in them, up to the whole window. Windows with equal keys of that last kind are equal, so they make one segment.
4. In each task segments are joined to one text of bounded size and sorted by their first 256 bytes. Starting with strings of 8 bytes, intervals of its Burrows-Wheeler
   transform are extended backwards, breadth first: the boundary at which an extended interval ends gets the
   current length as its common prefix, once, and only intervals that set a boundary go on. At LENGTH the expansion stops;
   boundaries still unset have a common prefix of LENGTH or more, and windows beside them are repeated.
5. Repeated windows go back to all runs with the same segment, and to the documents.

A null text is an empty one; texts under LENGTH bytes stay whole. Documents are told apart by row, not by doc_id: equal texts are copies
of each other whatever their ids, nulls and repeated rows included. An empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, pieces, stored, trim, typed

LENGTH = 200
#: Lengths of the strings that key a window, one after the other for keys that are too busy; the last is the window's own.
GRAMS = (64, 128, 168, LENGTH)
BATCH = 1 << 20
BLOCK = 512 << 10
MOST_BYTES = 2 << 20
#: Longer runs, of periodic text, are cut into segments of so many windows.
MOST_WINDOWS = 64 << 10
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of substrings of one array, of bytes or of hashes, by prefix sums of its polynomial, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, multiplier: int) -> None:
        n = len(data)
        have = self._powers.get(multiplier)
        if have is None or len(have[0]) <= n:
            size = max(n + 1, BATCH + 1)
            up, down = np.full(size, multiplier, np.uint64), np.full(size, pow(multiplier, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if size <= 4 * BATCH:
                self._powers[multiplier] = have
        self.down = have[1]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64, copy=False) + np.uint64(1)) * have[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MULTIPLIERS[0])
        return h ^ (h >> np.uint64(29))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    n = len(h) - width + 1
    blocks = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def names_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the 128-bit xxh3 of each ``data[begin:end]``."""
    import xxhash

    raw, digest = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:e]) for a, e in zip(begin.tolist(), end.tolist(), strict=True)]), dtype="<i8").reshape(-1, 2)


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """(text index, key, first window, bytes of the segment, name of the segment, whether the key's string stands in it twice) of each run."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z.reshape(0, 2), z.astype(bool)
    roll = Rolling(data, _MULTIPLIERS[1])
    at = np.arange(len(data) - gram + 1)
    grams = roll.of(at, at + gram)
    least = sliding_least(grams, length - gram + 1)
    valid = np.zeros(len(data) + 1, dtype=np.int8)
    has = windows > 0
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, starts[has] + windows[has], -1)
    where = np.flatnonzero(np.cumsum(valid)[: len(least)] > 0)
    key = least[where]
    new = np.ones(len(where), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (where[1:] != where[:-1] + 1)
    first_of = np.zeros(len(data), dtype=bool)
    first_of[starts[has]] = True
    new |= first_of[where]
    begin = np.flatnonzero(new)
    if len(where) > MOST_WINDOWS:
        offset = np.arange(len(where)) - begin[np.cumsum(new) - 1]
        new |= (offset > 0) & (offset % MOST_WINDOWS == 0)
        begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(where)) - 1
    s, e = where[begin], where[stop] + length
    doc = np.searchsorted(ends, s, side="right")
    # windows of one run can only be equal if its key's string stands there twice; then it does so in the
    # first window, in the last, or at different places in both
    seen = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)
    hit1, hit2 = seen[s] == key[begin][:, None], seen[e - length] == key[begin][:, None]
    twice = (hit1.sum(1) > 1) | (hit2.sum(1) > 1) | (s + hit1.argmax(1) != e - length + hit2.argmax(1))
    return doc, key[begin], s - starts[doc], e - s, names_of(data, s, e), twice


def _batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > BATCH:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if texts:
        yield at, texts[at:]


def sorted_by_prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes ordered by their first 256 bytes, common prefix of each with the one before, up to 8; -1 for the first)."""
    n = len(data)
    wide = np.zeros(n + 8, dtype=np.uint8)
    wide[:n] = data
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n].astype(np.uint64)
    order = np.argsort(key, kind="stable").astype(np.int32)
    ranked = key[order]
    del key
    differs = np.empty(n, dtype=bool)
    differs[0] = True
    differs[1:] = ranked[1:] != ranked[:-1]
    common = np.full(n, 8, dtype=np.int8)
    common[0] = -1
    x = ranked[1:] ^ ranked[:-1]
    for k in range(8, 0, -1):  # the first byte that differs
        common[1:][x >> np.uint64(8 * (8 - k)) != 0] = k - 1
    del x, ranked
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.cumsum(differs, dtype=np.int32) - 1
    h = 8
    while h < 256 and not differs.all():
        # only suffixes whose rank is shared need another look
        follow = np.full(n, -1, dtype=np.int32)
        follow[: n - h] = rank[h:]
        group = np.cumsum(differs, dtype=np.int32)
        open_ = np.flatnonzero(~differs | np.append(~differs[1:], False))
        sub = order[open_]
        sorted_ = np.lexsort((follow[sub], group[open_]))
        sub = sub[sorted_]
        order[open_] = sub
        g, f = group[open_], follow[sub]
        differs[open_[1:]] |= (f[1:] != f[:-1]) & (g[1:] == g[:-1])
        rank[order] = np.maximum.accumulate(np.where(differs, np.arange(n, dtype=np.int32), np.int32(0)))
        h *= 2
    return order, common


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the starts of windows that occur more than once in all segments together."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    # bytes are shifted by one: 0 ends a segment
    parts = [np.append(np.frombuffer(s, dtype=np.uint8).astype(np.uint16) + 1, 0) for s in segments]
    joined = np.concatenate(parts)
    present = np.unique(joined)
    if len(present) == 257:  # with the end that is one too many; UTF-8 leaves 13 of them out
        raise ValueError("the segments hold all 256 byte values, which UTF-8 text doesn't")
    if present[0] != 0:
        present = np.append(0, present)
    small = np.zeros(257, dtype=np.uint8)
    small[present] = np.arange(len(present))
    data = small[joined]
    n = len(data)
    order, common = sorted_by_prefix(data)
    bwt = data[order - 1]
    # last-to-first: where the suffix one byte longer stands
    lf = np.empty(n, dtype=np.int32)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    unset = np.append(common >= 8, False)
    bound = np.append(common, -1)
    left = np.flatnonzero(bound[:-1] < 8)  # intervals of strings of 8 bytes
    right = np.append(left[1:], n)
    ok = bound[right] == 7  # those that have just set their end
    left, right = left[ok], right[ok]
    for _ in range(8, length):
        if not len(left):
            break
        size = right - left
        one = size == 1
        nl, nr = [lf[left[one]]], [lf[left[one]] + 1]
        keep = [bwt[left[one]] != 0]
        if not one.all():
            l2, s2 = left[~one], size[~one]
            el = np.repeat(l2 - (np.cumsum(s2) - s2), s2) + np.arange(int(s2.sum()))
            c = bwt[el].astype(np.int64)
            key = np.repeat(np.arange(len(l2)), s2) * 256 + c
            o = np.argsort(key, kind="stable")
            k = key[o]
            first = np.ones(len(k), dtype=bool)
            first[1:] = k[1:] != k[:-1]
            at = np.flatnonzero(first)
            b = lf[el[o[at]]]
            nl.append(b)
            nr.append(b + np.diff(np.append(at, len(k))))
            keep.append(k[at] % 256 != 0)
        left, right, ok = np.concatenate(nl), np.concatenate(nr), np.concatenate(keep)
        ok &= unset[right]
        left, right = left[ok], right[ok]
        unset[right] = False
    again = np.zeros(n, dtype=bool)
    again[order] = unset[:n] | unset[1 : n + 1]
    out, at = [], 0
    for size in sizes.tolist():
        out.append(np.flatnonzero(again[at : at + max(0, size - length + 1)]))
        at += size + 1
    return out


def spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """[first, last] ranges of neighbouring window starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist(), strict=True))


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})


#: What names a distinct segment.
IDENT = ["key", "size", "h", "g"]
_IDENT = "key long, size int, h long, g long"


def _ident(key: np.ndarray, size: np.ndarray, name: np.ndarray) -> list[pa.Array]:
    return [pa.array(key.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy())]


def runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t1, t2, at, twice, key, size, h, g): the runs of each row's text, which t1 and t2 stand for."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [x.encode() for x in b.column("text").to_pylist()]
        t1, t2 = (np.asarray(b.column(c)) for c in ("t1", "t2"))
        for lo, part in _batches(texts):
            doc, key, at, size, name, twice = runs_of(part, length, _grams(length)[0])
            yield pa.RecordBatch.from_arrays([pa.array(t1[lo + doc]), pa.array(t2[lo + doc]), pa.array(at.astype(np.int32)), pa.array(twice), *_ident(key, size, name)], names=["t1", "t2", "at", "twice", *IDENT])

    return arrow_map(_keyed(docs, []).where(F.octet_length("text") >= length), run, f"t1 long, t2 long, at int, twice boolean, {_IDENT}")


def _grams(length: int) -> list[int]:
    return [max(1, g * length // LENGTH) for g in GRAMS]


def _crowded(each: DataFrame, most: int) -> DataFrame:
    """``each`` with ``hot``: whether its key's distinct segments have over ``most`` bytes. Such keys are met in 64 parts, so that none gathers its segments."""
    part = F.pmod("h", F.lit(64)).cast("int")
    weight = each.groupBy("key").agg(F.sum(F.col("size").cast("long")).alias("bytes")).where(F.col("bytes") > most)
    hot = weight.select("key", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("part"), F.lit(True).alias("hot"))
    return each.withColumn("part", part).join(hot, ["key", "part"], "left").drop("part").withColumn("hot", F.coalesce("hot", F.lit(False)))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(t1, t2, spans array<struct<a, b>>): for each distinct text with repeated windows, the byte ranges [a, b) that they cover, which may overlap."""
    every = stored(runs(docs, length), "runs")
    busy = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("key")
    # copies of a text have the same runs: they are one row with a count
    shared = stored(every.join(busy, "key", "left_semi").groupBy("t1", "t2", "at", *IDENT).agg(F.count(F.lit(1)).alias("n")), "shared")
    discard(every)
    each = shared.groupBy(*IDENT).agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2", "at")).alias("of"))
    wanted = _crowded(each, MOST_BYTES).select(F.col("of.t1").alias("t1"), F.col("of.t2").alias("t2"), F.struct(*IDENT, F.col("of.at").alias("at"), F.least("n", F.lit(2)).cast("int").alias("n"), "hot").alias("s"))
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list("s").alias("s"))
    texts = _keyed(docs, []).where(F.octet_length("text") >= length)

    def cut(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text, segs in zip(b.column("text").to_pylist(), b.column("s").to_pylist(), strict=True):
            raw = text.encode()
            rows += [(s["key"], s["size"], s["h"], s["g"], s["n"], s["hot"], raw[s["at"] : s["at"] + s["size"]]) for s in segs]
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*IDENT, "n", "hot", "raw"])

    segments = arrow_map(texts.join(wanted, ["t1", "t2"]).select("text", "s"), cut, f"{_IDENT}, n int, hot boolean, raw binary")
    segments = stored(segments, "segments")
    found = stored(_found(segments, length, 1), "found")
    discard(segments)
    # rows of one text, and of its copies, are the same
    placed = shared.select("t1", "t2", "at", *IDENT).join(found, IDENT)
    return placed.groupBy("t1", "t2").agg(F.collect_set(F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") + length).alias("b"))).alias("spans"))


def _found(segments: DataFrame, length: int, level: int) -> DataFrame:
    """(key, size, h, g, a, b): ranges [a, b] of repeated windows of ``segments``, a table of distinct ones (copies may come again) with counts; those that are hot go through the strings of the next ``level``."""

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int, int], tuple[int, bytes]] = {}
        total, last = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            found, rows = repeated_windows([raw for _, raw in held.values()], length), []
            for (ident, (n, raw)), starts in zip(held.items(), found, strict=True):
                rows += [(*ident, a, b) for a, b in (spans(starts, length) if n == 1 else [(0, len(raw) - length)])]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*IDENT, "a", "b"])

        for b in batches:
            for *ident, n, raw in zip(*(b.column(c).to_pylist() for c in (*IDENT, "n", "raw")), strict=True):
                if ident[0] != last and total > BLOCK:
                    yield from out()
                    held, total = {}, 0
                last, ident = ident[0], tuple(ident)
                if ident not in held:  # copies of a text bring their segments again
                    held[ident] = n, raw
                    total += len(raw)
        if held:
            yield from out()
        trim()

    cool = segments.where(~F.col("hot")).select(*IDENT, "n", "raw").repartition("key").sortWithinPartitions("key")
    cool = cool.mapInArrow(expand, f"{_IDENT}, a int, b int")
    hot = segments.where("hot")
    if hot.isEmpty():
        return cool
    grams = _grams(length)
    inner = stored(_split(hot.dropDuplicates(IDENT), length, grams[level]), "inner")
    own = {c: f"in_{c}" for c in IDENT}
    busy = inner.groupBy("in_key").agg(F.sum("n").alias("m"), F.max("twice").alias("twice")).where("m > 1 or twice").select("in_key")
    each = inner.join(busy, "in_key", "left_semi").groupBy(*own.values()).agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.any_value("raw").alias("raw")).withColumnsRenamed({v: k for k, v in own.items()})
    last = level + 1 >= len(grams)  # whole windows: a key has one segment
    each = stored(each.withColumn("hot", F.lit(False)) if last else _crowded(each, MOST_BYTES).select(*IDENT, "n", "hot", "raw"), "segments")
    within = _found(each, length, level + 1).withColumnsRenamed(own)
    back = inner.select(*IDENT, "at", *own.values()).join(within, list(own.values())).select(*IDENT, (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    return cool.unionByName(back)


def _split(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of ``segments`` by longer strings: each with its place ``at`` in its segment, how often that occurs, and its own name and bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, "raw"):
                raws = part.column("raw").to_pylist()
                of, key, at, size, name, twice = runs_of(raws, length, gram)
                outer = np.asarray(part.column("key"))[of].view(np.uint64)
                key = (key ^ (outer * np.uint64(_MULTIPLIERS[0]))) * np.uint64(_MULTIPLIERS[1])  # equal windows have both keys equal
                raw = [raws[i][j : j + k] for i, j, k in zip(of.tolist(), at.tolist(), size.tolist(), strict=True)]
                who = [part.column(c).take(pa.array(of)) for c in (*IDENT, "n")]
                yield pa.RecordBatch.from_arrays([*who, pa.array(at.astype(np.int32)), pa.array(twice), *_ident(key, size, name), pa.array(raw, pa.binary())], names=[*IDENT, "n", "at", "twice", *(f"in_{c}" for c in IDENT), "raw"])

    inside = ", ".join(f"in_{c}" for c in _IDENT.split(", "))
    return segments.select(*IDENT, "n", "raw").mapInArrow(run, f"{_IDENT}, n int, at int, twice boolean, {inside}, raw binary")


def covered(n: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges, ascending, that ``ranges`` cover together."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, keep: tuple[str, ...] = (), length: int = LENGTH) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans and kept binary (the remaining bytes) for every row."""
    found = repeats(docs, length)
    joined = _keyed(docs, list(keep)).join(found, ["t1", "t2"], "left").select(*keep, "text", "spans")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text, got in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw = text.encode()
            gone = covered(len(raw), [(s["a"], s["b"]) for s in got or ()])
            left, at = [], 0
            for a, e in gone:
                left.append(raw[at:a])
                at = e
            left.append(raw[at:])
            rows.append((len(raw), sum(e - a for a, e in gone), len(gone), b"".join(left)))
        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_, strict=True))], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return arrow_map(joined, run, typed(joined, keep, "n_bytes long, n_removed long, n_spans long, kept binary"))


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return remove(docs, ("doc_id",), length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs``, with all their columns, without the repeated bytes; characters of which only a part is left go too. Null texts become empty."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text")
    found = remove(rows, ("row",), length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()], pa.string())], names=["row", "kept"])

    out = found.select("row", "kept").mapInArrow(run, typed(found, ["row"], "kept string"))
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names])
