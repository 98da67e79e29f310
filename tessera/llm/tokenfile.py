"""Token files: Simple-8b coded ids of documents in ascending doc_id order.

A file set is a Parquet table of (shard, part, before, blob). Shards are ranges of doc_id; a shard's parts hold
its documents in order; ``before`` counts the shard's ids in earlier parts. A blob is one binary piece:

    header   8 bytes magic, then unsigned 64-bit: documents, ids, words of lengths, words of ids
    doc_ids  signed 64-bit each, with a bit map of nulls behind it, padded to 8 bytes
    lengths  Simple-8b words, then unsigned 32-bit offsets of their blocks, padded to 8 bytes
    ids      Simple-8b words, then unsigned 32-bit offsets of their blocks, padded to 8 bytes

Everything is little-endian. Documents without text hold the end id alone. Rows that repeat a doc_id keep a row
each, next to each other, ordered by their ids. Rows without a doc_id come first, dealt to shards of their own by the hash of their text. Files stand in the
order of their shards. An empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import simple8b
from tessera.llm.common import MAX_BUCKETS, arrow_map, bucket_of, cut_points, texts_of, typed
from tessera.llm.wordbpe import chunks

MAGIC = b"TSR8B\x00\x00\x01"
PART_IDS = 1 << 20


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    a, a_at = simple8b.encode(lengths)
    b, b_at = simple8b.encode(ids)
    head = np.array([len(doc_ids), len(ids), len(a), len(b)], dtype="<u8").tobytes()
    known = np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes()
    nulls = _padded(np.packbits(np.array([x is None for x in doc_ids], dtype=bool)).tobytes())
    return b"".join((MAGIC, head, known, nulls, a.astype("<u8").tobytes(), _padded(a_at.astype("<u4").tobytes()), b.astype("<u8").tobytes(), _padded(b_at.astype("<u4").tobytes())))


def unpack(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a blob."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token blob")
    docs, n, wa, wb = (int(x) for x in np.frombuffer(blob, "<u8", 4, 8))
    at = 40

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += -(-out.nbytes // 8) * 8
        return out

    known, nulls = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs)
    blocks = lambda count: -(-count // simple8b.BLOCK)
    a = take("<u8", wa)
    lengths = simple8b.decode(a, docs, take("<u4", blocks(docs)))
    b = take("<u8", wb)
    ids = simple8b.decode(b, n, take("<u4", blocks(n)))
    return [None if z else i for i, z in zip(known.tolist(), nulls.tolist(), strict=True)], lengths.astype(np.int64), ids


def tokens(docs: DataFrame, vocabulary: str, end_id: int, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, ids binary, *keep) of each whole text with ``end_id`` behind it, as little-endian unsigned 32-bit integers."""
    keep, end = keep or [], np.array([end_id], dtype="<u4").tobytes()

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = [x + end for x in chunks(vocabulary).encode(b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), *(b.column(k) for k in keep)], names=["doc_id", "ids", *keep])

    schema = T.StructType([*T.DataType.fromDDL("doc_id long, ids binary").fields, *typed(docs, keep, "").fields])
    return arrow_map(texts_of(docs, *keep), run, schema)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, per_shard: int = 4096) -> None:
    """Encode ``docs`` and write the file set to ``path``. Only ids move between tasks: a shard's go to one task of its own, which sorts and packs them."""
    cuts = cut_points(docs.select("doc_id"), per_shard)
    nulls = min(MAX_BUCKETS, -(-docs.where("doc_id is null").count() // per_shard))
    shard = F.lit(nulls) + bucket_of(F.col("doc_id").cast("long"), cuts)
    if nulls:
        shard = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(nulls))).otherwise(shard)
    with_ids = tokens(texts_of(docs, shard.cast("int").alias("shard")), vocabulary, end_id, ["shard"])
    dealt = with_ids.repartitionById(nulls + max(1, len(cuts)), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, before, n = None, 0, 0, 0
        held: list[tuple[int | None, bytes]] = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal part, before, n, held
            if held:
                ids = np.frombuffer(b"".join(x for _, x in held), dtype="<u4")
                blob = pack([i for i, _ in held], np.array([len(x) // 4 for _, x in held], dtype=np.uint64), ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "part", "before", "n_ids", "blob"])
                part, before, n, held = part + 1, before + len(ids), 0, []

        for b in batches:
            for s, d, x in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if s != shard or n >= PART_IDS:
                    yield from out()
                    if s != shard:
                        shard, part, before = s, 0, 0
                held.append((d, x))
                n += len(x) // 4
        yield from out()

    dealt.mapInArrow(run, "shard int, part int, before long, n_ids long, blob binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids binary) from a file set; start counts the ids of all documents before.

    What is broadcast is one number for each shard, of which there are twice ``MAX_BUCKETS`` at most.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").limit(2 * MAX_BUCKETS).toPandas()
    base = dict(zip(totals["shard"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist(), strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, before, blob in zip(b.column("shard").to_pylist(), b.column("before").to_pylist(), b.column("blob").to_pylist(), strict=True):
                doc_ids, lengths, ids = unpack(blob)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                starts = (ends - lengths).tolist()
                for lo in range(0, len(doc_ids), 1024):
                    hi = min(lo + 1024, len(doc_ids))
                    cut = [raw[4 * s : 4 * e] for s, e in zip(starts[lo:hi], ends[lo:hi].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[lo:hi], pa.int64()), pa.array([base[shard] + before + s for s in starts[lo:hi]], pa.int64()), pa.array(lengths[lo:hi], pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array([bytes(x) for x in cut], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return files.select("shard", "before", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
