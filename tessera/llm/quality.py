"""Quality scores from zstandard dictionaries of good and of bad text.

A text is compressed twice, with a dictionary trained on good and one trained on bad labelled text, in blocks of ``BLOCK`` bytes so that the
dictionary counts throughout. The difference of both sizes, normalised by them and by its usual spread, and how far the text compresses at all go
through a logistic curve fitted on labelled texts that neither dictionary has seen. The score is the chance that the label is 1, at the
labels' share among all labelled rows.

Fitting takes ``PER_LABEL`` labelled documents of each label at most, those with the least hash of their doc_id. Their texts and those
that are scored are always taken whole. One task for each label trains its dictionary, the others measure the texts that fit the curve; the
driver gets dictionaries and sizes, no texts. Too few texts to train on are their dictionary themselves, its latest ``DICTIONARY`` bytes. Null and empty texts have difference 0 and get the curve's value there.
Without texts of both labels every score is the share of label 1 (within 0.02 and 0.98), 0.5 without labels. Rows that repeat are each scored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, discard, least_hashed, stored, trim, typed

PER_LABEL = 1_500
DICTIONARY = 64 << 10
BLOCK = 1_024
LEVEL = 1
ACCEPT = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


_pairs: dict[tuple[bytes, bytes], list] = {}


def _compressors(good: bytes, bad: bytes) -> list:
    import zstandard

    key = hashlib.sha256(good).digest(), hashlib.sha256(bad).digest()
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (good, bad)]
    return _pairs[key]


def sizes(good: bytes, bad: bytes, texts: list[str | None]) -> list[tuple[int, int, int]]:
    """(bytes, compressed with the good dictionary, with the bad one) of each text."""
    a, b = (c.compress for c in _compressors(good, bad))
    out = []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        out.append((len(raw), sum(len(a(x)) for x in blocks), sum(len(b(x)) for x in blocks)))
    return out


def features(n: int, good: int, bad: int) -> tuple[float, float, float]:
    """The size difference as a share of both sizes, the same against the spread expected of such a size, and how short the shorter is."""
    both = good + bad
    if not both:
        return 0.0, 0.0, 0.0
    return 100 * (bad - good) / both, (bad - good) / both**0.5, -10 * max(0.0, 0.25 - min(good, bad) / n)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> list[float]:
    """Weights and intercept by Newton steps with a small ridge; labels are weighted so that label 1 has the share ``prior``."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    share = np.where(y > 0, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (share * (p - y)) + 1e-2 * w
        h = (z * (share * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _trained(texts: pa.Table) -> pa.Table:
    """(quality, dictionary) from the whole texts of one label."""
    import zstandard

    texts = texts.sort_by("place")
    raw = [t.encode() for t in texts.column("text").to_pylist()]
    parts = [t[i : i + 512] for t in raw for i in range(0, len(t), 512)]
    try:
        made = zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too few to train on: their text itself
        made = b"".join(raw)[-DICTIONARY:]
    trim()
    return pa.table({"quality": texts.column("quality").slice(0, 1), "dictionary": pa.array([made], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fit on ``labels`` (doc_id, quality) and the texts of ``docs``; repeated labels of a document count once, the lower first."""
    each = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    first = least_hashed(each, "quality", "doc_id", per_label)
    counts = {q: n for q, n in each.groupBy("quality").count().collect()}
    prior = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 0.02), 0.98) if counts else 0.5
    rows = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(first), "doc_id").distinct()  # 2 x per_label ids
    of_label = Window.partitionBy("quality")
    placed = rows.withColumns({"place": F.row_number().over(of_label.orderBy("doc_id", "text")) - 1, "n": F.count(F.lit(1)).over(of_label)})
    chosen = stored(placed.select("quality", "place", "text", (F.col("n") < 12).alias("both")), "labelled")
    trained = chosen.where("both or place % 3 <> 0").groupBy("quality").applyInArrow(_trained, "quality int, dictionary binary").collect()  # 2 x DICTIONARY
    made = {r["quality"]: bytes(r["dictionary"]) for r in trained}
    if len(made) < 2:
        discard(chosen)
        return Model(b"", b"", (0.0, 0.0, 0.0, float(np.log(prior / (1 - prior)))))

    def measure(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = sizes(made[1], made[0], b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("quality"), b.column("place"), *(pa.array(x, pa.int64()) for x in zip(*n, strict=True))], names=["quality", "place", "raw", "good", "bad"])

    held = arrow_map(chosen.where("both or place % 3 = 0").select("quality", "place", "text"), measure, "quality int, place int, raw long, good long, bad long").collect()
    discard(chosen)
    held = sorted(map(tuple, held))
    x = np.array([features(*n) for _, _, *n in held])
    return Model(made[1], made[0], tuple(_logistic(x, np.array([q for q, *_ in held], dtype=float), prior)))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, score): the chance of label 1 for each whole text."""
    w = np.array(model.weights)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    names = [k for k in keep if k != "text"]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = b.column("text").to_pylist()
        x = np.array([features(*n) for n in sizes(model.good, model.bad, texts)] if model.good else [(0.0, 0.0, 0.0)] * len(texts))
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", *keep)), pa.array(p)], names=["doc_id", *keep, "score"])

    return arrow_map(docs.select("doc_id", "text", *names), run, typed(docs, ("doc_id", *keep), "score double"))


def accepted(docs: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is ``least`` or more."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return score(rows, model, keep=("row",)).where(F.col("score") >= least).select("row.*")
