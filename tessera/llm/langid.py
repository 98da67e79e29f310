"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds those of its letters, each permuted by its place, into their product;
a document bundles (sums) the vectors of its trigrams, a language those of its documents; a document has the language whose
prototype has the greatest cosine with it. Words are runs of letters, lower-cased, with a blank at either end.

Prototypes are fitted on ``PER_LANGUAGE`` documents of each language at most, those with the least hash of their doc_id, and
are ``DIMENSIONS`` numbers for each language. Documents without letters, and all if nothing could be learnt, are ``und`` with score 0.
Equal cosines go to the language that sorts first. Rows that repeat are each scored; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, least_hashed, typed

DIMENSIONS = 4_096
PER_LANGUAGE = 500
SEED = 20_240_501
#: Letters whose vectors a worker keeps; others are made again when they are met.
LETTERS = 8_192
#: Bits of a letter in a trigram's code: 0 is the blank, others are one more than their code point.
WIDTH = 21
#: Trigrams whose vectors, and texts whose bundles, are in memory at once.
GRAMS = 1_024
TEXTS = 256


def letter_vector(letter: int) -> np.ndarray:
    """The vector of a letter, the same wherever it is made."""
    return np.random.default_rng((SEED, letter)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class Space:
    def __init__(self) -> None:
        import sys

        self.known: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(sys.maxunicode + 1, dtype=bool)
        self.is_letter[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = True

    def letters(self, those: np.ndarray) -> np.ndarray:
        out = np.empty((len(those), DIMENSIONS), dtype=np.int8)
        for i, x in enumerate(those.tolist()):
            v = self.known.get(x)
            if v is None:
                if len(self.known) >= LETTERS:
                    self.known.clear()
                v = self.known[x] = letter_vector(x)
            out[i] = v
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of a text as codes, and their counts."""
        at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = self.is_letter[at]
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sign = np.zeros(len(at) + 2, dtype=np.int64)
        sign[1:-1] = np.where(letter, 1 + at.astype(np.int64), 0)
        code = (sign[:-2] << 2 * WIDTH) | (sign[1:-1] << WIDTH) | sign[2:]
        code = code[sign[1:-1] > 0]
        return np.unique(code, return_counts=True)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        low = (1 << WIDTH) - 1
        those, at = np.unique(np.concatenate((codes >> 2 * WIDTH, (codes >> WIDTH) & low, codes & low)), return_inverse=True)
        base, (a, b, c) = self.letters(those), at.reshape(3, -1)
        return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of the texts, which have a letter)."""
        grams = [self.grams(x or "") for x in texts]
        out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        size = np.array([len(g) for g, _ in grams], dtype=np.int64)
        if size.any():
            every, at = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
            by = np.argsort(at, kind="stable")
            at, of, n = at[by], np.repeat(np.arange(len(texts)), size)[by], np.concatenate([n for _, n in grams])[by]
            for lo in range(0, len(every), GRAMS):
                i, j = np.searchsorted(at, (lo, lo + GRAMS))
                rows, row = np.unique(of[i:j], return_inverse=True)
                codes = every[lo : lo + GRAMS]
                counts = np.zeros((len(rows), len(codes)), dtype=np.float32)
                counts[row, at[i:j] - lo] = n[i:j]
                out[rows] += counts @ self.vectors(codes).astype(np.float32)
        return out, size > 0


_space: Space | None = None


def space() -> Space:
    global _space
    _space = _space or Space()
    return _space


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes from rows of (doc_id, text, lang) with a language and a text."""
    ids = F.broadcast(least_hashed(docs.where("lang is not null and text is not null"), "lang", "doc_id", per_language))  # per_language ids for each language
    chosen = docs.select("doc_id", "text", "lang").join(ids, ["doc_id", "lang"], "left_semi")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for lo in range(0, b.num_rows, TEXTS):
            part = b.slice(lo, TEXTS)
            vec, has = space().bundle(part.column("text").to_pylist())
            lang = np.array(part.column("lang").to_pylist(), dtype=object)
            norm = np.linalg.norm(vec, axis=1)
            for x in set(lang[has].tolist()):
                keep = has & (lang == x) & (norm > 0)
                sums[x] = sums.get(x, 0) + (vec[keep] / norm[keep, None]).sum(0).astype(float)
        rows = sorted(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float64()))], names=["lang", "v"])

    sums = arrow_map(chosen, run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    # whole thousandths: sums then don't depend on their order
    rows = sums.groupBy("lang", "k").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for lang, k, x in rows:
        out.setdefault(lang, np.zeros(DIMENSIONS))[k] = x
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score); score is the cosine with the predicted language's prototype, from 0 to 1."""
    names = list(prototypes)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    table = np.array([prototypes[x] for x in names], dtype=np.float32).reshape(-1, DIMENSIONS).T

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, b.num_rows, TEXTS):
            part = b.slice(lo, TEXTS)
            vec, has = space().bundle(part.column("text").to_pylist())
            lang, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
            if names:
                near = (vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)) @ table
                best = near.argmax(1)
                score = np.where(has, np.clip(near[np.arange(len(best)), best], 0, 1), 0).astype(float)
                lang = [names[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", *keep, "lang_pred", "score"])

    return arrow_map(docs.select("doc_id", "text", *keep), run, typed(docs, ("doc_id", *keep), "lang_pred string, score double"))
