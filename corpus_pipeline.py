"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, as a table on disk, and returns the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linedup, packing, quality, simhash, suffix
from tessera.llm.common import discard, stored, table
from tessera.llm.queries import held_out, vocabulary


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns as in op10."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    model = quality.fit(docs.where(~held_out()), labels)
    return quality.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line is like; documents that lose all lines stay, empty."""
    return _counted(linedup.dedup(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the least doc_id."""
    return simhash.one_of_each(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 200-byte strings; of characters that this would cut, nothing stays."""
    return _counted(suffix.cleaned(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of 2048 tokens and its place there."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", one_of_each_group),
    ("suffix-array dedup", drop_repeated_strings),
    ("best-fit packing", pack_sequences),
]

#: SimHash components, suffix matches and the classifier are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
