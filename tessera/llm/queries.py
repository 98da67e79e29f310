"""Queries over the training-data tables, each on the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, digest, langid, linedup, packing, quality, simhash, suffix, tokenfile, vectors
from tessera.llm.common import new_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> F.Column:
    """crc32 of doc_id as text, mod 4, is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(spark, path).drop("ids")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.components(table(spark, sf_dir, "embeddings"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    return langid.predict(docs.drop("lang"), langid.fit(docs.where("not held_out")), keep=("held_out",))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    scored = quality.score(docs, quality.fit(docs.where("not held_out"), labels), keep=("held_out",))
    return scored.withColumn("predicted", (F.col("score") >= quality.ACCEPT).cast("int"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_token_files, op3_simhash, op4_fingerprints, op5_line_dedup, op6_packing, op7_embeddings, op8_suffix_array, op9_language, op10_quality, pipeline)}


#: The links of op7 by all pairs of a label, and what each vector reaches.
OP7_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT vec_id, vec_id AS r FROM embeddings
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r
), least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1), degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degree ON a = vec_id
"""


#: Lines whose set of five-word shingles, or all of whose words, is like an earlier line's; every pair with a token in common is counted.
OP5_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), worded AS (
    SELECT doc_id, i, raw, list_filter(regexp_split_to_array(lower(raw), '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM lines
), named AS (
    SELECT doc_id, i, raw, w, array_to_string(w, ' ') AS name FROM worded
), firsts AS (
    SELECT name, min((doc_id, i)) AS place, any_value(w) AS w FROM named WHERE len(w) > 0 GROUP BY name
), tokens AS (
    SELECT name, place, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [name] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS t FROM firsts
), sizes AS (SELECT name, count(*) AS n FROM tokens GROUP BY name
), alike AS (
    SELECT a.name, b.name AS other, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND b.place < a.place GROUP BY 1, 2
), gone AS (
    SELECT DISTINCT alike.name FROM alike JOIN sizes x ON x.name = alike.name JOIN sizes y ON y.name = alike.other WHERE 9 * c >= 4 * (x.n + y.n)
), judged AS (
    SELECT named.*, len(named.w) > 0 AND (gone.name IS NOT NULL OR (doc_id, i) <> place) AS removed FROM named LEFT JOIN firsts ON firsts.name = named.name LEFT JOIN gone ON gone.name = named.name
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op7_embeddings": OP7_SQL}
