"""Canonical exact digests of documents, by built-in functions alone.

A text's canonical form is NFKC (by the ICU library that Spark carries), case-folded, NFKC again, with every run of white space one
blank and none at the ends. Its digest is two xxhash64 values with different starts, 32 hex digits. Groups are equal digests whose
canonical bytes are equal too: grouping takes both, so that texts whose digests collide stay apart.

An exact digest has two grades of likeness: 1.0 for equal digests, 0.0 for any others.

A null text is an empty one. A null doc_id sorts first and takes part like any other. Rows that repeat a doc_id follow one another in the
order of their texts; of equal rows each is the next of the one before. The next document of the last is the first, of a single one itself.
An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, cut_points, longs, stored

#: White space that NFKC leaves as it is.
SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{1680}\x{2028}\x{2029}]+"
SECOND_START = 0x7E55E7A


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), SPACES, " "))


def digest(canon: Column) -> Column:
    """32 hex digits of a canonical text."""
    part = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(SECOND_START), canon))))


def with_next(docs: DataFrame, per_bucket: int = 4096) -> DataFrame:
    """``docs`` (doc_id and others) with a struct ``following`` of the next document's columns in ascending doc_id order.

    Buckets are ranges of doc_id whose bounds are documents; a bound also goes to the bucket before it, and the first document to the last
    bucket, so each bucket is sorted alone and no row sees a partition of all rows.
    """
    cuts = cut_points(docs.select("doc_id"), per_bucket)
    low, nulls = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    last = max(0, len(cuts) - 1)
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low).cast("long")
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # under one name, so that no column of the input clashes
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row).withColumn("bucket", bucket_of(F.col("doc_id"), cuts))
    bounds = longs(cuts[1:]) if len(cuts) > 1 else None
    is_bound = F.coalesce(F.get(bounds, F.col("bucket") - 1) == F.col("doc_id"), F.lit(False)) if bounds is not None else F.lit(False)
    if nulls and cuts:  # the least id follows the nulls, within bucket 0
        is_bound = is_bound & (F.col("bucket") > 0)
    spot = lambda b, extra: F.struct(b.cast("int").alias("b"), F.lit(extra).alias("extra"))
    spots = F.array_compact(F.array(spot(F.col("bucket"), 0), F.when(is_bound, spot(F.col("bucket") - 1, 1)), F.when(is_first, spot(F.lit(last), 2))))
    dealt = marked.select("doc_id", "row", F.explode(spots).alias("spot")).select("doc_id", "row", "spot.b", "spot.extra")
    dealt = dealt.repartitionById(max(1, len(cuts)), "b")  # a task for each bucket
    order = Window.partitionBy("b").orderBy("extra", F.col("doc_id").asc_nulls_first(), *[F.col(f"row.`{c}`") for c in names if c != "doc_id"])
    return dealt.withColumn("following", F.lead("row").over(order)).where("extra = 0").select("row.*", "following")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Digests of each text, of its edited form and their likenesses, with the exact group (``group_id``: its least doc_id; ``copies``: its documents)."""
    canon = canonical(F.coalesce("text", F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), canon.alias("c"))
    pairs = with_next(texts.select("doc_id", "text", digest(F.col("c")).alias("fingerprint"), F.sha2(F.encode("c", "UTF-8"), 256).alias("sha")))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("following.text"), F.lit(1), quarter))
    forms = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "sha", F.col("following.fingerprint").alias("next"), edited.alias("e"), canonical(edited).alias("ec"))
    forms = forms.select("doc_id", "n_chars", F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", digest(F.col("ec")).alias("edited_fingerprint"), "next", "sha")
    like = lambda other: F.when(F.col("fingerprint") == F.col(other), 1.0).otherwise(0.0)
    rows = stored(forms.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next").alias("near_next"), "sha"), "digests")
    return rows.join(groups(docs), ["fingerprint", "sha"]).drop("sha")


def groups(docs: DataFrame) -> DataFrame:
    """(fingerprint, sha, group_id, copies): one row for each distinct canonical text; ``sha`` names the text where digests collide."""
    forms = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.coalesce("text", F.lit(""))).alias("c")).select("doc_id", digest(F.col("c")).alias("fingerprint"), "c")
    each = forms.groupBy("fingerprint", "c").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    return each.select("fingerprint", F.sha2(F.encode("c", "UTF-8"), 256).alias("sha"), "group_id", "copies")
