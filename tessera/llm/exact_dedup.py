"""Exact dedup by skew-safe combining: equal texts meet locally, then by salted digest, then once more without salt.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import WHITE_SPACE, fresh, written

#: A hot text meets in this many groups before the last, so no task sees more than its share of a group of copies.
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are identical. The digest routes rows; the normalised text itself is a
    grouping key at every stage (in the map-side combine, the salted merge and the last combine), so a digest that two
    texts share would still give two groups. Rows find their group by digest alone once it is proven that no digest has
    two texts; digests that do have two are matched on the whole text.

    Null texts count as ''. Null ids sort after all others: a group keeps its smallest id that is not null, and has a
    null keep_id if there is none. Of repeated rows with the id that stays, every one has that keep_id and is marked
    kept by this function; ``keep_first`` reduces those to one. An empty table gives an empty result. Other columns of
    docs are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    merged = salted.groupBy("digest", "body", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    winners = merged.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # the first winner's body is kept only where a digest has several: else the column is null and costs nothing
    heads = written(winners.select("digest", "keep_id", "group_size", F.xxhash64("body").alias("body_hash"), F.length("body").alias("body_length")), "exact-winners")
    shared = heads.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    ids = rows.select("doc_id", "digest")
    if shared.isEmpty():
        grouped = ids.join(heads.select("digest", "keep_id", "group_size"), "digest")
    else:
        clear = heads.join(shared, "digest", "left_anti").select("digest", "keep_id", "group_size")
        by_text = winners.join(shared, "digest", "left_semi")
        grouped = ids.join(clear, "digest").unionByName(rows.join(by_text, ["digest", "body"]).select("digest", "doc_id", "keep_id", "group_size"))
    return grouped.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text a row with a smaller id has; columns as they were.

    Rows that repeat the id that stays, with the same text, are reduced to one; rows whose id is null stay only if no
    row with an id has their text, and then one of them does.
    """
    digest, kept_id, kept_digest = (fresh(c, docs) for c in ("digest", "kept_id", "kept_digest"))
    groups = exact_groups(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest)).distinct()
    same = F.col(digest).eqNullSafe(F.col(kept_digest)) & F.col(doc_id).eqNullSafe(F.col(kept_id))
    kept = docs.withColumn(digest, F.sha2(normalised(F.col(text)), 256)).join(groups, same, "left_semi")
    again = kept.groupBy(doc_id, digest).agg(F.count("*").alias(kept_id)).filter(F.col(kept_id) > 1)
    if again.isEmpty():
        return kept.drop(digest)
    return kept.dropDuplicates([doc_id, digest]).drop(digest)
