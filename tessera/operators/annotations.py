"""Annotation sets: SRC-08 to SRC-11, FIL-01, FIL-02, FIL-14, FIL-18 to FIL-22, JOIN-03, JOIN-09, JOIN-13, JOIN-14, SET-01, SET-02."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select(annotations: DataFrame, projects: Sequence[int] | None = None, images: Sequence[int] | None = None, users: Sequence[int] | None = None, term: int | None = None, excluded: Sequence[int] = (), reviewed_only: bool = False) -> DataFrame:
    """Annotations by project, image, owner, term and review; those that carry an excluded term are left out.

    Plain predicates on columns, so that a Parquet scan gets them.
    """
    out = annotations
    for column, wanted in (("project_id", projects), ("image_id", images), ("user_id", users)):
        if wanted is not None:
            out = out.filter(F.col(column).isin(list(wanted)))
    if reviewed_only:
        out = out.filter("reviewed")
    if term is not None:
        out = out.filter(F.array_contains("terms", term))
    if excluded:
        out = out.filter(~F.arrays_overlap("terms", F.array(*map(F.lit, excluded))))
    return out


def together(parts: Sequence[DataFrame]) -> DataFrame:
    """The bag union of annotation sets. SET-01."""
    return reduce(DataFrame.unionByName, parts)


def first_term(annotations: DataFrame) -> DataFrame:
    """Annotations with a term, with the first as term_id. FIL-18."""
    return annotations.filter(F.size("terms") > 0).withColumn("term_id", F.element_at("terms", 1))


def per_term(annotations: DataFrame) -> DataFrame:
    """One row per annotation and term. FIL-22."""
    return annotations.withColumn("term_id", F.explode("terms"))


def first_class(annotations: DataFrame, class_map: DataFrame) -> DataFrame:
    """annotations with cls: of their terms in order, the first class that isn't 0; 0 if there is none; -1 leaves the
    annotation out. JOIN-09. class_map: term_id, cls (one row per term, a small table that Spark broadcasts if it fits)."""
    terms = annotations.select("annotation_id", F.posexplode("terms").alias("pos", "term_id")).join(class_map.filter("cls <> 0"), "term_id")
    first = terms.groupBy("annotation_id").agg(F.min_by("cls", "pos").alias("cls"))
    return annotations.join(first, "annotation_id", "left").withColumn("cls", F.coalesce("cls", F.lit(0))).filter("cls <> -1")


def only(df: DataFrame, column: str, wanted: str | Sequence[int] = "all") -> DataFrame:
    """'all', or the rows whose id is listed. FIL-14, JOIN-10."""
    return df if wanted == "all" else df.filter(F.col(column).isin(list(wanted)))


def in_fold(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a table of keys. JOIN-10."""
    return df.join(chosen.select(key), key, "left_semi")


def predicted(annotations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Annotations with their prediction; those without one are left out. JOIN-03, FIL-20."""
    return annotations.join(predictions, "annotation_id")


def reclassified(predictions: DataFrame, again: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """(relabelled predictions, the comparison): a second classifier's term takes the place of the first where it differs
    from the target; accepted says where it doesn't. JOIN-13, FIL-19, SNK-03."""
    both = predictions.join(again.select("annotation_id", F.col("term").alias("new_term"), F.col("rate").alias("new_rate")), "annotation_id").withColumn("accepted", F.col("new_term") == target)
    rejected = both.filter(~F.col("accepted"))
    kept = predictions.join(rejected.select("annotation_id"), "annotation_id", "left_anti")
    changed = rejected.select("annotation_id", F.col("new_term").alias("term"), F.col("new_rate").alias("rate"))
    return kept.select("annotation_id", "term", "rate").unionByName(changed), both


def clamp(value: Column, size: Column) -> Column:
    """A coordinate within 0 .. size - 1. FIL-15."""
    return F.greatest(F.lit(0), F.least(value, size - 1))


def strided(df: DataFrame, column: str, step: int, start: int = 0) -> DataFrame:
    """Every step-th coordinate. FIL-21."""
    return df.filter(F.pmod(F.col(column) - start, F.lit(step)) == 0)


def inside(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Rows whose x, y are in the image. FIL-16."""
    return df.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
