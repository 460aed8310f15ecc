"""Queries that fit models or ingest a stream: their rows are held against invariants, not SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation, learners
from tessera.plans.registry import query
from tessera.sources.fixtures import fixture
from tessera.streaming import tiles

FOLDS = 3


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("sample_id"), "label", F.col("embedding").alias("features"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = evaluation.stratified_folds(_samples(spark, sf_dir), FOLDS)
    return rows.filter("fold <> 0").drop("fold"), rows.filter("fold = 0").drop("fold")


@query()
def extra_trees_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir)
    return learners.cross_validated(rows, evaluation.stratified_folds(rows, FOLDS), 10, FOLDS, trees=4, k=8, depth=5, min_split=10)


@query()
def voting_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample and tree: the trees' own outputs, not their mean."""
    train, test = _split(spark, sf_dir)
    target = lambda df: df.withColumn("label", F.array(F.col("features")[0], F.col("features")[1]))
    nodes = learners.fit_trees(target(train), trees=4, k=8, depth=5, min_split=10)
    return learners.apply_trees(test, nodes).select("sample_id", "tree_id", F.round(F.col("value")[0], 6).alias("out0"), F.round(F.col("value")[1], 6).alias("out1"))


def _final(code: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = _split(spark, sf_dir)
        return learners.classified(train, test, code, **({"trees": 50} if code == "rf" else {}))

    run.__name__ = code
    return run


lr_l1, lr_l2, svm, rf = (query()(_final(code)) for code in ("lr_l1", "lr_l2", "svm", "rf"))


@query()
def stream_tile_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide_id, tiles, foreground): tiles arriving as files, one of them twice, thresholded and counted once each."""
    slide = fixture(spark, sf_dir, "f1_slide").select("slide_id", F.floor(F.col("x") / 8).cast("int").alias("tx"), F.floor(F.col("y") / 8).cast("int").alias("ty"), "v")
    return tiles.ingest_twice(slide)
