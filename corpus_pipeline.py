"""A corpus pipeline: documents in, token ids out. Each stage calls one operator of tessera.llm on all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, mixture, pieces, toxicity
from tessera.llm.queries import MIX_WEIGHTS, MODEL_FILE
from tessera.llm.shared import documents, fresh, written


#: Bytes of texts that go to Python at a time. Spark counts rows by default: 10,000 texts are 50 MB or more, held by the JVM and
#: by its worker at once, and twice while a buffer grows; what an executor took for that once it keeps.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session are of BATCH_BYTES at most, or of one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    small_batches(spark)
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    toxic = fresh("toxicity", docs)
    return toxicity.score(docs, model, into=toxic, keep_text=True).filter(F.col(toxic) < 0.5).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return jaccard_join.one_per_component(docs)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rate says; rates are 1 or more, so no document is lost."""
    names = tuple(fresh(c, docs) for c in ("n_tokens", "p", "rate", "copies"))
    mixed = mixture.mix(docs, _labels(spark, sf_dir), MIX_WEIGHTS, least=1.0, keep_text=True, names=names)
    return mixture.repeated(mixed, docs.columns, names[-1])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text."""
    small_batches(spark)
    return pieces.encode(docs, MODEL_FILE)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", weighted),
    ("sentencepiece", encoded),
]

#: SQL can't express the fitted models, the tokenizer and the rates; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each one's rows written and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
