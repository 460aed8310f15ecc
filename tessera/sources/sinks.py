"""Writing annotations, predictions, landmarks and error tables: SNK-01 to SNK-08."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.landmarks import error_matrix, wide


def append(df: DataFrame, path: str, by: str = "image_id") -> None:
    """Append rows to a table that is partitioned by image. SNK-01, SNK-02."""
    df.write.mode("append").partitionBy(by).parquet(path)


def without(table: DataFrame, deleted: DataFrame, key: str = "annotation_id") -> DataFrame:
    """The rows that aren't deleted. SNK-04."""
    return table.join(deleted.select(key), key, "left_anti")


def landmark_text(landmarks: DataFrame, path: str) -> None:
    """A folder per image of lines `term x y xr yr`. SNK-05."""
    line = F.format_string("%d %d %d %f %f", "term_id", "x", "y", "xr", "yr")
    landmarks.select("image_id", line.alias("value")).repartition("image_id").sortWithinPartitions("image_id", "value").write.partitionBy("image_id").text(path)


def landmark_csv(landmarks: DataFrame, names: dict[int, str], path: str, images: DataFrame | None = None) -> None:
    """One line per image, `name_x;name_y` per term, -1 where there is none. SNK-06, JOIN-14. images: those without any
    landmark have a line too."""
    table = wide(landmarks, sorted(names))
    if images is not None:
        table = images.select("image_id").join(table, "image_id", "left")
    cell = lambda c: F.when(F.col(c).isNull(), "-1").otherwise(F.format_string("%3.3f", F.col(c).cast("double")))
    columns = [cell(f"{t}_{c}").alias(f"{names[t]}_{c}") for t in sorted(names) for c in "xy"]
    table.select(F.col("image_id").alias("ID_IMAGE"), *columns).write.option("sep", ";").option("header", True).csv(path)


def crops(found: DataFrame, failures: DataFrame, path: str) -> None:
    """Both tables of `images.crops_and_failures`, under crops and failures. UDF-07."""
    found.write.parquet(f"{path}/crops")
    failures.write.parquet(f"{path}/failures")


def error_csv(predictions: DataFrame, terms: list[int], path: str) -> None:
    """Errors by image and term, averages at the end of lines and in a last line. SNK-07."""
    cells = error_matrix(predictions).select(F.coalesce(F.col("image_id").cast("string"), F.lit("term_avg")).alias("image"), F.coalesce(F.col("term_id").cast("string"), F.lit("img_avg")).alias("term"), "err")
    table = cells.groupBy("image").pivot("term", [*map(str, terms), "img_avg"]).agg(F.first("err"))
    table.orderBy(F.col("image") == "term_avg", "image").write.option("sep", ";").option("header", True).csv(path)


def save_model(nodes: DataFrame, classes: DataFrame, parameters: dict[str, str], path: str) -> None:
    """A forest as tables: nodes, classes, parameters. SNK-08."""
    spark = nodes.sparkSession
    nodes.write.parquet(f"{path}/nodes")
    classes.write.parquet(f"{path}/classes")
    spark.createDataFrame([(k, str(v)) for k, v in parameters.items()], "key string, value string").write.parquet(f"{path}/parameters")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """SRC-20."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/classes"), {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/parameters").collect()}
