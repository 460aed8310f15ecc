"""Tiles as a stream of files: STM-01, STM-02, SRC-19."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.storage import cut

KEYS = ("slide_id", "tx", "ty")


def tile_rows(pixels: DataFrame) -> DataFrame:
    """One row per tile with its values. pixels: slide_id, tx, ty, v."""
    return pixels.groupBy(*KEYS).agg(F.sort_array(F.collect_list("v")).alias("values"))


def foreground(tiles: DataFrame, threshold: int) -> DataFrame:
    """tiles with how many values are above the threshold: no state, so it appends. RAS-01."""
    return tiles.withColumn("foreground", F.size(F.filter("values", lambda v: v > threshold)))


def counted(stream: DataFrame, threshold: int = 135) -> DataFrame:
    """(slide_id, tiles, foreground) of a stream of tiles, each tile once however often it arrives."""
    once = foreground(stream, threshold).dropDuplicates(list(KEYS))
    return once.groupBy("slide_id").agg(F.count("*").alias("tiles"), F.sum("foreground").alias("foreground"))


def read(spark, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """The counts after all files that are there: an update-mode query into the shared folder, of which the last version
    of each slide counts."""
    spark = stream.sparkSession
    target = f"{folder}/{name}-counts"

    def put(batch: DataFrame, version: int) -> None:
        batch.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{target}/batch={version}")

    query = counted(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    versions = spark.read.parquet(target)
    return versions.groupBy("slide_id").agg(F.max_by("tiles", "version").alias("tiles"), F.max_by("foreground", "version").alias("foreground"))


def ingest_twice(pixels: DataFrame) -> DataFrame:
    """Write the tiles as files, a part of them twice, and count them as a stream."""
    spark = pixels.sparkSession
    tiles = cut(tile_rows(pixels))
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tiles-{uuid.uuid4().hex}"
    tiles.repartition("slide_id").write.mode("append").parquet(f"{folder}/in")
    tiles.filter("slide_id % 2 = 0").repartition("slide_id").write.mode("append").parquet(f"{folder}/in")
    return ingest(read(spark, f"{folder}/in", tiles.schema), folder, "tiles")
