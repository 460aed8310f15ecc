"""Regions as runs, zones, borders and thresholds, each beside SQL that works pixel by pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import annotations, features, raster, regions, spatial
from tessera.plans.registry import query
from tessera.sources.fixtures import fixture

SLIDE = ["slide_id"]
#: Runs of the pixels p(slide_id, x, y) in SQL.
RUNS = "SELECT slide_id, y, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1 FROM (SELECT slide_id, y, x, x - row_number() OVER (PARTITION BY slide_id, y ORDER BY x) AS g FROM p) GROUP BY slide_id, y, g"


def _runs(spark: SparkSession, sf_dir: str, rule: str = "m = 1") -> DataFrame:
    return regions.runs(fixture(spark, sf_dir, "f1_slide").withColumn("on", F.expr(rule).cast("int")), SLIDE, "on")


@query("f1_pixels", sql="SELECT image_id, x, y, CASE WHEN v > 128 THEN 255 ELSE 0 END AS v FROM f1_pixels")
def binary_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.binary(fixture(spark, sf_dir, "f1_pixels").drop("label"), F.lit(128)).select("image_id", "x", "y", "v")


@query("f1_pixels", sql="""
WITH i AS (SELECT DISTINCT image_id FROM f1_pixels), g AS (SELECT image_id, x, y FROM i, (SELECT unnest(range(12)) AS x), (SELECT unnest(range(12)) AS y))
SELECT g.image_id, CAST(g.x AS INT) AS x, CAST(g.y AS INT) AS y, coalesce(v, 7) AS v FROM g LEFT JOIN f1_pixels f ON f.image_id = g.image_id AND f.x + 2 = g.x AND f.y + 2 = g.y""")
def constant_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = fixture(spark, sf_dir, "f1_pixels").drop("label")
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return raster.padded(pixels, ["image_id"], sizes, 2, 7)


@query("f1_slide", sql=f"WITH p AS (SELECT slide_id, x, y FROM f1_slide WHERE m = 1 AND x BETWEEN 5 AND 60 AND y BETWEEN 9 AND 40) {RUNS}")
def region_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.clipped(_runs(spark, sf_dir), *map(F.lit, (5, 9, 60, 40))).select("slide_id", "y", "x0", "x1")


@query("f1_slide", sql=f"WITH p AS (SELECT slide_id, x, y FROM f1_slide WHERE m = 1 AND v % 3 <> 0) {RUNS}")
def region_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.common(_runs(spark, sf_dir), _runs(spark, sf_dir, "v % 3 <> 0"), SLIDE).select("slide_id", "y", "x0", "x1")


@query("f1_slide", sql=f"""
WITH o AS (SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE dx*dx + dy*dy <= 4),
p AS (SELECT DISTINCT slide_id, x + dx AS x, CAST(y + dy AS INT) AS y FROM f1_slide, o WHERE m = 1) {RUNS}""")
def region_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.grown(_runs(spark, sf_dir), SLIDE, 2).select("slide_id", F.col("y").cast("int").alias("y"), "x0", "x1")


@query("f1_slide", sql=f"""
WITH o AS (SELECT dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy) WHERE dx*dx + dy*dy <= 1),
p AS (SELECT a.slide_id, a.x, a.y FROM f1_slide a, o JOIN f1_slide b ON b.slide_id = a.slide_id AND b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.m = 1 WHERE a.m = 1 GROUP BY 1, 2, 3 HAVING count(*) = 5) {RUNS}""")
def region_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.shrunk(_runs(spark, sf_dir), SLIDE, 1).select("slide_id", F.col("y").cast("int").alias("y"), "x0", "x1")


@query("f1_slide", sql="SELECT slide_id AS image_id, x, y, CASE WHEN m = 1 THEN v ELSE 0 END AS v FROM f1_slide")
def pixels_outside_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).withColumnRenamed("slide_id", "image_id")
    return spatial.outside_zero(fixture(spark, sf_dir, "f1_slide").withColumnRenamed("slide_id", "image_id"), runs, "v")


@query("f2_images", "f3_boxes", sql="""
SELECT DISTINCT i.image_id, CAST(t.x0 AS INT) AS x0, CAST(t.y0 AS INT) AS y0 FROM f2_images i, LATERAL (SELECT unnest(range(0, i.width, 128)) AS x0) x, LATERAL (SELECT unnest(range(0, i.height, 128)) AS y0) y, LATERAL (SELECT x.x0, y.y0) t
JOIN f3_boxes b ON b.image_id = i.image_id AND b.x0 <= least(t.x0 + 127, i.width - 1) AND b.x0 + b.w - 1 >= t.x0 AND b.y0 <= least(t.y0 + 127, i.height - 1) AND b.y0 + b.h - 1 >= t.y0""")
def tiles_over_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "f3_boxes").select("image_id", F.col("y0").alias("y"), (F.col("y0") + F.col("h") - 1).alias("y1"), "x0", (F.col("x0") + F.col("w") - 1).alias("x1"))
    return spatial.tiles_over(raster.tiles(fixture(spark, sf_dir, "f2_images"), 128), rows).select("image_id", "x0", "y0")


@query("f3_boxes", sql="SELECT annotation_id, t AS term_id FROM (SELECT annotation_id, term1 AS t FROM f3_boxes UNION ALL SELECT annotation_id, term2 FROM f3_boxes)")
def terms_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.per_term(fixture(spark, sf_dir, "f3_boxes").withColumn("terms", F.array("term1", "term2"))).select("annotation_id", "term_id")


@query("f4_landmarks", sql="""
SELECT image_id, term_id, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y FROM f4_landmarks, (SELECT unnest(range(-3, 4, 3)) AS dx), (SELECT unnest(range(-3, 4, 3)) AS dy) WHERE dx*dx + dy*dy <= 9""")
def landmark_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.disc(fixture(spark, sf_dir, "f4_landmarks"), 3, 3).select("image_id", "term_id", "x", "y")


@query("f2_images", sql="""
SELECT image_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(i * ceil(width / 4.0) AS BIGINT) AS x0, CAST(j * ceil(height / 3.0) AS BIGINT) AS y0, CAST(ceil(width / 4.0) AS BIGINT) AS w, CAST(ceil(height / 3.0) AS BIGINT) AS h
FROM f2_images, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(3)) AS j)""")
def zone_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spatial.zones(fixture(spark, sf_dir, "f2_images"), 4, 3)
    return z.select("image_id", "i", "j", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "w", "h")))
