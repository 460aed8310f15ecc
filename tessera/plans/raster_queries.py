"""Queries on tiles and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import features, landmarks, raster, regions
from tessera.plans.registry import query
from tessera.sources.fixtures import fixture

IMAGE, SLIDE = ["image_id"], ["slide_id"]


@query("f2_images", sql="""
SELECT image_id, tile_id, x0, y0, w, h FROM (
 SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY y0, x0) - 1 AS tile_id, x0, y0, least(512, width - x0) AS w, least(512, height - y0) AS h
 FROM (SELECT *, unnest(range(0, CAST(height AS BIGINT), 487)) AS y0 FROM (SELECT *, unnest(range(0, CAST(width AS BIGINT), 487)) AS x0 FROM f2_images)))
WHERE NOT (x0 > 1500 AND y0 > 1000)""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.tiles(fixture(spark, sf_dir, "f2_images"), 512, 25, end=(1500, 1000))


@query("f1_rgb", sql="""
SELECT * FROM (SELECT image_id, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r, round(avg(g), 6) AS mean_g, round(stddev_pop(g), 6) AS std_g,
 round(avg(b), 6) AS mean_b, round(stddev_pop(b), 6) AS std_b FROM f1_rgb GROUP BY image_id)
WHERE NOT ((std_r < 30 AND std_g < 72 AND std_b < 72) OR (mean_r > 124 AND mean_g > 124 AND mean_b > 124))""")
def tile_stats_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = ("r", "g", "b")
    stats = raster.tile_stats(fixture(spark, sf_dir, "f1_rgb"), IMAGE, rgb)
    stats = stats.select("image_id", *(F.round(c, 6).alias(c) for c in stats.columns[1:]))
    flat = (F.col("std_r") < 30) & (F.col("std_g") < 72) & (F.col("std_b") < 72)
    return stats.filter(~flat & raster.not_empty(rgb, 0, 124))


@query("f1_rgb", sql="""
WITH d AS (SELECT *, greatest(r, g, b) AS hi, CAST(greatest(r, g, b) - least(r, g, b) AS DOUBLE) AS df FROM f1_rgb),
t AS (SELECT *, CASE WHEN df = 0 THEN 0 WHEN b = hi THEN ((r - g) / df + 4.0) * 60 WHEN g = hi THEN ((b - r) / df + 2.0) * 60 ELSE (g - b) / df * 60 END AS a FROM d)
SELECT image_id, x, y, round(CASE WHEN a < 0 THEN a + 360 WHEN a > 360 THEN a - 360 ELSE a END, 6) AS h,
 round(CASE WHEN hi > 0 THEN df / hi ELSE 0.0 END, 6) AS s, CAST(hi AS DOUBLE) AS v FROM t""")
def hsv_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, s, v = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    return fixture(spark, sf_dir, "f1_rgb").select("image_id", "x", "y", F.round(h, 6).alias("h"), F.round(s, 6).alias("s"), v.alias("v"))


@query("f1_rgb", sql="""
SELECT image_id, x, y, round(CASE WHEN stddev_pop(r) OVER w > 1e-8 THEN (r - avg(r) OVER w) / stddev_pop(r) OVER w ELSE 0 END, 5) AS c0,
 round(CASE WHEN stddev_pop(g) OVER w > 1e-8 THEN (g - avg(g) OVER w) / stddev_pop(g) OVER w ELSE 0 END, 5) AS c1,
 round(CASE WHEN stddev_pop(b) OVER w > 1e-8 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE 0 END, 5) AS c2 FROM f1_rgb WINDOW w AS (PARTITION BY image_id)""")
def trgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = color.converted(fixture(spark, sf_dir, "f1_rgb"), 1)
    return out.select("image_id", "x", "y", *(F.round(f"c{i}", 5).alias(f"c{i}") for i in range(3)))


@query("f1_rgb", sql="SELECT image_id, x, y, round((r + g + b) / 3.0, 6) AS gray FROM f1_rgb")
def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "f1_rgb").select("image_id", "x", "y", F.round(color.gray(F.col("r"), F.col("g"), F.col("b")), 6).alias("gray"))


@query("f1_pixels", sql="""
WITH h AS (SELECT image_id, v, count(*) AS n FROM f1_pixels GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS below, CAST(sum(n * v) OVER u AS DOUBLE) AS mass, CAST(sum(n) OVER w AS DOUBLE) AS total, CAST(sum(n * v) OVER w AS DOUBLE) AS s FROM h
 WINDOW w AS (PARTITION BY image_id), u AS (PARTITION BY image_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT image_id, v, round(CASE WHEN total > below THEN below * (total - below) * (mass / below - (s - mass) / (total - below)) * (mass / below - (s - mass) / (total - below)) ELSE 0 END, 6) AS q FROM c)
SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY q DESC, v) AS r FROM b) WHERE r = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.otsu(fixture(spark, sf_dir, "f1_pixels"), IMAGE)


@query("f1_pixels", sql="""
WITH s AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM f1_pixels GROUP BY 1),
g AS (SELECT image_id, lo, hi, unnest(range(CAST(lo AS BIGINT), hi + 1)) AS t FROM s WHERE lo < hi),
h AS (SELECT image_id, v, count(*) AS n FROM f1_pixels GROUP BY 1, 2),
m AS (SELECT g.image_id, lo, hi, t, sum(CASE WHEN v <= t THEN n * v END) / sum(CASE WHEN v <= t THEN n END) AS a,
 sum(CASE WHEN v > t AND v < hi THEN n * v END) / sum(CASE WHEN v > t AND v < hi THEN n END) AS b FROM g JOIN h ON h.image_id = g.image_id GROUP BY 1, 2, 3, 4),
f AS (SELECT *, (a + b) / 2.0 AS mid, row_number() OVER (PARTITION BY image_id ORDER BY t) AS r FROM m WHERE t + 2 > (a + b) / 2.0 OR t + 1 >= hi - 1)
SELECT s.image_id, CAST(coalesce(round(mid), CASE WHEN s.lo >= s.hi THEN 128 END) AS INT) AS threshold FROM s LEFT JOIN f ON f.image_id = s.image_id AND r = 1""")
def isodata_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.isodata(fixture(spark, sf_dir, "f1_pixels"), IMAGE)


@query("f1_slide", sql="""
WITH i AS (SELECT slide_id, x, y, v, sum(v) OVER (PARTITION BY slide_id, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s, count(*) OVER (PARTITION BY slide_id, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM f1_slide),
j AS (SELECT slide_id, x, y, v, sum(s) OVER w / sum(n) OVER w AS mean FROM i WINDOW w AS (PARTITION BY slide_id, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT slide_id, x, y, CASE WHEN v > mean - 5 THEN 255 ELSE 0 END AS m FROM j""")
def adaptive_box_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.adaptive_box(fixture(spark, sf_dir, "f1_slide").drop("m"), SLIDE, 3, 5).select("slide_id", "x", "y", "m")


@query("f1_slide", sql="""
SELECT slide_id, x, y, CAST(sum(r) OVER (PARTITION BY slide_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s
FROM (SELECT slide_id, x, y, sum(v) OVER (PARTITION BY slide_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS r FROM f1_slide)""")
def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.integral(fixture(spark, sf_dir, "f1_slide"), SLIDE).select("slide_id", "x", "y", "s")


@query("f1_pixels", sql="""
WITH b AS (SELECT image_id, x, y, v FROM f1_pixels),
p AS (SELECT image_id, x AS px, y AS py FROM b WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5),
r AS (SELECT * FROM (VALUES (0, 'h2', 1, -2, -1, -2, 1), (0, 'h2', -1, 0, 1, -2, 1), (1, 'v2', 1, -1, 2, -2, -1), (1, 'v2', -1, -1, 2, 0, 1),
 (2, 'sq', 1, -2, -1, -2, -1), (2, 'sq', -1, 0, 1, -2, -1), (2, 'sq', -1, -2, -1, 0, 1), (2, 'sq', 1, 0, 1, 0, 1)) t(f, kind, sign, xa, xb, ya, yb)),
c AS (SELECT f, kind, CASE WHEN kind = 'h2' THEN -sign ELSE sign END AS sign, xa, xb, ya, yb FROM r)
SELECT p.image_id, px AS x, py AS y, f, CAST(sum(sign * v) AS BIGINT) AS d FROM p CROSS JOIN c JOIN b ON b.image_id = p.image_id
 AND b.x BETWEEN px + xa AND px + xb AND b.y BETWEEN py + ya AND py + yb GROUP BY 1, 2, 3, 4""")
def haar_h2_v2_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = fixture(spark, sf_dir, "f1_pixels")
    points = pixels.filter("x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5").select("image_id", "x", "y")
    return features.haar_sql(pixels, points, [("h2", -2, -2, 1, 1), ("v2", -1, -2, 2, 1), ("sq", -2, -2, 1, 1)])


@query("f1_pixels", sql="""
WITH o AS (SELECT * FROM (VALUES (0, 1, 2), (1, -3, 0), (2, 0, -2), (3, 4, 4)) t(f, dx, dy))
SELECT a.image_id, a.x, a.y, f, a.v - b.v AS d FROM f1_pixels a CROSS JOIN o JOIN f1_pixels b ON b.image_id = a.image_id
 AND b.x = greatest(0, least(7, a.x + dx)) AND b.y = greatest(0, least(7, a.y + dy))""")
def gaussian_offset_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.offset_differences(fixture(spark, sf_dir, "f1_pixels").drop("label"), [(1, 2), (-3, 0), (0, -2), (4, 4)], 8, 8)


@query("f1_pixels", sql="""
SELECT image_id, k, CAST(floor(x / pow(2, k)) AS INT) AS x, CAST(floor(y / pow(2, k)) AS INT) AS y, round(avg(v), 6) AS v FROM f1_pixels, (SELECT unnest(range(0, 4)) AS k) GROUP BY 1, 2, 3, 4""")
def pyramid_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pyramid(fixture(spark, sf_dir, "f1_pixels"), IMAGE, 4).withColumn("v", F.round("v", 6))


@query("f1_slide", sql="""
WITH a AS (SELECT slide_id, x, y, min(m) OVER w AS e, max(m) OVER w AS d FROM f1_slide WINDOW w AS (PARTITION BY slide_id, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT slide_id, x, y, min(e) OVER w AS eroded, max(d) OVER w AS dilated FROM a WINDOW w AS (PARTITION BY slide_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def erode_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fixture(spark, sf_dir, "f1_slide").select("slide_id", "x", "y", F.col("m").alias("eroded"), F.col("m").alias("dilated"))
    return raster.dilate(raster.erode(both, SLIDE, 2, value="eroded"), SLIDE, 2, value="dilated")


def _clean_sql() -> str:
    steps, last = [], "f1_slide"
    for i, (hit, a, b) in enumerate(raster.HIT_OR_MISS):
        at = lambda o: f"coalesce((SELECT o.m FROM {last} o WHERE o.slide_id = c.slide_id AND o.y = c.y + ({o[0]}) AND o.x = c.x + ({o[1]})), 0)"  # noqa: B023, E731
        steps.append(f"p{i} AS MATERIALIZED (SELECT slide_id, x, y, CASE WHEN m = 1 AND {at(hit)} = 1 AND {at(a)} = 0 AND {at(b)} = 0 THEN 0 ELSE m END AS m FROM {last} c)")
        last = f"p{i}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT slide_id, x, y, m FROM {last}"


@query("f1_slide", sql=_clean_sql())
def hit_or_miss_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.hit_or_miss(fixture(spark, sf_dir, "f1_slide"), SLIDE).select("slide_id", "x", "y", "m")


RUNS = "r AS (SELECT slide_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT slide_id, y, x, x - row_number() OVER (PARTITION BY slide_id, y ORDER BY x) AS g FROM f1_slide WHERE m = 1) GROUP BY slide_id, y, g)"
OBJECTS = RUNS + """,
n AS (SELECT *, row_number() OVER (ORDER BY slide_id, y, x0) AS id FROM r),
e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.slide_id = b.slide_id AND b.y = a.y + 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w AS (SELECT id AS v, id AS label FROM n UNION SELECT l.b, w.label FROM w JOIN l ON l.a = w.v WHERE w.label < l.b),
c AS (SELECT v, min(label) AS label FROM w GROUP BY v),
o AS (SELECT f.slide_id, f.y AS first_y, f.x0 AS first_x, CAST(sum(n.x1 - n.x0 + 1) AS BIGINT) AS area, min(n.x0) AS "left", min(n.y) AS top, max(n.x1) AS "right", max(n.y) AS bottom
 FROM c JOIN n ON n.id = c.v JOIN n f ON f.id = c.label GROUP BY 1, 2, 3)"""


@query("f1_slide", sql=f"WITH {RUNS} SELECT * FROM r")
def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.runs(fixture(spark, sf_dir, "f1_slide"), SLIDE)


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.areas(regions.labelled(regions.runs(fixture(spark, sf_dir, "f1_slide"), SLIDE), SLIDE), SLIDE)


@query("f1_slide", sql=f"WITH RECURSIVE {OBJECTS} SELECT * FROM o WHERE area BETWEEN 3 AND 60")
def components_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir).filter(regions.within(F.col("area"), 3, 60))


@query("f1_slide", sql=f"WITH RECURSIVE {OBJECTS}, k AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY area DESC, first_y, first_x) AS r FROM o) SELECT slide_id, first_y, first_x, area FROM k WHERE r > 1 AND area > 2 AND area < 1000")
def drop_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = regions.without_largest(_objects(spark, sf_dir), SLIDE)
    return rest.filter(regions.within(F.col("area"), 2, 1000, strict=True)).select("slide_id", "first_y", "first_x", "area")


@query("f1_slide", sql="""
SELECT slide_id, x, y, v FROM f1_slide a WHERE NOT EXISTS (SELECT 1 FROM (SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE dx*dx + dy*dy BETWEEN 1 AND 4) o
 JOIN f1_slide b ON b.slide_id = a.slide_id AND b.x = a.x + o.dx AND b.y = a.y + o.dy WHERE b.v > a.v)""")
def nms_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.suppressed(fixture(spark, sf_dir, "f1_slide").drop("m"), SLIDE, 2).select("slide_id", "x", "y", "v")


@query("f1_pixels", sql="SELECT image_id, x, y, v FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS r FROM f1_pixels WHERE v > 0) WHERE r <= 5")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixture(spark, sf_dir, "f1_pixels").select("image_id", F.lit(0).alias("term_id"), "x", "y", F.col("v").alias("p"))
    return landmarks.top_candidates(points, 5).select("image_id", "x", "y", F.col("p").alias("v"))
