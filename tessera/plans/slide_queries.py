"""Queries on whole slides as blocks: forests applied to every pixel, local thresholds, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features, raster, regions, slides
from tessera.plans.registry import query
from tessera.sources.fixtures import fixture

SLIDE = ["slide_id"]
#: A forest whose outputs are a line in the pixel's place i of a 4 x 4 window: (tree, node, feature, threshold, start, slope).
NODES = ((0, 1, 5, 135.0, None, None), (0, 2, None, None, 0.1, 0.01), (0, 3, None, None, 0.9, -0.03),
         (1, 1, 10, 120.0, None, None), (1, 2, None, None, 0.15, 0.02), (1, 3, 0, 150.0, None, None), (1, 6, None, None, 0.55, 0.01), (1, 7, None, None, 0.8, -0.02))
WINDOW = 4


def _sizes(pixels: DataFrame, key: str) -> DataFrame:
    return pixels.groupBy(key).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _forest(spark: SparkSession) -> DataFrame:
    rows = []
    for tree, node, feature, threshold, start, slope in NODES:
        ones = [] if start is None else [start + slope * i for i in range(WINDOW * WINDOW)]
        rows.append((tree, node, feature, threshold, start is not None, [p for one in ones for p in (1 - one, one)] or [0.0] * 2 * WINDOW * WINDOW, 1))
    return spark.createDataFrame(rows, "tree_id int, node long, feature int, threshold double, leaf boolean, value array<double>, n long")


@query("f1_slide", sql="""
WITH s AS (SELECT slide_id, max(x) + 1 AS width, max(y) + 1 AS height FROM f1_slide GROUP BY 1),
t AS (SELECT DISTINCT slide_id, tx, ty FROM (SELECT slide_id, tx, ty, avg(v) AS mean FROM f1_slide, range(5) a(tx), range(5) b(ty) WHERE x >= 18 * tx AND x < 18 * tx + 20 AND y >= 18 * ty AND y < 18 * ty + 20 GROUP BY 1, 2, 3) WHERE mean <= 128),
w AS (SELECT s.slide_id, 2 * i AS cx, 2 * j AS cy FROM s, range(60) a(i), range(60) b(j) WHERE 2 * i + 4 <= width AND 2 * j + 4 <= height AND EXISTS (SELECT 1 FROM t WHERE t.slide_id = s.slide_id AND t.tx = 2 * i // 18 AND t.ty = 2 * j // 18)),
p AS (SELECT w.slide_id, cx, cy, max(CASE WHEN x = cx + 1 AND y = cy + 1 THEN v END) AS f5, max(CASE WHEN x = cx + 2 AND y = cy + 2 THEN v END) AS f10, max(CASE WHEN x = cx AND y = cy THEN v END) AS f0
  FROM w JOIN f1_slide f ON f.slide_id = w.slide_id AND x >= cx AND x < cx + 4 AND y >= cy AND y < cy + 4 GROUP BY 1, 2, 3 HAVING count(*) = 16),
o AS (SELECT slide_id, cx + i % 4 AS x, cy + i // 4 AS y, (CASE WHEN f5 > 135 THEN 0.9 - 0.03 * i ELSE 0.1 + 0.01 * i END + CASE WHEN f10 <= 120 THEN 0.15 + 0.02 * i WHEN f0 <= 150 THEN 0.55 + 0.01 * i ELSE 0.8 - 0.02 * i END) / 2 AS p FROM p, range(16) r(i))
SELECT slide_id AS image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM o GROUP BY 1, 2, 3 HAVING round(sum(CAST(p AS DOUBLE)), 9) > round(count(*) - sum(CAST(p AS DOUBLE)), 9)""")
def segment_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of class 1 of all slides, by a fixed forest; tiles that are bright on average make no windows."""
    pixels = fixture(spark, sf_dir, "f1_slide").select(F.col("slide_id").alias("image_id"), "x", "y", "v")
    mask = slides.segmented(_sizes(pixels, "image_id"), pixels, _forest(spark), ["v"], size=WINDOW, step=2, tile=20, min_dev=0, max_mean=128, clean=False)
    return mask.filter("m = 1").select("image_id", "x", "y")


@query("f1_slide", sql="""
WITH k AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-d * d / 8.0) AS w FROM range(-5, 6) r(d))),
s AS (SELECT slide_id, min(x) AS nx, max(x) AS mx, min(y) AS ny, max(y) AS my FROM f1_slide GROUP BY 1),
g AS (SELECT slide_id, px.x, py.y, nx, mx FROM s, LATERAL (SELECT unnest(range(nx, mx + 1)) AS x) px, LATERAL (SELECT unnest(range(ny, my + 1)) AS y) py),
a AS (SELECT g.slide_id, g.x, g.y, least(greatest(g.x + d, nx), mx) AS bx, w FROM g, k),
r AS (SELECT a.slide_id, a.x, a.y, sum(w * b.v) AS r FROM a JOIN f1_slide b ON b.slide_id = a.slide_id AND b.x = bx AND b.y = a.y GROUP BY 1, 2, 3),
c AS (SELECT f.slide_id, f.x, f.y, f.v, least(greatest(f.y + d, ny), my) AS by_, w FROM f1_slide f JOIN s ON s.slide_id = f.slide_id, k),
m AS (SELECT c.slide_id, c.x, c.y, c.v, sum(w * b.r) AS mean FROM c JOIN r b ON b.slide_id = c.slide_id AND b.x = c.x AND b.y = by_ GROUP BY 1, 2, 3, 4)
SELECT slide_id, x, y, CASE WHEN v - round_even(round(mean, 6), 0) > -3 THEN 255 ELSE 0 END AS m FROM m""")
def adaptive_gaussian_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.adaptive_gaussian(fixture(spark, sf_dir, "f1_slide").drop("m"), SLIDE, 11, 2.5).select("slide_id", "x", "y", "m")


_DISTANCE = "abs(p + 0.5 - (i + 0.5) * n / {0}.0) / {1}"
_WEIGHTS = {
    "bilinear": "greatest(0.0, 1 - d)",
    "cubic": "CASE WHEN d < 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 WHEN d < 2 THEN -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 ELSE 0 END",
    "lanczos": "CASE WHEN d = 0 THEN 1 WHEN d < 3 THEN 3 * sin(pi() * d) * sin(pi() * d / 3) / (pi() * d * pi() * d) ELSE 0 END",
    "area": "greatest(0.0, least(p + 1, (i + 1) * n / {0}.0) - greatest(p, i * n / {0}.0))",
}
_TARGET = (28, 33)


def _resampled_sql(kernel: str, wide: str) -> str:
    axis = lambda target: f"(SELECT n, p, i, {_WEIGHTS[kernel].format(target)} AS w FROM (SELECT n, p, i, {_DISTANCE.format(target, wide.format(target))} AS d FROM (SELECT DISTINCT n FROM n), range(100) a(p), range({target}) b(i)))"
    return f"""WITH s AS (SELECT slide_id, max(x) + 1 AS width, max(y) + 1 AS height FROM f1_slide GROUP BY 1), n AS (SELECT width AS n FROM s UNION SELECT height FROM s),
r AS (SELECT f.slide_id, k.i AS x, f.y, height, sum(k.w * v) / sum(k.w) AS v FROM f1_slide f JOIN s ON s.slide_id = f.slide_id JOIN {axis(_TARGET[0])} k ON k.n = width AND k.p = f.x AND abs(k.w) > 1e-12 GROUP BY 1, 2, 3, 4)
SELECT slide_id, CAST(x AS INT) AS x, CAST(k.i AS INT) AS y, round(sum(k.w * v) / sum(k.w), 6) AS v FROM r JOIN {axis(_TARGET[1])} k ON k.n = height AND k.p = r.y AND abs(k.w) > 1e-12 GROUP BY 1, 2, 3"""


def _resampled(name: str, kernel: str, antialias: bool, wide: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pixels = fixture(spark, sf_dir, "f1_slide")
        out = raster.resampled(pixels, SLIDE, _sizes(pixels, "slide_id"), *_TARGET, kernel, antialias)
        return out.select("slide_id", "x", "y", F.round("v", 6).alias("v"))

    run.__name__ = name
    query("f1_slide", sql=_resampled_sql(kernel, wide))(run)


for _kernel in _WEIGHTS:
    _resampled(f"resample_{_kernel}", _kernel, True, "greatest(n / {0}.0, 1.0)")
_resampled("resample_bilinear_plain", "bilinear", False, "1.0")

#: Windows on a grid over each slide: their sides, the step, and the sizes that they are brought to.
_CROP, _STEP = (12, 9), 8


def _resized_sql(kernel: str, tw: int, th: int) -> str:
    axis = lambda n, target: f"(SELECT p, i, {_WEIGHTS[kernel].format(target)} AS w FROM (SELECT n, p, i, {_DISTANCE.format(target, f'greatest(n / {target}.0, 1.0)')} AS d FROM (SELECT {n} AS n), range({n}) a(p), range({target}) b(i)))"
    w, h = _CROP
    return f"""WITH s AS (SELECT slide_id, max(x) + 1 AS width, max(y) + 1 AS height FROM f1_slide GROUP BY 1),
c AS (SELECT slide_id, {_STEP} * i AS wx, {_STEP} * j AS wy FROM s, range(100) a(i), range(100) b(j) WHERE {_STEP} * i + {w} <= width AND {_STEP} * j + {h} <= height),
r AS (SELECT c.slide_id, wx, wy, k.i AS tx, y - wy AS py, sum(k.w * v) / sum(k.w) AS v FROM c JOIN f1_slide f ON f.slide_id = c.slide_id AND x >= wx AND x < wx + {w} AND y >= wy AND y < wy + {h} JOIN {axis(w, tw)} k ON k.p = x - wx AND abs(k.w) > 1e-12 GROUP BY 1, 2, 3, 4, 5)
SELECT slide_id AS image_id, wy * 100000 + wx AS sw, CAST(tx AS INT) AS x, CAST(k.i AS INT) AS y, round(sum(k.w * v) / sum(k.w), 6) AS v FROM r JOIN {axis(h, th)} k ON k.p = py AND abs(k.w) > 1e-12 GROUP BY 1, 2, 3, 4"""


def _resized(name: str, kernel: str, tw: int, th: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every window of a grid over all slides at another size, by a kernel. FEA-03, FEA-06, FUN-23."""
        pixels = fixture(spark, sf_dir, "f1_slide").withColumnRenamed("slide_id", "image_id")
        at = lambda size, n: F.explode(F.sequence(F.lit(0), F.col(size) - n, F.lit(_STEP)))
        fits = _sizes(pixels, "image_id").filter((F.col("width") >= _CROP[0]) & (F.col("height") >= _CROP[1]))
        corners = fits.withColumn("x0", at("width", _CROP[0])).withColumn("y0", at("height", _CROP[1]))
        boxes = corners.select("image_id", (F.col("y0").cast("long") * 100000 + F.col("x0")).alias("sw"), "x0", "y0", F.lit(_CROP[0]).alias("w"), F.lit(_CROP[1]).alias("h"))
        return features.resized(boxes, pixels, tw, th, ["v"], kernel=kernel).withColumn("v", F.round("v", 6))

    run.__name__ = name
    query("f1_slide", sql=_resized_sql(kernel, tw, th))(run)


_resized("window_reduced_bilinear", "bilinear", 5, 4)
_resized("window_reduced_area", "area", 5, 4)
_resized("window_enlarged_cubic", "cubic", 16, 10)


@query("f1_slide", sql="""
WITH p AS (SELECT slide_id, x, y FROM f1_slide WHERE m = 1),
n AS (SELECT slide_id, count(*) AS area FROM p GROUP BY 1),
t AS (SELECT slide_id, count(*) AS touching FROM (SELECT a.slide_id FROM p a JOIN p b ON b.slide_id = a.slide_id AND b.y = a.y AND b.x = a.x + 1 UNION ALL SELECT a.slide_id FROM p a JOIN p b ON b.slide_id = a.slide_id AND b.x = a.x AND b.y = a.y + 1) GROUP BY 1),
q AS (SELECT slide_id, x + i AS cx, y + j AS cy, count(*) AS k, sum((i + j) % 2) AS odd FROM p, range(2) a(i), range(2) b(j) GROUP BY 1, 2, 3),
c AS (SELECT slide_id, sum(CASE WHEN k IN (1, 3) THEN 1 WHEN k = 2 AND odd IN (0, 2) THEN 2 ELSE 0 END) AS corners FROM q GROUP BY 1)
SELECT slide_id, area, 4 * area - 2 * coalesce(touching, 0) AS perimeter, CAST(corners AS BIGINT) AS corners FROM n LEFT JOIN t USING (slide_id) JOIN c USING (slide_id)""")
def outline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, perimeter and corners of the outlines of all objects, holes taken off."""
    runs = regions.runs(fixture(spark, sf_dir, "f1_slide"), SLIDE)
    rings = regions.contour(regions.labelled(runs, SLIDE), SLIDE).withColumn("n", F.size("ring"))
    sides = F.zip_with(F.slice("ring", 1, F.col("n") - 1), F.slice("ring", 2, F.col("n") - 1), lambda p, q: F.struct((p[0] * q[1] - q[0] * p[1]).alias("a"), (F.abs(p[0] - q[0]) + F.abs(p[1] - q[1])).alias("l")))
    total = lambda c: F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x[c])
    each = rings.withColumn("s", sides).select("slide_id", total("a").alias("a"), total("l").alias("l"), (F.col("n") - 1).alias("n"))
    return each.groupBy("slide_id").agg((F.sum("a") / 2).cast("long").alias("area"), F.sum("l").alias("perimeter"), F.sum("n").cast("long").alias("corners"))
