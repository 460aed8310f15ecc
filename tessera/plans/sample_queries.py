"""Queries on windows, descriptors, samples, segmentation by windows of a disc, and choices among candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features, landmarks, raster, workflow
from tessera.plans.registry import query
from tessera.sources.fixtures import fixture

#: Windows on a grid: their side, the step, and the side of what they are reduced to.
WINDOW, STEP, TARGET = 12, 8, 4
GRID = f"""w AS (SELECT slide_id, wx, wy FROM (SELECT slide_id, max(x) + 1 AS width, max(y) + 1 AS height FROM f1_slide GROUP BY 1),
 LATERAL (SELECT unnest(range(0, greatest(width - {WINDOW}, 0) + 1, {STEP})) AS wx), LATERAL (SELECT unnest(range(0, greatest(height - {WINDOW}, 0) + 1, {STEP})) AS wy)),
c AS (SELECT w.slide_id AS image_id, wy * 100000 + wx AS sw, tx, ty, f.v, f.m FROM w, (SELECT unnest(range({TARGET})) AS tx), (SELECT unnest(range({TARGET})) AS ty)
 JOIN f1_slide f ON f.slide_id = w.slide_id AND f.x = wx + tx * {WINDOW // TARGET} AND f.y = wy + ty * {WINDOW // TARGET})"""


def _slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "f1_slide").withColumnRenamed("slide_id", "image_id")


def _grid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slide's windows, reduced to the nearest pixels, with a (alpha): 255 in the mask and 0 outside."""
    slide = _slide(spark, sf_dir).withColumn("a", F.col("m") * 255)
    whole = slide.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).withColumns({"x0": F.lit(0), "y0": F.lit(0), "tile_id": F.lit(0)})
    corners = features.grid_windows(whole, WINDOW, STEP)
    boxes = corners.select("image_id", (F.col("y").cast("long") * 100000 + F.col("x")).alias("sw"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(WINDOW).alias("w"), F.lit(WINDOW).alias("h"))
    return features.resized(boxes, slide, TARGET, TARGET, ["v", "a"])


@query("f1_slide", sql=f"WITH {GRID} SELECT image_id, sw, CAST(ty * {TARGET} + tx AS INT) AS place, CAST(v AS DOUBLE) AS value FROM c")
def grid_window_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-03, FEA-05, FEA-06."""
    vectors = features.vectors(_grid_windows(spark, sf_dir), ["v"])
    return vectors.select("image_id", "sw", F.posexplode("features").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


@query("f1_slide", sql=f"""
WITH {GRID} SELECT image_id, sw, max(CASE WHEN tx = {TARGET // 2} AND ty = {TARGET // 2} AND m = 1 THEN image_id % 3 + 1 ELSE 0 END) AS label,
 string_agg(CASE WHEN m = 1 THEN image_id % 3 + 1 ELSE 0 END, '' ORDER BY ty, tx) AS labels FROM c GROUP BY 1, 2""")
def grid_window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a window by its central pixel and by each pixel. FEA-07 to FEA-09."""
    windows, label = _grid_windows(spark, sf_dir), F.col("image_id") % 3 + 1
    masks = features.label_mask(windows, label).select("image_id", "sw", F.array_join(F.transform("labels", lambda v: v.cast("string")), "").alias("labels"))
    return features.label_of_centre(windows, TARGET, TARGET, label).join(masks, ["image_id", "sw"])


@query("f2_images", sql="SELECT image_id, width, height FROM f2_images WHERE CASE WHEN width < height THEN 0.75 * width * 16 / 24 > height ELSE 0.75 * height * 24 / 16 > width END")
def windows_too_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that hold no window of 3 : 2 whose side is three quarters of their shorter one. FEA-02."""
    return features.too_small(fixture(spark, sf_dir, "f2_images"), 0.75, 24, 16).select("image_id", "width", "height")


@query("f2_images", sql="""
SELECT image_id, CAST(sw AS INT) AS sw, CAST(0 AS INT) AS x0, width AS w, least(height, 1024) AS h, height - least(height, 1024) = 0 AS whole FROM f2_images, (SELECT unnest(range(2)) AS sw)""")
def oversize_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a fixed size, wider than any image: they take its whole width. FEA-01, FEA-03. whole: the height too, so
    that the window starts at the top; lower ones start where a hash says, within the image."""
    images = fixture(spark, sf_dir, "f2_images")
    boxes = features.window_boxes(images, 2, 0.1, 1.0, 4096, 1024, fixed=True).join(images.select("image_id", "height"), "image_id")
    inside = F.col("y0").between(0, F.col("height") - F.col("h"))
    return boxes.filter(inside).select("image_id", "sw", "x0", "w", "h", (F.col("h") == F.col("height")).alias("whole"))


PATCHES = """
p AS (SELECT image_id, x, y FROM f1_pixels WHERE (x + 3 * y) % 7 = 0),
m AS (SELECT image_id, k, CAST(floor(x / pow(2, k)) AS INT) AS x, CAST(floor(y / pow(2, k)) AS INT) AS y, avg(v) AS v FROM f1_pixels, (SELECT unnest(range(3)) AS k) GROUP BY 1, 2, 3, 4),
a AS (SELECT p.image_id, p.x, p.y, CAST(k AS INT) AS k, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, CAST(floor(p.x / pow(2, k)) AS INT) AS cx, CAST(floor(p.y / pow(2, k)) AS INT) AS cy
 FROM p, (SELECT unnest(range(3)) AS k), (SELECT unnest(range(-2, 2)) AS dy), (SELECT unnest(range(-2, 2)) AS dx))
SELECT a.image_id, a.x, a.y, a.k, a.dy, a.dx, round(coalesce(m.v, 0) - {less}, 6) AS v FROM a LEFT JOIN m ON m.image_id = a.image_id AND m.k = a.k AND m.x = cx + dx AND m.y = cy + dy
 LEFT JOIN m AS c ON c.image_id = a.image_id AND c.k = a.k AND c.x = cx AND c.y = cy"""


def _patches(spark: SparkSession, sf_dir: str, subtract: bool) -> DataFrame:
    pixels = fixture(spark, sf_dir, "f1_pixels").drop("label")
    points = pixels.filter((F.col("x") + 3 * F.col("y")) % 7 == 0).select("image_id", "x", "y")
    return features.patches(raster.pyramid(pixels, ["image_id"], 3), points, 2, 3, subtract).withColumn("v", F.round("v", 6))


@query("f1_pixels", sql="WITH " + PATCHES.format(less="0"))
def patch_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-13."""
    return _patches(spark, sf_dir, False)


@query("f1_pixels", sql="WITH " + PATCHES.format(less="coalesce(c.v, 0)"))
def patch_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-14."""
    return _patches(spark, sf_dir, True)


@query("f1_slide", sql="""
WITH l AS (SELECT slide_id, x, y FROM f1_slide WHERE v % 61 = 0),
o AS (SELECT dx, dy FROM (SELECT unnest(range(-4, 5)) AS dx), (SELECT unnest(range(-4, 5)) AS dy) WHERE dx*dx + dy*dy <= 16),
d AS (SELECT DISTINCT slide_id, x + dx AS x, y + dy AS y FROM l, o)
SELECT f.slide_id AS image_id, f.x, f.y, f.v FROM f1_slide f LEFT JOIN d ON d.slide_id = f.slide_id AND d.x = f.x AND d.y = f.y WHERE d.x IS NULL AND f.x BETWEEN 3 AND 76 AND f.y BETWEEN 3 AND 76""")
def background_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels outside the discs of landmarks and the border: as many are asked for as a slide has. RAS-14, SET-03."""
    slide = _slide(spark, sf_dir).drop("m")
    marks = slide.filter("v % 61 = 0").select("image_id", "x", "y")
    return features.background(slide, marks, 4, 3, 80, 80, 80 * 80)


def _elliptical_sql() -> str:
    """A mask closed and opened, window by window, from the offsets of an elliptical one of 7 x 7."""
    offsets = [(dx, dy) for dy in range(-3, 4) for dx in range(-3, 4) if abs(dx) <= (3, 3, 2, 0)[abs(dy)]]
    steps = [f"WITH o(dx, dy) AS (VALUES {', '.join(map(str, offsets))})", "s0 AS (SELECT slide_id, x, y, CASE WHEN v < 100 THEN 1 ELSE 0 END AS m FROM f1_slide)"]
    for i, pick in enumerate(("max", "min", "min", "max")):
        steps.append(f"q{i} AS MATERIALIZED (SELECT slide_id, x + dx AS x, y + dy AS y, {pick}(m) AS m FROM s{i}, o GROUP BY 1, 2, 3)")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT slide_id, x, y, q{i}.m FROM q{i} JOIN s0 USING (slide_id, x, y))")
    return ",\n".join(steps) + "\nSELECT * FROM s4"


@query("f1_slide", sql=_elliptical_sql())
def green_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAS-05."""
    slide = fixture(spark, sf_dir, "f1_slide").select("slide_id", "x", "y", F.col("v").alias("g"))
    return workflow.green_segmenter(100, window="ellipse")(slide, ["slide_id"])


def _rounds_sql(rounds: int) -> str:
    steps = ["WITH f AS (SELECT image_id, term_id, y, x, CAST(v AS DOUBLE) AS p, n % 3 - 1 AS dx, v % 5 - 2 AS dy FROM f5_votes)", "r0 AS (SELECT image_id, term_id, y, x, p FROM f)"]
    for i in range(rounds):
        steps.append(f"k{i} AS (SELECT *, max(p) OVER (PARTITION BY image_id, term_id) AS top FROM r{i})")
        steps.append(f"m{i} AS (SELECT image_id, term_id, CAST(greatest(0, least(15, y - dy)) AS INT) AS y, CAST(greatest(0, least(15, x - dx)) AS INT) AS x, k{i}.p FROM k{i} JOIN f USING (image_id, term_id, y, x) WHERE k{i}.p >= 0.25 * top)")
        steps.append(f"r{i + 1} AS (SELECT image_id, term_id, y, x, sum(p) AS p FROM m{i} WHERE x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14 GROUP BY 1, 2, 3, 4)")
    return ",\n".join(steps) + f"\nSELECT * FROM r{rounds}"


@query("f5_votes", sql=_rounds_sql(3))
def vote_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes moved and summed three times. ITR-04."""
    votes = fixture(spark, sf_dir, "f5_votes")
    offsets = votes.select("image_id", "term_id", "y", "x", (F.col("n") % 3 - 1).cast("int").alias("dx"), (F.col("v") % 5 - 2).cast("int").alias("dy"))
    sizes = votes.select("image_id").distinct().withColumns({"width": F.lit(16), "height": F.lit(16)})
    return landmarks.reaggregated(votes.select("image_id", "term_id", "y", "x", F.col("v").cast("double").alias("p")), offsets, sizes, 0.25, 3)


#: Links of landmarks (src, dst) with a training displacement (dx, dy): a tree, and one edge that closes a ring.
LINKS = ((1, 2, 2, -1), (1, 2, 0, 3), (2, 3, -3, 0), (2, 4, 1, 1), (4, 5, 0, -4), (5, 6, 2, 2), (5, 7, -1, 3), (3, 4, 4, 0))
SIGMA, ROUNDS = 4.0, 3
CANDIDATES = f"""l(src, dst, dx, dy) AS (VALUES {", ".join(map(str, LINKS))}),
c AS (SELECT * FROM (SELECT image_id, term_id, x, y, v, row_number() OVER (PARTITION BY image_id, term_id ORDER BY v DESC, y, x) AS r FROM f5_votes) WHERE r <= 3),
g AS (SELECT a.image_id, a.term_id AS src, b.term_id AS dst, a.r AS a, b.r AS b, max(exp(-(pow(a.x - b.x - l.dx, 2) + pow(a.y - b.y - l.dy, 2)) / {2 * SIGMA * SIGMA})) AS w
 FROM c a JOIN l ON l.src = a.term_id JOIN c b ON b.image_id = a.image_id AND b.term_id = l.dst GROUP BY 1, 2, 3, 4, 5),
h AS (SELECT image_id, src, dst, a, b, w / sum(w) OVER (PARTITION BY image_id, src, dst, a) AS c FROM g)"""


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, how well those of linked landmarks suit each other)"""
    votes = fixture(spark, sf_dir, "f5_votes").select("image_id", "term_id", "x", "y", F.col("v").cast("double").alias("p"))
    found = landmarks.top_candidates(votes, 3)
    links = spark.createDataFrame(LINKS, "src long, dst long, dx int, dy int")
    return found, landmarks.compatibility(found, links.select("src", "dst").distinct(), links, SIGMA)


@query("f5_votes", sql=f"WITH {CANDIDATES} SELECT image_id, src, dst, CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(c, 8) AS c FROM h")
def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11."""
    return _candidates(spark, sf_dir)[1].withColumn("c", F.round("c", 8))


def _messages_sql() -> str:
    """Messages as products of numbers, round by round, where the operator adds logarithms."""
    steps = [f"WITH {CANDIDATES}", "e AS (SELECT * FROM h UNION ALL SELECT image_id, dst, src, b, a, c FROM h)", "m0 AS (SELECT image_id, src, dst, a, 1.0 / count(DISTINCT b) AS m FROM e GROUP BY 1, 2, 3, 4)"]
    for i in range(ROUNDS):
        heard = f"(SELECT coalesce(product(m.m), 1) FROM m{i} m WHERE m.image_id = e.image_id AND m.src = e.dst AND m.a = e.b AND m.dst <> e.src)"
        steps.append(f"n{i} AS (SELECT e.image_id, e.src, e.dst, e.a, sum(e.c * c.v * {heard}) AS m FROM e JOIN c ON c.image_id = e.image_id AND c.term_id = e.dst AND c.r = e.b GROUP BY 1, 2, 3, 4)")
        steps.append(f"m{i + 1} AS (SELECT image_id, src, dst, a, m / sum(m) OVER (PARTITION BY image_id, src, dst) AS m FROM n{i})")
    belief = f"ln(c.v) + coalesce((SELECT sum(ln(m.m)) FROM m{ROUNDS} m WHERE m.image_id = c.image_id AND m.src = c.term_id AND m.a = c.r), 0)"
    steps.append(f"b AS (SELECT c.*, {belief} AS belief FROM c)")
    steps.append("t AS (SELECT *, row_number() OVER (PARTITION BY image_id, term_id ORDER BY belief DESC, r) AS place FROM b)")
    return ",\n".join(steps) + "\nSELECT image_id, term_id, CAST(r AS INT) AS rank, x, y, round(belief, 6) AS belief FROM t WHERE place = 1"


@query("f5_votes", sql=_messages_sql())
def landmarks_by_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of each landmark that three rounds of messages choose. ITR-07, JOIN-11."""
    found, links = _candidates(spark, sf_dir)
    return landmarks.best_by_messages(found, links, ROUNDS).withColumn("belief", F.round("belief", 6))
