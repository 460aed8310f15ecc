"""Queries on annotations, landmarks, votes and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.operators import annotations, evaluation, landmarks, learners, regions, spatial, workflow
from tessera.plans.registry import query
from tessera.sources.fixtures import fixture


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "f3_boxes").withColumn("terms", F.array("term1", "term2"))


@query("f3_boxes", sql="""
SELECT annotation_id, project_id, image_id, term1 FROM f3_boxes WHERE project_id = 1 AND reviewed AND term1 <> 5 AND term2 <> 5
UNION ALL SELECT annotation_id, project_id, image_id, term1 FROM f3_boxes WHERE project_id = 2 AND term1 <> 5 AND term2 <> 5""")
def annotation_filter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    parts = [annotations.select(boxes, [1], excluded=[5], reviewed_only=True), annotations.select(boxes, [2], excluded=[5])]
    return annotations.together(parts).select("annotation_id", "project_id", "image_id", "term1")


@query("f3_boxes", sql="""
WITH c AS (SELECT annotation_id, CASE term1 WHEN 3 THEN 1 WHEN 5 THEN -1 ELSE 0 END AS a, CASE term2 WHEN 3 THEN 1 WHEN 5 THEN -1 ELSE 0 END AS b FROM f3_boxes)
SELECT annotation_id, CASE WHEN a <> 0 THEN a ELSE b END AS cls FROM c WHERE CASE WHEN a <> 0 THEN a ELSE b END <> -1""")
def first_nonzero_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    terms = boxes.select(F.col("term1").alias("term_id")).distinct()
    return annotations.first_class(boxes, terms.withColumn("cls", F.when(F.col("term_id") == 3, 1).when(F.col("term_id") == 5, -1).otherwise(0))).select("annotation_id", "cls")


@query("f3_boxes", "f3_rois", sql="""
SELECT r.roi_id, CAST(r.w * r.h AS BIGINT) AS area, count(b.annotation_id) AS annotations FROM f3_rois r LEFT JOIN f3_boxes b ON b.image_id = r.image_id
 AND b.x0 >= r.x0 AND b.y0 >= r.y0 AND b.x0 + b.w <= r.x0 + r.w AND b.y0 + b.h <= r.y0 + r.h GROUP BY 1, 2""")
def roi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.roi_counts(_boxes(spark, sf_dir), fixture(spark, sf_dir, "f3_rois"))


PAIRS = """SELECT a.image_id, a.annotation_id AS a, b.annotation_id AS b, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) AS overlap_w, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) AS overlap_h
 FROM f3_boxes a JOIN f3_boxes b ON a.image_id = b.image_id AND a.annotation_id < b.annotation_id AND a.x0 <= b.x0 + b.w AND b.x0 <= a.x0 + a.w AND a.y0 <= b.y0 + b.h AND b.y0 <= a.y0 + a.h"""


@query("f3_boxes", sql=f"SELECT * FROM ({PAIRS}) WHERE overlap_w + overlap_h >= 10")
def zone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.touching_pairs(_boxes(spark, sf_dir), least=10)


@query("f3_boxes", sql=f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM ({PAIRS}) UNION ALL SELECT b, a FROM ({PAIRS})),
r AS (SELECT annotation_id AS v, annotation_id AS label FROM f3_boxes UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.v WHERE r.label < e.b)
SELECT v AS annotation_id, min(label) AS label FROM r GROUP BY v""")
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.merge_groups(_boxes(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    text = F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", x, y, x + w, y, x + w, y + h, x, y + h, x, y)
    return _boxes(spark, sf_dir).withColumn("wkt", text)


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("rings", geometry.rings(F.col("wkt")))


def _different(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, annotation_id, rings): polygons of an image with one text as one, read once. Their union is the same."""
    each = _texts(spark, sf_dir).groupBy("image_id", "wkt").agg(F.min("annotation_id").alias("annotation_id"))
    return each.select("image_id", "annotation_id", geometry.rings(F.col("wkt")).alias("rings"))


@query("f3_boxes", sql="""SELECT annotation_id, CAST(x0 + w // 2 AS INT) AS cx, CAST(floor(2000 - y0 - h / 2.0) AS INT) + CASE WHEN h % 2 = 1 THEN 1 ELSE 0 END AS cy, CAST(w * h AS DOUBLE) AS area FROM f3_boxes""")
def wkt_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _polygons(spark, sf_dir)
    ring = F.col("rings")[0]
    # the sums of an exact half may fall short by a rounding error; a millionth is added before cutting
    moved = geometry.moved(ring, F.lit(1e-6), F.lit(1e-6))
    cx, cy = geometry.centroid(moved)
    return p.select("annotation_id", cx.alias("cx"), geometry.flipped(cy, F.lit(2000)).alias("cy"), F.round(geometry.area(ring), 6).alias("area"))


@query("f3_boxes", sql="""
WITH p AS (SELECT annotation_id, image_id, x0, w, unnest(range(y0, y0 + h)) AS y FROM f3_boxes),
x AS (SELECT DISTINCT image_id, y, unnest(range(x0, x0 + w)) AS x FROM p)
SELECT image_id, CAST(y AS INT) AS y, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1 FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM x) GROUP BY image_id, y, g""")
def polygon_raster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x0, x1): the union of the polygons of every image."""
    each = regions.rasterised(_different(spark, sf_dir), ["image_id", "annotation_id"])
    return regions.merged(each.drop("annotation_id"), ["image_id"]).select("image_id", "y", "x0", "x1")


@query()
def polygon_raster_runs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows under the name that the brute-force test knows."""
    return polygon_raster_runs(spark, sf_dir)


@query("f4_landmarks", sql="SELECT image_id, " + ", ".join(f"coalesce(printf('%3.3f', CAST(max(CASE WHEN term_id = {t} THEN {c} END) AS DOUBLE)), '-1') AS t{t}_{c}" for t in range(8) for c in "xy") + " FROM f4_landmarks GROUP BY image_id")
def landmark_pivot_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = landmarks.wide(fixture(spark, sf_dir, "f4_landmarks"), list(range(8)))
    return table.select("image_id", *(F.when(F.col(f"{t}_{c}").isNull(), "-1").otherwise(F.format_string("%3.3f", F.col(f"{t}_{c}").cast("double"))).alias(f"t{t}_{c}") for t in range(8) for c in "xy"))


@query("f4_landmarks", sql="""
SELECT term_id, round(avg(x / 400.0), 8) AS mean_x, round(avg(y / 400.0), 8) AS mean_y, round(var_samp(x / 400.0), 10) AS var_x, round(var_samp(y / 400.0), 10) AS var_y, round(covar_samp(x / 400.0, y / 400.0), 10) AS cov_xy FROM f4_landmarks GROUP BY 1""")
def landmark_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = fixture(spark, sf_dir, "f4_landmarks").withColumns({"xr": F.col("x") / 400.0, "yr": F.col("y") / 400.0})
    p = landmarks.prior(marks)
    return p.select("term_id", *(F.round(c, 8).alias(c) for c in ("mean_x", "mean_y")), *(F.round(c, 10).alias(c) for c in ("var_x", "var_y", "cov_xy")))


@query("f4_landmarks", sql="""
WITH p AS (SELECT a.term_id AS src, b.term_id AS dst, a.x - b.x AS dx, a.y - b.y AS dy FROM f4_landmarks a JOIN f4_landmarks b USING (image_id) WHERE a.term_id <> b.term_id),
m AS (SELECT src, dst, avg(dx) AS mx, avg(dy) AS my FROM p GROUP BY 1, 2),
d AS (SELECT p.src, p.dst, round(avg(sqrt(pow(dx - mx, 2) + pow(dy - my, 2))), 6) AS d FROM p JOIN m ON m.src = p.src AND m.dst = p.dst GROUP BY 1, 2)
SELECT src, dst, d, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM d) WHERE r <= 3""")
def edge_top_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = landmarks.edges(fixture(spark, sf_dir, "f4_landmarks")).withColumn("d", F.round("d", 6))
    return landmarks.nearest_partners(pairs, 3)


@query("f4_landmarks", sql="""
WITH b AS (SELECT a.image_id, a.x, a.y, r.x AS x0, r.y AS y0 FROM f4_landmarks a JOIN f4_landmarks r ON r.term_id = a.term_id AND r.image_id = 3),
c AS (SELECT image_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, x0 - avg(x0) OVER w AS x0, y0 - avg(y0) OVER w AS y0 FROM b WINDOW w AS (PARTITION BY image_id)),
p AS (SELECT image_id, sum(x*x0 + y*y0) / sqrt(sum(x0*x0 + y0*y0)) / sum(x*x + y*y) AS a, sum(x*y0 - x0*y) / sqrt(sum(x0*x0 + y0*y0)) / sum(x*x + y*y) AS b FROM c GROUP BY 1)
SELECT image_id, round(a, 8) AS a, round(b, 8) AS b, round(sqrt(a*a + b*b), 8) AS scale, round(atan2(b, a), 6) AS angle FROM p""")
def procrustes_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = landmarks.alignment(fixture(spark, sf_dir, "f4_landmarks"), 3)
    return p.select("image_id", *(F.round(c, 8).alias(c) for c in ("a", "b", "scale")), F.round("angle", 6).alias("angle"))


def _sizes(votes: DataFrame) -> DataFrame:
    return votes.select("image_id").distinct().withColumns({"width": F.lit(16), "height": F.lit(16)})


@query("f5_votes", sql="""
SELECT image_id, term_id, CAST(y - (v % 5 - 2) AS INT) AS y, CAST(x - (n % 3 - 1) AS INT) AS x, count(*) AS votes FROM f5_votes
WHERE x - (n % 3 - 1) BETWEEN 0 AND 15 AND y - (v % 5 - 2) BETWEEN 0 AND 15 GROUP BY 1, 2, 3, 4""")
def offset_vote_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = fixture(spark, sf_dir, "f5_votes")
    predicted = votes.withColumns({"dx": (F.col("n") % 3 - 1).cast("int"), "dy": (F.col("v") % 5 - 2).cast("int")})
    return landmarks.offset_votes(predicted, _sizes(votes))


@query("f5_votes", sql="""
WITH e AS (SELECT image_id, term_id, CAST(term_id * 2 AS INT) AS ex, CAST(image_id + 2 AS INT) AS ey FROM (SELECT DISTINCT image_id, term_id FROM f5_votes)),
n AS (SELECT e.image_id, e.term_id, x, y, v, row_number() OVER (PARTITION BY e.image_id, e.term_id ORDER BY v DESC, y, x) AS r FROM e JOIN f5_votes f ON f.image_id = e.image_id AND f.term_id = e.term_id AND abs(x - ex) <= 3 AND abs(y - ey) <= 3)
SELECT e.image_id, e.term_id, coalesce(x, ex) AS x, coalesce(y, ey) AS y, v FROM e LEFT JOIN n ON n.image_id = e.image_id AND n.term_id = e.term_id AND r = 1""")
def local_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = fixture(spark, sf_dir, "f5_votes").select("image_id", "term_id", "x", "y", "v")
    expected = votes.select("image_id", "term_id").distinct().withColumns({"ex": (F.col("term_id") * 2).cast("int"), "ey": (F.col("image_id") + 2).cast("int")})
    return landmarks.local_maximum(votes, expected, 3)


@query("f5_votes", sql="""
WITH k AS (SELECT *, max(v) OVER (PARTITION BY image_id, term_id) AS top FROM f5_votes),
m AS (SELECT image_id, term_id, CAST(greatest(0, least(15, y - (v % 5 - 2))) AS INT) AS y, CAST(greatest(0, least(15, x - (n % 3 - 1))) AS INT) AS x, v FROM k WHERE v >= 0.3 * top)
SELECT image_id, term_id, y, x, CAST(sum(v) AS DOUBLE) AS p FROM m WHERE x BETWEEN 1 AND 14 AND y BETWEEN 1 AND 14 GROUP BY 1, 2, 3, 4""")
def prob_reaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = fixture(spark, sf_dir, "f5_votes")
    offsets = votes.select("image_id", "term_id", "y", "x", (F.col("n") % 3 - 1).cast("int").alias("dx"), (F.col("v") % 5 - 2).cast("int").alias("dy"))
    return landmarks.reaggregated(votes.select("image_id", "term_id", "y", "x", F.col("v").cast("double").alias("p")), offsets, _sizes(votes), 0.3)


@query("f5_votes", sql="""
SELECT image_id, term_id, n AS p, median(CAST(x AS DOUBLE)) AS x, median(CAST(y AS DOUBLE)) AS y FROM (SELECT *, max(n) OVER (PARTITION BY image_id, term_id) AS top FROM f5_votes) WHERE n = top GROUP BY 1, 2, 3""")
def median_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landmarks.median_of_max(fixture(spark, sf_dir, "f5_votes").withColumn("p", F.col("n")))


@query("f6_preds", sql="""
WITH e AS (SELECT image_id, term_id, min(sqrt(CAST(pow(x_pred - x_true, 2) + pow(y_pred - y_true, 2) AS DOUBLE))) AS err FROM f6_preds GROUP BY 1, 2)
SELECT image_id, term_id, round(avg(err), 6) AS err FROM e GROUP BY CUBE (image_id, term_id)""")
def error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landmarks.error_matrix(fixture(spark, sf_dir, "f6_preds")).withColumn("err", F.round("err", 6))


@query("f6_preds", sql="""
WITH e AS (SELECT term_id, sqrt(CAST(pow(x_pred - x_true, 2) + pow(y_pred - y_true, 2) AS DOUBLE)) AS err FROM f6_preds)
SELECT term_id, round(avg(err) - 1.96 * stddev_pop(err) / sqrt(count(*)), 6) AS low, round(avg(err), 6) AS mean, round(avg(err) + 1.96 * stddev_pop(err) / sqrt(count(*)), 6) AS high FROM e GROUP BY 1""")
def error_ci95(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = landmarks.interval95(fixture(spark, sf_dir, "f6_preds"))
    return e.select("term_id", *(F.round(c, 6).alias(c) for c in ("low", "mean", "high")))


GRID = "WITH c AS (SELECT label FROM f7_samples UNION SELECT pred FROM f7_samples), m AS (SELECT a.label, b.label AS pred, count(s.sample_id) AS n FROM c a CROSS JOIN c b LEFT JOIN f7_samples s ON s.label = a.label AND s.pred = b.label GROUP BY 1, 2)"


@query("f7_samples", sql=f"{GRID} SELECT * FROM m")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(fixture(spark, sf_dir, "f7_samples"))


@query("f7_samples", sql=f"""{GRID},
p AS (SELECT label, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN label = pred THEN n ELSE 0 END) AS BIGINT) AS "right" FROM m GROUP BY 1),
r AS (SELECT *, CASE WHEN total > 0 THEN "right" / total END AS rate FROM p)
SELECT label, total, "right", round(rate, 8) AS rate, CAST(NULL AS DOUBLE) AS class_average FROM r
UNION ALL SELECT NULL, CAST(sum(total) AS BIGINT), CAST(sum("right") AS BIGINT), round(sum("right") / sum(total), 8), round(avg(rate), 8) FROM r""")
def recognition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation.recognition(fixture(spark, sf_dir, "f7_samples"))
    return r.withColumns({"rate": F.round("rate", 8), "class_average": F.round("class_average", 8)})


@query("f7_samples", sql="SELECT sample_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS class_idx, CAST(ntile(5) OVER (PARTITION BY label ORDER BY sample_id) - 1 AS INT) AS fold FROM f7_samples")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fixture(spark, sf_dir, "f7_samples")
    return evaluation.stratified_folds(samples, 5).join(evaluation.class_index(samples), "label").select("sample_id", "label", "class_idx", "fold")


@query("f7_samples", sql="SELECT sample_id, label, CAST(ntile(7) OVER (PARTITION BY label ORDER BY sample_id) - 1 AS INT) AS chunk FROM f7_samples")
def chunk_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chunked(fixture(spark, sf_dir, "f7_samples"), 7, ["label"]).select("sample_id", "label", "chunk")


@query("f8_subwindows", sql="""
WITH n AS (SELECT image_id, count(DISTINCT sw) AS n FROM f8_subwindows GROUP BY 1),
p AS (SELECT image_id, class_idx, sum(p) / any_value(n) AS p FROM f8_subwindows JOIN n USING (image_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(p, 8) DESC, class_idx) AS r FROM p)
SELECT image_id, class_idx, round(p, 8) AS p FROM r WHERE r = 1""")
def subwindow_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_class(evaluation.soft_votes(fixture(spark, sf_dir, "f8_subwindows")).withColumn("p", F.round("p", 8)))


@query("f8_subwindows", sql="SELECT image_id, class_idx, round(count(*) / sum(count(*)) OVER (PARTITION BY image_id), 8) AS p FROM f8_subwindows GROUP BY 1, 2")
def hard_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hard_votes(fixture(spark, sf_dir, "f8_subwindows")).withColumn("p", F.round("p", 8))


@query("f8_subwindows", sql="""
WITH o AS (SELECT tree_id, coalesce(sum(top + 1) OVER (ORDER BY tree_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT tree_id, max(leaf) AS top FROM f8_subwindows GROUP BY 1)),
n AS (SELECT image_id, count(DISTINCT sw) AS n FROM f8_subwindows GROUP BY 1),
f AS (SELECT image_id, CAST(leaf + off AS BIGINT) AS leaf_id, count(*) / any_value(n) AS v FROM f8_subwindows JOIN o USING (tree_id) JOIN n USING (image_id) GROUP BY 1, 2),
m AS (SELECT leaf_id, max(v) AS m FROM f WHERE image_id % 2 = 0 GROUP BY 1)
SELECT image_id, leaf_id, round(CASE WHEN m > 0 THEN v / m ELSE v END, 8) AS v FROM f LEFT JOIN m USING (leaf_id)""")
def leaf_frequency_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = evaluation.leaf_frequency(fixture(spark, sf_dir, "f8_subwindows"))
    # the training images are the even ones; their maxima scale all
    return evaluation.scaled(f, evaluation.column_max(f.filter("image_id % 2 = 0"))).withColumn("v", F.round("v", 8))


@query("f8_subwindows", sql="""
WITH w AS (SELECT image_id, sw % 13 AS x, tree_id * 2 % 13 AS y, class_idx, p FROM f8_subwindows),
c AS (SELECT image_id, y + j AS y, x + i AS x, class_idx, round(sum(p), 6) AS p FROM w, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) GROUP BY 1, 2, 3, 4)
SELECT image_id, y, x, CASE WHEN x < 2 OR x >= 14 OR y < 2 OR y >= 14 THEN 0 ELSE class_idx END AS m FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY p DESC, class_idx) AS r FROM c) WHERE r = 1""")
def confidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = fixture(spark, sf_dir, "f8_subwindows").select("image_id", (F.col("sw") % 13).alias("x"), (F.col("tree_id") * 2 % 13).alias("y"), "class_idx", "p")
    sums = evaluation.confidence_map(windows, 4, cells=True).withColumn("p", F.round("p", 6))
    return evaluation.winning_class(sums, 16, 16, 2)


@query("emb_long", sql="""
WITH q AS (SELECT vec_id AS q, i, e FROM emb_long WHERE vec_id % 20 = 0),
d AS (SELECT q, vec_id AS t, label, round(sum((q.e - b.e) * (q.e - b.e)), 8) AS d FROM q JOIN emb_long b ON b.i = q.i AND b.vec_id <> q.q GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS r FROM d),
v AS (SELECT q, label, count(*) AS n FROM k WHERE r <= 10 GROUP BY 1, 2)
SELECT q AS sample_id, label AS pred, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, label) AS r FROM v) WHERE r = 1""")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), "label", "embedding")
    return learners.nearest_vote(rows, rows.filter("sample_id % 20 = 0").select("sample_id", "embedding"), 10)


@query("f2_images", "f3_boxes", sql="""
SELECT image_id, term1 AS term_id, CAST(trunc(arg_max(x0 + w / 2.0, annotation_id)) AS INT) AS x, CAST(arg_max(height - CAST(trunc(y0 + h / 2.0) AS INT), annotation_id) AS INT) AS y
FROM f3_boxes JOIN f2_images USING (image_id) WHERE reviewed GROUP BY 1, 2""")
def landmark_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each term lies in each image: centroids of reviewed polygons, from the top."""
    x0, y0 = F.col("x0"), F.col("y0")
    x1, y1 = x0 + F.col("w"), y0 + F.col("h")
    text = F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)
    reviewed = annotations.select(_boxes(spark, sf_dir).withColumn("wkt", text), reviewed_only=True)
    return workflow.landmark_positions(reviewed, fixture(spark, sf_dir, "f2_images").select("image_id", "height"))
