"""What must not grow with copies, estimates or rows in a task: plans and sizes of intermediate tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import regions, spatial
from tessera.plans.queries import QUERIES


def test_tiles_over_takes_bands_and_joins_without_the_driver(spark):
    tiles = spark.createDataFrame([(i, 10 * i + n, x, y, 100, 100) for i in range(3) for n, (x, y) in enumerate([(0, 0), (100, 0), (0, 100), (100, 100)])], "image_id long, tile_id int, x0 int, y0 int, w int, h int")
    bands = spark.createDataFrame([(0, 90, 101, 20, 40), (0, 90, 101, 20, 40), (1, 150, 150, 99, 99), (7, 0, 500, 0, 500)], "image_id long, y int, y1 int, x0 int, x1 int")
    rows = bands.select("image_id", F.explode(F.sequence("y", "y1")).alias("y"), "x0", "x1")
    found = spatial.tiles_over(tiles, bands)
    assert {r["tile_id"] for r in found.collect()} == {0, 2, 12} == {r["tile_id"] for r in spatial.tiles_over(tiles, rows).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "cx#" in x]


def test_boxes_that_lie_alike_are_one_vertex(spark, monkeypatch):
    boxes = [(7, x, 0, 10, 10) for x in (0, 8, 40) for _ in range(60)] + [(8, 0, 0, 10, 10), (7, 0, 0, None, 10), (7, 60, 0, 0, 0), (7, 60, 0, 0, 0), (7, 90, 0, -5, 1), (7, 90, 0, -5, 1)]
    rows = [(k, *b) for k, b in enumerate(boxes)] + [(3, 7, 40, 5, 1, 1)]  # key 3 lies at two places
    table = spark.createDataFrame(rows, "annotation_id long, image_id int, x0 int, y0 int, w int, h int").repartition(3)

    def touch(a, b):
        if a[1] != b[1] or None in a or None in b:
            return False
        return all(min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i]) >= 0 for i in (2, 3))

    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and touch(a, b))
    assert sorted((r["a"], r["b"]) for r in spatial.touching_pairs(table).collect()) == want
    sizes, plain = [], spatial.components
    monkeypatch.setattr(spatial, "components", lambda v, e, *by: (sizes.append((v.count(), e.count())), plain(v, e, *by))[1])
    label = {r["annotation_id"]: r["label"] for r in spatial.merge_groups(table).collect()}
    assert max(map(max, sizes)) < 20
    same = {k: {k} for k, *_ in rows}
    for a, b in want:
        if same[a] is not same[b]:
            both = same[a] | same[b]
            same.update(dict.fromkeys(both, both))
    assert label == {k: min(v) for k, v in same.items()}


def test_a_place_of_many_boxes_is_many_rows_of_keys(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ALIKE", 8)
    boxes = spark.range(50).select(F.col("id").alias("annotation_id"), F.lit(1).alias("image_id"), *(F.lit(9).alias(c) for c in ("x0", "y0", "w", "h")))
    found = spatial.touching_pairs(boxes)
    assert found.count() == 50 * 49 // 2 == found.filter("a < b").distinct().count()


def test_rows_of_keys_are_small_and_a_place_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ALIKE", 8)
    boxes = spark.range(90).select(F.col("id").alias("annotation_id"), F.lit(1).alias("image_id"), (F.col("id") % 3 * 5).cast("int").alias("x0"), *(F.lit(9).alias(c) for c in ("y0", "w", "h")))
    found = spatial.touching_pairs(boxes)
    rows = found.select("a", "b", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(a, b) for a in range(90) for b in range(a + 1, 90) if abs(a % 3 - b % 3) < 2]
    assert len({r["task"] for r in rows if r["a"] % 3 == r["b"] % 3 == 0}) > 1
    monkeypatch.setattr(spatial, "FEW", 2)
    places = spatial._places(boxes, "annotation_id")
    pairs = spatial._touching(places, 256, 256, 0, 4096)
    met = spatial._rows_of_keys(boxes, "annotation_id", places, pairs).select(F.size("keys_a").alias("a"), F.size("keys_b").alias("b"))
    assert max(r["a"] for r in met.collect()) == 2 and met.agg(F.sum(F.col("a") * F.col("b"))).first()[0] == 30 * 30 * 5


@pytest.fixture(scope="module")
def repeated_orders(spark, sf_dir, tmp_path_factory):
    """The tables with each order five times, at keys that derive the same box."""
    folder = tmp_path_factory.mktemp("repeated")
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem", "embeddings"):
        (folder / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.crossJoin(spark.range(5).select((F.col("id") * 2000).alias("_more"))).withColumn("o_orderkey", F.col("o_orderkey") + F.col("_more")).drop("_more").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_equal_polygons_are_rasterised_once(spark, sf_dir, repeated_orders, monkeypatch):
    sizes, plain = [], regions.rasterised
    monkeypatch.setattr(regions, "rasterised", lambda p, by: (sizes.append(p.count()), plain(p, by))[1])
    once, five = (sorted(map(tuple, QUERIES["polygon_raster_runs"](spark, d).collect())) for d in (sf_dir, repeated_orders))
    assert once == five and sizes[0] == sizes[1]


def test_boxes_that_lie_alike_meet_a_region_once(spark, sf_dir, repeated_orders, monkeypatch):
    sizes, plain = [], spatial.contained
    monkeypatch.setattr(spatial, "contained", lambda b, r, *key: (sizes.append(b.count()), plain(b, r, *key))[1])
    once, five = ({r["roi_id"]: r["annotations"] for r in QUERIES["roi_counts"](spark, d).collect()} for d in (sf_dir, repeated_orders))
    assert {k: 5 * n for k, n in once.items()} == five and sizes[0] == sizes[1]


def test_gaussian_mask_agrees_with_sql_on_a_slide_with_missing_pixels(spark, sf_dir, tmp_path):
    import duckdb

    from tessera.plans.queries import SQL

    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 356 AND vec_id NOT BETWEEN 130 AND 144").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    columns = "slide_id, x, y, m"
    want = duck.sql(f"SELECT {columns} FROM ({SQL['adaptive_gaussian_mask']})").fetchall()
    assert sorted(map(tuple, QUERIES["adaptive_gaussian_mask"](spark, str(tmp_path)).select(*columns.split(", ")).collect())) == sorted(want)


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines() if "Exchange " in x]


def test_confidence_shuffles_windows_once(spark):
    from tessera.operators import evaluation

    rows = [(i, (7 * n) % 90 - 5, (13 * n) % 70 - 3, n % 3, 0.125 * (n % 9)) for i in range(3) for n in range(200)]
    windows = spark.createDataFrame(rows, "image_id long, x long, y long, class_idx int, p double").repartition(3)
    want = {}
    for i, x, y, c, p in rows:
        for dx in range(4):
            for dy in range(4):
                want[i, y + dy, x + dx, c] = want.get((i, y + dy, x + dx, c), 0) + p
    for cells in (False, True):
        found = evaluation.confidence_map(windows, 4, cells=cells)
        assert {(r["image_id"], r["y"], r["x"], r["class_idx"]): r["p"] for r in found.collect()} == want and found.count() == len(want)
    best = evaluation.winning_class(found, 86, 70, 2)
    assert len(exchanges(evaluation.winning_class(evaluation.confidence_map(spark.range(9).selectExpr("id image_id", "id x", "id y", "1 class_idx", "0.5D p"), 4, cells=True), 9, 9, 0))) == 1
    assert best.count() == len({k[:3] for k in want})


def test_landmarks_are_dealt_by_image_before_they_are_rows(spark):
    from tessera.operators import landmarks

    marks = spark.range(40).selectExpr("id % 9 image_id", "id % 5 term_id", "CAST(id AS INT) x", "CAST(-id AS INT) y")
    found = landmarks.wide(marks, [0, 1, 7])
    assert found.columns == ["image_id", "0_x", "0_y", "1_x", "1_y", "7_x", "7_y"]
    rows = [(i % 9, i % 5, i) for i in range(40)]
    value = lambda i, t, way: max((way * v for a, b, v in rows if (a, b) == (i, t)), default=None)
    assert {tuple(r) for r in found.collect()} == {(i, *(value(i, t, way) for t in (0, 1, 7) for way in (1, -1))) for i in range(9)}
    lines = exchanges(found)
    assert len(lines) == 1 and "REPARTITION_BY_COL" in lines[0]


def test_errors_are_dealt_by_image_before_they_are_rows(spark):
    from tessera.operators import landmarks

    preds = spark.range(60).selectExpr("id % 9 image_id", "id % 5 term_id", "id x_true", "id y_true", "id + id % 4 x_pred", "id y_pred")
    lines = exchanges(landmarks.error_matrix(preds))
    assert len(lines) == 2 and "REPARTITION_BY_COL" in lines[-1]


def test_nearest_vote_in_slices_agrees_with_brute_force(spark, monkeypatch):
    import numpy as np

    from tessera.operators import learners

    monkeypatch.setattr(learners, "PIECE", 7)
    monkeypatch.setattr(learners, "SLICE", 900)
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (90, 5)).astype(float)
    rows = spark.createDataFrame([(i, i * 7 % 4, [float(v) for v in p]) for i, p in enumerate(points)], "sample_id long, label int, embedding array<float>")
    want = {}
    for q in range(0, 90, 20):
        near = sorted((round(float(((points[q] - points[t]) ** 2).sum()), 8), t) for t in range(90) if t != q)[:6]
        votes = [t * 7 % 4 for _, t in near]
        pred = max(range(4), key=lambda c: (votes.count(c), -c))
        want[q] = (pred, votes.count(pred))
    found = learners.nearest_vote(rows, rows.filter("sample_id % 20 = 0").select("sample_id", "embedding"), 6, block=3)
    assert {r["sample_id"]: (r["pred"], r["votes"]) for r in found.collect()} == want
    assert learners.nearest_vote(rows.limit(0), rows.limit(0), 6).isEmpty()


def test_patches_are_read_from_blocks(spark, sf_dir):
    plan = QUERIES["patch_differences"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plan
