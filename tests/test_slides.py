"""Segmentation of whole slides and validation of classes, on pictures of bright squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, raster, slides, workflow

SIZE = 6


def picture(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(20, 60, (48, 50))
    truth = np.zeros((48, 50), int)
    for x, y in ((5, 6), (30, 4), (18, 28)):
        truth[y : y + 11, x : x + 12] = 1
    v[truth == 1] = rng.integers(180, 230, int(truth.sum()))
    return v, truth


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for image in (1, 2):
        v, _ = picture(image)
        rows += [(image, x, y, int(v[y, x])) for y in range(48) for x in range(50)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, v int").cache()


def test_squares_are_segmented(spark, table):
    annotations = spark.createDataFrame([(1, 1, 3, 4, 16, 15, [1]), (2, 1, 28, 2, 16, 15, [1]), (3, 1, 0, 20, 16, 20, [2]), (4, 1, 30, 20, 18, 20, [3])], "annotation_id long, image_id long, x0 int, y0 int, w int, h int, terms array<int>")
    masks = spark.createDataFrame([(1, y, 5, 16) for y in range(6, 17)] + [(2, y, 30, 41) for y in range(4, 15)] + [(3, y, 0, 15) for y in range(20, 40)], "annotation_id long, y int, x0 int, x1 int")
    class_map = spark.createDataFrame([(1, 1), (2, 0), (3, -1)], "term_id int, cls int")
    windows = slides.training_windows(annotations, masks, table, class_map, ["v"], n=8, size=SIZE).collect()
    assert len(windows) == 24 and {r["sample_id"].split("/")[0] for r in windows} == {"1", "2", "3"}
    for r in windows:  # labels are of the same pixels as the values
        assert all((f > 120) == bool(c) for f, c in zip(r["features"], r["label"], strict=True))
    nodes = slides.build_segmentation(annotations, masks, table, class_map, ["v"], n=20, size=SIZE, trees=3, k=10, depth=6)
    images = spark.createDataFrame([(1, 50, 48), (2, 50, 48)], "image_id long, width int, height int")
    rois = spark.createDataFrame([(2, y, 0, 49) for y in range(26)], "image_id long, y int, x0 int, x1 int")
    options = {"size": SIZE, "step": 2, "tile": 20, "min_dev": 2}
    mask = slides.segmented(images, table, nodes, ["v"], **options).filter("image_id = 2").collect()
    _, truth = picture(2)
    assert np.mean([r["m"] == truth[r["y"], r["x"]] for r in mask]) > 0.95 and len(mask) > 2000
    found = slides.segment_slides(images, table, nodes, ["v"], least=60, rois=rois, **options).collect()
    assert [r["image_id"] for r in found] == [2, 2] and all(90 <= r["area"] <= 170 for r in found)
    counts = workflow.count_in_rois(spark.createDataFrame(found), spark.createDataFrame([(7, 2, 0, 0, 50, 26), (8, 2, 0, 30, 50, 10)], "roi_id long, image_id long, x0 int, y0 int, w int, h int")).collect()
    assert {r["roi_id"]: r["annotations"] for r in counts} == {7: 2, 8: 0}


def test_both_ways_through_a_forest_agree(spark, table, monkeypatch):
    nodes = [(t, 1, 3 + t, 90.0, False, [0.0] * 72, 9) for t in range(2)] + [(t, 2 + s, None, None, True, [p for i in range(36) for p in (1 - (s + 1) / 3 - i / 400, (s + 1) / 3 + i / 400)], 4) for t in range(2) for s in range(2)]
    forest = spark.createDataFrame(nodes, "tree_id int, node long, feature int, threshold double, leaf boolean, value array<double>, n long")
    holes = table.filter("NOT (x BETWEEN 20 AND 22 AND y BETWEEN 30 AND 31)").unionByName(table.limit(5))
    images = spark.createDataFrame([(1, 50, 48), (2, 50, 48), (3, 50, 48)], "image_id long, width int, height int")
    rois = spark.createDataFrame([(2, y, 5, 44) for y in range(3, 30)] + [(3, 1, 0, 9)], "image_id long, y int, x0 int, x1 int")
    for options in ({"step": 3, "tile": 14, "min_dev": 40}, {"step": 6, "tile": 16, "min_dev": 2, "rois": rois}):
        found = slides.segmented(images, holes, forest, ["v"], size=SIZE, clean=False, **options)
        dense = {(r["image_id"], r["x"], r["y"]) for r in found.filter("m = 1").collect()}
        assert found.count() == found.select("image_id", "x", "y").distinct().count()
        with monkeypatch.context() as m:
            m.setattr(slides, "FOREST_BYTES", 0)
            joined = slides.segmented(images, holes.distinct(), forest, ["v"], size=SIZE, clean=False, **options)
            assert dense == {(r["image_id"], r["x"], r["y"]) for r in joined.filter("m = 1").collect()} and dense
    assert slides.segmented(images, table.limit(0), forest, ["v"], size=SIZE, step=2).isEmpty()
    with pytest.raises(ValueError):
        slides.segmented(images, table, forest, ["v"], size=SIZE, tile=5)


def test_blocks_give_what_one_array_gives(spark, table):
    v, _ = picture(2)
    other = table.filter("image_id = 2").withColumn("v", F.when(F.col("v") > 50, 1).otherwise(0))
    whole = {(r["x"], r["y"]): r["v"] for r in raster.hit_or_miss(other, ["image_id"], "v").collect()}
    small = {(r["x"], r["y"]): r["v"] for r in raster.hit_or_miss(other, ["image_id"], "v", side=7).collect()}
    assert whole == small and len(whole) == v.size
    for size in (3, 11):
        ways = [raster.adaptive_gaussian(table, ["image_id"], size, 3, side=side).filter("image_id = 2").collect() for side in (13, 64)]
        assert {tuple(r) for r in ways[0]} == {tuple(r) for r in ways[1]} and len(ways[0]) == v.size
    shifted = table.withColumns({"x": F.col("x") - 17, "y": F.col("y") - 100})
    back = blocks.each(shifted, ["image_id"], ["v"], 3, lambda b: b.rows({"v": b.own(b.values["v"])}), "v int", side=10)
    assert sorted(map(tuple, back.collect())) == sorted((r["image_id"], r["x"] - 17, r["y"] - 100, r["v"]) for r in table.collect())
    assert blocks.each(table.limit(0), ["image_id"], ["v"], 3, lambda b: b.rows({}), "v int").isEmpty()


def test_resampling(spark, table):
    v, _ = picture(1)
    sizes = spark.createDataFrame([(1, 50, 48)], "image_id long, width int, height int")
    same = raster.resampled(table.filter("image_id = 1"), ["image_id"], sizes, 50, 48, "cubic").collect()
    assert all(r["v"] == pytest.approx(v[r["y"], r["x"]]) for r in same) and len(same) == v.size
    half = {(r["x"], r["y"]): r["v"] for r in raster.resampled(table, ["image_id"], sizes, 25, 24, "area").collect()}
    assert all(half[x, y] == pytest.approx(v[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean()) for x in range(25) for y in range(24))
    large = {(r["x"], r["y"]): r["v"] for r in raster.resampled(table, ["image_id"], sizes, 100, 96, "bilinear").collect()}
    assert len(large) == 9600 and large[3, 0] == pytest.approx(0.75 * v[0, 1] + 0.25 * v[0, 2]) and large[0, 0] == v[0, 0]


def test_classes_are_validated(spark, table):
    colours = table.withColumns({"r": F.col("v"), "g": F.col("v"), "b": F.col("v")}).drop("v")
    boxes = [(i, image, x, y, 10, 9, c) for i, (image, x, y, c) in enumerate([(1, 6, 7, 1), (1, 31, 5, 1), (2, 19, 29, 1), (2, 6, 7, 1), (1, 36, 30, 0), (1, 2, 34, 0), (2, 36, 30, 0), (2, 2, 34, 0)])]
    annotations = spark.createDataFrame(boxes, "annotation_id long, image_id long, x0 int, y0 int, w int, h int, class_idx int")
    predictions, rates = workflow.validated(annotations, colours, classes=2, folds=2, n=4, least=0.5, size=4, trees=2, k=6, depth=3)
    assert sorted((r["image_id"], r["label"], r["pred"]) for r in predictions.collect()) == [(i, b[-1], b[-1]) for i, b in enumerate(boxes)]
    assert {r["label"]: r["rate"] for r in rates.collect()} == {0: 1.0, 1: 1.0, None: 1.0}


def test_windows_by_kernel_are_those_of_their_own_image(spark):
    """A window resampled is what its crop is as an image of its own; gaps, turns and empty tables too."""
    from pyspark.sql import functions as F

    from tessera.operators import features, raster

    pixels = spark.range(50 * 40).select(F.lit(3).cast("long").alias("image_id"), (F.col("id") % 50).cast("int").alias("x"), F.floor(F.col("id") / 50).cast("int").alias("y"), (F.col("id") * 7919 % 251).cast("int").alias("v"))
    pixels = pixels.filter("NOT (x = 31 AND y = 20)")
    boxes = spark.createDataFrame([(3, 0, 0, 0, 9, 9), (3, 1, 28, 17, 20, 13), (3, 2, 49, 39, 1, 1), (3, 4, 5, 5, 0, 4), (8, 0, 0, 0, 4, 4)], "image_id long, sw int, x0 int, y0 int, w int, h int")
    key = lambda r: (r["sw"], r["x"], r["y"])
    for kernel in raster.KERNELS:
        found = features.resized(boxes, pixels, 6, 6, ["v"], kernel=kernel)
        got = {key(r): r["v"] for r in found.collect()}
        assert {k[0] for k in got} == {0, 1, 2}
        for sw, x0, y0, w, h in ((0, 0, 0, 9, 9), (1, 28, 17, 20, 13), (2, 49, 39, 1, 1)):
            crop = pixels.filter(f"x >= {x0} AND x < {x0 + w} AND y >= {y0} AND y < {y0 + h}").select(F.lit(sw).alias("sw"), (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), "v")
            sizes = spark.createDataFrame([(sw, w, h)], "sw int, width int, height int")
            want = {key(r): r["v"] for r in raster.resampled(crop, ["sw"], sizes, 6, 6, kernel).collect()}
            assert want.keys() == {k for k in got if k[0] == sw} and all(abs(want[k] - got[k]) < 1e-9 for k in want)
    turned = features.resized(boxes, pixels, 6, 6, ["v"], turn=True, kernel="area").collect()
    assert sorted(round(r["v"], 9) for r in turned) == sorted(round(r["v"], 9) for r in features.resized(boxes, pixels, 6, 6, ["v"], kernel="area").collect())
    assert features.resized(boxes.limit(0), pixels, 6, 6, ["v"], kernel="cubic").isEmpty()


def test_window_vectors_by_kernel(spark):
    """On flat colour the kernels give what the nearest pixels give."""
    from pyspark.sql import functions as F

    from tessera.operators import raster, workflow

    images = spark.createDataFrame([(1, 20, 16), (2, 16, 24)], "image_id long, width int, height int")
    pixels = spark.range(1, 3).select(F.col("id").alias("image_id")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(23))))
    pixels = pixels.join(images, "image_id").filter("x < width AND y < height").select("image_id", "x", "y", (F.col("image_id") * 90).cast("int").alias("r"), F.lit(30).alias("g"), F.lit(255).alias("b"))
    plain = workflow.window_vectors(images, pixels, 4, 0.3, 1.0, 5).collect()
    assert len(plain) == 8
    for kernel in raster.KERNELS:
        found = workflow.window_vectors(images, pixels, 4, 0.3, 1.0, 5, kernel=kernel).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, plain))
