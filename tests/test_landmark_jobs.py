"""Landmarks on pictures whose landmarks can be seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import landmark_jobs, learners

OFFSETS = [(3, 0), (-3, 0), (0, 3), (0, -3), (2, 2), (-2, -2)]


@pytest.fixture(scope="module")
def pictures(spark):
    rng, cells, marks = np.random.default_rng(0), [], []
    for i in range(8):
        im = rng.integers(0, 20, (20, 20))
        x, y = rng.integers(7, 13, 2)
        im[y - 1 : y + 2, x - 1 : x + 2] = 200
        cells += [(i, xx, yy, int(im[yy, xx])) for yy in range(20) for xx in range(20)]
        marks.append((i, 1, int(x), int(y)))
    return (
        spark.createDataFrame(cells, "image_id long, x int, y int, v int").cache(),
        spark.createDataFrame([(i, 20, 20) for i in range(8)], "image_id long, width int, height int"),
        spark.createDataFrame(marks, "image_id long, term_id int, x int, y int"),
    )


def test_points_are_found(pictures):
    pixels, sizes, marks = pictures
    nodes, prior = landmark_jobs.fit(pixels, sizes, marks, OFFSETS, radius=1, outer=7, negatives=20, trees=3, k=4, depth=5)
    found = landmark_jobs.predict(pixels, sizes, nodes, prior, OFFSETS, 80, trees=3)
    off = found.join(marks.withColumnsRenamed({"x": "tx", "y": "ty"}), ["image_id", "term_id"]).select(F.avg(F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")))).first()[0]
    assert off < 2


def test_several_outputs(spark):
    rows = spark.createDataFrame([(i, [i % 2, (i // 2) % 3], [float(i % 2), float((i // 2) % 3)]) for i in range(60)], "sample_id long, label array<int>, features array<float>")
    means = learners.predict_mean(learners.apply_trees(rows, learners.fit_trees(rows, 2, 8, 3, depth=6)))
    for r in means.collect():
        v = np.array(r["value"]).reshape(2, 3)
        assert np.allclose(v.sum(axis=1), 1) and list(v.argmax(axis=1)) == [r["sample_id"] % 2, (r["sample_id"] // 2) % 3]


@pytest.fixture(scope="module")
def pairs(spark):
    """Pictures with a bright and a grey spot, the grey one right of the bright one."""
    rng, cells, marks = np.random.default_rng(2), [], []
    for i in range(6):
        im = rng.integers(0, 20, (18, 24))
        x, y = int(rng.integers(5, 9)), int(rng.integers(6, 12))
        im[y - 1 : y + 2, x - 1 : x + 2] = 220
        im[y - 1 : y + 2, x + 8 : x + 11] = 120
        cells += [(i, xx, yy, int(im[yy, xx])) for yy in range(18) for xx in range(24)]
        marks += [(i, 1, x, y), (i, 2, x + 9, y)]
    return (
        spark.createDataFrame(cells, "image_id long, x int, y int, v int").cache(),
        spark.createDataFrame([(i, 24, 18) for i in range(6)], "image_id long, width int, height int"),
        spark.createDataFrame(marks, "image_id long, term_id int, x int, y int"),
    )


def mean_error(found, marks):
    joined = found.select("image_id", "term_id", "x", "y").join(marks.withColumnsRenamed({"x": "tx", "y": "ty"}), ["image_id", "term_id"])
    return joined.select(F.avg(F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))), F.count("*")).first()


def test_landmarks_by_messages(pairs):
    pixels, sizes, marks = pairs
    model = landmark_jobs.fit_graph(pixels, sizes, marks, OFFSETS, radius=1, outer=8, negatives=20, partners=1, reach=3, moved=12, trees=2, k=4, depth=4)
    assert [tuple(r) for r in model["links"].collect()] == [(1, 2)]
    found = landmark_jobs.predict_by_messages(pixels, sizes, model, OFFSETS, trees=2, step=1, n=4, rounds=2)
    off, n = mean_error(found, marks)
    assert n == 12 and off < 2


def test_landmarks_by_shape(pairs):
    pixels, sizes, marks = pairs
    shifts = landmark_jobs.fit_offsets(pixels, sizes, marks, OFFSETS, reach=4, n=30, trees=2, k=4, depth=5)
    off, n = mean_error(landmark_jobs.predict_by_shape(pixels, sizes, marks, shifts, OFFSETS, reference=0, n=60, largest=6, trees=2, least=2), marks)
    assert n == 12 and off < 2.5


def test_point_vectors_read_the_clamped_pixel(spark, pairs):
    pixels, sizes, marks = pairs
    offsets = [(9, -4), (-30, 2), (0, 0)]
    v = {(r["image_id"], r["x"], r["y"]): r["v"] for r in pixels.collect()}
    points = marks.unionByName(marks.limit(1)).unionByName(marks.withColumn("x", F.lit(23)))
    found = landmark_jobs.point_vectors(pixels.filter("NOT (image_id = 3 AND x = 0)"), sizes, points, offsets).collect()
    assert found and all(r["image_id"] != 3 for r in found) and len(found) == points.filter("image_id <> 3").count()
    for r in found:
        i, x, y = r["image_id"], r["x"], r["y"]
        assert r["features"] == [v[i, x, y] - v[i, min(max(x + dx, 0), 23), min(max(y + dy, 0), 17)] for dx, dy in offsets]
