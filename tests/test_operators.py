"""Invariants and small cases worked out by numpy or by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import color, geometry
from tessera.operators import annotations, features, graph, landmarks, learners, raster, regions, spatial


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(3).integers(0, 256, (20, 24))


@pytest.fixture(scope="module")
def pixels(spark, picture):
    h, w = picture.shape
    return spark.createDataFrame([(1, x, y, int(picture[y, x])) for y in range(h) for x in range(w)], "image_id long, x int, y int, v int").cache()


def as_array(df, shape, value="v"):
    out = np.full(shape, -1.0)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


def test_integral_of_ones(pixels):
    ones = raster.integral(pixels.withColumn("v", F.lit(1)), ["image_id"])
    assert ones.filter("s <> (x + 1) * (y + 1)").isEmpty()


def test_morphology(pixels, picture):
    grown = as_array(raster.dilate(pixels, ["image_id"], 1, times=2), picture.shape)
    padded = np.pad(picture, 2, constant_values=-1)
    want = np.max([padded[dy : dy + 20, dx : dx + 24] for dy in range(5) for dx in range(5)], axis=0)
    assert (grown == want).all()
    assert (as_array(raster.open_(pixels, ["image_id"], 1), picture.shape) <= picture).all()
    assert (as_array(raster.close(pixels, ["image_id"], 1), picture.shape) >= picture).all()


def test_hit_or_miss(spark, picture):
    mask = (picture > 150).astype(int)
    df = spark.createDataFrame([(1, x, y, int(mask[y, x])) for y in range(20) for x in range(24)], "image_id long, x int, y int, m int")
    want = mask.copy()
    for hit, *misses in raster.HIT_OR_MISS:
        p = np.pad(want, 1)
        at = lambda o, p=p: p[1 + o[0] : 21 + o[0], 1 + o[1] : 25 + o[1]]
        want = np.where((want == 1) & (at(hit) == 1) & (at(misses[0]) == 0) & (at(misses[1]) == 0), 0, want)
    assert (as_array(raster.hit_or_miss(df, ["image_id"]), mask.shape, "m") == want).all()


def test_otsu_parts_two_levels(spark):
    df = spark.createDataFrame([(1, i, 0, 10 if i < 30 else 200) for i in range(50)], "image_id long, x int, y int, v int")
    assert raster.otsu(df, ["image_id"]).first()["threshold"] == 10
    one = df.withColumn("v", F.lit(7))
    assert raster.isodata(one, ["image_id"]).first()["threshold"] == 128


def test_components_don_t_depend_on_partitions(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 7 != 6] + [(100, 3)]
    e = spark.createDataFrame(edges, "a long, b long")
    v = spark.createDataFrame([(i,) for i in [*range(62), 100, 200]], "v long")
    found = {}
    for n in (2, 9):
        found[n] = {r["v"]: r["label"] for r in graph.components(v.repartition(n), e.repartition(n)).collect()}
    assert found[2] == found[9]
    assert found[2][100] == 0 and found[2][13] == 7 and found[2][200] == 200


def test_regions(spark):
    mask = ["..##..", ".####.", ".#..#.", "..##..", "......", "#....."]
    df = spark.createDataFrame([(1, x, y, int(c == "#")) for y, row in enumerate(mask) for x, c in enumerate(row)], "image_id long, x int, y int, m int")
    runs = regions.runs(df, ["image_id"])
    areas = regions.areas(regions.labelled(runs, ["image_id"]), ["image_id"]).collect()
    assert sorted(r["area"] for r in areas) == [1, 2, 8]
    joined = regions.labelled(runs, ["image_id"], diagonal=True)
    assert sorted(r["area"] for r in regions.areas(joined, ["image_id"]).collect()) == [1, 10]
    ring_mask = [".####.", ".#..#.", ".####.", "......", "#....."]
    ring = spark.createDataFrame([(1, x, y, int(c == "#")) for y, row in enumerate(ring_mask) for x, c in enumerate(row)], "image_id long, x int, y int, m int")
    rings = regions.contour(regions.labelled(regions.runs(ring, ["image_id"]), ["image_id"]), ["image_id"]).collect()
    assert sorted(r["outer"] for r in rings) == [False, True, True]
    signed = lambda ring: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)) / 2
    assert sum(signed(r["ring"]) for r in rings) == 11
    again = regions.merged(runs.unionByName(runs), ["image_id"])
    assert again.exceptAll(runs).isEmpty() and runs.exceptAll(again).isEmpty()
    box = spark.createDataFrame([(1, y, 5, 14) for y in range(10)], "image_id long, y int, x0 int, x1 int")
    back = regions.shrunk(regions.grown(box, ["image_id"], 2), ["image_id"], 2)
    assert {tuple(r) for r in back.select("y", "x0", "x1").collect()} == {(y, 5, 14) for y in range(10)}


def test_simplify_keeps_bounds(spark):
    ring = [[int(100 * np.cos(t)), int(100 * np.sin(t))] for t in np.linspace(0, 2 * np.pi, 400)]
    df = spark.createDataFrame([(1, ring)], "id int, ring array<array<int>>")
    found = regions.simplified(df, "ring", 20, 40).first()["ring"]
    assert 20 <= len(found) <= 40 and found[0] == ring[0] and found[-1] == ring[-1]


def test_polygon_text(spark):
    df = spark.createDataFrame([("POLYGON((0 0, 10 0, 10 4, 0 4, 0 0),(1 1, 2 1, 2 2, 1 1))",)], "wkt string").withColumn("r", geometry.rings(F.col("wkt")))
    ring = F.col("r")[0]
    r = df.select(F.size("r").alias("n"), geometry.area(ring).alias("a"), *(c.alias(n) for c, n in zip(geometry.centroid(ring), "xy", strict=True)), geometry.valid(ring).alias("ok"), geometry.wkt_of(ring).alias("t")).first()
    assert (r["n"], r["a"], r["x"], r["y"], r["ok"]) == (2, 40.0, 5, 2, True)
    assert r["t"].startswith("POLYGON((0.0 0.0, 10.0 0.0")


def test_hue_order_on_ties(spark):
    df = spark.createDataFrame([(9, 9, 1), (1, 9, 9), (9, 1, 9), (5, 5, 5)], "r int, g int, b int")
    h, s, v = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    assert [r[0] for r in df.select(h).collect()] == [60.0, 180.0, 300.0, 0.0]


def test_haar_dense_and_sql_agree(spark, pixels, picture):
    boxes = features.random_rectangles(20, 3, 1)
    points = [(1, x, y) for y in (0, 7, 19) for x in (0, 11, 23)]
    sql = {(r["x"], r["y"], r["f"]): r["d"] for r in features.haar_sql(pixels, spark.createDataFrame(points, "image_id long, x int, y int"), boxes).collect()}
    tile = spark.createDataFrame([(1, 24, 20, bytearray(picture.astype(np.uint8).tobytes()), [p[1] for p in points], [p[2] for p in points])], "image_id long, w int, h int, data binary, xs array<int>, ys array<int>")
    for r in features.haar_dense(tile, boxes).collect():
        assert [sql[r["x"], r["y"], f] for f in range(20)] == r["features"]


def test_windows_lie_inside_and_repeat(spark):
    images = spark.createDataFrame([(i, 40 + i, 90 - i) for i in range(20)], "image_id long, width int, height int")
    boxes = features.window_boxes(images, 10, 0.2, 0.9, 16, 16)
    assert boxes.join(images, "image_id").filter("x0 < 0 OR y0 < 0 OR x0 + w > width OR y0 + h > height").isEmpty()
    again = features.window_boxes(images.repartition(7), 10, 0.2, 0.9, 16, 16)
    assert boxes.exceptAll(again).isEmpty()


def test_probabilities_add_up(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 3), [float(i % 3 + rng.normal(0, 0.2)), float(rng.normal())]) for i in range(90)]
    df = spark.createDataFrame(rows, "sample_id long, label int, features array<float>")
    leaves = learners.apply_trees(df, learners.fit_trees(df, 3, 2, 3, depth=5))
    means = learners.predict_mean(leaves).collect()
    assert all(abs(sum(r["value"]) - 1) < 1e-9 for r in means)
    found = {r["sample_id"]: r["pred"] for r in learners.predict_class(leaves).collect()}
    assert sum(found[i] == i % 3 for i in range(90)) > 80


def test_messages_on_a_chain_find_the_best_path(spark):
    rng = np.random.default_rng(5)
    p, c = rng.random((3, 3)) + 0.1, rng.random((2, 3, 3)) + 0.1
    cand = spark.createDataFrame([(1, t, r, t, r, float(p[t, r])) for t in range(3) for r in range(3)], "image_id long, term_id int, rank int, x int, y int, p double")
    links = spark.createDataFrame([(1, t, t + 1, a, b, float(c[t, a, b])) for t in range(2) for a in range(3) for b in range(3)], "image_id long, src int, dst int, a int, b int, c double")
    found = {r["term_id"]: r["rank"] for r in landmarks.best_by_messages(cand, links, 4).collect()}
    joint = np.einsum("a,b,c,ab,bc->abc", *p, *c)
    want = [int(joint.sum(axis=tuple(j for j in range(3) if j != i)).argmax()) for i in range(3)]
    assert [found[t] for t in range(3)] == want


def test_alignment_turns_back(spark):
    base = [(0, 0, 0), (1, 10, 0), (2, 10, 5), (3, 0, 8)]
    turned = [(t, 3 * -y + 7, 3 * x - 2) for t, x, y in base]
    df = spark.createDataFrame([(0, *b) for b in base] + [(1, *b) for b in turned], "image_id long, term_id int, x int, y int")
    out = {(r["image_id"], r["term_id"]): (r["x"], r["y"]) for r in landmarks.aligned(df, 0).collect()}
    for t in range(4):
        assert np.allclose(out[0, t], out[1, t])


def test_relabel(spark):
    first = spark.createDataFrame([(1, 7, 0.9), (2, 7, 0.8)], "annotation_id long, term int, rate double")
    again = spark.createDataFrame([(1, 7, 0.6), (2, 4, 0.7)], "annotation_id long, term int, rate double")
    new, both = annotations.reclassified(first, again, 7)
    assert {tuple(r) for r in new.collect()} == {(1, 7, 0.9), (2, 4, 0.7)}
    assert {r["annotation_id"]: r["accepted"] for r in both.collect()} == {1: True, 2: False}


def test_merging_merged_boxes_changes_nothing(spark):
    boxes = spark.createDataFrame([(1, i, (i * 37) % 200, (i * 53) % 200, 12, 12) for i in range(60)], "image_id long, annotation_id long, x0 int, y0 int, w int, h int")
    once = spatial.merged_boxes(boxes)
    assert spatial.touching_pairs(once).isEmpty()
    assert spatial.merged_boxes(once).exceptAll(once).isEmpty()


def test_sparse_and_dense_masks_are_cleaned_alike(spark):
    rng = np.random.default_rng(8)
    mask = (rng.random((14, 15)) < 0.35).astype(int)
    rows = [(1, x, y, int(mask[y, x])) for y in range(14) for x in range(15)]
    dense = spark.createDataFrame(rows, "image_id long, x int, y int, m int")
    want = {(x, y) for y in range(14) for x in range(15) if mask[y, x]}
    for hit, *misses in raster.HIT_OR_MISS:
        on = lambda x, y, o: (x + o[1], y + o[0]) in want  # noqa: E731, B023
        want = want - {(x, y) for x, y in want if on(x, y, hit) and not any(on(x, y, o) for o in misses)}
    for df in (dense, dense.filter("m = 1")):
        assert {(r["x"], r["y"]) for r in raster.hit_or_miss(df, ["image_id"]).filter("m = 1").collect()} == want


def test_box_means_at_any_radius(spark, pixels, picture):
    for radius in (1, 7, 40):
        found = as_array(raster.box_mean(pixels, ["image_id"], radius), picture.shape, "mean")
        for y, x in ((0, 0), (9, 11), (19, 23)):
            assert abs(found[y, x] - picture[max(y - radius, 0) : y + radius + 1, max(x - radius, 0) : x + radius + 1].mean()) < 1e-9


def test_outlines_enclose_their_pixels(spark):
    rng = np.random.default_rng(6)
    mask = (rng.random((12, 13)) < 0.6).astype(int)
    df = spark.createDataFrame([(1, x, y, int(mask[y, x])) for y in range(12) for x in range(13)], "image_id long, x int, y int, v int")
    objects = regions.labelled(regions.runs(df, ["image_id"], "v"), ["image_id"])
    areas = {(r["first_y"], r["first_x"]): r["area"] for r in regions.areas(objects, ["image_id"]).collect()}
    signed, sides = {}, 0
    for r in regions.contour(objects, ["image_id"]).collect():
        ring, key = r["ring"], (r["first_y"], r["first_x"])
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
        assert r["outer"] == (twice > 0) and ring[0] == ring[-1]
        signed[key] = signed.get(key, 0) + twice / 2
        sides += sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(ring, ring[1:], strict=False))
    wide = np.pad(mask, 1)
    assert signed == areas and sides == np.abs(np.diff(wide, axis=0)).sum() + np.abs(np.diff(wide, axis=1)).sum()


def test_trees_without_rows(spark):
    rows = spark.createDataFrame([], "sample_id long, label int, features array<float>")
    nodes = learners.fit_trees(rows, 3, 2, classes=2)
    assert nodes.isEmpty() and learners.apply_trees(rows, nodes).isEmpty()


def test_final_classifiers_with_probabilities(spark):
    rng = np.random.default_rng(12)
    label = rng.integers(0, 3, 90)
    x = np.eye(3)[label] * 2 + rng.normal(0, 0.4, (90, 3))
    rows = spark.createDataFrame([(int(i), int(c), [float(v) for v in f]) for i, (c, f) in enumerate(zip(label, x, strict=True))], "sample_id long, label int, features array<double>")
    train, test = rows.filter("sample_id < 60"), rows.filter("sample_id >= 60")
    for code, options in (("svm", {}), ("et", {"trees": 5, "depth": 4})):
        found = learners.classified(train, test, code, **options).collect()
        assert len(found) == 30 and all(1 / 3 - 1e-9 <= r["p"] <= 1 for r in found if r["pred"] == r["label"])
        assert sum(r["pred"] == r["label"] for r in found) >= 27


def test_final_classifiers_make_their_training_rows_once(spark):
    """The fits go through the rows again and again; what makes the rows must not run each time."""
    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, i % 3, [float(i % 3 == c) * 2 + i % 7 / 10 for c in range(3)]) for i in range(60)], "sample_id long, label int, features array<double>")
    found = learners.classified(rows.mapInArrow(one, rows.schema), rows, "svm").collect()
    assert len(found) == 60 and made.value == 60


def test_regions_of_interest_by_mask(spark):
    """A slanted region: tiles that only its box meets go, pixels that no run covers are of class 0."""
    runs = spark.createDataFrame([(1, i, 10 * i, 10 * i + 14) for i in range(100)] + [(1, 3, 35, 60)], "image_id long, y int, x0 int, x1 int")
    tiles = spark.createDataFrame([(1, 10 * b + a, 100 * a, 10 * b, 100, 10) for a in range(10) for b in range(10)], "image_id long, tile_id int, x0 int, y0 int, w int, h int")
    covered = {(x, i) for i in range(100) for x in range(10 * i, 10 * i + 15)} | {(x, 3) for x in range(35, 61)}
    want = {r for r in ((10 * b + a) for a in range(10) for b in range(10)) if any((x, y) in covered for x in range(100 * (r % 10), 100 * (r % 10) + 100) for y in range(10 * (r // 10), 10 * (r // 10) + 10))}
    assert {r["tile_id"] for r in spatial.tiles_over(tiles, runs).collect()} == want and len(want) < 30
    pixels = spark.createDataFrame([(1, x, y, 7) for y in range(12) for x in range(0, 130, 3)], "image_id long, x int, y int, cls int")
    assert all(r["cls"] == 7 * ((r["x"], r["y"]) in covered) for r in spatial.outside_zero(pixels, runs).collect())


def test_elliptical_windows_by_brute_force(spark):
    rng = np.random.default_rng(4)
    assert raster.ellipse(3) == [3, 3, 2, 0]
    cells = {(i, int(x), int(y)): int(rng.integers(-50, 50)) for i in (1, 2) for x in range(-3, 30) for y in range(25) if rng.random() < 0.7}
    found = raster.elliptical(spark.createDataFrame([(*k, v) for k, v in cells.items()], "image_id long, x int, y int, v int"), ["image_id"], 2, ("dilate", "erode", "erode"), side=8)
    window = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dx) <= (2, 2, 0)[abs(dy)]]
    want = cells
    for pick in (max, min, min):
        want = {(i, x, y): pick(want[i, x + dx, y + dy] for dx, dy in window if (i, x + dx, y + dy) in want) for i, x, y in want}
    assert {(r["image_id"], r["x"], r["y"]): r["v"] for r in found.collect()} == want
    halves = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, None), (1, 5, 0, -1.5), (1, 5, 0, -1.5)], "image_id long, x int, y int, v double")
    assert sorted((r["x"], r["v"]) for r in raster.elliptical(halves, ["image_id"], 1, ["dilate"]).collect()) == [(0, 0.5), (1, 0.5), (5, -1.5)]
    assert raster.elliptical(halves.limit(0), ["image_id"], 1, ["erode"]).isEmpty()
