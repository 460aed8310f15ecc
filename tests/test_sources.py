"""Image folders, landmark files, sinks and the workflow."""

import struct

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import raster, workflow
from tessera.sources import images, sinks


def bmp(rgb):
    h, w, _ = rgb.shape
    pad = (-3 * w) % 4
    body = b"".join(row[:, ::-1].astype(np.uint8).tobytes() + b"\0" * pad for row in rgb[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def test_image_folder(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 256, (4, 5, 3))
    for c in ("3", "8"):
        (tmp_path / c).mkdir()
        (tmp_path / c / "1.bmp").write_bytes(bmp(rgb))
    (tmp_path / "3" / "notes.png").write_text("no image")
    found = images.labelled_directory(spark, str(tmp_path))
    assert sorted(r["label"] for r in found.select("label").collect()) == ["3", "8"]
    cells = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in images.pixels(found.filter("label = '3'"), "label").collect()}
    assert cells == {(x, y): tuple(map(int, rgb[y, x])) for y in range(4) for x in range(5)}
    mapped = images.labelled_directory(spark, str(tmp_path), spark.createDataFrame([("3", "0")], "label string, cls string"))
    assert [r["label"] for r in mapped.select("label").collect()] == ["0"]
    std = images.standardised(images.pixels(found, "path"), "path").groupBy("path").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in std)


def test_landmark_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7.txt").write_text("1 10 20 0.1 0.2\n2 30 40 0.3 0.4\n")
    (tmp_path / "in" / "8.txt").write_text("2 50 60 0.5 0.6\n")
    marks = images.landmark_files(spark, str(tmp_path / "in"))
    assert {(r["image_id"], r["term_id"], r["x"]) for r in marks.collect()} == {(7, 1, 10), (7, 2, 30), (8, 2, 50)}
    ids = spark.createDataFrame([(7,), (8,)], "image_id long")
    assert {(r["image_id"], r["x"]) for r in images.for_images(ids, marks, 1, 0).collect()} == {(7, 10), (8, 0)}
    sinks.landmark_csv(marks, {1: "a", 2: "b"}, str(tmp_path / "csv"))
    lines = sorted(x for p in (tmp_path / "csv").glob("part*") for x in p.read_text().split())
    assert set(lines) == {"ID_IMAGE;a_x;a_y;b_x;b_y", "7;10.000;20.000;30.000;40.000", "8;-1;-1;50.000;60.000"}
    sinks.landmark_text(marks, str(tmp_path / "text"))
    assert sorted(p.name for p in (tmp_path / "text").glob("image_id*")) == ["image_id=7", "image_id=8"]
    preds = spark.createDataFrame([(7, 1, 0, 0, 3, 4), (7, 2, 0, 0, 0, 1), (8, 2, 0, 0, 0, 3)], "image_id long, term_id int, x_true int, y_true int, x_pred int, y_pred int")
    sinks.error_csv(preds, [1, 2], str(tmp_path / "err"))
    rows = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "err")).collect()
    assert {tuple(r) for r in rows} == {("7", "5.0", "1.0", "3.0"), ("8", None, "3.0", "3.0"), ("term_avg", "5.0", "2.0", "3.0")}
    nodes = spark.createDataFrame([(0, 1, None, None, True, [1.0], 3)], "tree_id int, node long, feature int, threshold double, leaf boolean, value array<double>, n long")
    sinks.save_model(nodes, ids, {"trees": "1"}, str(tmp_path / "model"))
    again, _, parameters = sinks.load_model(spark, str(tmp_path / "model"))
    assert again.collect() == nodes.collect() and parameters == {"trees": "1"}


def test_workflow(spark):
    rgb = np.full((30, 30, 3), 220)
    rgb[4:14, 4:16, 1] = 40
    rgb[20:25, 20:25, 1] = 40
    pixels = spark.createDataFrame([(1, x, y, int(rgb[y, x, 0]), int(rgb[y, x, 1]), int(rgb[y, x, 2])) for y in range(30) for x in range(30)], "image_id long, x int, y int, r int, g int, b int")
    flow = workflow.Workflow().segment(workflow.green_segmenter(100, 1)).dispatch("large", F.col("area") > 50, lambda o: o.withColumns({"cls": F.lit(1), "p": F.lit(0.5)})).dispatch("small", F.lit(True))
    found = {r["dispatch"]: (r["area"], r["cls"]) for r in flow.run(pixels).collect()}
    assert found == {"large": (120, 1), "small": (25, None)}
    slide = pixels.select("image_id", "x", "y", F.col("g").alias("v"))
    assert sorted(r["area"] for r in workflow.find_objects(slide, ["image_id"], dark=True, least=10, most=1000).collect()) == [25, 120]
    rois = spark.createDataFrame([(5, 1, 0, 0, 18, 18)], "roi_id long, image_id long, x0 int, y0 int, w int, h int")
    assert workflow.count_in_rois(workflow.find_objects(slide, ["image_id"], dark=True, least=10, most=1000), rois).first()["annotations"] == 1


def test_window_classifier(spark):
    rng = np.random.default_rng(1)
    cells = [(i, x, y, *(int(v) for v in (rng.integers(0, 90, 3) if i % 2 else rng.integers(150, 255, 3)))) for i in range(6) for y in range(12) for x in range(12)]
    pixels = spark.createDataFrame(cells, "image_id long, x int, y int, r int, g int, b int")
    sizes = spark.createDataFrame([(i, 12, 12, i % 2) for i in range(6)], "image_id long, width int, height int, class_idx int")
    windows = workflow.window_vectors(sizes, pixels, 4, 0.5, 1.0, 4, space=0).cache()
    nodes = workflow.fit_windows(sizes, windows, 2, trees=2, k=4, depth=3)
    assert {r["image_id"]: r["class_idx"] for r in workflow.classify_windows(windows, nodes).collect()} == {i: i % 2 for i in range(6)}


def test_tile_feed_matches_batch(spark):
    images_ = spark.createDataFrame([(1, 100, 70)], "image_id long, width int, height int")
    t = raster.tiles(images_, 32, 2)
    assert t.filter("x0 + w > 100 OR y0 + h > 70").isEmpty() and t.count() == 12


def test_failed_crops_are_rows(spark, tmp_path):
    folder = tmp_path / "crops"
    (folder / "sub").mkdir(parents=True)
    rgb = np.random.default_rng(1).integers(0, 256, (3, 4, 3))
    (folder / "a.bmp").write_bytes(bmp(rgb))
    (folder / "sub" / "b 1.bmp").write_bytes(bmp(rgb[:2]))
    (folder / "broken.bmp").write_bytes(bmp(rgb)[:40])
    (folder / "text.png").write_text("no image")
    (folder / "empty.bmp").write_bytes(b"")
    found, failed = images.crops_and_failures(spark, str(folder))
    assert {(r["name"], r["width"], r["height"]) for r in found.collect()} == {("a.bmp", 4, 3), ("b 1.bmp", 4, 2)}
    assert {(r["name"], r["reason"]) for r in failed.collect()} == {("broken.bmp", "not an image"), ("text.png", "not an image")}
    sizes = spark.createDataFrame([("a.bmp", 4, 3), ("b 1.bmp", 4, 3), ("empty.bmp", 4, 3)], "name string, w int, h int")
    found, failed = images.crops_and_failures(spark, str(folder), sizes)
    sinks.crops(found, failed, str(tmp_path / "out"))
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "out" / "crops")).collect()] == ["a.bmp"]
    reasons = {r["name"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "out" / "failures")).collect()}
    assert reasons["b 1.bmp"] == "size 4x2" and reasons["empty.bmp"] == "missing" and len(reasons) == 4


def test_landmark_export(spark, tmp_path):
    (tmp_path / "images.csv").write_text("1,9,100,50,0.5,20,a.svs\n2,9,100,60,,,b.svs\n3,8,10,10,,,c.svs\n")
    (tmp_path / "terms.json").write_text('{"term_id": 7, "project_id": 9, "name": "tip"}\n{"term_id": 5, "project_id": 9, "name": "eye"}\n{"term_id": 6, "project_id": 9, "name": "unused"}\n')
    table = images.image_metadata(spark, str(tmp_path / "images.csv"), 9, "csv")
    terms = images.ontology(spark, str(tmp_path / "terms.json"), 9, "json")
    assert [r["height"] for r in table.orderBy("image_id").collect()] == [50, 60] and [r["term_id"] for r in terms.collect()] == [5, 6, 7]
    rows = [(1, 1, [7, 5], True, "POINT(10.9 20.2)"), (2, 1, [5], True, "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"), (3, 1, [7], True, "POINT (11 21)"), (4, 2, [7], False, "POINT(1 1)"), (5, 2, [], True, "POINT(1 1)"), (6, 3, [5], True, "POINT(1 1)")]
    annotations = spark.createDataFrame(rows, "annotation_id long, image_id long, terms array<long>, reviewed boolean, wkt string")
    workflow.export_landmarks(annotations, table, terms, str(tmp_path / "csv"))
    lines = {x for p in (tmp_path / "csv").glob("part*") for x in p.read_text().split()}
    assert lines == {"ID_IMAGE;eye_x;eye_y;tip_x;tip_y", "1;5.000;45.000;11.000;29.000", "2;-1;-1;-1;-1"}
