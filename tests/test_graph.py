"""Components, objects over cells, dense cells and discs against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, raster, regions, spatial


def reached(vertices, edges):
    label = {v: v for v in vertices}

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    return {v: top(v) for v in vertices}


@pytest.mark.parametrize("limit", [1 << 20, 7])
def test_components(spark, limit, monkeypatch):
    monkeypatch.setattr(graph, "EDGES", limit)
    rng = random.Random(3)
    vertices = [(k, v) for k in ("p", "q", "p'") for v in range(-20, 180)]
    edges = [(k, rng.randrange(-20, 180), rng.randrange(-20, 180)) for k in ("p", "q") for _ in range(90)] + [("p'", v, v + 1) for v in range(-20, 100)] + [("q", 5, 5)] * 3
    want = reached(vertices, [((k, a), (k, b)) for k, a, b in edges])
    v, e = spark.createDataFrame(vertices, "k string, v long"), spark.createDataFrame(edges, "k string, a long, b long").repartition(5)
    found = graph.components(v.unionByName(v.limit(9)), e, ["k"]).collect()
    assert {(r["k"], r["v"]): (r["k"], r["label"]) for r in found} == want and len(found) == len(want)
    alone = graph.components(v.select("v"), e.filter("k = 'q'").drop("k")).collect()
    assert {r["v"]: r["label"] for r in alone} == {v: t[1] for (k, v), t in want.items() if k == "q"}
    assert {r["v"] == r["label"] for r in graph.components(v.filter("k = 'p'").select("v"), e.drop("k").limit(0)).collect()} == {True}


@pytest.mark.parametrize("diagonal,side", [(False, 5), (True, 5), (True, 64), (False, 8)])
def test_objects_over_many_cells(spark, diagonal, side):
    rng = np.random.default_rng(side)
    masks = {1: rng.random((40, 43)) < 0.55, 2: rng.random((31, 64)) < 0.4, 3: np.ones((17, 30), bool)}
    masks[3][1:-1, 1:-1] = False
    rows = [(i, int(x) - 9, int(y) - 11, 1) for i, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    runs = regions.runs(spark.createDataFrame(rows, "image_id long, x int, y int, m int"), ["image_id"]).withColumn("tag", F.lit("t"))
    found = regions.labelled(runs, ["image_id"], diagonal, side)
    assert found.columns == ["image_id", "y", "x0", "x1", "tag", "object"]
    got = found.collect()
    assert len(got) == runs.count()
    pixels = {(i, y, x) for i, x, y, _ in rows}
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    want = reached(pixels, [((i, y, x), (i, y + dy, x + dx)) for i, y, x in pixels for dy, dx in steps if (i, y + dy, x + dx) in pixels])
    assert all(tuple(r["object"]) == want[r["image_id"], r["y"], x] for r in got for x in range(r["x0"], r["x1"] + 1))
    assert regions.labelled(runs.limit(0), ["image_id"]).isEmpty()


def test_a_dense_cell_is_many_keys(spark):
    rng = random.Random(8)
    boxes = [(i, 1, rng.randrange(256), rng.randrange(256), rng.randrange(3), rng.randrange(3)) for i in range(3000)] + [(3000 + i, rng.randrange(3), rng.randrange(-600, 900), rng.randrange(-600, 900), rng.randrange(80), rng.randrange(80)) for i in range(400)]
    table = spark.createDataFrame(boxes, "annotation_id long, image_id long, x0 int, y0 int, w int, h int")
    cells = spatial.celled_evenly(table, crowd=60)
    sizes = [r["count"] for r in cells.groupBy("image_id", "cx", "cy", "sx", "sy").count().collect()]
    assert max(sizes) < 300 and len(sizes) > 60
    want = set()
    by = defaultdict(list)
    for b in boxes:
        by[b[1]].append(b)
    for some in by.values():
        x0, y0, w, h = (np.array([b[k] for b in some]) for k in (2, 3, 4, 5))
        meet = (x0[:, None] <= (x0 + w)[None]) & (x0[None] <= (x0 + w)[:, None]) & (y0[:, None] <= (y0 + h)[None]) & (y0[None] <= (y0 + h)[:, None])
        want |= {(some[i][0], some[j][0]) for i, j in zip(*np.nonzero(np.triu(meet, 1)), strict=True)}
    for crowd in (60, 10**9):
        found = spatial.touching_pairs(table, crowd=crowd).collect()
        assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("radius,skip_axes", [(1, False), (4, False), (4, True), (9, False)])
def test_suppression(spark, radius, skip_axes):
    rng = np.random.default_rng(radius)
    v = rng.integers(0, 30, (24, 21))
    keep = rng.random(v.shape) < 0.8
    table = spark.createDataFrame([(1, int(x), int(y), int(v[y, x])) for y, x in zip(*np.nonzero(keep), strict=True)], "image_id long, x int, y int, v int")
    want = set()
    for y, x in zip(*np.nonzero(keep), strict=True):
        around = [(y + dy, x + dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dx * dx + dy * dy <= radius * radius and not (skip_axes and not dx * dy)]
        if all(v[y, x] >= v[p] for p in around if 0 <= p[0] < 24 and 0 <= p[1] < 21 and keep[p]):
            want.add((x, y, v[y, x]))
    found = raster.suppressed(table, ["image_id"], radius, skip_axes)
    assert {(r["x"], r["y"], r["v"]) for r in found.collect()} == want


def traced(pixels):
    """{(outer, ring)} of one object's pixels (y, x), by walking from corner to corner."""
    follow = defaultdict(list)
    for y, x in pixels:
        for gone, a, b in (((y - 1, x), (x, y), (x + 1, y)), ((y, x + 1), (x + 1, y), (x + 1, y + 1)), ((y + 1, x), (x + 1, y + 1), (x, y + 1)), ((y, x - 1), (x, y + 1), (x, y))):
            if gone not in pixels:
                follow[a].append(b)
    out = set()
    while follow:
        at = start = min(follow)
        ring, way = [at], None
        while True:
            to = next((b for b in follow[at] if way and (b[0] - at[0], b[1] - at[1]) == (-way[1], way[0])), follow[at][0])
            follow[at].remove(to)
            if not follow[at]:
                del follow[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step == way:
                ring.pop()
            ring.append(to)
            at, way = to, step
            if at == start:
                break
        out.add((sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)) > 0, tuple(ring)))
    return out


@pytest.mark.parametrize("diagonal", [False, True])
def test_outlines(spark, diagonal):
    rng = np.random.default_rng(5)
    masks = {1: rng.random((30, 28)) < 0.6, 2: np.ones((21, 40), bool), 3: rng.random((12, 60)) < 0.45, 4: np.zeros((24, 24), bool)}
    masks[2][1:-1:2, 1:-1:2] = False
    for i in range(0, 24, 4):  # a comb whose outline passes many cells
        masks[4][i : i + 2] = True
    masks[4][:, 0] = True
    rows = [(i, int(x) - 5, int(y) - 7, 1) for i, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    objects = regions.labelled(regions.runs(spark.createDataFrame(rows, "image_id long, x int, y int, m int"), ["image_id"]), ["image_id"], diagonal)
    own = defaultdict(set)
    for r in objects.collect():
        own[r["image_id"], r["object"]["y"], r["object"]["x0"]].update((r["y"], x) for x in range(r["x0"], r["x1"] + 1))
    want = {(*k, outer, ring) for k, pixels in own.items() for outer, ring in traced(pixels)}
    for side in (4, 256):
        found = [(r["image_id"], r["first_y"], r["first_x"], r["outer"], tuple(map(tuple, r["ring"]))) for r in regions.contour(objects, ["image_id"], side).collect()]
        assert set(found) == want and len(found) == len(want)
    assert regions.contour(objects.limit(0), ["image_id"]).isEmpty()
