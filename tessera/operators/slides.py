"""Segmentation of whole slides: a pixel model from annotations, its use tile by tile, and what follows. FIL-10, ML-23, ML-24, JOB-04, JOB-05."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import annotations as marks
from tessera.operators import blocks, features, learners, raster, regions, spatial

BOX = ("annotation_id", "image_id", "x0", "y0", "w", "h")


def training_windows(annotations: DataFrame, masks: DataFrame, pixels: DataFrame, class_map: DataFrame, channels: Sequence[str], n: int = 100, size: int = 24, seed: int = 0) -> DataFrame:
    """(sample_id, label, features): n random windows in the crop of each annotation, with a class per pixel.

    annotations: BOX and terms; masks: runs (annotation_id, y, x0, x1) of their polygons; class_map: term_id, cls (1: to be
    predicted, -1: left out, others 0). A pixel outside the polygon is of class 0. An annotation smaller than a window is
    taken with its surroundings.
    """
    known = marks.first_class(annotations, class_map)
    wide = known.withColumns({"w": F.greatest("w", F.lit(size)), "h": F.greatest("h", F.lit(size))})
    boxes = wide.select(*BOX)
    inside = masks.select("annotation_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.lit(255).alias("a")).distinct()
    of = boxes.select("annotation_id", F.col("x0").alias("_x"), F.col("y0").alias("_y"))
    crop = spatial.crops(boxes, pixels).join(of, "annotation_id").withColumns({"x": F.col("x") + F.col("_x"), "y": F.col("y") + F.col("_y")})
    crop = crop.join(inside, ["annotation_id", "x", "y"], "left").select(F.col("annotation_id").alias("image_id"), (F.col("x") - F.col("_x")).alias("x"), (F.col("y") - F.col("_y")).alias("y"), *channels, F.coalesce("a", F.lit(0)).alias("a"))
    images = boxes.select(F.col("annotation_id").alias("image_id"), F.col("w").alias("width"), F.col("h").alias("height"))
    windows = features.resized(features.window_boxes(images, n, 1.0, 1.0, size, size, seed, fixed=True), crop, size, size, [*channels, "a"])
    labels = features.label_mask(windows.join(known.select(F.col("annotation_id").alias("image_id"), "cls"), "image_id"), F.col("cls"))
    whole = features.vectors(windows, channels).filter(F.size("features") == size * size * len(channels))  # a crop may leave the slide
    return whole.join(labels, ["image_id", "sw"]).select(F.concat_ws("/", "image_id", "sw").alias("sample_id"), F.col("labels").alias("label"), "features")


def build_segmentation(annotations: DataFrame, masks: DataFrame, pixels: DataFrame, class_map: DataFrame, channels: Sequence[str], n: int = 100, size: int = 24, trees: int = 10, k: int = 28, min_split: int = 2, depth: int = 12, seed: int = 0) -> DataFrame:
    """The nodes of trees with an output per pixel of a window. ML-23, JOB-04."""
    rows = training_windows(annotations, masks, pixels, class_map, channels, n, size, seed)
    return learners.fit_trees(rows, trees, k, classes=2, min_split=min_split, depth=depth, seed=seed)


#: A forest of at most so many bytes may be sent to every executor.
FOREST_BYTES = 256 << 20


class Forest:
    """Trees with an output per pixel of a window, packed in arrays: what a dense pass looks up."""

    def __init__(self, nodes: list, classes: int):
        place = {(n["tree_id"], n["node"]): i for i, n in enumerate(nodes)}
        self.roots = np.array(sorted(i for (_, node), i in place.items() if node == 1))
        self.leaf = np.array([n["leaf"] for n in nodes], bool)
        self.feature = np.array([n["feature"] or 0 for n in nodes])
        self.threshold = np.array([n["threshold"] or 0.0 for n in nodes])
        child = lambda n, side: place.get((n["tree_id"], n["node"] * 2 + side), 0)
        self.children = np.array([[child(n, 0), child(n, 1)] for n in nodes])
        leaves = np.flatnonzero(self.leaf)
        self.value_of = np.full(len(nodes), -1)
        self.value_of[leaves] = np.arange(len(leaves))
        self.values = np.array([nodes[i]["value"] for i in leaves], float).reshape(len(leaves), -1, classes)

    def means(self, planes: np.ndarray, y: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        """(windows, pixels of a window, classes): the trees' mean for windows with corners at (y, x) of planes (channels, h, w)."""
        channels = len(planes)
        total = 0.0
        for root in self.roots:
            at = np.full(len(y), root)
            going = np.flatnonzero(~self.leaf[at])
            while going.size:
                f = self.feature[at[going]]
                pixel, channel = f // channels, f % channels
                seen = planes[channel, y[going] + pixel // size, x[going] + pixel % size]
                at[going] = self.children[at[going], (seen > self.threshold[at[going]]).astype(int)]
                going = going[~self.leaf[at[going]]]
            total = total + self.values[self.value_of[at]]
        return total / len(self.roots)


def packed(nodes: DataFrame, classes: int = 2) -> Forest | None:
    """The forest as arrays, if its measured size is within FOREST_BYTES; else None."""
    one = nodes.select(F.size("value")).first()
    if one is None or nodes.count() * (8 * one[0] + 64) > FOREST_BYTES:
        return None
    return Forest(nodes.select("tree_id", "node", "feature", "threshold", "leaf", F.when(F.col("leaf"), F.col("value")).alias("value")).collect(), classes)


def _kept_tiles(images: DataFrame, pixels: DataFrame, channels: Sequence[str], size: int, step: int, tile: int, rois: DataFrame | None, min_dev: float, max_mean: float) -> DataFrame:
    """(image_id, tx, ty, width, height): tiles that rois touch and that aren't empty. A tile starts at a multiple of its step and
    overlaps the next one by size - step, so that each window of a grid lies in one tile."""
    apart = tile - (size - step)
    span = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - tile) / apart) + 1, F.lit(0)), F.floor(F.col(c) / apart)))
    placed = pixels.select("image_id", "x", "y", *channels).withColumn("tx", span("x")).withColumn("ty", span("y"))
    key = ["image_id", "tx", "ty"]
    if rois is not None:
        every = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.col(c) - 1) / apart)))
        grid = images.filter("width > 0 AND height > 0").withColumn("tx", every("width")).withColumn("ty", every("height"))
        boxes = grid.select(*key, F.concat_ws(",", "tx", "ty").alias("tile_id"), (F.col("tx") * apart).alias("x0"), (F.col("ty") * apart).alias("y0"), F.lit(tile).alias("w"), F.lit(tile).alias("h"))
        placed = placed.join(spatial.tiles_over(boxes, rois).select(*key), key, "left_semi")
    full = raster.tile_stats(placed, key, channels).filter(raster.not_empty(channels, min_dev, max_mean)).select(*key)
    return full.join(images.select("image_id", "width", "height"), "image_id")


def _dense(pixels: DataFrame, kept: DataFrame, forest: Forest, channels: Sequence[str], size: int, step: int, tile: int) -> DataFrame:
    """(image_id, x, y, m) of the pixels that windows of kept tiles may reach, by one pass over blocks with a halo of a window."""
    apart, halo, names = tile - (size - step), size - 1, list(channels)
    around = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1))))
    near = kept.select("image_id", "tx", "ty", "width", "height", around.alias("o"))
    # windows of a tile reach its own block and those right and below; a block has the tiles that are kept as bits
    near = near.groupBy("image_id", (F.col("tx") + F.col("o.dx")).alias("_bx"), (F.col("ty") + F.col("o.dy")).alias("_by")).agg(
        F.expr("bit_or(shiftleft(1, (1 - o.dy) * 3 + 1 - o.dx))").alias("_kept"), F.first("width").alias("_width"), F.first("height").alias("_height"))
    rows = blocks.dealt(pixels.select("image_id", "x", "y", *channels), ["image_id"], channels, halo, apart).join(near, ["image_id", "_bx", "_by"])
    shared = pixels.sparkSession.sparkContext.broadcast(forest)

    def segment(block: blocks.Block) -> pa.Table:
        trees: Forest = shared.value
        kept_bits, width, height = (block.table.column(c)[0].as_py() for c in ("_kept", "_width", "_height"))
        ys, xs = [], []
        for bit in range(9):
            if kept_bits >> bit & 1:
                ox, oy = (block.bx + bit % 3 - 1) * apart, (block.by_ + bit // 3 - 1) * apart
                gx = np.arange(ox, min(ox + tile, width) - size + 1, step)
                gy = np.arange(oy, min(oy + tile, height) - size + 1, step)
                gy, gx = (g.ravel() for g in np.meshgrid(gy, gx, indexing="ij"))
                ys.append(gy)
                xs.append(gx)
        # windows that meet the block's own pixels, in the block's coordinates
        y, x = np.concatenate(ys) - block.y0 + halo, np.concatenate(xs) - block.x0 + halo
        meets = (y >= 0) & (x >= 0) & (y < apart + halo) & (x < apart + halo)
        y, x = y[meets], x[meets]
        whole = np.pad(block.present.astype(int).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        filled = whole[y + size, x + size] - whole[y, x + size] - whole[y + size, x] + whole[y, x] == size * size
        y, x = y[filled], x[filled]
        planes = np.stack([block.values[c] for c in names]).astype(float)
        votes = np.zeros((*block.present.shape, trees.values.shape[2]))
        for start in range(0, len(y), 4096):
            v, u = y[start : start + 4096], x[start : start + 4096]
            means = trees.means(planes, v, u, size)
            for i in range(size * size):  # corners differ, so the places of one pixel of the window do
                votes[v + i // size, u + i % size] += means[:, i]
        best = np.round(votes, 9).argmax(axis=2).astype(np.int32)  # the lowest class on ties, and without a window
        return block.rows({"m": block.own(best)})

    return blocks.grouped(rows, ["image_id"], channels, halo, segment, "m int", apart)


def _by_rows(pixels: DataFrame, kept: DataFrame, nodes: DataFrame, channels: Sequence[str], size: int, step: int, tile: int) -> DataFrame:
    """`_dense` for a forest of any size: windows as rows, trees by joins. Only pixels under a window have a row."""
    apart = tile - (size - step)
    placed = kept.select("image_id", F.lit(0).alias("tile_id"), (F.col("tx") * apart).alias("x0"), (F.col("ty") * apart).alias("y0"), F.least(F.lit(tile), F.col("width") - F.col("tx") * apart).alias("w"), F.least(F.lit(tile), F.col("height") - F.col("ty") * apart).alias("h"))
    corners = features.grid_windows(placed.filter((F.col("w") >= size) & (F.col("h") >= size)), size, step).select("image_id", "x", "y").distinct()
    boxes = corners.select("image_id", F.concat_ws(",", "x", "y").alias("sw"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lit(size).alias("w"), F.lit(size).alias("h"))
    vectors = features.vectors(features.resized(boxes, pixels, size, size, channels), channels).filter(F.size("features") == size * size * len(channels))
    means = learners.predict_mean(learners.apply_trees(vectors.select(F.concat_ws("/", "image_id", "sw").alias("sample_id"), "features"), nodes))
    place, corner = F.split("sample_id", "/"), F.split(F.split("sample_id", "/")[1], ",")
    each = means.select(place[0].cast("long").alias("image_id"), corner[0].cast("int").alias("x"), corner[1].cast("int").alias("y"), F.posexplode("value").alias("i", "p"))
    # value: two classes for each pixel of the window, by rows
    at = F.floor(F.col("i") / 2)
    votes = each.groupBy("image_id", (F.col("x") + at % size).cast("int").alias("x"), (F.col("y") + F.floor(at / size)).cast("int").alias("y"), (F.col("i") % 2).alias("class_idx")).agg(F.sum("p").alias("p"))
    return votes.groupBy("image_id", "x", "y").agg(F.max_by("class_idx", F.struct(F.round("p", 9), -F.col("class_idx"))).cast("int").alias("m"))


def segmented(images: DataFrame, pixels: DataFrame, nodes: DataFrame, channels: Sequence[str], size: int = 24, step: int = 8, tile: int = 512, rois: DataFrame | None = None, min_dev: float = 5, max_mean: float = 250, clean: bool = True) -> DataFrame:
    """(image_id, x, y, m): 1 where the windows over a pixel give class 1 the larger sum. ML-24.

    images: image_id, width, height. Tiles overlap by a window less a step, so every pixel meets the windows that it would on
    one large image. Tiles that rois (runs image_id, y, x0, x1) don't touch, and empty ones, make no windows; pixels that no
    window reaches are 0, or have no row where no tile near them is kept; pixels outside rois are 0. Windows that miss a
    pixel are left out. Isolated pixels are cleaned off unless clean is False.

    A forest of at most FOREST_BYTES is packed and sent to the executors; each block of pixels, with a halo of a window, is
    one array in which all windows go down all trees by index, and their votes add up in place. Pixels are shuffled once. A
    larger forest is applied by joins.
    """
    if tile < size or step > size:
        raise ValueError("a tile holds a window, and windows leave no gaps")
    kept = _kept_tiles(images, pixels, channels, size, step, tile, rois, min_dev, max_mean)
    forest = packed(nodes)
    best = _by_rows(pixels, kept, nodes, channels, size, step, tile) if forest is None else _dense(pixels, kept, forest, channels, size, step, tile)
    if rois is not None:
        best = spatial.outside_zero(best, rois, "m")
    return raster.hit_or_miss(best, ["image_id"]) if clean else best


def segment_slides(images: DataFrame, pixels: DataFrame, nodes: DataFrame, channels: Sequence[str], least: float = 0, most: float = 1e18, rois: DataFrame | None = None, **options: int) -> DataFrame:
    """(image_id, first_y, first_x, area, box): the objects of segmented slides within area bounds; whole slides are
    labelled, so objects that cross tiles are one. JOB-05; workflow.count_in_rois counts them by region."""
    mask = segmented(images, pixels, nodes, channels, rois=rois, **options)
    objects = regions.areas(regions.labelled(regions.runs(mask, ["image_id"]), ["image_id"]), ["image_id"])
    return objects.filter(regions.within(F.col("area"), least, most))
