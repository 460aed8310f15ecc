"""Sub-windows, descriptors and samples: FEA-01 to FEA-20, WIN-12, JOIN-07, JOIN-08, RAS-14.

Every random choice is a hash of the seed and the row's keys, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators.raster import integral, resampled


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from a hash of seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(k) if isinstance(k, str) else k for k in keys)), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys, F.lit(1)))) * F.cos(2 * np.pi * uniform(seed, *keys, F.lit(2)))


def window_boxes(images: DataFrame, n: int, least: float, most: float, tw: int, th: int, seed: int = 0, fixed: bool = False) -> DataFrame:
    """(image_id, sw, x0, y0, w, h): n random windows in each image, of the target's shape. FEA-01.

    Images that hold no window of the least size have no rows: `too_small` lists them. FEA-02.
    """
    each = images.filter(~_small(least, tw, th, fixed)).withColumn("sw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = lambda j: uniform(seed, "image_id", "sw", F.lit(j))
    width, height = F.col("width"), F.col("height")
    if fixed:
        cw, ch = F.least(F.lit(float(tw)), width), F.least(F.lit(float(th)), height)
    else:
        narrow = width < height
        low_w, high_w = least * width, F.least(most * width, height * tw / th)
        low_h, high_h = least * height, F.least(most * height, width * th / tw)
        cw = F.when(narrow, low_w + u(0) * (high_w - low_w)).otherwise((low_h + u(0) * (high_h - low_h)) * tw / th)
        ch = F.when(narrow, (low_w + u(0) * (high_w - low_w)) * th / tw).otherwise(low_h + u(0) * (high_h - low_h))
    w, h = F.greatest(F.floor(cw), F.lit(1)), F.greatest(F.floor(ch), F.lit(1))
    sized = each.withColumns({"w": w.cast("int"), "h": h.cast("int")})
    return sized.select("image_id", "sw", F.floor(u(1) * (width - F.col("w"))).cast("int").alias("x0"), F.floor(u(2) * (height - F.col("h"))).cast("int").alias("y0"), "w", "h")


def _small(least: float, tw: int, th: int, fixed: bool) -> Column:
    if fixed:
        return F.lit(False)
    return F.when(F.col("width") < F.col("height"), least * F.col("width") * th / tw > F.col("height")).otherwise(least * F.col("height") * tw / th > F.col("width"))


def too_small(images: DataFrame, least: float, tw: int, th: int) -> DataFrame:
    return images.filter(_small(least, tw, th, False))


def crops(boxes: DataFrame, pixels: DataFrame, channels: Sequence[str], cell: int = 32) -> DataFrame:
    """(image_id, sw, x, y, channels): the pixels of each window, counted from its corner. Windows meet the pixels of the
    cells that they touch, so a join key holds at most cell * cell pixels. Windows without width or height have no rows."""
    span = lambda c, d: F.sequence(F.floor(F.col(c) / cell), F.floor((F.col(c) + F.col(d) - 1) / cell))
    touched = boxes.filter("w > 0 AND h > 0").select("image_id", "sw", "x0", "y0", "w", "h").withColumn("cx", F.explode(span("x0", "w"))).withColumn("cy", F.explode(span("y0", "h")))
    seen = pixels.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"), *(F.col(c).alias(f"of_{c}") for c in channels))
    inside = (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x0") + F.col("w")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y0") + F.col("h"))
    found = touched.join(seen, ["image_id", "cx", "cy"]).filter(inside)
    return found.select("image_id", "sw", (F.col("px") - F.col("x0")).cast("int").alias("x"), (F.col("py") - F.col("y0")).cast("int").alias("y"), *(F.col(f"of_{c}").alias(c) for c in channels))


def resized(boxes: DataFrame, pixels: DataFrame, tw: int, th: int, channels: Sequence[str], turn: bool = False, seed: int = 0, kernel: str | None = None, antialias: bool = True) -> DataFrame:
    """(image_id, sw, y, x, channels): each window at the target size. FEA-03. turn: one of five right-angle turns and
    mirrors for five windows in six. FEA-04.

    Without kernel the nearest pixel: a target pixel asks for one source pixel by an equi join on (image_id, x, y), whose
    rows are windows * tw * th. With one of `raster.KERNELS` the channels are doubles, weighted sums over the window's own
    pixels: its rows are the pixels of all windows, added up along rows and then columns. Pixels that are missing have no
    part in a sum, and a target pixel without any has no row.
    """
    if kernel:
        sizes = boxes.select("image_id", "sw", F.col("w").alias("width"), F.col("h").alias("height"))
        found = resampled(crops(boxes, pixels, channels), ["image_id", "sw"], sizes, tw, th, kernel, antialias, channels)
    else:
        found = _nearest(boxes, pixels, tw, th, channels)
    return _turned(found, tw, th, seed) if turn else found


def _nearest(boxes: DataFrame, pixels: DataFrame, tw: int, th: int, channels: Sequence[str]) -> DataFrame:
    grid = boxes.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(tw - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(th - 1))))
    asked = grid.select("image_id", "sw", "x", "y", (F.col("x0") + F.floor(F.col("x") * F.col("w") / tw)).cast("int").alias("px"), (F.col("y0") + F.floor(F.col("y") * F.col("h") / th)).cast("int").alias("py"))
    return asked.join(pixels.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), *channels), ["image_id", "px", "py"]).drop("px", "py")


def _turned(found: DataFrame, tw: int, th: int, seed: int) -> DataFrame:
    if tw != th:
        raise ValueError("only square windows can be turned")
    way = F.floor(uniform(seed, "image_id", "sw", F.lit(9)) * 6)
    x, y, e = F.col("x"), F.col("y"), tw - 1
    nx = F.when(way == 1, e - x).when(way == 2, x).when(way == 3, y).when(way == 4, e - x).when(way == 5, e - y).otherwise(x)
    ny = F.when(way == 1, y).when(way == 2, e - y).when(way == 3, e - x).when(way == 4, e - y).when(way == 5, x).otherwise(y)
    return found.withColumns({"x": nx, "y": ny})


def vectors(windows: DataFrame, channels: Sequence[str], label: Column | None = None) -> DataFrame:
    """(image_id, sw, features): the values of a window in order of row, column and channel. FEA-05."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *channels)))
    flat = windows.groupBy("image_id", "sw").agg(cells.alias("_c"))
    return flat.select("image_id", "sw", F.flatten(F.transform("_c", lambda c: F.array(*(c[k].cast("float") for k in channels)))).alias("features"))


def grid_windows(tiles: DataFrame, size: int, step: int) -> DataFrame:
    """(image_id, tile_id, x, y): the corners of windows on a grid over a tile. FEA-06."""
    span = lambda c, d: F.sequence(F.col(c), F.col(c) + F.greatest(F.col(d) - size, F.lit(0)), F.lit(step))
    return tiles.withColumn("x", F.explode(span("x0", "w"))).withColumn("y", F.explode(span("y0", "h"))).select("image_id", "tile_id", "x", "y")


def label_of_centre(windows: DataFrame, tw: int, th: int, label: Column) -> DataFrame:
    """(image_id, sw, label): 0 where the central pixel is transparent. FEA-08, UDF-01."""
    return windows.filter((F.col("x") == tw // 2) & (F.col("y") == th // 2)).select("image_id", "sw", F.when(F.col("a") == 0, 0).otherwise(label).alias("label"))


def label_mask(windows: DataFrame, label: Column) -> DataFrame:
    """(image_id, sw, labels): the label of each pixel that is opaque, else 0. FEA-09."""
    masked = windows.withColumn("_l", F.when(F.col("a") == 255, label).otherwise(0))
    return masked.groupBy("image_id", "sw").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "_l"))), lambda c: c["_l"]).alias("labels"))


def disc(landmarks: DataFrame, radius: int, step: int = 1) -> DataFrame:
    """Landmarks moved to every point of a grid within the radius. FEA-10, JOIN-08."""
    r = range(-radius, radius + 1, step)
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in r for dy in r if dx * dx + dy * dy <= radius * radius))
    return landmarks.withColumn("_o", F.explode(offsets)).withColumns({"x": F.col("x") + F.col("_o.dx"), "y": F.col("y") + F.col("_o.dy")}).drop("_o")


def ring_samples(landmarks: DataFrame, n: int, inner: float, outer: float, width: Column, height: Column, seed: int = 0) -> DataFrame:
    """n random points about each landmark, between two radii, within the image. FEA-11."""
    each = landmarks.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = lambda j: uniform(seed, "image_id", "term_id", "i", F.lit(j))
    radius, angle = inner + u(0) * (outer - inner), 2 * np.pi * u(1)
    at = lambda c, shift, size: F.greatest(F.lit(0), F.least(F.round(F.col(c) + shift).cast("int"), size - 1))
    return each.withColumns({"x": at("x", radius * F.cos(angle), width), "y": at("y", radius * F.sin(angle), height)})


def rotations(images: DataFrame, times: int, degrees: float, seed: int = 0) -> DataFrame:
    """images once per pass with its angle: 0 first, then uniform within +- degrees. FEA-12."""
    each = images.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return each.withColumn("angle", F.when(F.col("pass") == 0, F.lit(0.0)).otherwise((uniform(seed, "image_id", "pass") * 2 - 1) * degrees))


def background(pixels: DataFrame, landmarks: DataFrame, radius: int, border: int, width: int, height: int, n: int, seed: int = 0) -> DataFrame:
    """n pixels of each image outside all landmark discs and the border, by a hash. RAS-14, SRT-04, SET-03."""
    inner = pixels.filter((F.col("x") >= border) & (F.col("x") < width - border) & (F.col("y") >= border) & (F.col("y") < height - border))
    free = inner.join(disc(landmarks, radius).select("image_id", "x", "y").distinct(), ["image_id", "x", "y"], "left_anti")
    w = Window.partitionBy("image_id").orderBy(F.xxhash64(F.lit(seed), "y", "x"), "y", "x")
    return free.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def patches(pyramid: DataFrame, points: DataFrame, half: int, levels: int, subtract: bool = False) -> DataFrame:
    """(image_id, x, y, k, dy, dx, v): the (2 half)**2 means about each point at each level. FEA-13; less the centre: FEA-14.
    Read by index from blocks of each level: points are shuffled once per level, not once per mean."""
    r = range(-half, half)
    places = [(dy, dx) for dy in r for dx in r]
    side = F.pow(F.lit(2.0), F.col("k"))
    asked = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    asked = asked.select("image_id", "k", F.floor(F.col("x") / side).cast("int").alias("x"), F.floor(F.col("y") / side).cast("int").alias("y"), F.col("x").alias("_x"), F.col("y").alias("_y"))

    def see(plane: np.ndarray, rows: np.ndarray, columns: np.ndarray, _others: dict) -> dict[str, pa.Array]:
        v = np.nan_to_num(np.stack([plane[rows + dy, columns + dx] for dy, dx in places], axis=1), nan=0.0, posinf=np.inf, neginf=-np.inf)
        if subtract:
            v = v - np.nan_to_num(plane[rows, columns], nan=0.0, posinf=np.inf, neginf=-np.inf)[:, None]
        return {"means": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), len(places)).cast(pa.list_(pa.float64()))}

    found = blocks.at_points(pyramid.filter(F.col("k") < levels), asked, ["image_id", "k"], "v", half, see, "means array<double>", 8 * len(places))
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in places))
    each = found.select("image_id", F.col("_x").alias("x"), F.col("_y").alias("y"), "k", F.explode(F.arrays_zip(offsets.alias("o"), F.col("means").alias("v"))).alias("m"))
    return each.select("image_id", "x", "y", "k", "m.o.dy", "m.o.dx", "m.v")


def haar_corners(kind: str, x1: int, y1: int, x2: int, y2: int, compat: bool = False) -> list[tuple[int, int, int]]:
    """(column, row, coefficient) of the integral image, relative to the point. WIN-12, FEA-15.

    compat keeps a plus before the first corner of horizontal pairs, where the true difference has a minus.
    """
    left, top = x1 - 1, y1 - 1
    if kind in ("h2", "h3"):
        parts = int(kind[1])
        size = (x2 - x1 + 1) // parts
        columns, signs = [*(left + i * size for i in range(parts)), x2], {2: (1, -2, 1), 3: (-1, 2, -2, 1)}[parts]
        out = [(c, r, way * s) for r, way in ((y2, 1), (top, -1)) for c, s in zip(columns, signs, strict=True)]
        return [(c, r, abs(k)) if compat and parts == 2 and (c, r) == (left, top) else (c, r, k) for c, r, k in out]
    if kind in ("v2", "v3"):
        way = -1 if kind == "v2" else 1
        return [(r, c, way * k) for c, r, k in haar_corners("h" + kind[1], y1, x1, y2, x2)]
    if kind == "sq":
        xs, ys = [left, left + (x2 - x1 + 1) // 2, x2], [top, top + (y2 - y1 + 1) // 2, y2]
        return [(x, y, kx * ky) for x, kx in zip(xs, (1, -2, 1), strict=True) for y, ky in zip(ys, (1, -2, 1), strict=True)]
    raise ValueError(kind)


def haar_sql(pixels: DataFrame, points: DataFrame, rectangles: Sequence[tuple], compat: bool = False) -> DataFrame:
    """(image_id, x, y, f, d) by equi joins on the integral image: for a few rectangles. WIN-12. Corners are clamped; those
    before the first row or column are 0."""
    corners = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(cx).alias("cx"), F.lit(cy).alias("cy"), F.lit(k).alias("k")) for f, (kind, *box) in enumerate(rectangles) for cx, cy, k in haar_corners(kind, *box, compat=compat)))
    ends = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    asked = points.join(ends, "image_id").withColumn("c", F.explode(corners))
    at = lambda c, e, m: F.least(F.greatest(F.col(c) + F.col(f"c.{e}"), F.lit(-1)), F.col(m))
    asked = asked.select("image_id", "x", "y", F.col("c.f").alias("f"), F.col("c.k").alias("k"), at("x", "cx", "mx").alias("px"), at("y", "cy", "my").alias("py"))
    sums = integral(pixels, ["image_id"]).select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), "s")
    found = asked.join(sums, ["image_id", "px", "py"], "left")
    return found.groupBy("image_id", "x", "y", "f").agg(F.sum(F.col("k") * F.coalesce("s", F.lit(0))).alias("d"))


def haar_dense(tiles: DataFrame, rectangles: Sequence[tuple], compat: bool = False) -> DataFrame:
    """(image_id, x, y, features) for many rectangles. tiles: image_id, w, h, data (bytes, row by row), xs, ys (points).

    One vectorised pass per tile: the integral image of the tile, then one gather per corner of a rectangle.
    """
    table = [haar_corners(kind, *box, compat=compat) for kind, *box in rectangles]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                sums = np.zeros((r.h + 1, r.w + 1), np.int64)
                sums[1:, 1:] = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w).astype(np.int64).cumsum(0).cumsum(1)
                xs, ys = np.asarray(r.xs), np.asarray(r.ys)
                values = np.zeros((len(xs), len(table)), np.float32)
                for f, corners in enumerate(table):
                    for cx, cy, k in corners:
                        values[:, f] += k * sums[np.clip(ys + cy + 1, 0, r.h), np.clip(xs + cx + 1, 0, r.w)]
                out.append(pd.DataFrame({"image_id": r.image_id, "x": xs, "y": ys, "features": list(values)}))
            if out:
                yield pd.concat(out)

    return tiles.select("image_id", "w", "h", "data", "xs", "ys").mapInPandas(apply, "image_id long, x int, y int, features array<float>")


def random_rectangles(n: int, half: int, seed: int = 0) -> list[tuple]:
    """n rectangles shared out over the five kinds. FEA-15. A small table, drawn once on the driver."""
    rng, out = np.random.default_rng(seed), []
    for kind, dx, dy in (("h2", 1, 0), ("v2", 0, 1), ("h3", 2, 0), ("v3", 0, 2), ("sq", 1, 1)):
        for _ in range(n // 5):
            x1, y1 = int(rng.integers(-half, half - dx + 1)), int(rng.integers(-half, half - dy + 1))
            out.append((kind, x1, y1, int(rng.integers(x1 + dx, half + 1)), int(rng.integers(y1 + dy, half + 1))))
    return out


def random_offsets(n: int, sigma: float, seed: int = 0) -> list[tuple[int, int]]:
    """n offsets from a rounded normal distribution. FEA-16."""
    return [tuple(map(int, o)) for o in np.rint(np.random.default_rng(seed).normal(0, sigma, (n, 2)))]


def offset_differences(pixels: DataFrame, offsets: Sequence[tuple[int, int]], width: int, height: int) -> DataFrame:
    """(image_id, x, y, f, d): a pixel less the one at an offset, clamped to the image. FEA-16, JOIN-07. Read by index from
    blocks with a halo of the largest offset; differences with pixels that are missing have no row. v is whole."""
    dx, dy = (np.array([o[i] for o in offsets]) for i in (0, 1))

    def see(block: blocks.Block) -> pa.Table:
        v = np.where(block.present, block.values["v"].astype(float), np.nan)
        y, x = np.nonzero(block.own(block.present))
        h = block.halo
        py = np.clip(y[:, None] + dy + block.y0, 0, height - 1) - block.y0 + h
        px = np.clip(x[:, None] + dx + block.x0, 0, width - 1) - block.x0 + h
        inside = (py >= 0) & (px >= 0) & (py < len(v)) & (px < len(v))
        d = v[y + h, x + h][:, None] - np.where(inside, v[np.where(inside, py, 0), np.where(inside, px, 0)], np.nan)
        i, f = np.nonzero(~np.isnan(d))
        names, values = ["image_id", "x", "y", "f", "d"], [(x[i] + block.x0).astype(np.int32), (y[i] + block.y0).astype(np.int32), f.astype(np.int32), d[i, f].astype(np.int64)]
        return pa.Table.from_arrays([pa.repeat(block.key[0], len(i)), *map(pa.array, values)], names=names)

    halo = int(max(np.abs(dx).max(), np.abs(dy).max(), 0))
    return blocks.each(pixels.select("image_id", "x", "y", "v"), ["image_id"], ["v"], halo, see, "f int, d long", max(blocks.SIDE, halo))


def displaced(landmarks: DataFrame, n: int, reach: int, seed: int = 0, polar: bool = False) -> DataFrame:
    """n points about each landmark with their offset as target: uniform in a square, or polar. FEA-18, FEA-19."""
    each = landmarks.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u, v = uniform(seed, "image_id", "term_id", "i", F.lit(0)), uniform(seed, "image_id", "term_id", "i", F.lit(1))
    dx, dy = ((u * reach * F.cos(2 * np.pi * v), u * reach * F.sin(2 * np.pi * v)) if polar else ((u * 2 - 1) * reach, (v * 2 - 1) * reach))
    moved = each.withColumns({"dx": F.round(dx).cast("int"), "dy": F.round(dy).cast("int")})
    return moved.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})


def candidates(images: DataFrame, prior: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(image_id, term_id, i, x, y): n points from each term's normal prior, in the image's size. FEA-20. prior is one row
    per term; the join is on nothing, against that small table."""
    each = images.crossJoin(F.broadcast(prior)).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    a, b = normal(seed, "image_id", "term_id", "i", F.lit(0)), normal(seed, "image_id", "term_id", "i", F.lit(1))
    sx = F.sqrt("var_x")
    low = F.when(sx > 0, F.col("cov_xy") / sx).otherwise(F.lit(0.0))
    rest = F.sqrt(F.greatest(F.col("var_y") - low * low, F.lit(0.0)))
    at = lambda v, size: F.greatest(F.lit(0), F.least(F.round(v * size).cast("int"), size - 1))
    return each.select("image_id", "term_id", "i", at(F.col("mean_x") + sx * a, F.col("width")).alias("x"), at(F.col("mean_y") + low * a + rest * b, F.col("height")).alias("y"))
