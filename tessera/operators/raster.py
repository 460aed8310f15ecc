"""Operators on long pixel tables (key columns, x, y, v): RAS, WIN-01, WIN-02, FUN-23, FIL-08, AGG-10, AGG-20."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import blocks

#: Weights of small Gaussian kernels, by size.
SMALL_GAUSSIAN = {3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}

#: Patterns of the clean-up, in the order they are applied: (offset that is set, two offsets that are unset), as (row, column).
HIT_OR_MISS = (
    ((-1, 1), (-1, 0), (0, 1)),
    ((-1, -1), (-1, 0), (0, -1)),
    ((1, 0), (0, -1), (0, 1)),
    ((-1, 0), (0, -1), (0, 1)),
    ((0, 1), (-1, 0), (1, 0)),
    ((0, -1), (-1, 0), (1, 0)),
)


def histogram(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*by, "v").agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, threshold): the value that best parts those up to it from those above; the least of equal ones. RAS-02."""
    w = Window.partitionBy(*by)
    upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(pixels, by).withColumns({"below": F.sum("n").over(upto), "mass": F.sum(F.col("n") * F.col("v")).over(upto), "total": F.sum("n").over(w), "sum": F.sum(F.col("n") * F.col("v")).over(w)})
    above = F.col("total") - F.col("below")
    gap = F.col("mass") / F.col("below") - (F.col("sum") - F.col("mass")) / above
    between = F.when(above > 0, F.col("below") * above * gap * gap).otherwise(F.lit(0.0))
    return h.withColumn("between", F.round(between, 6)).groupBy(*by).agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))


def isodata(pixels: DataFrame, by: Sequence[str], bins: int = 256) -> DataFrame:
    """(by, threshold): the first value at which the mean of both class means is passed. RAS-06.

    The upper class leaves out the largest value. An image of one value has bins / 2.
    """
    w = Window.partitionBy(*by)
    seen = pixels.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    grid = seen.filter("low < high").withColumn("v", F.explode(F.sequence("low", "high")))
    h = grid.join(histogram(pixels, by), [*by, "v"], "left").fillna(0, ["n"])
    upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    top = F.col("v") < F.col("high")
    h = h.withColumns({"n1": F.sum("n").over(upto), "s1": F.sum(F.col("n") * F.col("v")).over(upto), "n2": F.sum(F.when(top, F.col("n")).otherwise(0)).over(w), "s2": F.sum(F.when(top, F.col("n") * F.col("v")).otherwise(0)).over(w)})
    middle = (F.col("s1") / F.col("n1") + (F.col("s2") - F.col("s1")) / F.nullif(F.col("n2") - F.col("n1"), F.lit(0))) / 2.0
    h = h.withColumn("middle", middle)
    stop = (F.col("v") + 2 > F.col("middle")) | (F.col("v") + 1 >= F.col("high") - 1)
    found = h.filter(stop).groupBy(*by).agg(F.min_by("middle", "v").alias("middle"))
    return seen.join(found, list(by), "left").select(*by, F.coalesce(F.round("middle"), F.when(F.col("low") >= F.col("high"), F.lit(bins / 2.0))).cast("int").alias("threshold"))


def binary(pixels: DataFrame, threshold: Column) -> DataFrame:
    """v becomes 255 above the threshold, else 0. RAS-01."""
    return pixels.withColumn("v", F.when(F.col("v") > threshold, 255).otherwise(0))


def integral(pixels: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """pixels with s, the sum of all values left of and above a pixel, itself included. WIN-01."""
    row = Window.partitionBy(*by, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy(*by, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("_row", F.sum(value).over(row)).withColumn("s", F.sum("_row").over(column)).drop("_row")


def box_mean(pixels: DataFrame, by: Sequence[str], radius: int, value: str = "v") -> DataFrame:
    """pixels with mean, over the square of that radius cut at the border. Two separable passes; no join. A sum over a
    stretch is the difference of two sums from the start, so the work of a pixel doesn't grow with the radius."""

    def stretch(column: str, of: Window) -> Column:
        upto = lambda end: F.coalesce(F.sum(column).over(of.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
        return upto(radius) - upto(-radius - 1)

    row, column = Window.partitionBy(*by, "y").orderBy("x"), Window.partitionBy(*by, "x").orderBy("y")
    sums = pixels.withColumn("_one", F.col(value).isNotNull().cast("int")).withColumns({"_s": stretch(value, row), "_n": stretch("_one", row)})
    return sums.withColumn("mean", stretch("_s", column) / stretch("_n", column)).drop("_s", "_n", "_one")


def gaussian_kernel(size: int) -> np.ndarray:
    """Weights of an odd number of places, with the deviation that goes with the size; the sizes 3, 5 and 7 have fixed ones."""
    if size % 2 == 0 or size < 3:
        raise ValueError("a block has an odd size of 3 or more")
    if size in SMALL_GAUSSIAN:
        return np.array(SMALL_GAUSSIAN[size])
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def adaptive_gaussian(pixels: DataFrame, by: Sequence[str], size: int, constant: float, value: str = "v", side: int | None = None) -> DataFrame:
    """(by, x, y, v, m): 255 where v is above the weighted mean of its block of size x size less a constant. RAS-04.

    The mean is rounded (halves to even) and the constant rounded up, as for 8-bit images; beyond the border the nearest
    pixel of the image counts. Images are rectangles; a pixel missing inside one counts as 0, a null as 0.
    Rows and then columns are weighted in blocks with a halo of half a size.
    """
    kernel, reach = gaussian_kernel(size), size // 2
    side = side or max(blocks.SIDE, size)

    def weigh(block: blocks.Block) -> pa.Table:
        rows, columns = np.flatnonzero(block.present.any(axis=1)), np.flatnonzero(block.present.any(axis=0))
        top, left, bottom, right = rows[0], columns[0], rows[-1] + 1, columns[-1] + 1
        inner = block.values[value][top:bottom, left:right].astype(float)
        wide = np.pad(inner, reach, mode="edge")
        h, w = inner.shape
        across = sum(k * wide[:, i : i + w] for i, k in enumerate(kernel))
        mean = np.zeros(block.present.shape)
        mean[top:bottom, left:right] = sum(k * across[i : i + h] for i, k in enumerate(kernel))
        mean = np.rint(np.round(block.own(mean), 6))
        v = block.own(block.values[value])
        return block.rows({value: v, "m": np.where(v - mean > -np.ceil(constant), 255, 0).astype(np.int32)})

    return blocks.each(pixels, by, [value], reach, weigh, f"`{value}` {dict(pixels.dtypes)[value]}, m int", side)


def adaptive_box(pixels: DataFrame, by: Sequence[str], radius: int, constant: float) -> DataFrame:
    """pixels with m: 255 where v is above the local mean less a constant. RAS-03."""
    return box_mean(pixels, by, radius).withColumn("m", F.when(F.col("v") > F.col("mean") - constant, 255).otherwise(0)).drop("mean")


def _stretched(pixels: DataFrame, by: Sequence[str], radius: int, grow: bool, value: str) -> DataFrame:
    pick = F.max if grow else F.min
    row = Window.partitionBy(*by, "y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy(*by, "x").orderBy("y").rangeBetween(-radius, radius)
    return pixels.withColumn(value, pick(value).over(row)).withColumn(value, pick(value).over(column))


def dilate(pixels: DataFrame, by: Sequence[str], radius: int = 2, times: int = 1, value: str = "v") -> DataFrame:
    """The largest value of a square, cut at the border; n times a radius is one pass of n * radius. RAS-07."""
    return _stretched(pixels, by, radius * times, True, value)


def erode(pixels: DataFrame, by: Sequence[str], radius: int = 2, times: int = 1, value: str = "v") -> DataFrame:
    return _stretched(pixels, by, radius * times, False, value)


def close(pixels: DataFrame, by: Sequence[str], radius: int = 2, value: str = "v") -> DataFrame:
    return erode(dilate(pixels, by, radius, value=value), by, radius, value=value)


def open_(pixels: DataFrame, by: Sequence[str], radius: int = 2, value: str = "v") -> DataFrame:
    return dilate(erode(pixels, by, radius, value=value), by, radius, value=value)


def hit_or_miss(pixels: DataFrame, by: Sequence[str], value: str = "m", side: int = blocks.SIDE) -> DataFrame:
    """A mask without the pixels that a pattern matches, pattern by pattern. RAS-09. Outside counts as unset, and so do
    pixels that a sparse mask leaves out. Columns: by, x, y and the mask, null as 0; a repeated pixel counts once.

    The patterns are applied one after another to blocks whose halo is what they reach together, a pixel each: one shuffle.
    """
    if any(max(abs(d) for d in offset) > 1 for offset in sum(HIT_OR_MISS, ())):
        raise ValueError("patterns reach one pixel")

    def clean(block: blocks.Block) -> pa.Table:
        mask = block.values[value]

        def at(offset: tuple[int, int]) -> np.ndarray:
            return np.pad(mask, 1)[1 + offset[0] : 1 + offset[0] + len(mask), 1 + offset[1] : 1 + offset[1] + len(mask)]

        for hit, *misses in HIT_OR_MISS:
            matched = (mask == 1) & (at(hit) == 1)
            for miss in misses:
                matched &= at(miss) == 0
            mask = np.where(matched, 0, mask)
        return block.rows({value: block.own(mask)})

    return blocks.each(pixels, by, [value], len(HIT_OR_MISS), clean, f"`{value}` {dict(pixels.dtypes)[value]}", side)


def padded(pixels: DataFrame, by: Sequence[str], sizes: DataFrame, margin: int, value: int) -> DataFrame:
    """pixels within a border of constant value; coordinates move by margin. RAS-08. sizes: by, width, height."""
    grid = sizes.select(*by, F.explode(F.sequence(F.lit(0), F.col("width") + 2 * margin - 1)).alias("x"), "height", "width").select(*by, "x", "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") + 2 * margin - 1)).alias("y"))
    shifted = pixels.select(*by, (F.col("x") + margin).alias("x"), (F.col("y") + margin).alias("y"), "v")
    return grid.join(shifted, [*by, "x", "y"], "left").select(*by, "x", "y", F.coalesce("v", F.lit(value)).alias("v"))


def _sliding(array: np.ndarray, reach: int) -> np.ndarray:
    """The largest of the 2 * reach + 1 entries around each one along the rows; the work doesn't grow with the reach.

    Rows are cut into stretches of that length; a window is the end of one stretch and the start of the next, so running
    maxima from both sides of each stretch are enough.
    """
    size = 2 * reach + 1
    low = np.array(-np.inf if array.dtype.kind == "f" else np.iinfo(array.dtype).min, array.dtype)
    n = -(-(array.shape[1] + 2 * reach) // size) * size
    wide = np.full((array.shape[0], n), low)
    wide[:, reach : reach + array.shape[1]] = array
    parts = wide.reshape(len(wide), -1, size)
    ahead = np.maximum.accumulate(parts, axis=2).reshape(len(wide), n)
    back = np.maximum.accumulate(parts[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(wide), n)
    return np.maximum(back[:, : array.shape[1]], ahead[:, size - 1 : size - 1 + array.shape[1]])


def ellipse(radius: int) -> list[int]:
    """How far an elliptical window of 2 * radius + 1 pixels reaches along its middle row, the next one, and so on."""
    return [round(math.sqrt(radius * radius - d * d)) for d in range(radius + 1)]


def _largest_in(v: np.ndarray, reaches: Sequence[int]) -> np.ndarray:
    """The largest entry of a window around each one; the window's row d above or below the middle reaches reaches[d]."""
    n = len(v)
    rows = {r: _sliding(v, r) for r in set(reaches)}
    out = rows[reaches[0]].copy()
    for d, reach in enumerate(reaches[1:], 1):
        if d < n:
            np.maximum(out[: n - d], rows[reach][d:], out=out[: n - d])
            np.maximum(out[d:], rows[reach][: n - d], out=out[d:])
    return out


def elliptical(pixels: DataFrame, by: Sequence[str], radius: int, steps: Sequence[str], value: str = "v", side: int | None = None) -> DataFrame:
    """(by, x, y, value): value dilated and eroded by an elliptical window, in the order of steps. RAS-05, RAS-07.

    Pixels that don't exist take no part, so windows are cut at the border. Nulls count as 0; a repeated pixel counts once.
    All steps are done on blocks whose halo is what they reach together: one shuffle, and two passes for each row of the
    window whatever its width.
    """
    signs = [{"dilate": 1, "erode": -1}[s] for s in steps]
    reaches, kind = ellipse(radius), dict(pixels.dtypes)[value]

    def stretch(block: blocks.Block) -> pa.Table:
        v = block.values[value]
        wide = v.astype(np.float64 if v.dtype.kind == "f" else np.int64)
        low = -np.inf if v.dtype.kind == "f" else np.iinfo(np.int64).min + 1
        for sign in signs:
            wide = sign * _largest_in(np.where(block.present, sign * wide, low), reaches)
        return block.rows({value: block.own(wide).astype(v.dtype)})

    halo = radius * len(signs)
    return blocks.each(pixels, by, [value], halo, stretch, f"`{value}` {kind}", side or max(blocks.SIDE, halo))


def suppressed(pixels: DataFrame, by: Sequence[str], radius: int, skip_axes: bool = False, side: int | None = None) -> DataFrame:
    """(by, x, y, v): the pixels that no other within the disc exceeds. RAS-13. skip_axes leaves the neighbours on both axes
    out. Nulls are left out; a repeated pixel counts once.

    A disc is chords: for each row of it, the largest value of a stretch, found for all pixels of a block at once. So a
    block takes 2 * radius + 1 passes, and pixels are shuffled once, with a halo of the radius.
    """
    kind = dict(pixels.dtypes)["v"]

    def suppress(block: blocks.Block) -> pa.Table:
        v = block.values["v"]
        low = np.array(-np.inf if v.dtype.kind == "f" else np.iinfo(v.dtype).min, v.dtype)
        v = np.where(block.present, v, low)
        n, h = block.side, block.halo
        around = np.full((n, n), low)
        for dy in range(-radius, radius + 1):
            reach = math.isqrt(radius * radius - dy * dy)
            rows = v[h + dy : h + dy + n]
            if dy and not skip_axes:
                np.maximum(around, _sliding(rows, reach)[:, h : h + n], out=around)
            elif reach and not (skip_axes and not dy):
                # the chord without its middle: a stretch on either side
                half = -(-reach // 2)
                both = _sliding(np.pad(rows, ((0, 0), (half, half)), constant_values=low), (reach - 1) // 2)
                for at in ((reach + 1) // 2, -(reach + 1) // 2 if reach % 2 else -(reach // 2)):
                    start = half + h + at
                    np.maximum(around, both[:, start : start + n], out=around)
                if reach % 2 == 0:
                    for at in (reach, -reach):
                        np.maximum(around, rows[:, h + at : h + at + n], out=around)
        return block.rows({"v": block.own(v)}, block.own(block.present) & (block.own(v) >= around))

    return blocks.each(pixels.filter("v IS NOT NULL"), by, ["v"], radius, suppress, f"v {kind}", side or max(blocks.SIDE, radius))


def pyramid(pixels: DataFrame, by: Sequence[str], levels: int) -> DataFrame:
    """(by, k, x, y, v): means over squares of 2**k. RAS-15, FUN-23 (area average)."""
    each = pixels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = F.pow(F.lit(2.0), F.col("k"))
    return each.groupBy(*by, "k", F.floor(F.col("x") / side).cast("int").alias("x"), F.floor(F.col("y") / side).cast("int").alias("y")).agg(F.avg("v").alias("v"))


def nearest(pixels: DataFrame, by: Sequence[str], ratio: float) -> DataFrame:
    """pixels of an image reduced by ratio < 1, the first of each square. FUN-23 (nearest)."""
    return pixels.groupBy(*by, F.floor(F.col("x") * ratio).cast("int").alias("nx"), F.floor(F.col("y") * ratio).cast("int").alias("ny")).agg(F.min_by("v", F.struct("y", "x")).alias("v")).withColumnsRenamed({"nx": "x", "ny": "y"})


def _sinc(t: Column) -> Column:
    return F.when(t == 0, F.lit(1.0)).otherwise(F.sin(math.pi * t) / (math.pi * t))


def _cubic(t: Column) -> Column:
    a = -0.5
    return F.when(t < 1, ((a + 2) * t - (a + 3)) * t * t + 1).when(t < 2, (((t - 5) * t + 8) * t - 4) * a).otherwise(0.0)


#: Kernel -> (reach, weight at a distance). Area weights are the shares of pixels that the target pixel covers.
KERNELS = {
    "bilinear": (1.0, lambda t: F.greatest(F.lit(0.0), 1 - t)),
    "cubic": (2.0, _cubic),
    "lanczos": (3.0, lambda t: F.when(t < 3, _sinc(t) * _sinc(t / 3)).otherwise(0.0)),
    "area": (1.0, None),
}


def resampled(pixels: DataFrame, by: Sequence[str], sizes: DataFrame, tw: int, th: int, kernel: str = "bilinear", antialias: bool = True, values: Sequence[str] = ("v",)) -> DataFrame:
    """(by, x, y, values as double): images at a target size, by weighted sums along rows and then columns. FUN-23.

    sizes: by, width, height. Target centres lie at (i + 0.5) * size / target. antialias widens the kernel by the ratio where
    an image is reduced; without it, and where it grows, a target pixel sees the kernel's own reach. Weights are those of the
    pixels that exist, scaled to a sum of 1; a target pixel without any has no row. Nulls have no part. area: the mean of
    what a target pixel covers.

    A pixel is sent to the few target columns (then rows) that its kernel reaches; both passes add up before the shuffle.
    """
    reach, weight = KERNELS[kernel]

    def along(table: DataFrame, axis: str, size: str, target: int, keep: Sequence[str]) -> DataFrame:
        scale = F.col(size) / target
        wide = F.greatest(scale, F.lit(1.0)) if antialias else F.lit(1.0)
        if kernel == "area":
            low, high = F.floor(F.col(axis) / scale), F.ceil((F.col(axis) + 1) / scale) - 1
        else:
            low, high = F.ceil((F.col(axis) + 0.5 - reach * wide) / scale - 0.5), F.floor((F.col(axis) + 0.5 + reach * wide) / scale - 0.5)
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(target - 1))
        sent = table.withColumns({"_low": low, "_high": high, "_scale": scale, "_wide": wide}).filter("_low <= _high").withColumn("_i", F.explode(F.sequence("_low", "_high")))
        if kernel == "area":
            w = F.least(F.col(axis) + 1, (F.col("_i") + 1) * F.col("_scale")) - F.greatest(F.col(axis).cast("double"), F.col("_i") * F.col("_scale"))
        else:
            w = weight(F.abs(F.col(axis) + 0.5 - (F.col("_i") + 0.5) * F.col("_scale")) / F.col("_wide"))
        sums = [(F.sum(F.col("_w") * F.col(v)) / F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v) for v in values]
        weighed = sent.withColumn("_w", w).filter(F.abs("_w") > 1e-12)
        return weighed.groupBy(*by, F.col("_i").cast("int").alias(axis), *keep).agg(*sums)

    each = pixels.select(*by, "x", "y", *(F.col(v).cast("double").alias(v) for v in values)).join(sizes.select(*by, "width", "height"), list(by))
    return along(along(each, "x", "width", tw, ["y", "height"]), "y", "height", th, ["x"]).select(*by, "x", "y", *values)


def tile_stats(pixels: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each channel of a tile. AGG-10."""
    return pixels.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in channels for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))


def not_empty(channels: Sequence[str], min_dev: float, max_mean: float) -> Column:
    """False where all deviations are below min_dev or all means above max_mean. FIL-08."""
    flat, bright = F.lit(True), F.lit(True)
    for c in channels:
        flat, bright = flat & (F.col(f"std_{c}") < min_dev), bright & (F.col(f"mean_{c}") > max_mean)
    return ~(flat | bright)


def tiles(images: DataFrame, size: int, overlap: int = 0, start: tuple[int, int] = (0, 0), end: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, tile_id, x0, y0, w, h): the tile grid of each image; end drops tiles past both ends. SRC-14, FIL-13."""
    step = size - overlap
    x = images.filter((F.col("width") > start[0]) & (F.col("height") > start[1])).withColumn("x0", F.explode(F.sequence(F.lit(start[0]), F.col("width") - 1, F.lit(step))))
    grid = x.withColumn("y0", F.explode(F.sequence(F.lit(start[1]), F.col("height") - 1, F.lit(step))))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("y0", "x0")) - 1
    out = grid.select("image_id", number.alias("tile_id"), "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y0")).alias("h"))
    return out if end is None else out.filter(~((F.col("x0") > end[0]) & (F.col("y0") > end[1])))


FILTERS = {
    "binary": lambda pixels, by, threshold=128: binary(pixels, F.lit(threshold)),
    "otsu": lambda pixels, by: binary(pixels.join(otsu(pixels, by), list(by)), F.col("threshold")).drop("threshold"),
    "gaussian": lambda pixels, by, size=11, constant=0.0: adaptive_gaussian(pixels, by, size, constant).withColumn("v", F.col("m")).drop("m"),
    "adaptive": lambda pixels, by, radius=5, constant=0.0: adaptive_box(pixels, by, radius, constant).withColumn("v", F.col("m")).drop("m"),
}
