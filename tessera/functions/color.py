"""Colour conversions as columns: FUN-01 to FUN-06."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below this standard deviation a channel counts as constant.
FLAT = 1e-8


def flat_rgb(pixels: Column) -> Column:
    """An array of (r, g, b) structs as one array, pixel by pixel."""
    return F.flatten(F.transform(pixels, lambda p: F.array(p["r"], p["g"], p["b"])))


def gray(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(hue in degrees, saturation 0..1, value). Where several channels are the largest, blue decides, then green."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    diff = (top - low).cast("double")
    turn = F.when(b == top, (r - g) / diff + 4.0).when(g == top, (b - r) / diff + 2.0).otherwise((g - b) / diff) * 60.0
    hue = F.when(diff == 0, F.lit(0.0)).when(turn < 0, turn + 360.0).when(turn > 360, turn - 360.0).otherwise(turn)
    return hue, F.when(top > 0, diff / top).otherwise(F.lit(0.0)), top.cast("double")


def normalised(value: str, by: Sequence[str]) -> Column:
    """(v - mean) / population deviation within `by`; 0 where the deviation is nothing. FUN-02, WIN-11."""
    w = Window.partitionBy(*by)
    spread = F.stddev_pop(value).over(w)
    return F.when(spread > FLAT, (F.col(value) - F.avg(value).over(w)) / spread).otherwise(F.lit(0.0))


def opaque(channel: Column, alpha: Column) -> Column:
    """White where the pixel is transparent. FUN-06."""
    return F.when(alpha == 0, F.lit(255)).otherwise(channel)


def converted(pixels: DataFrame, space: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """pixels with c0, c1, c2 (or c0 alone) in colour space 0 RGB, 1 normalised RGB, 2 HSV, 3 grey. FUN-05."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    if space == 0:
        out = (r, g, b)
    elif space == 1:
        out = tuple(normalised(c, by) for c in ("r", "g", "b"))
    elif space == 2:
        out = hsv(r, g, b)
    elif space == 3:
        out = (gray(r, g, b),)
    else:
        raise ValueError(f"no colour space {space}")
    return pixels.withColumns({f"c{i}": c for i, c in enumerate(out)})
