"""Coordinates and geometry texts as columns: FUN-07 to FUN-18, FUN-22."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def flipped(y: Column, height: Column) -> Column:
    """Between coordinates from the top and from the bottom. FUN-08."""
    return height - y


def to_slide(local: Column, zoom: int, origin: Column) -> Column:
    """Tile to slide coordinates. FUN-09."""
    return local * (1 << zoom) + origin


def to_tile(slide: Column, zoom: int, origin: Column) -> Column:
    return F.floor((slide - origin) / (1 << zoom))


def from_thumbnail(x: Column, padding: int, full: Column, thumb: Column) -> Column:
    """Thumbnail to slide coordinates. FUN-10."""
    return (x - padding) * (full / thumb)


def moved(ring: Column, dx: Column, dy: Column) -> Column:
    """A ring of (x, y) structs moved. FUN-11."""
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def turned(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned about the centre of its image, in the frame of the enlarged turned image. FUN-12."""
    a = F.radians(degrees)
    cos, sin = F.cos(a), F.sin(a)
    wide, high = F.abs(width * cos) + F.abs(height * sin), F.abs(width * sin) + F.abs(height * cos)
    cx, cy = x - width / 2, y - height / 2
    return cx * cos + cy * sin + wide / 2, cy * cos - cx * sin + high / 2


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def numbers(wkt: Column) -> Column:
    return F.transform(F.regexp_extract_all(wkt, F.lit(NUMBER), F.lit(1)), lambda s: s.cast("double"))


def rings(wkt: Column) -> Column:
    """The rings of a polygon's text, the exterior first, each an array of (x, y). FUN-17."""
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda t: F.struct(F.split(F.trim(t), " +")[0].cast("double").alias("x"), F.split(F.trim(t), " +")[1].cast("double").alias("y"))
    return F.transform(texts, lambda r: F.transform(F.split(r, ","), point))


def wkt_of(ring: Column) -> Column:
    """A ring as text. FUN-18."""
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def _edges(ring: Column) -> Column:
    size = F.size(ring)
    return F.zip_with(F.slice(ring, 1, size - 1), F.slice(ring, 2, size - 1), lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("cross"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v)


def area(ring: Column) -> Column:
    """The area of a closed ring. FUN-14."""
    return F.abs(_total(F.transform(_edges(ring), lambda e: e["cross"]))) / 2


def centroid(ring: Column) -> tuple[Column, Column]:
    """The centroid of a closed ring, cut to whole numbers. FUN-07."""
    double_area = _total(F.transform(_edges(ring), lambda e: e["cross"]))
    mean = lambda s: _total(F.transform(_edges(ring), lambda e: e[s] * e["cross"])) / (3 * double_area)
    return mean("sx").cast("int"), mean("sy").cast("int")


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """(x0, y0, x1, y1). FUN-15."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def vertices(ring: Column) -> Column:
    return F.size(ring)


def valid(ring: Column) -> Column:
    """Closed, of four points at least, and with an area. FIL-12."""
    return (F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1)) & (area(ring) > 0)
