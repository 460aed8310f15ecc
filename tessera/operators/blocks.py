"""Dense blocks of pixels with a halo, for neighbourhoods that are cheaper by index than by join: SRC-14, FIL-13.

A long pixel table is dealt into square blocks. A pixel goes to its own block and to those whose halo covers it, so the
rows shuffled are the pixels times (1 + 2 * halo / side) squared, once, whatever is done in the block. A block is one
group of bounded size; what it returns for its own pixels is exact if the work reaches no farther than the halo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 256


class Block:
    """One block: arrays of side + 2 * halo rows and columns. present: where there is a pixel. x0, y0: its own corner."""

    def __init__(self, key: tuple, table: pa.Table, by: Sequence[str], values: Sequence[str], side: int, halo: int):
        self.key, self.by, self.side, self.halo = key[: len(by)], list(by), side, halo
        self.bx, self.by_ = key[len(by)].as_py(), key[len(by) + 1].as_py()
        self.x0, self.y0 = self.bx * side, self.by_ * side
        self.table = table
        wide = side + 2 * halo
        row = table.column("y").to_numpy() - (self.y0 - halo)
        column = table.column("x").to_numpy() - (self.x0 - halo)
        self.present = np.zeros((wide, wide), bool)
        self.present[row, column] = True
        self.values = {}
        for name in values:
            found = table.column(name).fill_null(0).to_numpy()
            self.values[name] = np.zeros((wide, wide), found.dtype)
            self.values[name][row, column] = found

    def own(self, array: np.ndarray) -> np.ndarray:
        """The block's own part of an array with its halo."""
        h = self.halo
        return array[h : h + self.side, h : h + self.side]

    def rows(self, columns: dict[str, np.ndarray], where: np.ndarray | None = None) -> pa.Table:
        """A row per own pixel (or where a mask of own pixels says): keys, x, y and the values of arrays of own pixels."""
        y, x = np.nonzero(self.own(self.present) if where is None else where)
        keys = [pa.repeat(k, len(x)) for k in self.key]
        arrays = [*keys, pa.array((x + self.x0).astype(np.int32)), pa.array((y + self.y0).astype(np.int32)), *(pa.array(a[y, x]) for a in columns.values())]
        return pa.Table.from_arrays(arrays, names=[*self.by, "x", "y", *columns])


def dealt(pixels: DataFrame, by: Sequence[str], values: Sequence[str], halo: int, side: int = SIDE) -> DataFrame:
    """pixels (by, x, y, values) once per block that they belong to, with _bx and _by. Rows without a place are left out."""

    def span(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))

    if halo > side:
        raise ValueError("a halo is at most as wide as a block")
    placed = pixels.filter("x IS NOT NULL AND y IS NOT NULL").select(*by, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *values)
    return placed.withColumn("_bx", span("x")).withColumn("_by", span("y"))


def each(pixels: DataFrame, by: Sequence[str], values: Sequence[str], halo: int, apply: Callable[[Block], pa.Table], columns: str, side: int = SIDE) -> DataFrame:
    """What apply gives for each block: (by, x, y, columns). A pixel that comes twice counts once."""
    return grouped(dealt(pixels, by, values, halo, side), by, values, halo, apply, columns, side)


def grouped(rows: DataFrame, by: Sequence[str], values: Sequence[str], halo: int, apply: Callable[[Block], pa.Table], columns: str, side: int = SIDE) -> DataFrame:
    """`each` for rows that `dealt` gave, which may have more columns (they are in Block.table)."""
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in by), "x int", "y int", columns])
    names, wanted, wide, reach = list(by), list(values), side, halo

    def of_block(key: tuple, table: pa.Table) -> pa.Table:
        return apply(Block(key, table, names, wanted, wide, reach))

    return rows.groupBy(*by, "_bx", "_by").applyInArrow(of_block, schema)


def at_points(pixels: DataFrame, points: DataFrame, by: Sequence[str], value: str, halo: int, see: Callable[[np.ndarray, np.ndarray, np.ndarray, dict], dict], columns: str, wide: int, side: int = SIDE) -> DataFrame:
    """points (by, x, y and more) with `columns`, from what lies around them: see(plane, rows, columns, the points' other
    values) gets the block with its halo as an array of doubles, NaN where there is no pixel, and the points' places in it.

    Only blocks with points are sent, pixels once per block that they reach. What comes back is `wide` bytes a point, made a
    slice at a time, so a task holds one block and some points.
    """
    side = max(side, halo)
    names, own, keys = list(by), [c for c in points.columns if c not in by], [*by, "_bx", "_by"]
    asked = points.withColumns({"_bx": F.floor(F.col("x") / side), "_by": F.floor(F.col("y") / side)})
    near = dealt(pixels.select(*by, "x", "y", F.col(value).cast("double").alias("_v")), by, ["_v"], halo, side).join(asked.select(*keys).distinct(), keys, "left_semi")
    none = [F.lit(None).cast(t).alias(c) for c, t in points.dtypes if c in own and c not in ("x", "y")]
    both = near.select(*keys, F.lit(True).alias("_pixel"), "_v", F.col("x").cast(dict(points.dtypes)["x"]).alias("x"), F.col("y").cast(dict(points.dtypes)["y"]).alias("y"), *none)
    rest = [c for c in own if c not in ("x", "y")]
    rows = both.unionByName(asked.select(*keys, F.lit(False).alias("_pixel"), F.lit(None).cast("double").alias("_v"), "x", "y", *rest))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in points.dtypes), columns])
    order, step = points.columns, max((32 << 20) // wide, 1)

    def of_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x0, y0 = key[len(names)].as_py() * side - halo, key[len(names) + 1].as_py() * side - halo
        plane = np.full((side + 2 * halo, side + 2 * halo), np.nan)
        held = []
        for batch in batches:
            is_pixel = batch.column("_pixel")
            seen, others = batch.filter(is_pixel), batch.filter(pa.compute.invert(is_pixel))
            plane[seen.column("y").to_numpy() - y0, seen.column("x").to_numpy() - x0] = seen.column("_v").fill_null(np.nan).to_numpy()
            if others.num_rows:
                held.append(others)
        for others in held:
            for start in range(0, others.num_rows, step):
                part = others.slice(start, step)
                made = see(plane, part.column("y").to_numpy() - y0, part.column("x").to_numpy() - x0, {c: part.column(c).to_numpy(zero_copy_only=False) for c in rest} | {"x0": x0, "y0": y0})
                kept = made.pop("kept", None)
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in order), *made.values()], names=[*order, *made])
                yield out if kept is None else out.filter(pa.array(kept))

    return rows.groupBy(*keys).applyInArrow(of_block, schema)
