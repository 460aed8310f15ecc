"""Masks as runs of pixels and their objects: WIN-02, RAS-11, RAS-12, GEO-01 to GEO-06, FUN-14, FIL-03 to FIL-07."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import components, smallest
from tessera.operators.storage import cut


def runs(mask: DataFrame, by: Sequence[str], value: str = "m") -> DataFrame:
    """(by, y, x0, x1): maximal horizontal stretches of set pixels. WIN-02."""
    w = Window.partitionBy(*by, "y").orderBy("x")
    on = mask.filter(F.col(value) != 0).withColumn("_g", F.col("x") - F.row_number().over(w))
    return on.groupBy(*by, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def merged(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overlapping and adjoining intervals x0..x1 of a row as one: the union of regions. GEO-01."""
    w = Window.partitionBy(*by, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(reach.isNull() | (F.col("x0") > reach + 1), 1).otherwise(0))
    return marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def clipped(regions: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """The part of runs within a box. GEO-02."""
    inside = regions.filter((F.col("y") >= y0) & (F.col("y") <= y1) & (F.col("x1") >= x0) & (F.col("x0") <= x1))
    return inside.withColumns({"x0": F.greatest("x0", x0), "x1": F.least("x1", x1)})


def common(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """The intersection of two regions as runs. SET-05."""
    other = b.select(*by, "y", F.col("x0").alias("_p"), F.col("x1").alias("_q"))
    return a.join(other, [*by, "y"]).filter((F.col("x0") <= F.col("_q")) & (F.col("_p") <= F.col("x1"))).withColumns({"x0": F.greatest("x0", "_p"), "x1": F.least("x1", "_q")}).drop("_p", "_q")


def grown(regions: DataFrame, by: Sequence[str], radius: int) -> DataFrame:
    """Runs grown by a disc. GEO-03."""
    reach = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(int((radius * radius - dy * dy) ** 0.5)).alias("dx")) for dy in range(-radius, radius + 1)))
    wide = regions.withColumn("_d", F.explode(reach)).select(*by, (F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x0") - F.col("_d.dx")).alias("x0"), (F.col("x1") + F.col("_d.dx")).alias("x1"))
    return merged(wide, by)


def shrunk(regions: DataFrame, by: Sequence[str], radius: int) -> DataFrame:
    """Runs shrunk by a disc: what stays at every shift. GEO-03."""
    n = 2 * radius + 1
    reach = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(int((radius * radius - dy * dy) ** 0.5)).alias("dx")) for dy in range(-radius, radius + 1)))
    cores = regions.withColumn("_d", F.explode(reach)).select(*by, (F.col("y") + F.col("_d.dy")).alias("y"), (F.col("x0") + F.col("_d.dx")).alias("x0"), (F.col("x1") - F.col("_d.dx")).alias("x1")).filter("x0 <= x1")
    # a stretch stays where all n rows cover it: count covers between the ends of the runs
    ends = cores.select(*by, "y", F.col("x0").alias("x"), F.lit(1).alias("d")).unionByName(cores.select(*by, "y", (F.col("x1") + 1).alias("x"), F.lit(-1).alias("d"))).groupBy(*by, "y", "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by, "y").orderBy("x")
    cover = ends.withColumns({"_c": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_to": F.lead("x").over(w)})
    return merged(cover.filter((F.col("_c") == n) & F.col("_to").isNotNull()).select(*by, "y", F.col("x").alias("x0"), (F.col("_to") - 1).alias("x1")), by)


#: Side of the cells in which objects are found before cells are joined.
SIDE = 256


def _place(y: Column, x: Column) -> Column:
    """One number for a place, in order of y and then x."""
    return F.shiftleft(y.cast("long"), 32) + x.cast("long") + 2**31


def labelled(regions: DataFrame, by: Sequence[str], diagonal: bool = False, side: int = SIDE) -> DataFrame:
    """Runs with object: the key (by, y, x0) of the first run of their connected object. RAS-11, ITR-01.

    Runs are cut at the borders of cells. A cell is one group of at most side * side / 2 pieces, whose objects are found in
    one pass; only the graph of objects that meet across borders is labelled between cells. Runs of a row don't overlap.
    """
    reach = 1 if diagonal else 0
    columns = [c for c in regions.columns if c not in (*by, "y", "x0", "x1")]
    band = F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side)))
    pieces = regions.select(*by, F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"), *columns).withColumn("_cx", band)
    pieces = pieces.withColumns({"_cy": F.floor(F.col("y") / side), "_p": F.greatest(F.col("x0"), F.col("_cx") * side).cast("int"), "_q": F.least(F.col("x1"), F.col("_cx") * side + (side - 1)).cast("int")})

    def of_cell(table: pa.Table) -> pa.Table:
        y, p, q = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "_p", "_q"))
        order = np.lexsort((p, y))
        wide, top = 4 * side, y.min()
        row, left, right = (y[order] - top + 1) * wide, p[order] - p.min() + 1, q[order] - p.min() + 1
        # pieces of the next row that meet a piece are next to each other
        low = np.searchsorted(row + right, row + wide + left - reach, "left")
        high = np.searchsorted(row + left, row + wide + right + reach, "right")
        many = np.maximum(high - low, 0)
        b = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        first = order[smallest(len(y), np.repeat(np.arange(len(y)), many), b)]
        out = np.empty(len(y), np.int64)
        out[order] = (y[first] << 32) + p[first] + 2**31
        return table.append_column("_local", pa.array(out))

    types = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    local = cut(pieces.groupBy(*by, "_cx", "_cy").applyInArrow(of_cell, f"{types}, _local long"))
    ends = local.select(*by, "y", "_cx", "_cy", "_p", "_q", "_local")
    # from the last row of a cell to the first of the one below, by the columns that both have
    beside = F.explode(F.expr(f"filter(array(_cx - 1, _cx, _cx + 1), c -> c = _cx OR {reach} = 1 AND (c < _cx AND _p = _cx * {side} OR c > _cx AND _q = _cx * {side} + {side - 1}))"))
    low = ends.filter(f"y = _cy * {side} + {side - 1}").select(*by, (F.col("_cy") + 1).alias("_cy"), beside.alias("_cx"), F.col("_p").alias("_p2"), F.col("_q").alias("_q2"), F.col("_local").alias("a"))
    down = low.join(ends.filter(f"y = _cy * {side}"), [*by, "_cx", "_cy"]).filter((F.col("_p") <= F.col("_q2") + reach) & (F.col("_p2") <= F.col("_q") + reach)).select(*by, "a", F.col("_local").alias("b"))
    # from the last column of a cell to the first of the next one
    rows = F.explode(F.array(*(F.col("y") + d for d in range(-reach, reach + 1))))
    right = ends.filter(f"_q = _cx * {side} + {side - 1}").select(*by, rows.alias("y"), (F.col("_cx") + 1).alias("_cx"), F.col("_local").alias("a"))
    across = right.join(ends.filter(f"_p = _cx * {side}"), [*by, "_cx", "y"]).select(*by, "a", F.col("_local").alias("b"))
    edges = down.unionByName(across)
    labels = components(edges.select(*by, F.col("a").alias("v")).unionByName(edges.select(*by, F.col("b").alias("v"))), edges, by)
    found = local.filter("_p = x0").join(labels.withColumnRenamed("v", "_local"), [*by, "_local"], "left").withColumn("_first", F.coalesce("label", "_local"))
    first = F.struct(*by, F.shiftright("_first", 32).cast("int").alias("y"), (F.col("_first").bitwiseAND(0xFFFFFFFF) - 2**31).cast("int").alias("x0"))
    return found.select(*by, "y", "x0", "x1", *columns, first.alias("object"))


def areas(objects: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per object: where it starts, its area and bounding box. FUN-14, FUN-15."""
    return objects.groupBy(*by, F.col("object.y").alias("first_y"), F.col("object.x0").alias("first_x")).agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom"))


def within(area: Column, least: float, most: float, strict: bool = False) -> Column:
    """Area between two bounds, empty objects left out. FIL-03; strict at both ends: FIL-04."""
    return (area > least) & (area < most) if strict else (area > 0) & (area >= least) & (area <= most)


def finder_bounds(zoom: int, least: float | None = None, most: float | None = None) -> tuple[float, float]:
    """Bounds of the object finder: 2500 and 1e10 by the zoom, where not given. FIL-05."""
    return (2500 / 2**zoom if least is None else least), (1e10 / 2**zoom if most is None else most)


def without_largest(objects: DataFrame, by: Sequence[str]) -> DataFrame:
    """The objects of an image but the largest, the first of equal ones. FIL-07."""
    w = Window.partitionBy(*by).orderBy(F.desc("area"), "first_y", "first_x")
    return objects.withColumn("_r", F.row_number().over(w)).filter("_r > 1").drop("_r")


def rasterised(polygons: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, y, x0, x1) of polygons (by, rings: arrays of (x, y) structs): pixels whose centre is inside, odd-even, holes
    left out. GEO-05, RAS-10. Edges meet the rows they cross; crossings are paired in order."""
    ring = polygons.select(*by, F.explode("rings").alias("r"))
    edge = ring.select(*by, F.explode(F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))).alias("e")).select(*by, "e.*").filter("ay <> by")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
    crossed = edge.filter(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    at = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    w = Window.partitionBy(*by, "y").orderBy("at")
    paired = crossed.withColumn("at", at).withColumns({"_n": F.row_number().over(w), "to": F.lead("at").over(w)}).filter("_n % 2 = 1")
    return paired.select(*by, F.col("y").cast("int").alias("y"), F.ceil(F.col("at") - 0.5).cast("int").alias("x0"), (F.ceil(F.col("to") - 0.5) - 1).cast("int").alias("x1")).filter("x0 <= x1")


#: Directions of a side, clockwise: right, down, left, up; the object lies on its right hand.
RIGHT, DOWN, LEFT, UP = range(4)


def _sides(objects: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, sx, sy, ex, ey, way): the sides of runs that no run of the object adjoins, from corner to corner, clockwise."""
    side = lambda *of: F.struct(*(c.cast("int").alias(n) for c, n in zip(of, ("sx", "sy", "ex", "ey"), strict=False)), F.lit(of[4]).alias("way"))
    x0, x1, y = F.col("x0"), F.col("x1") + 1, F.col("y")
    upright = objects.select(*key, F.explode(F.array(side(x1, y, x1, y + 1, DOWN), side(x0, y + 1, x0, y, UP))).alias("s")).select(*key, "s.*")
    # along a line between two rows, where the row below (a) or above (b) starts and ends
    event = lambda line, x, a, b: F.struct(line.cast("int").alias("line"), x.cast("int").alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    events = objects.select(*key, F.explode(F.array(event(y, x0, 1, 0), event(y, x1, -1, 0), event(y + 1, x0, 0, 1), event(y + 1, x1, 0, -1))).alias("e"))
    turns = events.select(*key, "e.*").groupBy(*key, "line", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> 0 OR b <> 0")
    w = Window.partitionBy(*key, "line").orderBy("x")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    level = turns.select(*key, "line", "x", F.lead("x").over(w).alias("to"), F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b")).filter("(a > 0) <> (b > 0)")
    x, to, line = F.col("x"), F.col("to"), F.col("line")
    flat = level.select(*key, F.when(F.col("a") > 0, side(x, line, to, line, RIGHT)).otherwise(side(to, line, x, line, LEFT)).alias("s")).select(*key, "s.*")
    return upright.unionByName(flat)


def _ranked(by: Sequence[str], side: int):
    """Links (by, cell, id, next) of a cell -> each with the chain that it belongs to within the cell: head, offset from it, and
    for the head `tail`, the link that follows the chain (null: the chain is closed), its length and least id."""

    def jump(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last link that step leads to, and how many steps that takes; -1 ends. Within a cycle neither means anything."""
        at, far = np.where(step < 0, np.arange(len(step)), step), (step >= 0).astype(np.int64)
        for _ in range(max(int(len(step)).bit_length(), 1)):
            far, at = far + far[at], at[at]
        return at, far

    def apply(table: pa.Table) -> pa.Table:
        ids, follow = table.column("id").to_numpy(), table.column("next").to_numpy()
        order = np.argsort(ids)
        place = np.searchsorted(ids[order], follow)
        inside = ids[order][np.minimum(place, len(ids) - 1)] == follow
        step = np.where(inside, order[np.minimum(place, len(ids) - 1)], -1)
        back = np.full(len(ids), -1)
        back[step[inside]] = np.flatnonzero(inside)
        linked = np.flatnonzero(inside)
        ring = smallest(len(ids), np.argsort(order)[linked], np.argsort(order)[step[linked]])[np.argsort(order)]  # by order of id
        least = order[ring]
        # a closed chain is opened before its least link
        opened = np.bincount(ring, weights=(step < 0), minlength=len(ids))[ring] == 0
        cut_at = opened & (least == np.arange(len(ids)))
        step[back[cut_at]] = -1
        back[cut_at] = -1
        head, offset = jump(back)
        last, _ = jump(step)
        n = np.bincount(head, minlength=len(ids))
        is_head = head == np.arange(len(ids))
        out = {
            "head": pa.array(ids[head]), "offset": pa.array(offset), "tail": pa.array(follow[last], mask=~is_head | opened),
            "length": pa.array(n, mask=~is_head), "least": pa.array(ids[least], mask=~is_head), "closed": pa.array(opened),
        }
        for name, column in out.items():
            table = table.append_column(name, column)
        return table

    return apply


def _rings(links: DataFrame, by: Sequence[str], side: int) -> DataFrame:
    """links (by, cx, cy, id, next, ...) in cycles, with ring, the least id of its cycle, and rank, how far it is from there.

    List ranking on two levels: chains are followed within cells by one pass, then chains that leave their cell jump along
    each other, twice as far in each round. Rounds follow the logarithm of the number of cells that a ring passes.
    """
    types = ", ".join(f"`{c}` {t}" for c, t in links.dtypes)
    local = cut(links.groupBy(*by, "cx", "cy").applyInArrow(_ranked(by, side), f"{types}, head long, offset long, tail long, length long, least long, closed boolean"))
    chains = local.filter("head = id AND NOT closed").select(*by, "head", "tail", "length", "least")
    if chains.isEmpty():
        return local.select(*links.columns, F.col("head").alias("ring"), F.col("offset").alias("rank"))
    # the least id of each ring
    now = cut(chains.select(*by, "head", F.col("tail").alias("to"), "least"))
    while True:
        there = now.select(*by, F.col("head").alias("to"), F.col("to").alias("farther"), F.col("least").alias("theirs"))
        now = cut(now.join(there, [*by, "to"]).select(*by, "head", F.col("farther").alias("to"), F.least("least", "theirs").alias("least"), (F.col("theirs") < F.col("least")).alias("lower")))
        if now.filter("lower").isEmpty():
            break
    rings = now.select(*by, "head", F.col("least").alias("ring"))
    # how many links from a chain to the start of the ring's first chain, which holds the least id
    first = local.join(rings.select(*by, F.col("ring").alias("id"), "ring").distinct(), [*by, "id"]).select(*by, "ring", F.col("head").alias("first"), F.col("offset").alias("shift"))
    named = cut(chains.join(rings, [*by, "head"]).join(first, [*by, "ring"]).select(*by, "head", "ring", "first", "shift", "length", F.when(F.col("tail") != F.col("first"), F.col("tail")).alias("to"), F.col("length").alias("left")))
    while True:
        there = named.select(*by, F.col("head").alias("to"), F.col("to").alias("farther"), F.col("left").alias("more"))
        named = cut(named.join(there, [*by, "to"], "left").select(*by, "head", "ring", "first", "shift", F.col("farther").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        if named.filter("to IS NOT NULL").isEmpty():
            break
    total = named.filter("head = first").select(*by, "ring", F.col("left").alias("total"))
    start = named.join(total, [*by, "ring"]).select(*by, "head", "ring", (F.col("total") - F.col("left") - F.col("shift")).alias("start"), "total")
    found = local.join(start, [*by, "head"], "left")
    rank = F.when(F.col("closed"), F.col("offset")).otherwise(F.pmod(F.col("start") + F.col("offset"), F.col("total")))
    return found.select(*links.columns, F.coalesce("ring", "head").alias("ring"), rank.alias("rank"))


def contour(objects: DataFrame, by: Sequence[str], side: int = SIDE) -> DataFrame:
    """(by, first_y, first_x, outer, ring): the outlines of each object, as arrays of corners that start and end with the
    leftmost and then topmost one; outer ones clockwise, those of holes the other way. RAS-12.

    objects: runs with their object, no two of a row adjoining. Sides of runs are rows, each pointing at the one that goes on
    from its end (where two outlines touch in a corner, towards the object's own side), and rings are ranked lists of sides. No
    object meets in one task; a ring does as it becomes one row.
    """
    key = [*by, "first_y", "first_x"]
    flat = objects.select(*by, F.col("object.y").alias("first_y"), F.col("object.x0").alias("first_x"), "y", "x0", "x1")
    number = lambda x, y, way: F.shiftleft(x.cast("long") + 2**29, 32) + F.shiftleft(y.cast("long") + 2**29, 2) + way
    sides = cut(_sides(flat, key).withColumn("id", number(F.col("sx"), F.col("sy"), F.col("way"))))
    on = sides.select(*key, F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("id").alias("_id"), F.col("way").alias("_way"))
    turn = F.pmod(F.col("_way") - F.col("way") + 1, F.lit(4))  # a turn to the right first, then straight on
    met = sides.join(on, [*key, "ex", "ey"])
    best = met.groupBy(*key, "sx", "sy", "ex", "ey", "id", "way").agg(F.min_by(F.struct("_id", "_way"), F.struct((turn != 2).alias("_t"), "_id")).alias("n"))
    links = best.select(*key, "sx", "sy", "ex", "ey", "id", F.col("n._id").alias("next"), (F.col("n._way") != F.col("way")).alias("turn"), F.floor(F.col("sx") / side).alias("cx"), F.floor(F.col("sy") / side).alias("cy"))
    ranked = _rings(links, by, side)
    corner = F.struct("rank", F.array("ex", "ey").alias("at"))
    area = F.sum(F.col("sx").cast("long") * F.col("ey") - F.col("ex").cast("long") * F.col("sy"))
    rings = ranked.groupBy(*key, "ring").agg(F.sort_array(F.collect_list(F.when(F.col("turn"), corner))).alias("c"), area.alias("a"))
    start = F.array((F.shiftright("ring", 32) - 2**29).cast("int"), (F.shiftright(F.col("ring").bitwiseAND(0xFFFFFFFF), 2) - 2**29).cast("int"))
    return rings.select(*key, (F.col("a") > 0).alias("outer"), F.concat(F.array(start), F.transform("c", lambda c: c["at"])).alias("ring"))


def simplified(outlines: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """Rings of more than `most` points reduced to between least and most, by the distance a point may lie off. GEO-06."""

    def reduce(ring: np.ndarray, off: float) -> np.ndarray:
        keep, stack = np.zeros(len(ring), bool), [(0, len(ring) - 1)]
        keep[[0, -1]] = True
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            p, q = ring[a], ring[b]
            d = q - p
            rest = ring[a + 1 : b] - p
            size = np.hypot(*d)
            far = np.abs(rest[:, 0] * d[1] - rest[:, 1] * d[0]) / size if size else np.hypot(rest[:, 0], rest[:, 1])
            i = int(far.argmax())
            if far[i] > off:
                keep[a + 1 + i] = True
                stack += [(a, a + 1 + i), (a + 1 + i, b)]
        return ring[keep]

    def fit(points: list) -> list:
        ring = np.array([list(p) for p in points], float)
        if len(ring) <= most:
            return [list(p) for p in points]
        low, high, best = 0.0, float(np.ptp(ring, axis=0).max()) + 1, ring
        for _ in range(30):
            off = (low + high) / 2
            best = reduce(ring, off)
            if least <= len(best) <= most:
                break
            low, high = (off, high) if len(best) > most else (low, off)
        return best.astype(int).tolist()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[column] = [fit(list(r)) for r in pdf[column]]
            yield pdf

    return outlines.mapInPandas(apply, outlines.schema)
