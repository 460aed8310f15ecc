"""Votes of sub-windows, classes, folds and confusion: AGG-01 to AGG-09, AGG-19, AGG-22, WIN-03 to WIN-09, FIL-11."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def soft_votes(rows: DataFrame) -> DataFrame:
    """(image_id, class_idx, p): the mean over an image's sub-windows of their probabilities. AGG-01."""
    n = rows.groupBy("image_id").agg(F.count_distinct("sw").alias("n"))
    return rows.groupBy("image_id", "class_idx").agg(F.sum("p").alias("s")).join(n, "image_id").select("image_id", "class_idx", (F.col("s") / F.col("n")).alias("p"))


def hard_votes(rows: DataFrame) -> DataFrame:
    """(image_id, class_idx, p): each row gives its class one n-th. AGG-02."""
    counts = rows.groupBy("image_id", "class_idx").agg(F.count("*").alias("k"))
    return counts.select("image_id", "class_idx", (F.col("k") / F.sum("k").over(Window.partitionBy("image_id"))).alias("p"))


def best_class(probabilities: DataFrame) -> DataFrame:
    """(image_id, class_idx, p): the likeliest class, the lowest on ties. AGG-22, AGG-06."""
    return probabilities.groupBy("image_id").agg(F.max_by("class_idx", F.struct("p", -F.col("class_idx"))).alias("class_idx"), F.max("p").alias("p"))


def leaf_offsets(nodes: DataFrame) -> DataFrame:
    """(tree_id, offset): where each tree's leaves start in one numbering. WIN-03. One row per tree is windowed."""
    w = Window.orderBy("tree_id").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.groupBy("tree_id").agg(F.max("leaf").alias("top")).select("tree_id", F.coalesce(F.sum(F.col("top") + 1).over(w), F.lit(0)).alias("offset"))


def leaf_frequency(rows: DataFrame) -> DataFrame:
    """(image_id, leaf_id, v): how often an image's sub-windows end in a leaf, by their number. AGG-03."""
    n = rows.groupBy("image_id").agg(F.count_distinct("sw").alias("n"))
    hits = rows.join(leaf_offsets(rows), "tree_id").groupBy("image_id", (F.col("leaf") + F.col("offset")).alias("leaf_id")).agg(F.count("*").alias("k"))
    return hits.join(n, "image_id").select("image_id", "leaf_id", (F.col("k") / F.col("n")).alias("v"))


def column_max(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("leaf_id").agg(F.max("v").alias("m"))


def scaled(frequencies: DataFrame, maxima: DataFrame) -> DataFrame:
    """Frequencies by the training maximum of their leaf; leaves without one stay. AGG-04."""
    return frequencies.join(maxima, "leaf_id", "left").select("image_id", "leaf_id", F.when(F.col("m") > 0, F.col("v") / F.col("m")).otherwise(F.col("v")).alias("v"))


#: Side of the cells that an image's confidence is added up in.
CELL = 64


def confidence_map(windows: DataFrame, size: int, cells: bool = False) -> DataFrame:
    """(image_id, y, x, class_idx, p): sums over the windows that cover a pixel. AGG-05. windows: x, y of the corner.

    Windows go to the cells that they reach, and are spread over their pixels there: what is shuffled are windows, not pixels.
    cells: with the cell, _cx and _cy, by which the rows are dealt.
    """
    reach = lambda c: F.sequence(F.floor(F.col(c) / CELL), F.floor((F.col(c) + (size - 1)) / CELL))
    dealt = windows.select("image_id", "y", "x", "class_idx", "p", F.explode(reach("x")).alias("_cx")).withColumn("_cy", F.explode(reach("y"))).repartition("image_id", "_cx", "_cy")
    at = ["image_id", "_cx", "_cy"]
    corners = dealt.groupBy(*at, "y", "x", "class_idx").agg(F.sum("p").alias("p"))
    inside = lambda c, cell: F.explode(F.sequence(F.greatest(F.col(c), F.col(cell) * CELL), F.least(F.col(c) + (size - 1), F.col(cell) * CELL + (CELL - 1))))
    cover = corners.withColumn("x", inside("x", "_cx")).withColumn("y", inside("y", "_cy"))
    sums = cover.groupBy(*at, "y", "x", "class_idx").agg(F.sum("p").alias("p"))
    return sums.select("image_id", "y", "x", "class_idx", "p", *(["_cx", "_cy"] if cells else []))


def winning_class(confidence: DataFrame, width: int, height: int, border: int) -> DataFrame:
    """(image_id, y, x, m): the likeliest class, the lowest on ties; 0 within the border. AGG-06, FIL-11. Rows that come with
    their cell stay where they are."""
    edge = (F.col("x") < border) | (F.col("x") >= width - border) | (F.col("y") < border) | (F.col("y") >= height - border)
    cell = [c for c in ("_cx", "_cy") if c in confidence.columns]
    best = confidence.groupBy("image_id", *cell, "y", "x").agg(F.max_by("class_idx", F.struct("p", -F.col("class_idx"))).alias("m")).drop(*cell)
    return best.withColumn("m", F.when(edge, 0).otherwise(F.col("m")))


def confusion(samples: DataFrame) -> DataFrame:
    """(label, pred, n) for every pair of classes, zeros included. AGG-07. The classes are crossed, not the samples."""
    classes = samples.select("label").union(samples.select("pred")).distinct()
    grid = classes.crossJoin(classes.withColumnRenamed("label", "pred"))
    return grid.join(samples.groupBy("label", "pred").agg(F.count("*").alias("n")), ["label", "pred"], "left").fillna(0, ["n"])


def recognition(samples: DataFrame) -> DataFrame:
    """One row per class (rate: share recognised, null without samples) and one of all (label null): rate overall,
    class_average over classes with samples, total. AGG-08, AGG-09."""
    per = confusion(samples).groupBy("label").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    per = per.select("label", "total", "right", F.when(F.col("total") > 0, F.col("right") / F.col("total")).alias("rate"))
    both = per.agg(F.sum("total").alias("total"), F.sum("right").alias("right"), F.avg("rate").alias("class_average"))
    return per.withColumn("class_average", F.lit(None).cast("double")).unionByName(both.select(F.lit(None).cast("int").alias("label"), "total", "right", (F.col("right") / F.col("total")).alias("rate"), "class_average"))


def class_index(samples: DataFrame) -> DataFrame:
    """(label, class_idx): classes in order. WIN-04, AGG-19. Ranked over the distinct labels."""
    return samples.select("label").distinct().withColumn("class_idx", F.row_number().over(Window.orderBy("label")) - 1)


def stratified_folds(samples: DataFrame, k: int, key: str = "sample_id") -> DataFrame:
    """samples with fold 0 .. k-1: contiguous parts of each class by key. WIN-06."""
    return samples.withColumn("fold", F.ntile(k).over(Window.partitionBy("label").orderBy(key)) - 1)


def chunked(samples: DataFrame, k: int, by: Sequence[str] = (), key: str = "sample_id") -> DataFrame:
    """samples with chunk 0 .. k-1, parts of almost equal size in order of key. WIN-05. Give `by` to number within groups:
    without it one task sorts all keys."""
    return samples.withColumn("chunk", F.ntile(k).over(Window.partitionBy(*by).orderBy(key)) - 1)


def shuffle_splits(samples: DataFrame, times: int, test: float, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """samples once per iteration with is_test, for the first ceil(test * n) by a hash. WIN-07."""
    each = samples.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    w = Window.partitionBy("iteration")
    rank = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "iteration", key), key))
    return each.withColumn("is_test", rank <= F.ceil(F.lit(test) * F.count("*").over(w)))


def random_groups(images: DataFrame, k: int, seed: int = 0, key: str = "image_id") -> DataFrame:
    """images with a group 0 .. k-1 by a hash. WIN-08."""
    return images.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int"))


def extended(folds: DataFrame, windows: DataFrame) -> DataFrame:
    """Sub-windows with their image's fold. WIN-09."""
    return windows.join(folds.select("image_id", "fold"), "image_id")
