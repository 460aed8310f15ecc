"""Landmark models built, validated and applied for all terms and images at once: FEA-17 to FEA-19, ML-19 to ML-22, JOB-08 to JOB-11.

Images are long grey pixels (image_id, x, y, v); sizes: image_id, width, height; landmarks: image_id, term_id, x, y.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import blocks, evaluation, features, landmarks, learners, raster
from tessera.operators.storage import cut


def point_vectors(pixels: DataFrame, sizes: DataFrame, points: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """points with features: the pixel less the one at each offset, clamped to the image. JOIN-07, FEA-16, FEA-17.

    Points are dealt into blocks whose halo is the largest offset, and features are read by index: what is shuffled is the
    blocks and the points, not points times offsets. A point for which a pixel is missing is left out.
    """
    dx, dy = (np.array([o[i] for o in offsets]) for i in (0, 1))
    halo = int(max(np.abs(dx).max(), np.abs(dy).max(), 0))

    def see(plane: np.ndarray, y: np.ndarray, x: np.ndarray, of: dict) -> dict:
        at = lambda place, shift, first, size: np.clip(place[:, None] + shift, -first, (size - 1 - first)[:, None])
        values = plane[y, x][:, None] - plane[at(y, dy, of["y0"], of["height"]), at(x, dx, of["x0"], of["width"])]
        kept = ~np.isnan(values).any(axis=1)
        offset = np.arange(len(y) + 1, dtype=np.int32) * len(dx)
        return {"features": pa.ListArray.from_arrays(pa.array(offset), pa.array(values.astype(np.float32).ravel())), "kept": kept}

    asked = points.join(sizes.select("image_id", "width", "height"), "image_id")
    return blocks.at_points(pixels, asked, ["image_id"], "v", halo, see, "features array<float>", 16 * len(offsets) + 64).drop("width", "height")


def _rows(vectors: DataFrame, label: F.Column | None = None) -> DataFrame:
    key = F.concat_ws("/", *(c for c in vectors.columns if c not in ("features", "label", "dx", "dy"))).alias("sample_id")
    kept = [F.col("label")] if label is None and "label" in vectors.columns else [] if label is None else [label.alias("label")]
    return vectors.select(key, F.col("term_id").cast("int").alias("group"), "features", *kept)


def fit(pixels: DataFrame, sizes: DataFrame, marks: DataFrame, offsets: Sequence[tuple[int, int]], radius: int, outer: float, negatives: int, trees: int = 4, seed: int = 0, **options: int) -> tuple[DataFrame, DataFrame]:
    """(trees of all terms, prior of relative positions). Points within the radius of a landmark are of class 1, random
    points about it of class 0. ML-19."""
    marks = marks.select("image_id", "term_id", "x", "y")
    sized = marks.join(sizes, "image_id")
    near = features.disc(marks, radius).withColumn("label", F.lit(1))
    far = features.ring_samples(sized, negatives, radius + 1, outer, F.col("width"), F.col("height"), seed).select("image_id", "term_id", "x", "y", F.lit(0).alias("label"))
    points = near.unionByName(far).dropDuplicates(["image_id", "term_id", "x", "y"])
    rows = _rows(point_vectors(pixels, sizes, points, offsets))
    prior = landmarks.prior(sized.withColumns({"xr": F.col("x") / F.col("width"), "yr": F.col("y") / F.col("height")}))
    return learners.fit_trees(rows, trees=trees, classes=2, grouped=True, seed=seed, **options), prior


def probabilities(pixels: DataFrame, sizes: DataFrame, points: DataFrame, nodes: DataFrame, offsets: Sequence[tuple[int, int]], trees: int = 4) -> DataFrame:
    """(image_id, term_id, x, y, p) of points: with all pixels of an image for each term, its probability map. ML-22."""
    vectors = point_vectors(pixels, sizes, points.select("image_id", "term_id", "x", "y").distinct(), offsets)
    means = learners.predict_mean(learners.apply_trees(_rows(vectors), nodes, grouped=trees))
    part = F.split("sample_id", "/")
    return means.select(*(part[i].cast(t).alias(c) for i, (c, t) in enumerate((("image_id", "long"), ("term_id", "int"), ("x", "int"), ("y", "int")))), F.round(F.col("value")[1], 9).alias("p"))


def predict(pixels: DataFrame, sizes: DataFrame, nodes: DataFrame, prior: DataFrame, offsets: Sequence[tuple[int, int]], n: int, trees: int = 4, seed: int = 0) -> DataFrame:
    """(image_id, term_id, p, x, y): the median of the likeliest of n points drawn from each term's prior. ML-21."""
    drawn = features.candidates(sizes, prior, n, seed)
    return landmarks.median_of_max(probabilities(pixels, sizes, drawn, nodes, offsets, trees))


def validate(pixels: DataFrame, sizes: DataFrame, marks: DataFrame, offsets: Sequence[tuple[int, int]], folds: int, n: int, **options: float) -> DataFrame:
    """(image_id, term_id, x_true, y_true, x_pred, y_pred, err): each random group of images predicted by models of the
    others. ML-20; `landmarks.interval95` sums it up."""
    grouped = evaluation.random_groups(sizes.select("image_id"), folds)
    out = None
    for k in range(folds):
        test, train = (grouped.filter((F.col("group") == k) == same).select("image_id") for same in (True, False))
        nodes, prior = fit(pixels, sizes, marks.join(train, "image_id", "left_semi"), offsets, **options)
        found = predict(pixels, sizes.join(test, "image_id", "left_semi"), nodes, prior, offsets, n, options.get("trees", 4))
        joined = marks.select("image_id", "term_id", F.col("x").alias("x_true"), F.col("y").alias("y_true")).join(found.select("image_id", "term_id", F.col("x").alias("x_pred"), F.col("y").alias("y_pred")), ["image_id", "term_id"])
        out = joined if out is None else out.unionByName(joined)
    return landmarks.errors(out)


def fit_offsets(pixels: DataFrame, sizes: DataFrame, marks: DataFrame, offsets: Sequence[tuple[int, int]], reach: int, n: int, trees: int = 4, seed: int = 0, **options: int) -> DataFrame:
    """Trees that tell, from a point near a landmark, its offset from it. FEA-18, FEA-19, ML-14, ML-15."""
    moved = features.displaced(marks.select("image_id", "term_id", "x", "y"), n, reach, seed).dropDuplicates(["image_id", "term_id", "x", "y"])
    rows = _rows(point_vectors(pixels, sizes, moved, offsets), F.array("dx", "dy"))
    return learners.fit_trees(rows, trees=trees, grouped=True, seed=seed, **options)


def voted(pixels: DataFrame, sizes: DataFrame, points: DataFrame, nodes: DataFrame, offsets: Sequence[tuple[int, int]], trees: int = 4) -> DataFrame:
    """(image_id, term_id, y, x, votes): every tree of every point votes. AGG-16, ML-15."""
    vectors = point_vectors(pixels, sizes, points.select("image_id", "term_id", "x", "y").distinct(), offsets)
    leaves = learners.apply_trees(_rows(vectors), nodes, grouped=trees)
    part = F.split("sample_id", "/")
    predicted = leaves.select(part[0].cast("long").alias("image_id"), part[1].cast("int").alias("term_id"), part[2].cast("int").alias("x"), part[3].cast("int").alias("y"), F.round(F.col("value")[0]).cast("int").alias("dx"), F.round(F.col("value")[1]).cast("int").alias("dy"))
    return landmarks.offset_votes(predicted, sizes)


def fit_graph(pixels: DataFrame, sizes: DataFrame, marks: DataFrame, offsets: Sequence[tuple[int, int]], radius: int, outer: float, negatives: int, partners: int, reach: int, moved: int, trees: int = 4, seed: int = 0, **options: int) -> dict[str, DataFrame]:
    """What `predict_by_messages` needs: trees of classes, trees of offsets, links to partners, training displacements. JOB-10."""
    marks = marks.select("image_id", "term_id", "x", "y")
    nodes, _ = fit(pixels, sizes, marks, offsets, radius, outer, negatives, trees, seed, **options)
    shifts = fit_offsets(pixels, sizes, marks, offsets, reach, moved, trees, seed, **options)
    links = landmarks.nearest_partners(landmarks.edges(marks), partners).select("src", "dst")
    # a link goes one way: message passing sends both ways along it
    links = links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    a = marks.select("image_id", F.col("term_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = marks.select("image_id", F.col("term_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    seen = a.join(links, "src").join(b, ["image_id", "dst"]).select("src", "dst", (F.col("ax") - F.col("bx")).alias("dx"), (F.col("ay") - F.col("by")).alias("dy")).distinct()
    return {"nodes": nodes, "shifts": shifts, "links": links, "displacements": seen}


def predict_by_messages(pixels: DataFrame, sizes: DataFrame, model: dict[str, DataFrame], offsets: Sequence[tuple[int, int]], trees: int = 4, step: int = 1, beta: float = 0.5, moves: int = 1, apart: int = 3, n: int = 5, sigma: float = 3.0, rounds: int = 10) -> DataFrame:
    """(image_id, term_id, rank, x, y, belief): a landmark of each term in each image. JOB-10.

    Probabilities of all pixels (every `step`th row and column) for each term; the likely ones move along their predicted
    offsets and add up; of the peaks, `apart` from each other, the n largest are candidates; messages along the links choose
    among them by the displacements seen in training.
    """
    terms = model["nodes"].select(F.floor(F.col("tree_id") / trees).cast("int").alias("term_id")).distinct()
    grid = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1, F.lit(step)))
    points = sizes.withColumn("x", grid("width")).withColumn("y", grid("height")).select("image_id", "x", "y").crossJoin(F.broadcast(terms))  # a row per term
    likely = cut(probabilities(pixels, sizes, points, model["nodes"], offsets, trees).filter("p > 0"))
    top = F.max("p").over(Window.partitionBy("image_id", "term_id"))
    kept = likely.withColumn("_top", top).filter(F.col("p") >= beta * F.col("_top")).select("image_id", "term_id", "x", "y")
    shifts = mean_offsets(pixels, sizes, kept, model["shifts"], offsets, trees)
    moved = cut(landmarks.reaggregated(likely, shifts, sizes, beta, moves))
    peaks = raster.suppressed(moved.select("image_id", "term_id", "x", "y", F.col("p").alias("v")), ["image_id", "term_id"], apart)
    candidates = cut(landmarks.top_candidates(peaks.withColumnRenamed("v", "p"), n))
    links = landmarks.compatibility(candidates, model["links"], model["displacements"], sigma)
    return landmarks.best_by_messages(candidates, links, rounds)


def mean_offsets(pixels: DataFrame, sizes: DataFrame, points: DataFrame, nodes: DataFrame, offsets: Sequence[tuple[int, int]], trees: int = 4) -> DataFrame:
    """(image_id, term_id, y, x, dx, dy): the trees' mean offset at each point, rounded. ML-14."""
    means = learners.predict_mean(learners.apply_trees(_rows(point_vectors(pixels, sizes, points.distinct(), offsets)), nodes, grouped=trees))
    part = F.split("sample_id", "/")
    return means.select(part[0].cast("long").alias("image_id"), part[1].cast("int").alias("term_id"), part[3].cast("int").alias("y"), part[2].cast("int").alias("x"), *(F.round(F.col("value")[i]).cast("int").alias(c) for i, c in enumerate(("dx", "dy"))))


def predict_by_shape(pixels: DataFrame, sizes: DataFrame, marks: DataFrame, shifts: DataFrame, offsets: Sequence[tuple[int, int]], reference: int, n: int, largest: int, directions: int = 2, trees: int = 4, least: int = 1, factor: float = 0.5, seed: int = 0) -> DataFrame:
    """(image_id, term_id, x, y): points drawn from each term's prior vote by their predicted offsets, and a shape model of the
    training landmarks searches the votes from coarse to fine. JOB-11; `landmarks.error_matrix` compares.

    marks: training landmarks; reference: the image whose shape the others are turned onto; shifts: trees of `fit_offsets`.
    """
    sized = marks.select("image_id", "term_id", "x", "y").join(sizes, "image_id")
    prior = landmarks.prior(sized.withColumns({"xr": F.col("x") / F.col("width"), "yr": F.col("y") / F.col("height")}))
    drawn = features.candidates(sizes, prior, n, seed).select("image_id", "term_id", "x", "y")
    votes = cut(voted(pixels, sizes, drawn, shifts, offsets, trees).withColumnRenamed("votes", "v"))
    model = landmarks.shape_model(landmarks.aligned(marks.select("image_id", "term_id", "x", "y"), reference), directions)
    start = sizes.crossJoin(F.broadcast(prior.select("term_id", "mean_x", "mean_y")))  # a row per term
    start = start.select("image_id", "term_id", F.round(F.col("mean_x") * F.col("width")).cast("int").alias("x"), F.round(F.col("mean_y") * F.col("height")).cast("int").alias("y"))
    return landmarks.shape_search(votes, start, model, largest, least, factor)
