"""Landmarks, vote maps and shapes: AGG-11, AGG-12, AGG-14, AGG-16 to AGG-18, AGG-21, WIN-10, SRT-01, SRT-02, JOIN-06, JOIN-11, ITR-03 to ITR-07."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.storage import cut


def prior(landmarks: DataFrame, height: float | None = None) -> DataFrame:
    """(term_id, mean and sample covariance of xr, yr). AGG-11. Missing landmarks have no row and don't count."""
    return landmarks.groupBy("term_id").agg(F.avg("xr").alias("mean_x"), F.avg("yr").alias("mean_y"), F.var_samp("xr").alias("var_x"), F.var_samp("yr").alias("var_y"), F.covar_samp("xr", "yr").alias("cov_xy"))


def wide(landmarks: DataFrame, terms: list[int]) -> DataFrame:
    """One row per image with x and y of each term, of several the largest. SRC-07. terms: the columns, from an aggregate over
    the data. Landmarks are dealt by image first: one file may hold more images than a task can keep a row for."""
    value = lambda t, c: F.max(F.when(F.col("term_id") == t, F.col(c))).alias(f"{t}_{c}")
    return landmarks.select("image_id", "term_id", "x", "y").repartition("image_id").groupBy("image_id").agg(*(value(t, c) for t in terms for c in "xy"))


def edges(landmarks: DataFrame) -> DataFrame:
    """(src, dst, d): how far on average the displacement of two landmarks is from its mean. AGG-18."""
    a = landmarks.select("image_id", F.col("term_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = landmarks.select("image_id", F.col("term_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = a.join(b, "image_id").filter("src <> dst").select("src", "dst", (F.col("ax") - F.col("bx")).alias("dx"), (F.col("ay") - F.col("by")).alias("dy"))
    mean = pairs.groupBy("src", "dst").agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
    off = F.sqrt(F.pow(F.col("dx") - F.col("mx"), 2) + F.pow(F.col("dy") - F.col("my"), 2))
    # the means are one row per pair of terms, whatever the number of images
    return pairs.join(mean, ["src", "dst"]).groupBy("src", "dst").agg(F.avg(off).alias("d"))


def nearest_partners(pairs: DataFrame, t: int) -> DataFrame:
    """The t partners of least d of each landmark, with their rank. SRT-01."""
    w = Window.partitionBy("src").orderBy("d", "dst")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= t)


def alignment(landmarks: DataFrame, reference: int) -> DataFrame:
    """(image_id, a, b, scale, angle) that turns each image's shape onto the reference image's, over common terms. ITR-06."""
    both = landmarks.join(landmarks.filter(F.col("image_id") == reference).select("term_id", F.col("x").alias("x0"), F.col("y").alias("y0")), "term_id")
    w = Window.partitionBy("image_id")
    c = both.select("image_id", *((F.col(v) - F.avg(v).over(w)).alias(v) for v in ("x", "y", "x0", "y0")))
    size = F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    norm = F.sqrt(F.sum(F.col("x0") * F.col("x0") + F.col("y0") * F.col("y0")))
    a = F.sum(F.col("x") * F.col("x0") + F.col("y") * F.col("y0")) / norm / size
    b = F.sum(F.col("x") * F.col("y0") - F.col("x0") * F.col("y")) / norm / size
    return c.groupBy("image_id").agg(a.alias("a"), b.alias("b")).select("*", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("scale"), F.atan2("b", "a").alias("angle"))


def aligned(landmarks: DataFrame, reference: int) -> DataFrame:
    """Landmarks centred, scaled and turned onto the reference. ITR-06."""
    w = Window.partitionBy("image_id")
    c = landmarks.select("image_id", "term_id", (F.col("x") - F.avg("x").over(w)).alias("x"), (F.col("y") - F.avg("y").over(w)).alias("y"))
    p = alignment(landmarks, reference).select("image_id", (F.col("scale") * F.cos("angle")).alias("c"), (F.col("scale") * F.sin("angle")).alias("s"))
    return c.join(p, "image_id").select("image_id", "term_id", (F.col("c") * F.col("x") - F.col("s") * F.col("y")).alias("x"), (F.col("s") * F.col("x") + F.col("c") * F.col("y")).alias("y"))


def shape_model(shapes: DataFrame, k: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(terms, mean shape, basis of the k widest directions) of aligned shapes. AGG-24. The covariance is aggregated by
    Spark from coordinate pairs of an image; the driver gets its (2 * terms) squared entries."""
    long = shapes.select("image_id", F.col("term_id"), F.lit(0).alias("axis"), F.col("x").alias("v")).unionByName(shapes.select("image_id", "term_id", F.lit(1).alias("axis"), F.col("y").alias("v")))
    mean = long.groupBy("axis", "term_id").agg(F.avg("v").alias("m"))
    c = long.join(mean, ["axis", "term_id"]).select("image_id", "axis", "term_id", (F.col("v") - F.col("m")).alias("d"))
    d = c.select("image_id", F.col("axis").alias("axis2"), F.col("term_id").alias("term2"), F.col("d").alias("d2"))
    cov = c.join(d, "image_id").groupBy("axis", "term_id", "axis2", "term2").agg((F.sum(F.col("d") * F.col("d2")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("c")).collect()
    means = {(r["axis"], r["term_id"]): r["m"] for r in mean.collect()}
    keys = sorted(means)
    at = {key: i for i, key in enumerate(keys)}
    m = np.zeros((len(keys), len(keys)))
    for r in cov:
        m[at[r["axis"], r["term_id"]], at[r["axis2"], r["term2"]]] = r["c"]
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return [t for a, t in keys if a == 0], np.array([means[key] for key in keys]), vectors[:, order]


def fit_shapes(points: DataFrame, terms: list[int], mean: np.ndarray, basis: np.ndarray, rounds: int = 100) -> DataFrame:
    """Each image's points moved to the nearest shape of the model. ITR-05. An image is a group of one row per term."""
    n = len(terms)
    index = {t: i for i, t in enumerate(terms)}
    mu = mean[:n] + 1j * mean[n:]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(n, complex)
        have = np.zeros(n, bool)
        for t, x, y in zip(pdf["term_id"], pdf["x"], pdf["y"], strict=True):
            if t in index:
                z[index[t]], have[index[t]] = complex(x, y), True
        if have.sum() < 2:
            return pdf[["image_id", "term_id", "x", "y"]].astype({"x": float, "y": float})
        b, centre = np.zeros(basis.shape[1]), z[have].mean()
        y = z - centre
        for _ in range(rounds):
            full = mean + basis @ b
            shape = full[:n] + 1j * full[n:]
            turn = np.vdot(y[have], shape[have]) / max(np.vdot(y[have], y[have]).real, 1e-12)
            back = np.where(have, y * turn, shape) - mu
            new = basis.T @ np.concatenate([back.real, back.imag])
            done, b = np.allclose(new, b, atol=1e-9), new
            if done:
                break
        full = mean + basis @ b
        out = (full[:n] + 1j * full[n:]) / (turn if abs(turn) > 1e-12 else 1) + centre
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "term_id": terms, "x": out.real, "y": out.imag})

    return points.select("image_id", "term_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("image_id").applyInPandas(fit, "image_id long, term_id int, x double, y double")


def offset_votes(predictions: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, term_id, y, x, votes): every prediction votes at its pixel less its offset; votes outside are lost.
    AGG-16, FIL-16. predictions: image_id, term_id, x, y, dx, dy; sizes: image_id, width, height."""
    moved = predictions.select("image_id", "term_id", (F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y")).join(sizes, "image_id")
    return moved.filter("x >= 0 AND y >= 0 AND x < width AND y < height").groupBy("image_id", "term_id", "y", "x").agg(F.count("*").alias("votes"))


def local_maximum(votes: DataFrame, expected: DataFrame, radius: int) -> DataFrame:
    """(image_id, term_id, x, y, v): the largest vote in the square about the expected place, the first by row on ties;
    the expected place where there is no vote. WIN-10. votes: image_id, term_id, x, y, v; expected: the same with ex, ey."""
    near = expected.join(votes, ["image_id", "term_id"], "left").filter(F.col("x").isNull() | ((F.abs(F.col("x") - F.col("ex")) <= radius) & (F.abs(F.col("y") - F.col("ey")) <= radius)))
    best = near.groupBy("image_id", "term_id").agg(F.max_by(F.struct("x", "y", "v"), F.struct("v", -F.col("y"), -F.col("x"))).alias("b"))
    return expected.join(best, ["image_id", "term_id"], "left").select("image_id", "term_id", F.coalesce("b.x", "ex").alias("x"), F.coalesce("b.y", "ey").alias("y"), F.col("b.v").alias("v"))


def shape_search(votes: DataFrame, start: DataFrame, model: tuple, largest: int, least: int = 1, factor: float = 0.5) -> DataFrame:
    """Coarse to fine: the local maximum within a radius, then the model's nearest shape; the radius shrinks. ITR-03.
    All images take each round together; there are log(largest / least) rounds."""
    terms, mean, basis = model
    at, radius = start.select("image_id", "term_id", F.col("x").alias("ex"), F.col("y").alias("ey")), float(largest)
    while radius >= least:
        found = local_maximum(votes, at, int(radius))
        fitted = fit_shapes(found.select("image_id", "term_id", "x", "y"), terms, mean, basis)
        at = cut(fitted.select("image_id", "term_id", F.round("x").cast("int").alias("ex"), F.round("y").cast("int").alias("ey")))
        radius *= factor
    return at.withColumnsRenamed({"ex": "x", "ey": "y"})


def reaggregated(votes: DataFrame, offsets: DataFrame, sizes: DataFrame, beta: float, rounds: int = 1) -> DataFrame:
    """votes (image_id, term_id, y, x, p) moved by predicted offsets and summed, `rounds` times. AGG-17, FIL-17, ITR-04.

    Pixels of beta times the image's largest value or more move; places are clamped to the image, and the border is
    emptied. offsets: image_id, term_id, y, x, dx, dy; sizes: image_id, width, height.
    """
    now = votes
    for i in range(rounds):
        w = Window.partitionBy("image_id", "term_id")
        kept = now.withColumn("_top", F.max("p").over(w)).filter(F.col("p") >= beta * F.col("_top")).drop("_top")
        moved = kept.join(offsets, ["image_id", "term_id", "y", "x"]).join(sizes, "image_id")
        x = F.greatest(F.lit(0), F.least(F.col("x") - F.col("dx"), F.col("width") - 1))
        y = F.greatest(F.lit(0), F.least(F.col("y") - F.col("dy"), F.col("height") - 1))
        put = moved.select("image_id", "term_id", y.alias("y"), x.alias("x"), "p", "width", "height").filter("x > 0 AND y > 0 AND x < width - 1 AND y < height - 1")
        now = put.groupBy("image_id", "term_id", "y", "x").agg(F.sum("p").alias("p"))
        if i < rounds - 1:
            now = cut(now)
    return now


def median_of_max(points: DataFrame) -> DataFrame:
    """(image_id, term_id, p, x, y): the medians of the places with the largest p. AGG-12."""
    w = Window.partitionBy("image_id", "term_id")
    best = points.withColumn("_top", F.max("p").over(w)).filter("p = _top")
    return best.groupBy("image_id", "term_id").agg(F.max("p").alias("p"), F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"))


def top_candidates(points: DataFrame, n: int) -> DataFrame:
    """The n largest p of each image and term, by row on ties; nothing that isn't positive. SRT-02."""
    w = Window.partitionBy("image_id", "term_id").orderBy(F.desc("p"), "y", "x")
    return points.filter("p > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def compatibility(candidates: DataFrame, pairs: DataFrame, displacements: DataFrame, sigma: float) -> DataFrame:
    """(image_id, src, dst, a, b, c) of candidates of linked landmarks: the largest Gaussian density of their displacement
    over training displacements, by its peak, then by the sum over b. JOIN-11. candidates: image_id, term_id, rank, x, y."""
    a = candidates.select("image_id", F.col("term_id").alias("src"), F.col("rank").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = candidates.select("image_id", F.col("term_id").alias("dst"), F.col("rank").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    joined = a.join(pairs.select("src", "dst"), "src").join(b, ["image_id", "dst"]).join(displacements, ["src", "dst"])
    off = F.pow(F.col("ax") - F.col("bx") - F.col("dx"), 2) + F.pow(F.col("ay") - F.col("by") - F.col("dy"), 2)
    best = joined.groupBy("image_id", "src", "dst", "a", "b").agg(F.max(F.exp(-off / (2 * sigma * sigma))).alias("c"))
    total = F.sum("c").over(Window.partitionBy("image_id", "src", "dst", "a"))
    return best.withColumn("c", F.when(total > 0, F.col("c") / total).otherwise(F.lit(0.0)))


def best_by_messages(candidates: DataFrame, links: DataFrame, rounds: int = 10) -> DataFrame:
    """(image_id, term_id, rank, x, y, belief): the candidate of the largest belief after message passing. ITR-07.

    candidates: image_id, term_id, rank, x, y, p. links: image_id, src, dst, a, b, c. A message from dst's candidates to
    a candidate of src sums c * p * the product of what dst hears from others; messages of an edge add up to 1. Products
    are sums of logarithms. Exact on trees; on other graphs, `rounds` rounds.
    """
    both = links.unionByName(links.select("image_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    both = cut(both.groupBy("image_id", "src", "dst", "a", "b").agg(F.max("c").alias("c")))
    unary = candidates.select("image_id", F.col("term_id").alias("dst"), F.col("rank").alias("b"), "p")
    messages = cut(both.groupBy("image_id", "src", "dst", "a").agg((F.lit(1.0) / F.count_distinct("b")).alias("m")))
    tiny = 1e-300
    for _ in range(rounds):
        heard = messages.select("image_id", F.col("src").alias("dst"), F.col("dst").alias("from"), F.col("a").alias("b"), F.log(F.greatest("m", F.lit(tiny))).alias("l"))
        total = heard.groupBy("image_id", "dst", "b").agg(F.sum("l").alias("all"))
        own = heard.select("image_id", "dst", "b", F.col("from").alias("src"), "l")
        base = both.join(unary, ["image_id", "dst", "b"]).join(total, ["image_id", "dst", "b"], "left").join(own, ["image_id", "dst", "b", "src"], "left")
        term = F.col("c") * F.col("p") * F.exp(F.coalesce("all", F.lit(0.0)) - F.coalesce("l", F.lit(0.0)))
        new = base.groupBy("image_id", "src", "dst", "a").agg(F.sum(term).alias("m"))
        s = F.sum("m").over(Window.partitionBy("image_id", "src", "dst"))
        messages = cut(new.withColumn("m", F.when(s > 0, F.col("m") / s).otherwise(F.lit(0.0))))
    logs = messages.groupBy("image_id", F.col("src").alias("term_id"), F.col("a").alias("rank")).agg(F.sum(F.log(F.greatest("m", F.lit(tiny)))).alias("l"))
    belief = candidates.join(logs, ["image_id", "term_id", "rank"], "left").withColumn("belief", F.log(F.greatest("p", F.lit(tiny))) + F.coalesce("l", F.lit(0.0)))
    w = Window.partitionBy("image_id", "term_id").orderBy(F.desc("belief"), "rank")
    return belief.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("image_id", "term_id", "rank", "x", "y", "belief")


def errors(predictions: DataFrame) -> DataFrame:
    """predictions (x_true, y_true, x_pred, y_pred) with err, the distance. JOIN-06, FUN-22."""
    dx, dy = F.col("x_pred") - F.col("x_true"), F.col("y_pred") - F.col("y_true")
    return predictions.withColumn("err", F.sqrt((dx * dx + dy * dy).cast("double")))


def error_matrix(predictions: DataFrame) -> DataFrame:
    """(image_id, term_id, err): the least error over models, with averages by image, by term and of all (null keys). AGG-14, SET-04."""
    # dealt by image first: one file may hold more landmarks than a task can keep a row for
    least = errors(predictions).select("image_id", "term_id", "err").repartition("image_id").groupBy("image_id", "term_id").agg(F.min("err").alias("err"))
    return least.cube("image_id", "term_id").agg(F.avg("err").alias("err"))


def interval95(predictions: DataFrame) -> DataFrame:
    """(term_id, low, mean, high): the mean error and 1.96 population deviations by the root of the count about it. AGG-13."""
    e = errors(predictions).groupBy("term_id").agg(F.avg("err").alias("mean"), (1.96 * F.stddev_pop("err") / F.sqrt(F.count("err"))).alias("half"))
    return e.select("term_id", (F.col("mean") - F.col("half")).alias("low"), "mean", (F.col("mean") + F.col("half")).alias("high"))
