"""Segment, locate, dispatch, classify; and the composite jobs: UDF-02 to UDF-04, UDF-06, JOB-02, JOB-03, JOB-01, JOB-06, JOB-07, JOB-12, JOB-13. JOB-04 and JOB-05: slides."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import color, geometry
from tessera.operators import annotations as marks
from tessera.operators import evaluation, features, learners, raster, regions, spatial
from tessera.operators.storage import cut
from tessera.sources import sinks

Segment = Callable[[DataFrame, Sequence[str]], DataFrame]
Classify = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Workflow:
    """Steps over pixels (by, x, y, channels). segment gives a mask column m; the first rule that holds dispatches an object
    to its label and classifier, which adds cls and p. Whole slides, not tiles, are labelled, so objects are never cut."""

    by: tuple[str, ...] = ("image_id",)
    segmenter: Segment | None = None
    rules: tuple[tuple[str, Column, Classify | None], ...] = field(default=())

    def segment(self, f: Segment) -> Workflow:
        return Workflow(self.by, f, self.rules)

    def dispatch(self, label: str, rule: Column, classifier: Classify | None = None) -> Workflow:
        return Workflow(self.by, self.segmenter, (*self.rules, (label, rule, classifier)))

    def run(self, pixels: DataFrame) -> DataFrame:
        """(by, first_y, first_x, area, box, dispatch, cls, p); objects that no rule takes are left out."""
        mask = self.segmenter(pixels, self.by)
        objects = regions.areas(regions.labelled(regions.runs(mask, self.by), self.by), self.by)
        taken = F.coalesce(*(F.when(rule, label) for label, rule, _ in self.rules))
        dispatched = objects.withColumn("dispatch", taken).filter("dispatch IS NOT NULL")
        out = None
        for label, _, classifier in self.rules:
            part = dispatched.filter(F.col("dispatch") == label)
            part = classifier(part) if classifier else part.withColumns({"cls": F.lit(None).cast("int"), "p": F.lit(None).cast("double")})
            out = part if out is None else out.unionByName(part)
        return out


def green_segmenter(threshold: int, radius: int = 3, window: str = "square") -> Segment:
    """Pixels of less green than a threshold, closed and opened by a window of 2 * radius + 1 pixels. RAS-05: with
    window="ellipse", which is one shuffle too; a square keeps the corners of objects."""
    if window not in ("square", "ellipse"):
        raise ValueError(f"no window {window}")

    def segment(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
        mask = pixels.select(*by, "x", "y", (F.col("g") < threshold).cast("int").alias("m"))
        if window == "square":
            return raster.open_(raster.close(mask, by, radius, "m"), by, radius, "m")
        return raster.elliptical(mask, by, radius, ("dilate", "erode", "erode", "dilate"), "m")

    return segment


def find_objects(pixels: DataFrame, by: Sequence[str], filter_name: str = "otsu", zoom: int = 0, least: float | None = None, most: float | None = None, dark: bool = False, **options: float) -> DataFrame:
    """Objects of thresholded slides within area bounds. JOB-06."""
    low, high = regions.finder_bounds(zoom, least, most)
    mask = raster.FILTERS[filter_name](pixels, list(by), **options).withColumn("m", (F.col("v") == (0 if dark else 255)).cast("int"))
    return regions.areas(regions.labelled(regions.runs(mask, by), by), by).filter(regions.within(F.col("area"), low, high))


def detect_samples(thumbnails: DataFrame, sizes: DataFrame, by: Sequence[str], radius: int = 275, constant: float = 5, erosions: int = 3, dilations: int = 3, least: float = 4e6, most: float = 1e18) -> DataFrame:
    """Tissue on thumbnails: local Gaussian threshold, clean-up, the objects but the largest, in slide coordinates. JOB-07.
    sizes: by, full_width, thumb_width."""
    mask = raster.adaptive_gaussian(thumbnails, by, 2 * radius + 1, constant).withColumn("m", (F.col("m") == 0).cast("int")).drop("v")
    mask = raster.dilate(raster.erode(mask, by, 2, erosions, "m"), by, 2, dilations, "m")
    objects = regions.without_largest(regions.areas(regions.labelled(regions.runs(mask, by), by), by), by).join(sizes, list(by))
    scale = F.col("full_width") / F.col("thumb_width")
    scaled = objects.withColumns({c: (F.col(c) * scale).cast("long") for c in ("left", "top", "right", "bottom")}).withColumn("area", F.col("area") * scale * scale)
    return scaled.filter(regions.within(F.col("area"), least, most, strict=True)).drop("full_width", "thumb_width")


def window_vectors(images: DataFrame, pixels: DataFrame, n: int, least: float, most: float, size: int, space: int = 2, seed: int = 0, kernel: str | None = None) -> DataFrame:
    """(image_id, sw, features) of random windows in a colour space. FEA-01 to FEA-05. kernel: how windows are brought to
    their size, one of `raster.KERNELS` with values rounded to 0..255, or the nearest pixel."""
    boxes = features.window_boxes(images, n, least, most, size, size, seed)
    cells = features.resized(boxes, pixels, size, size, ["r", "g", "b"], kernel=kernel)
    if kernel:
        cells = cells.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.round(c).cast("int"))) for c in ("r", "g", "b")})
    cells = color.converted(cells, space, ["image_id", "sw"])
    return features.vectors(cells, [c for c in cells.columns if c.startswith("c")])


def fit_windows(images: DataFrame, windows: DataFrame, classes: int, **options: int) -> DataFrame:
    """Trees over sub-windows with their image's class_idx. ML-05, ML-18, JOB-02."""
    rows = windows.join(images.select("image_id", F.col("class_idx").alias("label")), "image_id").select(_window_id(), "label", "features")
    return learners.fit_trees(rows, classes=classes, **options)


def _window_id() -> Column:
    return F.concat_ws("/", "image_id", "sw").alias("sample_id")


def classify_windows(windows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(image_id, class_idx, p): the mean over windows of the trees' means. ML-05, AGG-01, AGG-22, JOB-03."""
    means = learners.predict_mean(learners.apply_trees(windows.select(_window_id(), "features"), nodes))
    rows = means.select(F.split("sample_id", "/")[0].cast("long").alias("image_id"), F.split("sample_id", "/")[1].cast("int").alias("sw"), F.posexplode("value").alias("class_idx", "p"))
    return evaluation.best_class(evaluation.soft_votes(rows))


def validated(annotations: DataFrame, pixels: DataFrame, classes: int, folds: int, n: int = 100, least: float = 0.1, most: float = 1.0, size: int = 24, space: int = 2, seed: int = 0, **options: int) -> tuple[DataFrame, DataFrame]:
    """(predictions, rates) of annotations (annotation_id, image_id, box, class_idx) by cross-validation. JOB-01.

    Each annotation's crop gives n windows; the trees of the other folds classify them, and the mean over its windows its
    class. predictions: image_id (the annotation), label, fold, pred, p; rates as evaluation.recognition gives them.
    """
    crops = spatial.crops(annotations.select("annotation_id", "image_id", "x0", "y0", "w", "h"), pixels).drop("image_id").withColumnRenamed("annotation_id", "image_id")
    images = annotations.select(F.col("annotation_id").alias("image_id"), F.col("w").alias("width"), F.col("h").alias("height"), "class_idx")
    windows = cut(window_vectors(images, crops, n, least, most, size, space, seed))
    dealt = cut(evaluation.stratified_folds(images.withColumn("label", F.col("class_idx")), folds, "image_id").select("image_id", "class_idx", "fold"))
    out = None
    for fold in range(folds):
        train, test = dealt.filter(F.col("fold") != fold), dealt.filter(F.col("fold") == fold)
        nodes = fit_windows(train, windows.join(train.select("image_id"), "image_id", "left_semi"), classes, **options)
        found = classify_windows(windows.join(test.select("image_id"), "image_id", "left_semi"), nodes)
        part = test.withColumnRenamed("class_idx", "label").join(found.withColumnRenamed("class_idx", "pred"), "image_id")
        out = part if out is None else out.unionByName(part)
    out = cut(out)
    return out, evaluation.recognition(out.select("label", "pred"))


def count_in_rois(objects: DataFrame, rois: DataFrame) -> DataFrame:
    """Objects (image_id, first_y, first_x, box) counted per region of interest. AGG-15."""
    boxes = objects.select("image_id", F.xxhash64("image_id", "first_y", "first_x").alias("annotation_id"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("right") - F.col("left") + 1).alias("w"), (F.col("bottom") - F.col("top") + 1).alias("h"))
    return spatial.roi_counts(boxes, rois)


def landmark_positions(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, term_id, x, y) of annotations (annotation_id, image_id, terms, wkt): the point, or the centroid of the
    polygon's outer ring, in whole numbers and from the top. Of several for a term of an image the one of the largest id
    counts; those without a term, or of an image that isn't listed, have no row. FIL-18, FUN-07, FUN-08.
    images: image_id, height."""
    one = marks.first_term(annotations).join(images.select("image_id", "height"), "image_id")
    found = geometry.numbers(F.col("wkt"))
    cx, cy = geometry.centroid(geometry.rings(F.col("wkt"))[0])
    point = F.col("wkt").startswith("POINT")
    at = one.select("image_id", "term_id", "annotation_id", F.when(point, F.element_at(found, 1).cast("int")).otherwise(cx).alias("x"), geometry.flipped(F.when(point, F.element_at(found, 2).cast("int")).otherwise(cy), F.col("height")).alias("y"))
    return at.groupBy("image_id", "term_id").agg(F.max_by(F.struct("x", "y"), "annotation_id").alias("p")).select("image_id", "term_id", "p.x", "p.y")


def export_landmarks(annotations: DataFrame, images: DataFrame, terms: DataFrame, path: str) -> None:
    """Reviewed landmarks of a project as one CSV line per image, with the names of the terms that occur, in order of their
    ids. JOB-12. images: image_id, height; terms: term_id, name (an ontology: its names go through the driver)."""
    found = landmark_positions(marks.select(annotations, reviewed_only=True).join(images.select("image_id"), "image_id", "left_semi"), images)
    used = terms.join(found.select("term_id").distinct(), "term_id", "left_semi").orderBy("term_id").collect()
    sinks.landmark_csv(found, {r["term_id"]: r["name"] for r in used}, path, images)
