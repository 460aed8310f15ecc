"""Images, landmark files and metadata as tables: SRC-01 to SRC-07, SRC-12, SRC-13, SRC-17 to SRC-19, UDF-07."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = "image_id long, project_id long, width int, height int, resolution double, magnification int, filename string"
TERMS = "term_id long, project_id long, name string"
LANDMARKS = "term_id int, x int, y int, xr double, yr double"


def labelled_directory(spark: SparkSession, folder: str, class_map: DataFrame | None = None) -> DataFrame:
    """(path, label, width, height, channels, data) of <folder>/<class>/<file>; files that aren't images are left out.
    SRC-01. class_map (label, cls) gives other classes, and leaves out labels that it doesn't list. SRC-02."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    out = images.select(F.col("image.origin").alias("path"), F.regexp_extract("image.origin", r"([^/]+)/[^/]+$", 1).alias("label"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return out if class_map is None else out.join(class_map, "label").drop("label").withColumnRenamed("cls", "label")


def pixels(images: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, r, g, b): the bytes of an image, stored as blue, green, red (and alpha) by rows. SRC-18."""
    at = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * F.col("channels") + F.lit(k + 1), F.lit(1))), 16, 10).cast("int")
    each = images.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    gray = F.col("channels") == 1
    return each.select(*keys, (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *(F.when(gray, at(0)).otherwise(at(k)).alias(c) for c, k in (("r", 2), ("g", 1), ("b", 0))))


def standardised(pixel_rows: DataFrame, key: str, gray: Column | None = None) -> DataFrame:
    """Grey values less their image's mean, by its population deviation (0 where that is 0). SRC-04, WIN-11."""
    w = Window.partitionBy(key)
    value = pixel_rows.withColumn("v", (F.round(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114) if gray is None else gray).cast("double"))
    spread = F.stddev_pop("v").over(w)
    return value.withColumn("v", F.when(spread > 0, (F.col("v") - F.avg("v").over(w)) / spread).otherwise(F.lit(0.0))).select(key, "x", "y", "v")


def landmark_files(spark: SparkSession, folder: str, term: int | None = None) -> DataFrame:
    """(image_id, term_id, x, y, xr, yr) of text files named by image, a line per landmark. SRC-05."""
    rows = spark.read.schema(LANDMARKS).option("sep", " ").csv(folder).withColumn("image_id", F.regexp_extract(F.input_file_name(), r"([0-9]+)\.txt$", 1).cast("long"))
    rows = rows.select("image_id", "term_id", "x", "y", "xr", "yr")
    return rows if term is None else rows.filter(F.col("term_id") == term)


def for_images(images: DataFrame, landmarks: DataFrame, term: int, missing: int | None = None) -> DataFrame:
    """One row per image for one term; null, or `missing`, where it has none. SRC-06."""
    out = images.select("image_id").join(landmarks.filter(F.col("term_id") == term).drop("term_id"), "image_id", "left")
    return out if missing is None else out.fillna(missing, ["x", "y", "xr", "yr"])


def checked_tiles(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole tiles, others): a tile holds w * h pixels of its channels. SRC-17, UDF-07."""
    whole = F.octet_length("data") == F.col("w") * F.col("h") * F.col("channels")
    return tiles.filter(whole), tiles.filter(~whole | whole.isNull())


def once(crops: DataFrame) -> DataFrame:
    """Each crop once, by image, place, size and mask. SRC-19."""
    return crops.dropDuplicates([c for c in ("image_id", "x0", "y0", "w", "h", "alpha") if c in crops.columns])


def _records(spark: SparkSession, path: str, schema: str, project: int | None, kind: str, **options: str) -> DataFrame:
    table = spark.read.schema(schema).options(**options).format(kind).load(path)
    return table if project is None else table.filter(F.col("project_id") == project)


def image_metadata(spark: SparkSession, path: str, project: int | None = None, kind: str = "parquet", **options: str) -> DataFrame:
    """Images of a project with the columns of IMAGES, from Parquet, CSV or JSON; what a file lacks is null. SRC-12."""
    return _records(spark, path, IMAGES, project, kind, **options)


def ontology(spark: SparkSession, path: str, project: int | None = None, kind: str = "parquet", **options: str) -> DataFrame:
    """Terms of a project with the columns of TERMS, in order of their ids. SRC-13, SRT-03."""
    return _records(spark, path, TERMS, project, kind, **options).orderBy("term_id")


def crops_and_failures(spark: SparkSession, folder: str, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(crops: path, name, width, height, channels, data; failures: path, name, bytes, reason) of all files of a folder. UDF-07.

    Files are listed as binary, of which the bytes aren't read, and decoded by the image source, which keeps what it can't
    decode. Each file is in one of the tables; reasons are: not an image, and with sizes (name, w, h: the crops that were
    asked for) another size, or missing. Spark doesn't list files without bytes, so they are missing too. Names that
    sizes doesn't list may have any size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(_place(F.col("path")).alias("_at"), "path", F.col("length").alias("bytes"))
    image = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    decoded = image.select(_place(F.try_url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))).alias("_at"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    both = files.join(decoded, "_at", "left").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    odd = F.lit(False)
    if sizes is not None:
        both = both.join(sizes.select("name", "w", "h"), "name", "full")
        odd = (F.col("w") != F.col("width")) | (F.col("h") != F.col("height"))
    reason = F.when(F.col("path").isNull(), "missing").when(F.coalesce(F.col("height"), F.lit(-1)) < 1, "not an image").when(odd, F.concat(F.lit("size "), F.concat_ws("x", "width", "height")))
    told = both.withColumn("reason", reason)
    return told.filter("reason IS NULL").select("path", "name", "width", "height", "channels", "data"), told.filter("reason IS NOT NULL").select("path", "name", "bytes", "reason")


def _place(path: Column) -> Column:
    """A file's path without its scheme, which the two sources write differently; the image source also escapes it."""
    return F.regexp_replace(path, r"^[a-z0-9]+:/*", "/")
