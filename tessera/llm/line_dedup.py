"""Line dedup by winnowing over line hashes. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import WHITE_SPACE, written

#: A run of this many lines that comes again later goes; every such run holds a fingerprint.
RUN = 3
#: So does a shorter run, of one line too, that has this many words or more.
LONG_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _content(text: Column) -> Column:
    """The lines that count, as they compare: without white space at both ends, empty ones left out."""
    trimmed = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def _window_rows(docs: DataFrame, run: int, long_words: int | None) -> DataFrame:
    """One row per window: of `run` lines, and of fewer that have long_words words or more (none if that is null). It has
    its number of lines, its fingerprint (the least line hash in it), start, the place of that line, and two digests of the lines."""
    n_words = F.transform("lines", lambda x: F.size(F.split(x, WHITE_SPACE))) if long_words is not None else F.lit(None)
    hashed = docs.select("doc_id", "copy", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), n_words.alias("n_words"))
    count = F.size("lines")

    def windows(size: int) -> Column:
        starts = F.when(count >= size, F.sequence(F.lit(1), count - (size - 1))).otherwise(F.array().cast("array<int>"))
        if size < run:
            starts = F.filter(starts, lambda i: F.aggregate(F.slice("n_words", i, size), F.lit(0), lambda a, x: a + x) >= long_words)
        part = lambda i: F.slice("hashes", i, size)
        return F.transform(starts, lambda i: F.struct(
            F.lit(size).alias("size"), i.alias("start"), F.array_min(part(i)).alias("mark"), (i + F.array_position(part(i), F.array_min(part(i)))).alias("at"), F.xxhash64(part(i)).alias("content_a"), F.hash(F.slice("lines", i, size)).alias("content_b"),
        ))

    sizes = [run] if long_words is None else range(1, run + 1)
    return hashed.select("doc_id", "copy", F.explode(F.concat(*map(windows, sizes))).alias("w")).select("doc_id", "copy", "w.*")


def repeated_runs(docs: DataFrame, run: int = RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(doc_id, copy, starts): windows (start, size) that were found before, docs having doc_id, copy, lines.

    1. Winnowing: the fingerprints of a document are the minima of its windows. Those of one document only are dropped
       after one shuffle of (document, fingerprint, place).
    2. Extend: around a fingerprint that is found again, the windows that selected it say how far the match goes to both
       sides. Their contents are compared, by 96 bits of hashes, and the first place of each is the one that stays.
    Windows of different numbers of lines are not compared.
    """
    windows = written(_window_rows(docs, run, long_words), "line-windows")
    place, order = F.struct("doc_id", "copy", "at"), F.struct("doc_id", "copy", "start")
    # minima and maxima are combined before the shuffle, however common a line is; joins may be split by their left side
    mark, content = ["mark", "size"], ["mark", "size", "content_a", "content_b"]
    found = windows.groupBy(*mark).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select(*mark)
    seeds = windows.join(found, mark).select("doc_id", "copy", "start", *content)
    same = seeds.groupBy(*content).agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first < last").drop("last")
    apart = (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.copy") != F.col("copy")) | (F.col("start") - F.col("first.start") >= F.col("size"))
    return seeds.join(same, content).filter(apart).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "size")).alias("starts"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, long_words: int | None = LONG_WORDS, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, kept_sha256, kept_text (null unless keep_text).

    Lines are split at \\n, compared without white space at their ends, and lines without other characters don't count.
    A line goes if a window of `run` consecutive lines, or of fewer that have long_words words or more, covers it whose
    lines are also found, in that order, in an earlier window: one of a smaller doc_id, or one of the same text that
    ends before it starts. What stays is joined by \\n. With long_words None only windows of `run` lines count.

    Null texts have no lines; rows of one doc_id are told apart by their text (repeated rows with equal id and text are
    one document, and are judged alike); rows with a null id are kept whole and remove nothing; an empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).cast("string").alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    distinct = known.select("doc_id", "copy", _content(F.col("text")).alias("lines"))
    found = repeated_runs(distinct, run, long_words)
    marked = known.join(found, ["doc_id", "copy"], "left").select("doc_id", "text", "starts")
    marked = marked.unionByName(rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast(found.schema["starts"].dataType).alias("starts")))
    lines = marked.select("doc_id", _content(F.col("text")).alias("lines"), "starts")
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda w: F.sequence(w["start"], w["start"] + w["size"] - 1))))
    # the places that stay, by a hash of those that go: linear in the lines
    places = F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone")
    keep = F.when(F.col("starts").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.element_at("lines", i)))
    kept = lines.withColumn("gone", gone).withColumn("kept", keep)
    joined = F.array_join("kept", "\n")
    return kept.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.sha2(joined, 256).alias("kept_sha256"), (joined if keep_text else F.lit(None).cast("string")).alias("kept_text"),
    )
