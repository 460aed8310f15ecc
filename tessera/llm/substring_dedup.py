"""Substring dedup by seed and extend: winnowed anchors join documents, matches are extended both ways around them, and
the maximal repeats of a minimum length are removed wherever a document with a smaller id has them too."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WordHashes, chunks, rolling

#: A repeat has this many words at least; an anchor has K words, so every window of REPEAT words holds REPEAT-K+1 of them.
REPEAT, ANCHOR = 13, 6
#: An anchor of more documents than this is hot: its windows are dealt out over as many tasks as the root of their number.
HOT = 256


def selected(anchors: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` consecutive anchors the place of its minimum, the rightmost of equal ones.

    It depends on the window's content alone: equal windows select at equal offsets.
    """
    n = len(anchors) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = anchors[:n].copy(), np.arange(n)
    for j in range(1, width):
        later = anchors[j : j + n]
        less = later <= best
        best[less] = later[less]
        at[less] = np.flatnonzero(less) + j
    return at


def _anchors(repeat: int, k: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch, texts in chunks(batches):
            hashes, counts = [], []
            for t in texts:
                a = rolling(known.of(t.split()), k)
                found = np.unique(a[np.unique(selected(a, repeat - k + 1))])  # once per document
                hashes.append(found)
                counts.append(len(found))
            rows = np.repeat(np.arange(len(texts)), counts)
            anchor = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(anchor)], names=["doc_id", "anchor"])

    return apply


def _extensions(repeat: int, k: int):
    """Extends each seed both ways, over all the windows that selected it: (anchor, fingerprints of those windows, place).
    salt: 0, or of hot anchors one of as many as they have been given, by document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch, texts in chunks(batches):
            seeds, hot = (batch.column(batch.schema.get_field_index(c)) for c in ("seeds", "hot"))
            numbers = [xxhash.xxh3_64_intdigest(str(x)) for x in batch.column(0).to_pylist()]
            owner, anchor, salt, place, sizes, prints = [], [], [], [], [], []
            for i, t in enumerate(texts):
                h = known.of(t.split())
                a = rolling(h, k)
                at = selected(a, repeat - k + 1)
                hit = np.flatnonzero(np.isin(a[at], np.asarray(seeds[i].values).view(np.uint64)))
                if not len(hit):
                    continue
                # windows that follow each other and selected one anchor make up one row
                first = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(at[hit]) != 0)])
                owner.append(np.full(len(first), i))
                anchor.append(a[at[hit[first]]])
                salts = {np.int64(x["anchor"]).astype(np.uint64): x["salts"] for x in hot[i].as_py()}
                salt.append(np.array([1 + numbers[i] % salts[x] if x in salts else 0 for x in anchor[-1]], np.int32) if salts else np.zeros(len(first), np.int32))
                place.append((np.int64(zlib.crc32(t)) << 31) + hit[first])
                sizes.append(np.diff(np.r_[first, len(hit)]))
                prints.append(rolling(h, repeat)[hit])
            cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            offsets = np.r_[0, np.cumsum(cat(sizes, np.int64))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat(anchor, np.uint64).view(np.int64)), pa.array(cat(salt, np.int32)), batch.column(0).take(pa.array(cat(owner, np.int64))), pa.array(cat(place, np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cat(prints, np.uint64).view(np.int64)))],
                names=["anchor", "salt", "doc_id", "place", "prints"],
            )

    return apply


def seeds(docs: DataFrame, repeat: int = REPEAT, k: int = ANCHOR) -> DataFrame:
    """(doc_id, seeds, hot): the anchors of a document that another document has too; hot ones with their number of salts.

    A window aggregate finds the smallest and largest document of each anchor in one shuffle. An anchor comes once per
    document, so however common it is, it is a small part of the rows; Spark sorts and spills it, nothing is collected.
    """
    anchors = docs.select("doc_id", "text").mapInArrow(_anchors(repeat, k), "doc_id long, anchor long")
    same = Window.partitionBy("anchor")
    shared = anchors.withColumns({"first": F.min("doc_id").over(same), "last": F.max("doc_id").over(same), "n": F.count("*").over(same)}).filter("first < last")
    hot = F.when(F.col("n") > HOT, F.struct("anchor", F.ceil(F.sqrt("n")).cast("int").alias("salts")))
    return shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("seeds"), F.collect_set(hot).alias("hot"))


def repeats(docs: DataFrame, repeat: int = REPEAT, k: int = ANCHOR) -> DataFrame:
    """(doc_id, places): the windows of a document that a document with a smaller id has too.

    docs has doc_id (not null) and text. A place is a window's start, plus a checksum of the text that tells texts of one
    doc_id apart. Windows are equal if their anchors and their fingerprints are. Consecutive starts make up one maximal
    repeat: a match grows through the windows of neighbouring anchors.
    """
    seeded = docs.join(seeds(docs, repeat, k), "doc_id")
    extended = seeded.select("doc_id", "text", "seeds", "hot").mapInArrow(_extensions(repeat, k), "anchor long, salt int, doc_id long, place long, prints array<long>")
    # dealt out by anchor as short lists of windows; what is exploded after that stays in its task
    windows = extended.repartition("anchor", "salt").select("anchor", "salt", "doc_id", "place", F.posexplode("prints").alias("i", "print"))
    first = F.min("doc_id").over(Window.partitionBy("anchor", "salt", "print"))
    placed = windows.withColumn("first", first).select("anchor", "salt", "print", "doc_id", "first", (F.col("place") + F.col("i")).alias("at"))
    # of a hot anchor's windows, those that are first under their salt meet once more; the condition is one that can't be
    # tested before the window, so both branches read the same exchange
    winners = placed.filter("CASE WHEN doc_id = first THEN salt ELSE 0 END > 0").drop("first").withColumn("first", F.min("doc_id").over(Window.partitionBy("anchor", "print")))
    later = placed.filter("doc_id > first").select("doc_id", "at").unionByName(winners.filter("doc_id > first").select("doc_id", "at"))
    return later.groupBy("doc_id").agg(F.collect_set("at").alias("places"))


def _kept(repeat: int, keep_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            places = batch.column(batch.schema.get_field_index("places"))
            n_words, n_removed, n_repeats, digest, kept_texts = [], [], [], [], []
            for i, t in enumerate(texts):
                words = t.split()
                spots = np.zeros(0, np.int64)
                if places[i].is_valid:
                    found = np.asarray(places[i].values)
                    spots = np.sort(found[found >> 31 == zlib.crc32(t)] & 0x7FFFFFFF)
                n_repeats.append(0)
                if len(spots):
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, spots, 1)
                    np.add.at(gone, spots + repeat, -1)
                    gone = np.cumsum(gone[: len(words)]) > 0
                    n_repeats[-1] = 1 + int(np.count_nonzero(np.diff(spots) > repeat))
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_repeats, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "n_repeats", "kept_sha256", "kept_text"],
            )

    return apply


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat: int = REPEAT, k: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, n_repeats, kept_sha256, kept_text (null unless keep_text).

    A word goes if a window of `repeat` consecutive words covers it whose word sequence also starts in a document with a
    smaller doc_id. Windows are judged on the input. Words are split at white space and compared as they are, by 64-bit
    fingerprints of the window and of its anchor.

    Every window selects one of its anchors by content, so windows that are equal share an anchor at the same offset:
    extending the shared anchors over the windows that selected them finds every repeat. Null texts have no words; rows
    of one doc_id never remove each other's words, and each is judged alone; rows with a null id are kept whole and
    remove nothing; an empty table gives an empty result; other columns are not read.
    """
    if not 1 <= k <= repeat:
        raise ValueError("an anchor can't be longer than a repeat")
    rows = docs.select(doc_id, text)
    if rows.dtypes != [("doc_id", "bigint"), ("text", "string")]:
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    found = repeats(known, repeat, k)
    # both joins deal texts out by doc_id alone, so Spark shuffles them once and reads that exchange twice
    marked = known.join(found, "doc_id", "left").select("doc_id", "text", "places")
    nameless = rows.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("array<long>").alias("places"))
    return marked.unionByName(nameless).mapInArrow(_kept(repeat, keep_text), "doc_id long, n_words long, n_removed long, n_repeats long, kept_sha256 string, kept_text string")
