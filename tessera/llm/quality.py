"""Quality rules: counts of each text, and repetition found in a suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import chunks

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
#: A repeated substring counts from this many words; it may cover this fraction of the words, and be this long.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.30, 100
#: So many doublings are kept for the common prefixes, enough for repeats of under 4,096 words.
LEVELS_KEPT = 13

RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()),
])
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _common_by_levels(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours in order, by trying the doublings from the largest down."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        # a rank of level k at the end of the whole array stands for fewer words than 2**k, and then it is unique
        a, b, common = a + (same << k), b + (same << k), common + (same << k)
    return common


def _common_by_place(keys: np.ndarray, rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The same in the order of the text, where a common prefix is at least the one before less one word (Kasai)."""
    n, h, common = len(order), 0, np.zeros(len(order) - 1, np.int64)
    word, place, suffix, out = memoryview(keys), memoryview(rank), memoryview(order), memoryview(common)
    for i in range(n):
        if place[i] == n - 1:
            h = 0
            continue
        j = suffix[place[i] + 1]
        most = n - max(i, j)
        while h < most and word[i + h] == word[j + h]:
            h += 1
        out[place[i]] = h
        h -= h > 0
    return common


def repeat_lengths(words: np.ndarray, docs: np.ndarray, levels_kept: int = LEVELS_KEPT) -> tuple[np.ndarray, np.ndarray]:
    """For every position the length of the longest word sequence from there that its own document has elsewhere too,
    and whether its REPEAT_WINDOW-word window is found twice or more.

    Prefix doubling ranks the suffixes by their first 1, 2, 4, ... words, until all ranks differ; ranks start from
    (document, word), so suffixes of two documents never share a prefix. The last order is the suffix array. The common
    prefixes of neighbours come from the doublings while there are few, and in one pass over the text where a repeat is so
    long that there are more than levels_kept: then earlier doublings are not kept, so memory is linear in the words. Both
    neighbours of a suffix bound an interval, and the longer of the two common prefixes is the longest repeat from there.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    keys = docs * (words.max() + 1) + words
    rank = _ranks(keys)
    levels = [rank.astype(np.int32)]
    h = 1
    while rank.max() < n - 1:
        later = np.zeros(n, np.int64)
        later[: n - h] = rank[h:] + 1
        rank = _ranks(rank * np.int64(n + 1) + later)
        h *= 2
        levels = [*levels, rank.astype(np.int32)] if levels and len(levels) < levels_kept else []
        if h > n:
            break
    order = np.argsort(rank, kind="stable")
    common = _common_by_levels(levels, order) if levels else _common_by_place(keys, rank, order)
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest, longest >= REPEAT_WINDOW


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n positions lies in the union of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:n]) > 0


def _rules(min_repeat: int, max_covered: float, max_longest: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            split = [t.split() for t in texts]
            counts = np.array([len(w) for w in split], np.int64)
            n = int(counts.sum())
            ids: dict[bytes, int] = {}
            words = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, n)
            docs = np.repeat(np.arange(len(texts)), counts)
            longest, again = repeat_lengths(words, docs)
            spots = np.flatnonzero(again)
            in_window = covered(spots, np.full(len(spots), REPEAT_WINDOW), n)
            spots = np.flatnonzero(longest >= min_repeat)
            in_repeat = covered(spots, longest[spots], n)
            per_doc = lambda x: np.bincount(docs, weights=x, minlength=len(texts)).astype(np.int64)
            most = np.zeros(len(texts), np.int64)
            np.maximum.at(most, docs, longest)
            repeat_words, cover = per_doc(in_window), per_doc(in_repeat)
            dup_lines = []
            for t in texts:
                lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
                dup_lines.append(len(lines) - len(set(lines)))
            failed = (counts < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * counts)
            good = (cover <= max_covered * counts) & (most <= max_longest)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array(counts), pa.array([len(t.translate(None, b" \t\n\r\x0b\x0c").decode()) for t in texts], pa.int64()),
                pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], pa.int64()), pa.array(dup_lines, pa.int64()), pa.array(repeat_words),
                pa.array(failed), pa.array(~failed & good), pa.array(cover), pa.array(most),
            ], schema=RESULT)

    return apply


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of docs: the base counts, and the verdict on repetition.

    base_failed: fewer than 50 words, or over half of the words lie in 3-word windows that the text has twice or more.
    kept: base_failed is false, the maximal repeated substrings of min_repeat words or more cover at most max_covered of
    the words (the union of their spans; the first occurrence counts), and the longest repeat has at most max_longest
    words. Repeats are those within one text.

    Null texts have no words and fail; null ids stay null; repeated rows are judged alike; an empty table gives an
    empty result. Each row is judged alone: there is no shuffle, and a lost executor costs its own tasks only.
    """
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(_rules(min_repeat, max_covered, max_longest), SCHEMA)
