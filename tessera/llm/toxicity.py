"""Toxicity by two class-conditional Kneser-Ney models, one of toxic and one of ordinary texts.

The models spell words: each character of a word is predicted from those before it. A class has counts of its own for
the longest contexts; below them both classes share the continuation counts of shorter ones. So an expression that is
rare has nearly the same probability in both, and a stem that toxic texts have in many forms is known in all of them.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import chunks, fold, mixed, written

#: At most so many labelled rows of each class are read for the fit; which ones, a hash of doc_id decides.
MAX_LABELLED = 10_000
#: Characters of context: of the counts that each class has for itself, and of those that both share.
OWN, SHARED = 9, (4, 1, 0)
#: The features of a text: the mean log ratio of its words; the mean of the largest ones of so many different words; and
#: the logarithm of how many different words it has, as the largest of more words is larger by chance alone.
STRONGEST = 3
FEATURES = ("mean", "strongest", "size")
#: A model of up to so many entries (12 bytes each) is sent to the executors; texts are joined with a larger one.
LARGEST_SENT = 6_000_000
BASE = 0x9E3779B97F4A7C15


class Model(NamedTuple):
    """Log ratios toxic : ordinary of n-grams, and of contexts for the characters that aren't known after them."""

    entries: DataFrame  # key, ratio: of an n-gram, or of a context (with key's lowest bit 1, that of n-grams is 0)
    weights: tuple[float, float, float, float]  # of 1 and FEATURES
    sent: object | None  # the broadcast entries; None where they are too many


def tokens(text: bytes) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [w.strip(string.punctuation) or w for w in text.decode("utf-8", "replace").lower().split()]


def spelled(words: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(word, character, [(n-gram key, context key), ...]): for each character of the words and the end of each, the 64-bit
    hashes of the character with up to so many characters before it, the start being one, and of the latter alone."""
    text = "".join(f"\x01{w}\x02" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(code)) - np.repeat(starts, lengths)
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(len(code) + 1, BASE, np.uint64))
        down = np.multiply.accumulate(np.full(len(code), inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * down, dtype=np.uint64)])  # sums[i]: of the first i
        at = np.flatnonzero(place > 0)
        keys = []
        for k in sizes:
            first = at - np.minimum(place[at], k)
            gram = mixed((sums[at + 1] - sums[first]) * up[at])
            context = mixed((sums[at] - sums[first]) * up[at] + np.uint64(k))
            keys.append((gram & ~np.uint64(1), context | np.uint64(1)))
    return word[at], code[at], keys


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n0, n1): in how many ordinary and toxic texts a word is. What one text repeats counts once."""
    for batch, texts in chunks(batches):
        toxic = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
        found: dict[str, list[int]] = {}
        for label, text in zip(toxic, texts, strict=True):
            for w in set(tokens(text)):
                found.setdefault(w, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([n[c] for n in found.values()], pa.int64()) for c in (0, 1))], names=["word", "n0", "n1"])


GRAM = "gram long, ctx long, gram1 long, ctx1 long, gram2 long, ctx2 long, gram3 long"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of words: keys at every level, with the counts of the word."""
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            part = batch.slice(start, 20_000)
            word, _, keys = spelled(part.column(0).to_pylist(), (OWN, *SHARED))
            flat = [x.view(np.int64) for pair in keys for x in pair][:7]
            yield pa.RecordBatch.from_arrays([*map(pa.array, flat), *(pa.array(part.column(c).to_numpy()[word]) for c in (1, 2))], names=[*(f.split()[0] for f in GRAM.split(", ")), "n0", "n1"])


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxic, checks): at most max_labelled rows of each class, none with fold 0; a quarter of them, fold 4, checks
    the models that the others give. A doc_id with both labels counts as toxic."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold("doc_id") != 0)
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = [one.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for c in (0, 1)]
    return part[0].unionByName(part[1]).withColumn("checks", fold("doc_id") == 4)


def discount(ones: float, twos: float) -> float:
    """The Kneser-Ney discount, from how many counts are 1 and how many are 2."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def _discounts(counts: DataFrame, columns: list[str]) -> list[float]:
    row = counts.agg(*(F.count_if(F.col(c) == n) for c in columns for n in (1, 2))).first()
    return [discount(row[2 * i], row[2 * i + 1]) for i in range(len(columns))]


def _interpolated(n: Column, total: Column, types: Column, d: float, lower: Column) -> Column:
    """(max(n - d, 0) + d * types * lower) / total; lower where the context was never seen."""
    return F.when(total > 0, (F.greatest(n - d, F.lit(0.0)) + d * types * lower) / total).otherwise(lower)


def ratios(top: DataFrame) -> DataFrame:
    """(key, ratio) of n-grams and contexts, from top: the keys of GRAM with the counts n0, n1 of both classes.

    A class's model: its own discounted counts of the longest n-grams, and beyond them the shared model. The shared model
    is Kneser-Ney too: a shorter n-gram counts as often as there are different longer ones, of either class, that end in it.
    """
    c1 = top.groupBy("gram1", "ctx1", "gram2", "ctx2", "gram3").agg(F.count("*").alias("c"))
    c2 = c1.groupBy("gram2", "ctx2", "gram3").agg(F.count("*").alias("c"))
    c3 = c2.groupBy("gram3").agg(F.count("*").alias("c"))
    total = c3.agg(F.sum("c")).first()[0] or 1
    lower = c3.select("gram3", (F.col("c") / float(total)).alias("lower"))
    for level, (counts, below) in enumerate(((c2, "gram3"), (c1, "gram2"))):
        gram, ctx = (("gram2", "ctx2"), ("gram1", "ctx1"))[level]
        sums = counts.groupBy(ctx).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        p = _interpolated(F.col("c"), F.col("total"), F.col("types"), _discounts(counts, ["c"])[0], F.col("lower"))
        lower = written(counts.join(sums, ctx).join(lower, below).select(gram, p.alias("lower")), f"toxic-shared-{level}")
    d = _discounts(top, ["n0", "n1"])
    ctx = top.groupBy("ctx").agg(*(f(c).alias(f"{name}{c[1]}") for c in ("n0", "n1") for name, f in (("total", F.sum), ("types", lambda c: F.count_if(F.col(c) > 0)))))
    joined = top.join(ctx, "ctx").join(lower, "gram1")
    p = [_interpolated(F.col(f"n{c}"), F.col(f"total{c}"), F.col(f"types{c}"), d[c], F.col("lower")) for c in (0, 1)]
    rest = [F.when(F.col(f"total{c}") > 0, d[c] * F.col(f"types{c}") / F.col(f"total{c}")).otherwise(1.0) for c in (0, 1)]
    of = lambda key, x: (F.col(key).alias("key"), F.log(x[1] / x[0]).cast("float").alias("ratio"))
    return joined.select(*of("gram", p)).unionByName(ctx.select(*of("ctx", rest)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, largest_sent: int = LARGEST_SENT) -> Model:
    """Fit on a bounded sample of labelled rows; all counts are Spark tables, and no n-gram is left out.

    Of a doc_id that several rows have, the least text counts; equal texts count once, as toxic if any of them is.
    """
    sample = labelled_sample(labels, max_labelled)
    # at most 2 * max_labelled ids: a broadcast of proven size, so texts are not shuffled
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("checks").alias("checks"))
    texts = written(one.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("checks").alias("checks")), "toxic-labelled")
    words = texts.filter(~F.col("checks")).select("toxic", "text").mapInArrow(_words, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    keys = [f.split()[0] for f in GRAM.split(", ")]
    top = written(words.mapInArrow(_grams, f"{GRAM}, n0 long, n1 long").groupBy(*keys).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-grams")
    entries = written(ratios(top), "toxic-ratios")
    model = Model(entries, (0.0,) * 4, _sent(entries) if entries.count() <= largest_sent else None)
    return model._replace(weights=_calibrated(model, texts.filter("checks").select("toxic", "text"), labels))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(batch.column(i).to_numpy()).tobytes()], pa.binary()) for i in (0, 1)], names=["key", "ratio"])


def _sent(entries: DataFrame) -> object:
    """Keys and ratios for every executor; LARGEST_SENT bounds them."""
    parts = entries.mapInArrow(_packed, "key binary, ratio binary").toArrow()
    keys, values = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in parts.column(c))]) for c, kind in (("key", np.uint64), ("ratio", np.float32)))
    order = np.argsort(keys)
    return entries.sparkSession.sparkContext.broadcast((keys[order], values[order]))


class Table:
    """The entries of a model, sorted by key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def get(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, found), by key."""
        one, back = np.unique(asked, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, one), max(len(self.keys) - 1, 0))
        found = self.keys[at] == one if len(self.keys) else np.zeros(len(one), bool)
        return np.where(found, self.values[at] if len(self.keys) else 0, 0)[back], found[back]

    def ratios(self, words: list[str]) -> np.ndarray:
        """ln of the probability of each word among toxic words to that among ordinary ones."""
        out = []
        for start in range(0, len(words), 20_000):  # so that what is computed per character stays small
            part = words[start : start + 20_000]
            word, _, [(gram, context)] = spelled(part, (OWN,))
            ratio, found = self.get(gram)
            ratio[~found] = self.get(context[~found])[0]
            out.append(np.bincount(word, weights=ratio, minlength=len(part)))
        return np.concatenate(out)


def features(lengths: np.ndarray, ids: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean log ratio of the words, mean of the largest STRONGEST of different words, ln(1 + different words)) by text; ids
    are the texts' words. With fewer words than STRONGEST the mean is of those; without any all three are 0."""
    docs = np.repeat(np.arange(len(lengths)), lengths)
    mean = np.bincount(docs, weights=ratio[ids], minlength=len(lengths)) / np.maximum(lengths, 1)
    once = np.unique(docs * max(len(ratio), 1) + ids)
    doc, r = once // max(len(ratio), 1), ratio[once % max(len(ratio), 1)] if len(ratio) else np.zeros(0)
    order = np.lexsort((-r, doc))
    doc, r = doc[order], r[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    different = np.bincount(doc, minlength=len(lengths))
    strongest = np.bincount(doc[rank < STRONGEST], weights=r[rank < STRONGEST], minlength=len(lengths)) / np.clip(different, 1, STRONGEST)
    return mean, strongest, np.log1p(different)


def _split(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, number of words by text, the words of all texts as places in the first)."""
    index: dict[str, int] = {}
    split = [[index.setdefault(w, len(index)) for w in tokens(t)] for t in texts]
    return list(index), np.array([len(w) for w in split], np.int64), np.fromiter((i for w in split for i in w), np.int64)


def _featured(table: object, keep_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(*table.value)
        for batch, texts in chunks(batches):
            words, lengths, ids = _split(texts)
            found = features(lengths, ids, t.ratios(words) if words else np.zeros(0))
            n = len(batch.columns) - (not keep_text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *map(pa.array, found)], names=[*batch.schema.names[:n], *FEATURES])

    return apply


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, word, n, gram, context): the characters of the different words of each text; n: how often the text has the word."""
    for batch, texts in chunks(batches):
        for row, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            words, _, ids = _split([text])
            if words:
                word, _, [(gram, context)] = spelled(words, (OWN,))
                n = np.bincount(ids, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(word), pa.string()), *(pa.array(x) for x in (word, n[word], gram.view(np.int64), context.view(np.int64)))], names=["row", "word", "n", "gram", "ctx"])


def _joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The features by joins, where the model is too large to be sent: rows has a unique column row, and text."""
    asked = rows.select("row", "text").mapInArrow(_asked, "row string, word long, n long, gram long, ctx long")
    of = lambda key, name: entries.select(F.col("key").alias(key), F.col("ratio").alias(name))
    known = asked.join(of("gram", "own"), "gram", "left").join(of("ctx", "rest"), "ctx", "left")
    words = known.groupBy("row", "word").agg(F.max("n").alias("n"), F.sum(F.coalesce("own", "rest", F.lit(0.0)).cast("double")).alias("r"))
    largest = F.slice(F.sort_array(F.collect_list("r"), asc=False), 1, STRONGEST)  # of one text's words
    strongest = F.aggregate(largest, F.lit(0.0), lambda a, x: a + x) / F.least(F.count("*"), F.lit(STRONGEST))
    by_row = words.groupBy("row").agg((F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("mean"), strongest.alias("strongest"), F.log1p(F.count("*")).alias("size"))
    return rows.join(by_row, "row", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in FEATURES})


def _with_features(rows: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """rows, whose last column is text, with FEATURES behind it or in its place."""
    kept = rows.schema.fields[: None if keep_text else -1]
    if model.sent is None:
        found = _joined(written(rows.withColumn("row", F.expr("uuid()")), "toxic-rows"), model.entries)
        return found.select(*(f.name for f in kept), *FEATURES)
    return rows.mapInArrow(_featured(model.sent, keep_text), T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for c in FEATURES)]))


def _calibrated(model: Model, rows: DataFrame, labels: DataFrame) -> tuple[float, float, float, float]:
    """Weights of a logistic function, by Newton steps over the checking rows (2 * MAX_LABELLED at most); classes weigh as
    in all labels of the fit. Its constant is chosen so that 0.5 is where these rows have their largest F1 score."""
    found = _with_features(rows, model).collect()
    share = labels.filter("toxic IN (0, 1)").filter(fold("doc_id") != 0).agg(F.avg("toxic")).first()[0]
    share = 0.1 if share is None else min(max(share, 1e-4), 1 - 1e-4)
    y = np.array([r["toxic"] for r in found], float)
    if not 0 < y.sum() < len(y):
        return float(np.log(share / (1 - share))), 0.0, 0.0, 0.0
    x = np.array([[1.0, *(r[c] for c in FEATURES)] for r in found])
    scale = np.array([1.0, *np.maximum(x[:, 1:].std(axis=0), 1e-9)])
    x, w, ridge = x / scale, np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0]), np.array([1e-6, 0.1, 0.1, 0.1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge @ w**2 / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    w[0] -= best_cut(x @ w, y, weight)
    return tuple(float(v) for v in w / scale)


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle between the two neighbouring values of z that part the classes with the largest F1 score."""
    order = np.lexsort((y, -z))
    z, y, weight = z[order], y[order], weight[order]
    last = np.r_[np.diff(z) != 0, True]  # equal values are on one side
    f1 = np.where(last, 2 * np.cumsum(weight * y) / (np.cumsum(weight) + weight @ y), -1)
    k = int(np.argmax(f1))
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", keep_text: bool = False) -> DataFrame:
    """docs with a column `into` (0 to 1, higher: likelier toxic) at the end, and without the column text unless keep_text.

    Each text is judged alone, whole, so repeated rows score alike; an empty table gives an empty result. Null and empty texts have the score of a text whose words tell nothing. A column
    `into` that docs has already is replaced; all other columns stay, whatever their names.
    """
    plain = docs.drop(into) if into != text else docs
    others = [c for c in plain.columns if c != text]
    found = _with_features(plain.select(*others, F.col(text).cast("string")).toDF(*(f"c{i}" for i in range(len(others))), "text"), model, keep_text)
    w = [F.lit(x) for x in model.weights]
    z = sum((w[1 + i] * F.col(c) for i, c in enumerate(FEATURES)), w[0])
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(others)] + [F.col("text").alias(text)] * keep_text
    scored = found.select(*named, (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))).alias(into))
    return scored.select(*(c for c in plain.columns if c != text or keep_text), into)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **fit_options: object) -> DataFrame:
    """One row per row of docs: doc_id, held_out (crc32 of the id as text is 0 modulo 5), score, predicted (score >= 0.5).

    Labels of held-out rows are never read. Only the text gives the score. Null texts count as empty, null ids stay
    null; repeated rows score alike; without any labels of both classes all rows score the share of toxic labels (0.1
    without labels). Extra columns of docs are not read.
    """
    model = fit(docs, labels, doc_id, text, **fit_options)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), fold(doc_id).eqNullSafe(0).alias("held_out"), F.col(text).cast("string").alias("text"))
    return score(narrow, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
