"""N-gram Jaccard join by multiple-global-order filtering.

Two sets whose Jaccard similarity is 3/4 or more share a token within their prefixes (a quarter of each set) under any
order of all tokens. Order 1 puts tokens that are found very often last and is applied by a join; the pairs that pass
it must also pass orders 2 and 3 before their sets are compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shared import WordHashes, chunks, fresh, mixed, rolling, small_or_shuffled, written

SHINGLE = 5
#: 100 * intersection >= 75 * union, that is, 7 * intersection >= 3 * (sum of both sizes).
PERCENT = 75
#: Tokens listed as frequent go last in order 1: at most so many, with at least this count. Any list gives the same links.
MAX_FREQUENT, FREQUENT = 100_000, 32
#: Groups of up to this many classes with a prefix token give all their pairs; larger ones give pairs with one leader first.
GROUP = 48
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Columns of a sketch of the whole set: bit i says whether an odd number of tokens hash to i. The bits in which two sketches
#: differ are at most the tokens that are in one set alone, which are a seventh of both sizes at most if the sets link.
SKETCH = [f"s{i}" for i in range(8)]


def shingles(text: bytes, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the 5-word shingles; of the whole sequence when there are fewer words."""
    words = known.of(text.lower().split())
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(rolling(words, min(SHINGLE, len(words))))


def class_of(tokens: np.ndarray) -> int:
    """64-bit id of a set; rows with equal sets are one class."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) if len(tokens) else 0


def prefix_size(n: int | F.Column) -> int | F.Column:
    """Of two sets that are similar enough, the smallest floor(n/4)+1 tokens of each have one in common at least."""
    return n // 4 + 1 if isinstance(n, int) else F.floor(n / 4) + 1


def emitted_size(n: int | F.Column) -> int | F.Column:
    """The prefix and a reserve, for where tokens in it turn out to be in large groups and go last."""
    return min(n, n // 3 + 4) if isinstance(n, int) else F.least(n, F.floor(n / 3) + 4)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0, doc_id, size, class, key) by document, then (kind 1, token, count, -, -) for tokens met often in a task."""
    known, often = WordHashes(), Counter()
    names = ["kind", "a", "n", "v", "key"]
    for batch, texts in chunks(batches):
        sets = [shingles(t, known) for t in texts]
        once = {class_of(s): s for s in sets}
        if once:
            token, count = np.unique(np.concatenate(list(once.values())), return_counts=True)
            often.update(dict(zip(token[count > 2].view(np.int64).tolist(), count[count > 2].tolist(), strict=True)))
        ids = batch.column(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([class_of(s) for s in sets], np.uint64).view(np.int64)), batch.column(2)], names=names)
    items = list(often.items())
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(items), np.int32)), pa.array([k for k, _ in items], pa.int64()), pa.array([c for _, c in items], pa.int64()), pa.array([0] * len(items), pa.int64()), pa.nulls(len(items), pa.int64())], names=names)


def _prefixes(frequent: np.ndarray):
    """(token, class, rank): the prefix and reserve of each set in order 1, which is (frequent or not, hash)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for _, texts in chunks(batches):
            sets = {class_of(s): s for s in (shingles(t, known) for t in texts) if len(s)}
            heads = []
            for s in sets.values():
                size = emitted_size(len(s))
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    common = frequent[at] == s
                    if common.any():
                        s = np.concatenate([s[~common], s[common]])
                heads.append(s[:size])
            token = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            owner = np.repeat(np.array(list(sets), np.uint64), [len(h) for h in heads])
            rank = np.concatenate([np.arange(len(h), dtype=np.int32) for h in heads]) if heads else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(owner.view(np.int64)), pa.array(rank)], names=["token", "v", "rank"])

    return apply


def _head(tokens: np.ndarray, salt: int) -> np.ndarray:
    """The prefix in another order, as sorted 16-bit hashes with repetitions: sets share as many hashes at least as tokens."""
    return np.sort((np.sort(mixed(tokens ^ np.uint64(salt)))[: prefix_size(len(tokens))] & np.uint64(0xFFFF)).astype(np.uint16))


def sketch(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((mixed(tokens) >> np.uint64(55)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, tokens, prefixes in orders 2 and 3, sketch) of the texts asked for; a row of the same id with another text doesn't count."""
    known = WordHashes()
    for batch, texts in chunks(batches):
        asked = batch.column(batch.schema.get_field_index("v")).to_pylist()
        out = [(v, s) for v, s in zip(asked, (shingles(t, known) for t in texts), strict=True) if np.uint64(class_of(s)).view(np.int64) == v]
        heads = [pa.array([_head(s, salt).tobytes() for _, s in out], pa.binary()) for salt in ORDERS]
        sketches = np.array([sketch(s) for _, s in out], np.int64).reshape(-1, len(SKETCH))
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.int64()), pa.array([len(s) for _, s in out], pa.int64()), pa.array([s.tobytes() for _, s in out], pa.binary()), *heads, *(pa.array(c) for c in sketches.T)], names=["v", "n", "tokens", "head2", "head3", *SKETCH])


def enough(shared: int, n_a: int, n_b: int) -> bool:
    """Whether so many common prefix tokens leave room for a similarity of 3/4: past the prefix of the set whose prefix
    ends first, no more can be shared than that set has left."""
    return 7 * (shared + max(n_a - prefix_size(n_a), n_b - prefix_size(n_b))) >= 3 * (n_a + n_b)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries two sorted arrays share, repetitions included."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that pass both other orders."""
    for batch in batches:
        a, b, n_a, n_b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "n_a", "n_b"))
        ok = np.ones(len(a), bool)
        for order in ("2", "3"):
            x, y = (batch.column(batch.schema.get_field_index(f"head{order}_{s}")).to_pylist() for s in "ab")
            for i in np.flatnonzero(ok):
                ok[i] = enough(common(np.frombuffer(x[i], np.uint16), np.frombuffer(y[i], np.uint16)), n_a[i], n_b[i])
        kept = np.flatnonzero(ok)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("tokens_a", "tokens_b"))
        linked = [similar(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _room(shared: F.Column) -> F.Column:
    """`enough` over the columns n_a, n_b."""
    left = F.greatest(F.col("n_a") - prefix_size(F.col("n_a")), F.col("n_b") - prefix_size(F.col("n_b")))
    return 7 * (shared + left) >= 3 * (F.col("n_a") + F.col("n_b"))


def _pairs(postings: DataFrame) -> DataFrame:
    """(v_a, v_b, n_a, n_b, hot_a, ..., shared): pairs of a small group whose sizes allow the similarity, with their
    common tokens. Both sides are the same exchange."""
    near = f"100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n AND a.v < b.v"
    keys = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("v", "n", "hot", "cold", "full")]
    return postings.alias("a").join(postings.alias("b"), F.expr(f"a.token = b.token AND {near}")).groupBy(*keys).agg(F.count("*").alias("shared"))


def _across_groups(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that a large group's token may link, one of them being full.

    Of two sets that link, take the token that is first in order 1 among those they share: what follows it must leave room
    for the similarity in both, so the smaller set has it in its first seventh. That and the sketches are conditions of
    the join: of a group's pairs, those that can't link are never made.
    """
    rows = rows.join(sets.select("v", *SKETCH), "v")
    smaller = f"100 * a.n >= {PERCENT} * b.n AND (a.n < b.n OR (a.n = b.n AND a.v < b.v))"
    room = "7 * least(a.n - a.rank, b.n - b.rank) >= 3 * (a.n + b.n)"
    differ = " + ".join(f"bit_count(a.{s} ^ b.{s})" for s in SKETCH)
    may = F.expr(f"a.token = b.token AND a.label <> b.label AND (a.full OR b.full) AND {smaller} AND {room} AND 7 * ({differ}) <= a.n + b.n")
    return rows.filter("7 * rank <= n").alias("a").join(rows.alias("b"), may).select(F.least("a.v", "b.v").alias("a"), F.greatest("a.v", "b.v").alias("b")).distinct()


def _ordered(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(token, v, rank, n, large, hot, cold, full, before): the emitted tokens that several classes have.

    large: the token's group is over GROUP; such tokens go last in order 1, as do those listed before. hot, cold: how many
    tokens of the class are in large and other groups; before: how many large ones come before a token. full: a class has
    so many tokens in large groups that its prefix can't do without them.
    """
    same, own = Window.partitionBy("token"), Window.partitionBy("v")
    postings = docs.select("text").mapInArrow(_prefixes(frequent), "token long, v long, rank int")
    shared = postings.withColumn("first", F.min("v").over(same)).withColumn("last", F.max("v").over(same)).filter("first < last").select("token", "v", "rank").distinct()
    shared = written(shared.select("*", (F.count("*").over(same) > GROUP).alias("large")), "postings")
    sized = shared.join(classes.select("v", "n"), "v")
    before = F.sum(F.col("large").cast("int")).over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    sized = sized.withColumns({"hot": F.sum(F.col("large").cast("int")).over(own), "cold": F.sum((~F.col("large")).cast("int")).over(own), "before": F.coalesce(before, F.lit(0))})
    return written(sized.withColumn("full", emitted_size(F.col("n")) - F.col("hot") < prefix_size(F.col("n"))), "ordered")


def links(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(a, b): links between classes that are enough for the components: every link joins two classes of one component."""
    return _found_links(docs, classes, frequent)[0]


def _found_links(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The links, and the labels (v, label) of the components that they make.

    classes: v, n, key (of one document of the class). docs: key, text. Two classes that aren't full share a token of a
    group that isn't large, for their prefixes hold no others. Pairs with a full class may share tokens of large groups
    only: those groups give pairs with their leader first, and then, of the classes that aren't yet in one component, the
    pairs with a full class that _across_groups leaves.
    """
    rows = _ordered(docs, classes, frequent)
    columns = ["token", "v", "n", "hot", "cold", "full", "rank"]
    small = rows.filter(~F.col("large") & (F.col("rank") - F.col("before") < prefix_size(F.col("n")))).select(*columns)
    large = rows.filter(F.col("large") & (F.col("rank") < prefix_size(F.col("n")))).select(*columns)
    # what a full class shares in large groups isn't known here, and counts as all that it could
    unknown = F.when(F.col("full_a") | F.col("full_b"), F.least("hot_a", "hot_b")).otherwise(F.lit(0))
    near = _pairs(small).filter(_room(F.col("shared") + unknown)).select(F.col("v_a").alias("a"), F.col("v_b").alias("b"), "shared")
    # the leader of a large group is the class with the fewest tokens of its own: of near copies, the one most like the rest
    whole = large.filter("full")
    leaders = written(whole.groupBy("token").agg(F.min_by("v", F.struct(F.col("cold") / F.col("n"), "v")).alias("leader")), "leaders")
    star = whole.join(leaders, "token").filter("v <> leader").groupBy("leader", "v").agg(F.count("*").alias("shared"), F.max("n").alias("n")).filter(10 * F.col("shared") >= prefix_size(F.col("n")))
    star = star.select(F.least("leader", "v").alias("a"), F.greatest("leader", "v").alias("b"), F.col("v").alias("of"), "shared")
    found = written(near.withColumn("of", F.col("b")).unionByName(star).groupBy("a", "b", "of").agg(F.max("shared").alias("shared")), "pairs")
    sets = _set_table(docs, classes, found.select(F.col("a").alias("v")).unionByName(found.select(F.col("b").alias("v"))).distinct())
    # each class first with the partner it shares most with; what is joined then needs no further comparison
    best = found.groupBy("of").agg(F.max_by(F.struct("a", "b"), F.struct("shared", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
    linked = _linked(best, sets)
    rest = _across(found.select("a", "b").distinct(), _labels(linked)).join(best, ["a", "b"], "left_anti")
    linked = written(linked.unionByName(_linked(rest, sets)), "linked")
    labels = _labels(linked)
    labelled = large.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    mixed_groups = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("full").alias("any_full")).filter("low < high AND any_full").select("token")
    open_rows = written(labelled.join(mixed_groups, "token", "left_semi"), "open")
    if open_rows.isEmpty():
        return linked, labels
    open_sets = _set_table(docs, classes, open_rows.select("v").distinct())
    cross = written(_across_groups(open_rows, open_sets).join(found.select("a", "b").distinct(), ["a", "b"], "left_anti"), "cross")
    if cross.isEmpty():
        return linked, labels
    linked = linked.unionByName(_linked(cross, open_sets))
    return linked, _labels(linked)


def _set_table(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """The sets of the classes v asked for, each from one text of the class."""
    asked = asked.join(classes, "v").select("v", "key")
    # texts are shuffled only where too many are asked for
    return written(docs.join(small_or_shuffled(asked, "asked"), "key").select("v", "text").mapInArrow(_sets, f"v long, n long, tokens binary, head2 binary, head3 binary, {', '.join(f'{c} long' for c in SKETCH)}").dropDuplicates(["v"]), "sets")


def _joined(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of both sets; the sets are dealt out once for both joins."""
    part = sets.select("v", *columns)
    half = pairs.select("a", "b").join(part, F.col("a") == F.col("v")).select("a", "b", *(F.col(c).alias(f"{c}_a") for c in columns))
    return half.join(part, F.col("b") == F.col("v")).select("a", "b", *(f"{c}_a" for c in columns), *(F.col(c).alias(f"{c}_b") for c in columns))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar: first by orders 2 and 3, whose prefixes are small, then by the whole sets."""
    passed = written(_joined(pairs, sets, ["n", "head2", "head3"]).mapInArrow(_passes, "a long, b long"), "passed")
    return written(_joined(passed, sets, ["tokens"]).mapInArrow(_verify, "a long, b long, linked boolean").filter("linked").select("a", "b"), "verified")


def _labels(linked: DataFrame) -> DataFrame:
    return connected_components(linked)


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes aren't in one component yet."""
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"label_{c}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id, component_id.

    Words are lower-cased in A-Z and split at white space; a set holds the distinct 5-word shingles, or the whole
    sequence when there are fewer words; sets and shingles are compared by 64-bit hashes. Two documents link when
    100 * intersection >= 75 * union; component_id is the smallest doc_id that links reach.

    Documents with equal sets are one class, found by a grouped minimum, so copies are never paired. Null and empty texts
    have size 0 and link with nothing; null ids take part but are nobody's component_id (null if no one else is there);
    repeated rows give equal rows; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # texts are fetched by their id; those without one by a hash, which may equal an id, as fetched sets are checked
    rows = rows.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("key"))
    scanned = written(rows.mapInArrow(_scan, "kind int, a long, n long, v long, key long"), "scan")
    # a hint of bounded size for order 1; ties at the end of the list don't matter for the result
    listed = scanned.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "a").limit(MAX_FREQUENT).select("a").toArrow()
    frequent = np.sort(listed.column("a").to_numpy().astype(np.int64).view(np.uint64))
    sized = scanned.filter("kind = 0").select(F.col("a").alias("doc_id"), "n", "v", "key")
    classes = written(sized.filter("n > 0").groupBy("v").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key")), "classes")
    _, labels = _found_links(rows.select(F.coalesce("doc_id", "key").alias("key"), "text"), classes, frequent)
    top = classes.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least = top.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = written(top.join(least, "label").select("v", "component_id"), "class-components")
    full = sized.filter("n > 0").join(by_class, "v").select("doc_id", F.col("n").alias("n_shingles"), F.col("v").alias("class_id"), "component_id")
    return full.unionByName(sized.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; columns as they were.

    Rows without words and rows without an id all stay: they are nobody's copy.
    """
    name = fresh("dropped", docs)
    found = components(docs, doc_id, text)
    dropped = found.filter("doc_id IS NOT NULL AND n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(small_or_shuffled(dropped, "dropped"), F.col(doc_id) == F.col(name), "left_anti")
