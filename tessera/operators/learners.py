"""Learners: extremely randomised trees on DataFrames, nearest neighbours, and final classifiers. ML-01 to ML-04, ML-07 to ML-14, ML-16, ML-17."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.features import uniform
from tessera.operators.storage import cut

NODES = "tree_id int, node long, feature int, threshold double, leaf boolean, value array<double>, n long"


#: Rows of a piece that meets a block of queries, and bytes of differences that a task makes at a time.
PIECE, SLICE = 4096, 8 << 20
#: Training rows of a final classifier in a file, about.
PART = 16_384


def nearest_vote(rows: DataFrame, asked: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(sample_id, pred, votes): the class of most of the k nearest others, the lowest on ties. ML-12.

    Queries are dealt into blocks of about `block` by a hash, rows into pieces of about PIECE. A block and a piece meet as two
    matrices in one row, which stay Arrow buffers, and send on the k nearest per query: what is shuffled is queries * pieces *
    k rows, never all pairs. Differences are made SLICE bytes at a time, so a task's memory is that of an Arrow batch.
    """
    wide = rows.select(F.size("embedding")).first()
    if wide is None:
        return rows.limit(0).select(F.col("sample_id").cast("long"), F.col("label").cast("int").alias("pred"), F.lit(0).cast("long").alias("votes"))
    blocks, pieces = (-(-df.count() // size) or 1 for df, size in ((asked, block), (rows, PIECE)))
    dealt = lambda df, n: df.groupBy(F.pmod(F.xxhash64("sample_id"), F.lit(n)).alias("b"))
    flat = F.flatten(F.collect_list(F.transform("embedding", lambda v: v.cast("double"))))
    packed = dealt(asked, blocks).agg(F.collect_list("sample_id").alias("asked"), flat.alias("queries")).drop("b")
    held = dealt(rows, pieces).agg(F.collect_list("sample_id").alias("ids"), F.collect_list("label").alias("labels"), flat.alias("rows")).drop("b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked_ids, queries, ids, labels, found = (batch.column(c)[i].values.to_numpy() for c in ("asked", "queries", "ids", "labels", "rows"))
                a, b = queries.reshape(len(asked_ids), -1), found.reshape(len(ids), -1)
                step = max(1, SLICE // (8 * found.size))
                for start in range(0, len(a), step):
                    own = asked_ids[start : start + step]
                    d = np.round(((a[start : start + step, None, :] - b[None, :, :]) ** 2).sum(axis=2), 8)
                    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)
                    keep = ids[order] != own[:, None]
                    keep &= np.cumsum(keep, axis=1) <= k
                    which, place = np.nonzero(keep)
                    t = order[which, place]
                    yield pa.RecordBatch.from_arrays([pa.array(own[which]), pa.array(ids[t]), pa.array(labels[t]), pa.array(d[which, t])], names=["sample_id", "t", "label", "d"])

    # a stated set of queries against all rows, in blocks
    pairs = held.repartition(min(pieces, 1024)).crossJoin(packed).select("asked", "queries", "ids", "labels", "rows")
    near_rows = pairs.mapInArrow(near, "sample_id long, t long, label int, d double")
    best = near_rows.withColumn("_r", F.row_number().over(Window.partitionBy("sample_id").orderBy("d", "t"))).filter(F.col("_r") <= k)
    votes = best.groupBy("sample_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("sample_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("pred"), F.max("n").alias("votes"))


def _tests(k: int, width: int, seed: int, blocks: int | None):
    """The features that a node tries: k draws by a hash, in the tree's own block of features if there are blocks."""
    size = width // blocks if blocks else width
    start = F.col("tree_id") % blocks * size if blocks else F.lit(0)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (start + F.floor(uniform(seed, "tree_id", "node", j) * size)).cast("int")))


def fit_trees(rows: DataFrame, trees: int, k: int, classes: int | None = None, min_split: int = 2, depth: int = 12, seed: int = 0, blocks: int | None = None, grouped: bool = False) -> DataFrame:
    """Extremely randomised trees: a table of nodes. ML-01; blocks: tree i sees feature block i only, ML-13.

    rows: sample_id, label (an index below `classes`) and features; without `classes` label is an array of numbers to
    regress, ML-14; with `classes` it may be an array of indexes, one per output, ML-02 (value then holds `classes` numbers
    per output, in turn). grouped: rows have a column group, and trees group * trees and following see that group's rows
    only, so models of many groups are fitted together. Level by level, for all trees and nodes at once: one aggregate finds each tried feature's range, a
    hash draws a threshold in it, one aggregate adds up both sides of every test, and the test that lowers impurity most
    splits the node; one whose tried features are all constant is a leaf. Rows are joined with the table of open splits;
    nothing goes to the driver but its size. Without rows there are no nodes.
    """
    some = rows.select("features", "label").first()
    if some is None:
        return rows.sparkSession.createDataFrame([], NODES)
    width = len(some["features"])
    several = dict(rows.dtypes)["label"].startswith("array")
    one_hot = lambda v: F.array(*((v == c).cast("double") for c in range(classes)))
    if classes:
        target = F.flatten(F.transform("label", one_hot)) if several else one_hot(F.col("label"))
    else:
        target = F.transform("label", lambda v: v.cast("double"))
    outputs = (classes or 1) * (len(some["label"]) if several else 1)
    first = F.col("group") * trees if grouped else F.lit(0)
    state = cut(rows.select("sample_id", "features", target.alias("t"), F.explode(F.sequence(first, first + (trees - 1))).alias("tree_id")).withColumns({"tree_id": F.col("tree_id").cast("int"), "node": F.lit(1).cast("long")}))
    sums = [F.sum(F.col("t")[c]).alias(f"s{c}") for c in range(outputs)] + [F.sum(F.col("t")[c] * F.col("t")[c]).alias(f"q{c}") for c in range(outputs)]

    def impurity(prefix: str):
        """n * the mean over outputs of the variance; for class indicators that is the Gini impurity."""
        return sum((F.col(f"{prefix}q{c}") - F.col(f"{prefix}s{c}") * F.col(f"{prefix}s{c}") / F.greatest(F.col(f"{prefix}n"), F.lit(1)) for c in range(outputs)), F.lit(0.0))

    levels: list[DataFrame] = []
    for _ in range(depth + 1):
        totals = state.groupBy("tree_id", "node").agg(F.count("*").alias("n"), *sums)
        totals = cut(totals.withColumn("value", F.array(*(F.col(f"s{c}") / F.col("n") for c in range(outputs)))).withColumn("impurity", impurity("")))
        last = len(levels) == depth
        open_ = totals.filter((F.col("n") >= min_split) & (F.col("impurity") > 1e-12) & F.lit(not last)).select("tree_id", "node", F.col("impurity").alias("before"))
        if last or open_.isEmpty():
            levels.append(totals.select("tree_id", "node", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("leaf"), "value", "n"))
            break
        tried = state.join(open_.drop("before"), ["tree_id", "node"]).withColumn("f", F.explode(_tests(k, width, seed, blocks))).withColumn("x", F.element_at("features", F.col("f") + 1).cast("double"))
        ranges = tried.groupBy("tree_id", "node", "f").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low < high")
        drawn = cut(ranges.withColumn("threshold", F.col("low") + uniform(seed + 1, "tree_id", "node", "f") * (F.col("high") - F.col("low"))).select("tree_id", "node", "f", "threshold"))
        sides = tried.join(drawn, ["tree_id", "node", "f"]).withColumn("_left", F.col("x") <= F.col("threshold"))
        both = [(F.sum(F.when(F.col("_left") == side, v).otherwise(0.0))).alias(f"{p}{name}{c}") for p, side in (("l", True), ("r", False)) for c in range(outputs) for name, v in (("s", F.col("t")[c]), ("q", F.col("t")[c] * F.col("t")[c]))]
        both += [F.sum((F.col("_left") == side).cast("long")).alias(f"{p}n") for p, side in (("l", True), ("r", False))]
        scored = sides.groupBy("tree_id", "node", "f", "threshold").agg(*both).withColumn("after", impurity("l") + impurity("r"))
        best = scored.groupBy("tree_id", "node").agg(F.min_by(F.struct("f", "threshold"), F.struct(F.round("after", 9), "f")).alias("b"))
        splits = cut(best.select("tree_id", "node", F.col("b.f").alias("feature"), F.col("b.threshold").alias("threshold")))
        levels.append(totals.join(splits, ["tree_id", "node"], "left").select("tree_id", "node", "feature", "threshold", F.col("feature").isNull().alias("leaf"), "value", "n"))
        right = F.element_at("features", F.col("feature") + 1).cast("double") > F.col("threshold")
        state = cut(state.join(splits, ["tree_id", "node"]).select("sample_id", "features", "t", "tree_id", (F.col("node") * 2 + right.cast("long")).alias("node")))
        if state.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return cut(out)


def apply_trees(rows: DataFrame, nodes: DataFrame, depth: int = 64, grouped: int | None = None) -> DataFrame:
    """(sample_id, tree_id, node, value): the leaf that each row ends in. ML-03, JOIN-12. grouped: trees per group, of which
    a row (with a column group) goes through its own.

    Rows go down a level per round by an equi join on (tree_id, node), so the forest may be of any size.
    """
    trees = nodes.select("tree_id").distinct()
    if grouped:
        at = rows.select("sample_id", "features", "group").join(trees.withColumn("group", F.floor(F.col("tree_id") / grouped)), "group").drop("group")
    else:
        at = rows.select("sample_id", "features").join(trees, how="cross")
    at = at.withColumn("node", F.lit(1).cast("long"))
    done = None
    if nodes.isEmpty():
        return at.join(nodes, ["tree_id", "node"]).select("sample_id", "tree_id", "node", "value")
    for _ in range(depth):
        met = cut(at.join(nodes, ["tree_id", "node"]))
        ended = met.filter("leaf").select("sample_id", "tree_id", "node", "value")
        done = ended if done is None else done.unionByName(ended)
        rest = met.filter("NOT leaf")
        if rest.isEmpty():
            break
        at = rest.select("sample_id", "features", "tree_id", (F.col("node") * 2 + (F.element_at("features", F.col("feature") + 1).cast("double") > F.col("threshold")).cast("long")).alias("node"))
    return done


def predict_mean(leaves: DataFrame) -> DataFrame:
    """(sample_id, value): the mean over trees. ML-04, ML-13, ML-14."""
    each = leaves.select("sample_id", "tree_id", F.posexplode("value").alias("i", "v"))
    return each.groupBy("sample_id", "i").agg(F.avg("v").alias("v")).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("value"))


def predict_class(leaves: DataFrame) -> DataFrame:
    """(sample_id, pred, p): the likeliest class, the lowest on ties."""
    each = leaves.select("sample_id", F.posexplode("value").alias("i", "v")).groupBy("sample_id", "i").agg(F.round(F.avg("v"), 9).alias("v"))
    return each.groupBy("sample_id").agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("pred"), F.max("v").alias("p"))


def cross_validated(rows: DataFrame, folds: DataFrame, classes: int, n_folds: int, **options: int) -> DataFrame:
    """(sample_id, label, fold, pred, p): each fold predicted by trees of the others. ML-16. The rows are extracted once."""
    joined = cut(rows.join(folds.select("sample_id", "fold"), "sample_id"))
    out = None
    for fold in range(n_folds):
        nodes = fit_trees(joined.filter(F.col("fold") != fold), classes=classes, **options)
        test = joined.filter(F.col("fold") == fold)
        found = test.select("sample_id", "label", "fold").join(predict_class(apply_trees(test, nodes)), "sample_id")
        out = found if out is None else out.unionByName(found)
    return out


def final_classifier(code: str, n: int, c: float = 1.0, trees: int = 1000):
    """The estimator for leaf features: svm, lr_l1, lr_l2 or rf. ML-07, ML-08, ML-09, ML-11; c is the cost of an error, over n rows."""
    if code == "svm":
        return OneVsRest(classifier=LinearSVC(regParam=1 / (c * n), maxIter=20), parallelism=4)
    if code in ("lr_l1", "lr_l2"):
        return LogisticRegression(elasticNetParam=1.0 if code == "lr_l1" else 0.0, regParam=1 / (c * n), maxIter=50)
    if code == "rf":
        return RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", seed=0)
    raise ValueError(code)


def classified(train: DataFrame, test: DataFrame, code: str, n: int | None = None, **options: float) -> DataFrame:
    """(sample_id, label, pred, p): test rows by a final classifier, with the probability of the class. ML-17.

    et: extremely randomised trees that try the root of the number of features, ML-10. svm: its class, with a
    probability by a logistic fit on the margins of the training rows, ML-07.
    """
    if code == "et":
        classes = train.agg(F.max("label")).first()[0] + 1
        k = max(1, round(len(train.select("features").first()[0]) ** 0.5))
        nodes = fit_trees(train, **{"trees": 1000, "k": k, "classes": classes, **options})
        return test.select("sample_id", "label").join(predict_class(apply_trees(test, nodes)), "sample_id").select("sample_id", F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred"), "p")
    vectors = lambda df: df.select("sample_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("features"))
    rows = cut(vectors(train))
    count = rows.count()
    # the fits go through the rows hundreds of times: they are made once, and dealt evenly, as folds come with a class in a task
    rows = cut(rows.repartition(-(-count // PART) or 1, "sample_id"))
    model = final_classifier(code, n or count, **options).fit(rows)
    out = model.transform(vectors(test))
    if code == "svm":
        margins = lambda df: df.select("sample_id", "label", F.col("rawPrediction").alias("features"), F.col("prediction").alias("pred"))
        platt = LogisticRegression(regParam=1e-3, maxIter=50).fit(cut(margins(model.transform(rows))))
        out = platt.transform(margins(out)).drop("prediction").withColumnRenamed("pred", "prediction")
    p = F.element_at(vector_to_array("probability"), F.col("prediction").cast("int") + 1)
    return out.select("sample_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"), p.alias("p"))
