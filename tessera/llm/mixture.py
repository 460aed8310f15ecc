"""Mixing sources to target weights with soft membership. Native: DataFrame functions and pyspark.ml only."""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, written

#: The domain classifier is fitted on at most this many labelled rows; a hash of doc_id decides which.
MAX_LABELLED = 20_000
#: Of the targets, by how much totals may be off, and the projected gradient from nothing; of the squares, how near to the least.
TOLERANCE, NEAR = 1e-6, 1e-7
LENGTHS = (1.0, 0.5, 0.2, 0.05, 0.01)
FEATURES = ("f_words", "f_word_length", "f_symbols", "f_digits", "f_stops", "f_lines", "f_distinct_lines")


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens (words) and the features of a text: shares of kinds of characters, lengths, repeated lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.greatest(F.length(body), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(body, F.lit(pattern)) / size
    lines = F.split(body, "\n", -1)
    return docs.withColumn("n_tokens", F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).withColumns({
        "f_words": F.log1p(F.col("n_tokens").cast("double")),
        "f_word_length": size / F.greatest(F.col("n_tokens"), F.lit(1)),
        "f_symbols": share(r"[#*$%&|<>{}=_~^@/]"),
        "f_digits": share("[0-9]"),
        "f_stops": share("[.!?]"),
        "f_lines": F.size(lines) / F.greatest(F.col("n_tokens"), F.lit(1)),
        "f_distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    })


def fit_domains(rows: DataFrame, labels: DataFrame, domain: str, max_labelled: int = MAX_LABELLED) -> tuple[list, object, LogisticRegressionModel | None]:
    """(domains, scaler, classifier) from the labelled rows of `rows` (doc_id and features). With fewer than two labelled
    domains there is no classifier, and every posterior is the share of the labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(domain).isNotNull()).groupBy("doc_id").agg(F.min(domain).alias("domain"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # bounded by max_labelled: a broadcast of proven size
    chosen = written(rows.select("doc_id", *FEATURES).join(F.broadcast(sample), "doc_id"), "mix-labelled")
    domains = [r["domain"] for r in chosen.select("domain").distinct().orderBy("domain").collect()]
    if len(domains) < 2:
        return domains, None, None
    indexed = chosen.withColumn("label", F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double") - 1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(indexed)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(vectors)
    model = LogisticRegression(maxIter=50, regParam=1e-3, family="multinomial").fit(scaler.transform(vectors))
    return domains, scaler, model


def posteriors(docs: DataFrame, labels: DataFrame, domain: str = "quality", max_labelled: int = MAX_LABELLED) -> tuple[list, DataFrame]:
    """(domains, docs with n_tokens and p: one posterior per domain). A label isn't used for its own row: rows with and
    without labels get the classifier's prediction."""
    rows = featured(docs)
    domains, scaler, model = fit_domains(rows, labels, domain, max_labelled)
    if model is None:
        return domains or [None], rows.drop(*FEATURES).withColumn("p", F.array(F.lit(1.0)))
    scored = model.transform(scaler.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(rows)))
    return domains, scored.withColumn("p", vector_to_array("probability")).drop(*FEATURES, "raw", "features", "rawPrediction", "probability", "prediction")


def _dot(vector: np.ndarray) -> str:
    return " + ".join(f"({float(x)!r}D) * p[{j}]" for j, x in enumerate(vector))


def _rate(moved: np.ndarray, least: float) -> str:
    """The rate of a document: 1, moved by p . moved, then projected on rates of `least` or more."""
    return f"greatest({float(least)!r}D, 1 + {_dot(moved)})"


class Solved(NamedTuple):
    rate: Column  # of a row with p
    totals: np.ndarray  # expected domain totals at these rates
    converged: bool
    steps: int


def solve_rates(scored: DataFrame, targets: np.ndarray, least: float = 0.0, tolerance: float = TOLERANCE) -> Solved:
    """Rates of `least` or more whose expected domain totals come nearest to targets.

    It minimises the squares of total(k) - target(k), total(k) being the sum over documents of rate * n_tokens * p(k), by
    projected gradients that are projected lazily: steps add up in one vector, a document moves from rate 1 by p . vector,
    and to `least` if it is below. So a rate is a function of p whatever the number of steps. A step goes along the gradient
    scaled by the inverse matrix of the documents that are free to move; of several lengths the best is taken.

    A small pull towards rate 1 makes the rates unique; it is lowered until it costs less than NEAR of the squares. The rates
    have converged where the totals are within tolerance of the targets, or else where the projected gradient, as the
    tokens that one more plain step would move, is within tolerance of them. Each step is one aggregate over all documents;
    the driver holds K totals, K * K sums and the value of each length.
    """
    k, low = len(targets), f"{float(least)!r}D"
    scale = max(float(np.abs(targets).max()), 1.0)

    def sums(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """At each vector: the totals, the matrix of the free documents, the sum of what the lazily projected steps minimise, and
        how far rates are from 1 in all."""
        # the vectors are one literal that is exploded, so each step has the same small plan and the same generated code
        tried = ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in v) + ")" for v in vectors)
        rows = scored.select("n_tokens", "p", F.expr(f"posexplode(array({tried})) AS (i, v)"))
        rows = rows.withColumn("z", F.expr(" + ".join(f"v[{j}] * p[{j}]" for j in range(k)))).withColumn("r", F.expr(f"greatest({low}, 1 + z)"))
        free = f"CASE WHEN r > {low} THEN n_tokens ELSE 0 END"
        each = [f"sum(r * n_tokens * p[{j}])" for j in range(k)]
        each += [f"sum({free} * p[{j}] * p[{m}])" for j in range(k) for m in range(k)]
        each += [f"sum(n_tokens * CASE WHEN 1 + z > {low} THEN z + z * z / 2 ELSE {low} * z - ({low} - 1) * ({low} - 1) / 2 END)"]
        each += ["sum(n_tokens * (r - 1) * (r - 1))"]
        # a row for each vector
        found = {row[0]: np.array([float(x or 0) for x in row[1:]]) for row in rows.groupBy("i").agg(*(F.expr(x).alias(f"s{i}") for i, x in enumerate(each))).collect()}
        return [(row[:k], row[k:-2].reshape(k, k), row[-2], row[-1]) for row in (found[i] for i in range(len(vectors)))]

    def left(vector: np.ndarray, off: np.ndarray, bound: float) -> float:
        """The norm of what one more projected step along the plain gradient would change, in tokens."""
        rate = _rate(vector, least)
        change = f"({rate} - greatest({low}, {rate} - ({_dot(off / bound)})))"
        moved = scored.agg(F.expr(f"sum(n_tokens * {change} * {change})").alias("s")).first()[0]
        return float(np.sqrt(bound * float(moved or 0)))

    vector = np.zeros(k)
    total, free, value, away = sums([vector])[0]
    bound, steps = max(float(total.sum()) / max(1.0, float(least)), 1e-12), 0  # all tokens: p adds up to 1, so no gradient is steeper
    pull = bound * 1e-2
    while True:
        while True:
            off = total + pull * vector - targets
            if np.abs(off).max() <= tolerance * scale * 1e-2:
                break
            # scaled gradients get there in a few steps, plain ones always descend
            step = -np.linalg.solve(free + pull * np.eye(k), off)
            tried = [vector + length * step for length in LENGTHS] + [vector - length * off / bound for length in (1.0, 10.0)]
            found = sums(tried)
            worth = lambda v, at: v + pull * float(at @ at) / 2 - float(targets @ at)  # noqa: B023, E731
            best = min(range(len(tried)), key=lambda i: worth(found[i][2], tried[i]))
            steps += 1
            if not worth(found[best][2], tried[best]) < worth(value, vector):
                break
            vector, (total, free, value, away) = tried[best], found[best]
        squares = float(((total - targets) ** 2).sum())
        if np.abs(total - targets).max() <= tolerance * scale:
            return Solved(F.expr(_rate(vector, least)), total, True, steps)
        if pull * away <= NEAR * squares or pull < bound * 1e-13:
            converged = left(vector, total - targets, bound) <= tolerance * max(scale, float(np.sqrt(squares)))
            return Solved(F.expr(_rate(vector, least)), total, converged, steps)
        pull /= 100


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict, domain: str = "quality", budget: float | None = None, least: float = 0.0, seed: int = 0, doc_id: str = "doc_id",
    text: str = "text", max_labelled: int = MAX_LABELLED, keep_text: bool = False, names: tuple[str, str, str, str] = ("n_tokens", "p", "rate", "copies"),
) -> DataFrame:
    """docs with n_tokens, p (posteriors, in the order of the sorted domains), rate and copies, or as `names` calls them.

    weights: target share of tokens by domain, over the domains of the labels (0 if not named). budget: tokens to reach;
    by default the smallest with which no domain must give tokens away. copies is the rate rounded up or down by a hash
    of doc_id, so that its mean is the rate. Rates are exact for the soft membership: the sum over documents of
    rate * n_tokens * p meets weights * budget as nearly as rates of `least` or more allow; a warning says where the solver
    could not tell.

    Null and blank texts have no tokens, so no total asks for more or fewer of them: their rate is 1, or `least` if that is
    more. Null ids share one hash. Repeated rows
    get equal rates. Without labels all documents are one domain with rate 1. An empty table gives an empty result.
    Columns of docs with one of the names are replaced; all others stay, whatever their names. The text itself stays with
    keep_text.
    """
    others = [c for c in docs.columns if c not in (*names, doc_id, text)]
    # columns under names of their own, so none of docs meets one of the classifier
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    domains, scored = posteriors(plain, labels, domain, max_labelled)
    scored = written(scored if keep_text else scored.drop("text"), "mix-scored")
    k = len(domains)
    have = np.array([float(x or 0) for x in scored.agg(*(F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(k))).first()])
    w = np.array([float(weights.get(d, 0.0)) for d in domains]) if k > 1 else np.ones(k)
    w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
    want = float(np.max(have[w > 0] / w[w > 0])) if budget is None else float(budget)
    solved = solve_rates(scored, w * want, least) if have.sum() > 0 else Solved(F.lit(max(1.0, float(least))), have, True, 0)
    if not solved.converged:
        warnings.warn(f"rates not converged after {solved.steps} steps: totals {solved.totals.tolist()} for {(w * want).tolist()}", stacklevel=2)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rated = scored.withColumn("rate", F.when(F.col("n_tokens") > 0, solved.rate).otherwise(F.lit(max(1.0, float(least)))))
    rated = rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    of = {doc_id: F.col("doc_id"), **({text: F.col("text")} if keep_text else {}), **{c: F.col(f"c{i}") for i, c in enumerate(others)}}
    return rated.select(*(of[c].alias(c) for c in docs.columns if c in of), *(F.col(c).alias(name) for c, name in zip(("n_tokens", "p", "rate", "copies"), names, strict=True)))


def repeated(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """Each row of mixed as often as its copies say, with these columns."""
    number = fresh("number", mixed)
    return mixed.filter(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns)
