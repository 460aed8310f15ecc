"""Connected components, for objects of a mask and for groups of touching annotations: ITR-01, ITR-02."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.storage import cut

#: Edges that one task contracts at a time; a graph that is no larger after that is finished by one task.
EDGES = 1 << 20


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the vertices 0..n-1, the smallest one that it reaches over the edges a[i], b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        found = label.copy()
        for ends in (a, b):
            np.minimum.at(found, label[ends], low)
        while True:
            top = found[found]
            if (top == found).all():
                break
            found = top
        if (found == label).all():
            return label
        label = found


def _stars(by: Sequence[str], whole: bool) -> Callable:
    """Edges (by, a, b) -> (by, a, b) with b the smallest vertex that a reaches over the edges at hand, a other than b. At hand
    are EDGES edges, or all of a task."""

    def contracted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        keys = [table.column(c).combine_chunks().dictionary_encode() for c in by]
        codes = [k.indices.to_numpy(zero_copy_only=False).astype(float) for k in keys]
        _, first, group = np.unique(np.stack([np.nan_to_num(c, nan=-1) for c in codes], 1), axis=0, return_index=True, return_inverse=True) if by else (0, np.zeros(1, int), np.zeros(table.num_rows, int))
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        names, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        group = np.ravel(group)
        vertices, ends = np.unique(np.tile(group, 2) * len(names) + place, return_inverse=True)  # in order of group, then name
        label = smallest(len(vertices), ends[: len(a)], ends[len(a) :])
        other = np.flatnonzero(label != np.arange(len(label)))
        rows = pa.array(first[vertices[other] // len(names)])
        values = [*(table.column(c).take(rows).combine_chunks() for c in by), pa.array(names[vertices[other] % len(names)]), pa.array(names[vertices[label[other]] % len(names)])]
        return pa.RecordBatch.from_arrays(values, names=[*by, "a", "b"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= EDGES and not whole:
                yield contracted(held)
                held, n = [], 0
        if held:
            yield contracted(held)

    return apply


def components(vertices: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, label) for vertices (by, v) and edges (by, a, b), both long: the smallest vertex that each one reaches. Edges lie
    within one `by`.

    Edges are contracted where they are made, which leaves an edge per vertex of each task at most. A graph of at most EDGES
    edges is then finished by one task. A larger one is labelled in rounds: the smallest label of the neighbours, then two
    steps of label to its own label, until none changes; labels are written each round, so plans stay short and a lost
    executor costs one round at most.
    """
    types = dict(edges.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "a long", "b long"])
    plain = edges.filter("a <> b").select(*by, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    left = cut(plain.mapInArrow(_stars(by, False), schema).distinct())
    every = vertices.select(*by, F.col("v").cast("long").alias("v")).distinct()
    if left.count() <= EDGES:
        found = left.coalesce(1).mapInArrow(_stars(by, True), schema).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("a").alias("_a"), "b")
        same = F.col("v") == F.col("_a")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return every.join(found, same, "left").select(*by, "v", F.coalesce("b", "v").alias("label"))
    key = F.struct(*by) if by else F.lit(0)
    both = cut(left.select(key.alias("k"), "a", "b").unionByName(left.select(key.alias("k"), F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.select("k", F.col("a").alias("v")).distinct().withColumn("label", F.col("v")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), ["k", "b"]).groupBy("k", F.col("a").alias("v")).agg(F.min("label").alias("near"))
        found = labels.join(near, ["k", "v"]).select("k", "v", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        for _ in range(2):
            top = found.select("k", F.col("v").alias("label"), F.col("label").alias("top"))
            found = found.join(top, ["k", "label"]).select("k", "v", "before", F.col("top").alias("label"))
        found = cut(found)
        labels = found.select("k", "v", "label")
        if found.filter("before <> label").isEmpty():
            break
    ends = labels.select(*(F.col(f"k.{c}").alias(c) for c in by), "v", "label")
    return every.join(ends, [*by, "v"], "left").select(*by, "v", F.coalesce("label", "v").alias("label"))
