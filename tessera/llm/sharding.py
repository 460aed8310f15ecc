"""Sharding by a Feistel permutation of the global row numbers. Native: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the round function: multiplier and offset per round, and the prime of its field.
ROUNDS = ((48271, 11), (69621, 23), (16807, 37), (39373, 53), (62089, 71), (45742, 97))
PRIME = 2147483647
#: Rows are numbered within this many hash buckets; the bucket counts alone are numbered in one task.
BUCKETS = 1024


def sides(n: int) -> tuple[int, int]:
    """a * b is the smallest near-square that holds n numbers; it exceeds n by less than a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def feistel(number: Column, a: int, b: int, seed: int = 0) -> Column:
    """A bijection of 0 .. a*b-1: the halves, below a and below b, take turns at being shifted by a function of the other."""
    rounds = F.array(*(F.struct(F.lit(times).cast("long").alias("times"), F.lit(plus + seed % 1_000_003).cast("long").alias("plus"), F.lit(b if i % 2 else a).cast("long").alias("side")) for i, (times, plus) in enumerate(ROUNDS)))
    start = F.struct((number % a).cast("long").alias("left"), F.floor(number / F.lit(a)).cast("long").alias("right"))

    def turn(halves: Column, r: Column) -> Column:
        x = (halves["right"] % PRIME * r["times"] + r["plus"]) % PRIME
        return F.struct(halves["right"].alias("left"), ((halves["left"] + x * x % PRIME + halves["right"] % 1021) % r["side"]).alias("right"))

    return F.aggregate(rounds, start, turn, lambda halves: halves["left"] + halves["right"] * a)


def number_rows(rows: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows with row_number from 0 without gaps: by hash bucket, then by the columns of order. No task sorts all rows."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("n"))
    before = counts.select("_bucket", F.coalesce(F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # at most `buckets` rows: a broadcast of proven size
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(F.broadcast(before), "_bucket").withColumn("row_number", F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def shards(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law that holds is ``rows``: shard = position mod n_shards, slot = position div n_shards, where position is the
    permuted row number; counts differ by one at most and slots have no gaps, whatever the texts, copies included. The
    permutation is a six-round Feistel network over a near-square domain a*b >= n; positions of n or above walk the
    cycle until they fall below n (less than a such numbers exist, so a walk ends within that many steps). Only ids,
    sizes and checksums are shuffled, never texts. The result depends on the rows and the seed alone.

    A null text has size 16 and the checksum of ''. Null ids number first in their bucket; repeated rows are numbered
    like others (which of two equal rows has which slot can't be told apart). An empty table gives an empty result.
    grown_shard is null: under this law one more shard deals all rows anew.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    n = docs.count()
    a, b = sides(n)
    start = feistel(F.col("row_number"), a, b, seed)
    step = lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed))
    walked = F.when(F.col("position") < n, F.col("position")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, a * b - n + 1))), F.col("position"), step))
    placed = number_rows(rows, ["doc_id", "text_crc32", "size"], buckets).withColumn("position", start).withColumn("position", walked)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("position") / F.lit(n_shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
