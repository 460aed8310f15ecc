"""What the text operators have in common: written tables, word splitting, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and \t \n \v \f \r. ``bytes.split()`` splits on the same six.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Texts are handled in groups of about this many bytes, so that a task's memory doesn't follow the batch size.
CHUNK_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a new one; a
    cluster must name one, as its hosts share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm_dir.get() if jvm_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: its lineage ends there, and lost executors cost
    nothing that was computed before. The caller's checkpoint folder owns the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name made from `name` that none of the tables has, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Tables of ids with at most so many rows may be sent to every executor (16 MB at two numbers a row).
SMALL_ROWS = 1_000_000


def small_or_shuffled(ids: DataFrame, name: str) -> DataFrame:
    """A narrow table of ids, written and counted: marked for broadcast up to SMALL_ROWS rows, else joined by a shuffle."""
    table = written(ids, name)
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))) % 5


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes b''."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK_BYTES of text each (one text at least); only a slice's texts are copied."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ends):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, "right")))
            yield batch.slice(start, end - start), text_bytes(column.slice(start, end - start))
            start = end


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bounded number of words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every k consecutive entries, as a polynomial modulo 2**64; empty when there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b, out = np.uint64(base), hashes[:n].copy()
    for j in range(1, k):
        out = out * b + hashes[j : j + n]
    return mixed(out)
