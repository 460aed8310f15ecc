"""Aligning the tokens of two tokenizers, a byte-level BPE (A) and a SentencePiece BPE (B), over the same bytes.

Neither tokenizer has a token that crosses from a character into the space after it. So a text is cut into stretches there,
and what occurs more than once in a block of texts is encoded and aligned once. The stretches of a block lie one after
another in one byte string with two sorted lists of token ends. The shorter list is searched in the longer one by
galloping; ends that both have cut the groups, and the differences of ranks are the ranges of tokens that overlap.

The links of a block are counted by pair of ids. Counts of all blocks are added up in Spark, joined back to each block's
own pairs, and reach the texts through the stretches that they are made of: links are never rows of a table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import chunks, written

#: A space after a character that isn't white space starts a stretch; the space itself is left out.
CUT = re.compile(r"(?<=\S) ")
#: White space before a space: where texts have it, or start with a space, CUT tells; else every space is a cut.
RARE = re.compile(r"\s ")
#: Bytes of text in a block. A block's arrays are a row of a table, so they bound a task's memory.
BLOCK_BYTES = 16 << 20
#: Stretches are given to the tokenizers in lines of about so many characters.
LINE = 4096
#: Stretches of a block that are aligned at a time.
PART = 1 << 15
#: Elements that a lane of the search has.
LANE = 64


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each entry of `few`, how many entries of `many` are smaller; both are sorted.

    Stretches of LANE entries are searched side by side. In each, an entry starts where the one before ended, doubles its
    step until it has passed the key, and halves the last step.
    """
    n, m = len(few), len(many)
    if not n:
        return np.zeros(0, np.int64)
    lanes = -(-n // LANE)
    keys = np.full(lanes * LANE, few[-1], np.int64)
    keys[:n] = few
    keys = keys.reshape(lanes, LANE)
    ends = np.append(many.astype(np.int64), np.iinfo(np.int64).max)
    ranks = np.zeros((lanes, LANE), np.int64)
    low = np.zeros(lanes, np.int64)
    for j in range(LANE):
        key = keys[:, j]
        high = low.copy()
        wide = np.flatnonzero(ends[high] < key)
        step = 1
        while wide.size:
            low[wide] = high[wide] + 1
            high[wide] = np.minimum(high[wide] + step, m)
            step *= 2
            wide = wide[ends[high[wide]] < key[wide]]
        wide = np.flatnonzero(low < high)
        while wide.size:
            middle = (low[wide] + high[wide]) >> 1
            less = ends[middle] < key[wide]
            low[wide] = np.where(less, middle + 1, low[wide])
            high[wide] = np.where(less, high[wide], middle)
            wide = wide[low[wide] < high[wide]]
        ranks[:, j] = low
    return ranks.reshape(-1)[:n]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two sorted lists of ends over the same bytes, with the same last end: indices (in a, in b) of the ends that both
    have, and for each entry of the shorter list the first entry of the longer one that overlaps it and how many do."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    ranks = gallop(few, many)
    same = many[ranks] == few
    first = np.zeros(len(few), np.int64)
    first[1:] = ranks[:-1] + same[:-1]
    mine, other = np.flatnonzero(same), ranks[same]
    return (mine, other, first, ranks - first + 1) if few is a else (other, mine, first, ranks - first + 1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] entries), then those of starts[1], and so on."""
    offsets = np.cumsum(sizes) - sizes
    return np.repeat(starts - offsets, sizes) + np.arange(int(sizes.sum()))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs may be empty."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Tokenizers:
    """Both vocabularies as bytes, and the encoding of stretches."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        byte = self._bytes_of_signs()
        with open(a_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        entries = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if all(c in byte for c in t)}
        self.a_bytes = [entries.get(i, b"") for i in range(max(vocabulary.values()) + 1)]
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i)):
            raise ValueError("pieces that hold a space after other characters aren't supported")
        none = {i for i in range(n) if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)}
        self.b_bytes = [b"" if i in none else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_shown, self.b_shown = ([str(i) for i in range(len(t))] for t in (self.a_bytes, self.b_bytes))

    @staticmethod
    def _bytes_of_signs() -> dict[str, int]:
        """The sign that byte-level BPE writes for each byte: itself where it is printable Latin-1, else the next one from
        U+0100 on."""
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in set(printable)]
        return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}

    def encode(self, rests: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, B's ids, which stretches they stand for, bytes of each) of a space and each entry of rests. Stretches whose
        bytes come out otherwise in A or B have no tokens."""
        a_ids, b_ids = [], []
        sizes = np.array([1 + len(r.encode()) for r in rests], np.int64)
        good = np.ones(len(rests), bool)
        # a stretch that is empty or ends in white space can't be followed by another one
        alone = np.array([not r or r[-1].isspace() for r in rests], bool)
        line: list[int] = []
        length = 0
        for i, r in enumerate(rests):
            if alone[i]:
                self._line([i], rests, a_ids, b_ids, good)
            else:
                line.append(i)
                length += len(r) + 1
                if length >= LINE:
                    self._line(line, rests, a_ids, b_ids, good)
                    line, length = [], 0
        if line:
            self._line(line, rests, a_ids, b_ids, good)
        order = [i for x in a_ids for i in x[0]]
        flat = lambda lists: np.concatenate([ids for _, ids in lists]).astype(np.int64) if lists else np.zeros(0, np.int64)
        return flat(a_ids), flat(b_ids), np.array(order, np.int64), sizes[order] if order else sizes[:0]

    def _line(self, line: list[int], rests: list[str], a_ids: list, b_ids: list, good: np.ndarray) -> None:
        text = " ".join([rests[i] for i in line])
        whole = b" " + text.encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text) if text else [self.space]
        if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
            a_ids.append((line, np.array(a, np.int32)))  # four bytes an id until all are known, not an object
            b_ids.append((line, np.array(b, np.int32)))
        elif len(line) > 1:
            for i in line:
                self._line([i], rests, a_ids, b_ids, good)
        else:
            good[line[0]] = False


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """Both tokenizers, read once by each Python worker."""
    if (a_file, b_file) not in _loaded:
        _loaded[a_file, b_file] = Tokenizers(a_file, b_file)
    return _loaded[a_file, b_file]


class Numbers(dict):
    """Stretch -> its number in the block."""

    def __missing__(self, rest: str) -> int:
        value = self[rest] = len(self)
        return value


def cut(text: str) -> list[str]:
    """The stretches of a space and text, each without its first space."""
    return CUT.split(text) if text[0] == " " or RARE.search(text) else text.split(" ")


class Aligned:
    """The distinct stretches of a block: counts of each, its groups as text, and its links as pairs of ids. They are aligned
    PART at a time, so tokens and ends of a part only are held, and of the block what is kept of it."""

    def __init__(self, t: Tokenizers, rests: list[str]):
        parts = [Part(t, rests[i : i + PART]) for i in range(0, len(rests), PART)] or [Part(t, [])]
        joined = lambda name: np.concatenate([getattr(p, name) for p in parts])
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.links = map(joined, ("good", "n_a", "n_b", "n_groups", "n_links", "links"))
        self.shown = [x for p in parts for x in p.shown]


class Part:
    """Some stretches of a block, aligned at once."""

    def __init__(self, t: Tokenizers, rests: list[str]):
        n = len(rests)
        a, b, order, sizes = t.encode(rests)
        a_end, b_end, ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]), np.cumsum(sizes)
        in_a, in_b, first, many = overlaps(a_end, b_end)
        few_is_a = len(a_end) <= len(b_end)
        few, other = np.repeat(np.arange(len(first)), many), ranges(first, many)
        pairs = (a[few] << 32) | b[other] if few_is_a else (a[other] << 32) | b[few]
        # the stretch of a token, a group, a link: stretches end where both have an end
        a_upto, b_upto, g_upto = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right"), np.searchsorted(a_end[in_a], ends, "right")
        few_upto = a_upto if few_is_a else b_upto
        l_upto = np.concatenate(([0], np.cumsum(many)))[few_upto]
        self.good = np.zeros(n, bool)
        self.good[order] = True
        self.n_a, self.n_b, self.n_groups, self.n_links = (self._by_stretch(n, order, np.diff(u, prepend=0)) for u in (a_upto, b_upto, g_upto, l_upto))
        # links in order of the stretches' numbers
        rank = np.argsort(order, kind="stable")
        counts = np.diff(l_upto, prepend=0)
        self.links = pairs[ranges((l_upto - counts)[rank], counts[rank])] if len(order) else pairs
        self.shown = [""] * n
        a_text, b_text = [t.a_shown[i] for i in a.tolist()], [t.b_shown[i] for i in b.tolist()]
        a_cut, b_cut, g = (in_a + 1).tolist(), (in_b + 1).tolist(), g_upto.tolist()
        x = y = k = 0
        for i, last in zip(order.tolist(), g, strict=True):
            parts = []
            while k < last:
                parts.append(f"{','.join(a_text[x : a_cut[k]])}|{','.join(b_text[y : b_cut[k]])}")
                x, y, k = a_cut[k], b_cut[k], k + 1
            self.shown[i] = ";".join(parts)

    @staticmethod
    def _by_stretch(n: int, order: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[order] = counts
        return out


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, np.uint32), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * 4, codec="zstd", asbytes=True), np.uint32).astype(np.int64)


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


_TEXT = "struct<doc_id:bigint,n_words:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>"
_BLOCK = f"block long, pairs array<bigint>, times array<bigint>, stretch_links binary, n_stretches int, links binary, n_links long, words binary, n_words long, texts array<{_TEXT}>"


def _blocks(a_file: str, b_file: str, block_bytes: int):
    """Rows of (doc_id, text) -> rows of _BLOCK. `pairs` are the block's distinct pairs of ids with their `times`; `links` has
    for each distinct stretch its links as places in pairs (how many: `stretch_links`); `words` has the texts' stretches."""

    def block(t: Tokenizers, number: int, ids: list, texts: list[list[int]], known: Numbers) -> pa.RecordBatch:
        of = Aligned(t, list(known))
        words = [np.array(w, np.int64) for w in texts]
        words = [w if of.good[w].all() else w[:0] for w in words]
        sizes, flat = np.array([len(w) for w in words], np.int64), np.concatenate(words)
        used = np.bincount(flat, minlength=len(known))
        pairs, place = np.unique(of.links, return_inverse=True)
        times = np.bincount(place, weights=np.repeat(used, of.n_links), minlength=len(pairs)).astype(np.int64)
        sums = [_sums(x[flat], sizes) for x in (of.n_a, of.n_b, of.n_groups, of.n_links)]
        digests = [hashlib.sha256(";".join(map(of.shown.__getitem__, w.tolist())).encode()).hexdigest() if len(w) else "" for w in words]
        names = ["doc_id", "n_words", "n_a", "n_b", "n_groups", "n_links"]
        columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, *sums)), pa.array(digests, pa.string())]
        rows = pa.StructArray.from_arrays(columns, names=[*names, "groups_sha256"])
        values = [
            pa.array([number], pa.int64()), _list(pairs[times > 0], pa.int64()), _list(times[times > 0], pa.int64()), pa.array([_packed(of.n_links)]), pa.array([len(known)], pa.int32()),
            pa.array([_packed(np.where(times > 0, np.cumsum(times > 0) - 1, 0)[place])]), pa.array([len(place)], pa.int64()), pa.array([_packed(flat)]), pa.array([len(flat)], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), rows),
        ]
        return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in _BLOCK.split(", texts")[0].split(", ")] + ["texts"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizers(a_file, b_file), TaskContext.get().partitionId() << 24
        ids, texts, known, held = [], [], Numbers(), 0
        for batch, found in chunks(batches):
            ids += batch.column(0).to_pylist()
            texts += [list(map(known.__getitem__, cut(x.decode()))) if x else [] for x in found]
            held += sum(map(len, found))
            if held >= block_bytes:
                yield block(t, number, ids, texts, known)
                number, ids, texts, known, held = number + 1, [], [], Numbers(), 0
        if ids:
            yield block(t, number, ids, texts, known)

    return apply


def _answered(_block: tuple, answers: pa.Table, blocks: pa.Table) -> pa.Table:
    """The texts of one block, with sums over their links of the corpus-wide counts."""
    out = []
    place = answers.column("place").to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place], best[place] = answers.column("total").to_numpy(), answers.column("best").to_numpy()
    for row in range(blocks.num_rows):
        value = lambda c: blocks.column(c)[row].as_py()  # noqa: B023, E731
        texts = blocks.column("texts").combine_chunks().slice(row, 1).flatten()
        sizes = texts.field("n_words").to_numpy(zero_copy_only=False)
        links, words, per = _unpacked(value("links"), value("n_links")), _unpacked(value("words"), value("n_words")), _unpacked(value("stretch_links"), value("n_stretches"))
        sums = []
        for x in (best, total):
            of_links = x[links] if len(x) else np.zeros(len(links), np.int64)
            sums.append(pa.array(_sums(_sums(of_links, per)[words], sizes), pa.int64()))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        out.append(pa.Table.from_arrays([*(texts.field(c) for c in names), *sums, texts.field("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(out) if out else _NO_TEXTS.empty_table()


_NO_TEXTS = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def alignment(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Groups lie between byte offsets where tokens of both end; links are pairs of tokens whose bytes overlap. A pair of ids
    counts as often as it is linked in all texts; a link is best if its pair has the highest count of those with its B id.

    Null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and ''. Null ids stay null, repeated
    rows give equal rows and count again, an empty table gives an empty result, other columns are not read.

    Each text is encoded once. A block of block_bytes of text sends each of its distinct pairs once, so no pair has more
    rows than there are blocks; counts are added up before the shuffle too. The highest counts have a row per id of B's
    vocabulary at most, which bounds what is broadcast.
    """
    table = written(_narrow(docs, doc_id, text).mapInArrow(_blocks(a_file, b_file, block_bytes), _BLOCK), "alignment")
    pairs = table.select("block", F.posexplode(F.arrays_zip("pairs", "times"))).select("block", F.col("pos").alias("place"), F.col("col.pairs").alias("pair"), F.col("col.times").alias("times"))
    totals = written(pairs.groupBy("pair").agg(F.sum("times").alias("total")), "alignment-totals")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = F.broadcast(totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest")))
    known = totals.withColumn("b", b_id).join(highest, "b").select("pair", "total", F.when(F.col("total") == F.col("highest"), 1).otherwise(0).cast("long").alias("best"))
    answers = pairs.join(known, "pair").select("block", "place", "total", "best")
    texts = table.select(F.col("block").alias("of"), "stretch_links", "n_stretches", "links", "n_links", "words", "n_words", "texts")
    both = answers.groupBy("block").cogroup(texts.groupBy("of"))
    return both.applyInArrow(_answered, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, groups array<struct<a array<int>, b array<int>, end long>>): ids of A and B between common ends, and the byte
    offset in space+text where each group ends. No tokens: an empty array. No shuffle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_file, b_file)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())]))
        for batch, found in chunks(batches):
            out = []
            for x in found:
                a, b, order, _ = t.encode([x.decode()] if x else [])
                ends = np.cumsum(t.a_size[a])
                in_a, in_b, _, _ = overlaps(ends, np.cumsum(t.b_size[b])) if len(order) else (a, b, a, a)
                parts = zip(np.split(a, in_a + 1), np.split(b, in_b + 1), ends[in_a], strict=False)
                out.append([{"a": p.tolist(), "b": q.tolist(), "end": int(e)} for p, q, e in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "groups"])

    return _narrow(docs, doc_id, text).mapInArrow(apply, "doc_id long, groups array<struct<a:array<int>,b:array<int>,end:bigint>>")
