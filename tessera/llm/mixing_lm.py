"""LM scoring by online logistic context mixing.

A token is coded as bits. Where training texts had its two last words before, a first bit says whether the word that
came most often after them comes again. If not, ten bits spell the word's class, which is the hashed ending of it, and
one weighted choice says which word of that class it is. Each bit is predicted from several hashed contexts (the two
words before; no class, the class before, the one before that) and from what the same text had so far. A gate picks the
weights that mix the predictions, and an adaptive map refines the mixed probability.

Counts of words and of what follows two words grow with the corpus. They are never in one place: texts are packed in
blocks, each block sends its sorted keys to slices of the key space, and each slice adds up and answers every block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fold, text_bytes, written

LEVELS = 10
CLASSES = 1 << LEVELS
END = 0  # the class of the end of a text, and of what is before its start; words have those from 1 on
BACK = (0, 1, 2)  # the class contexts: none, and the class of the word 1 or 2 before
OWN_LEVELS = 4  # of the bits that the text's own history predicts
INPUTS = len(BACK) + 2  # and a constant
AGES = np.array([0, 3, 20, 100])  # gates of class bits: the level and how far into the text
GATES = LEVELS * len(AGES)
RUNS, SEEN = np.array([0, 1, 2, 4, 16]), np.array([0, 2, 3, 8])  # gates of the first bit: hits in a row before, and how often the context was seen
FIRST_GATES, FIRST_INPUTS = len(RUNS) * len(SEEN), 3
BUCKETS = 33
PRIOR = 0.4
#: Counts that a code of one byte stands for: all up to 64, then six to each doubling, up to 2 ** 38.
COUNTS = np.array([*range(64), *(int(64 * 2 ** (i / 6)) for i in range(192))], np.int64)
LOGS, FEW = np.log(COUNTS + PRIOR), np.minimum(COUNTS, SEEN[-1])
SEEN_GATE = np.searchsorted(SEEN, np.arange(2 * SEEN[-1] + 1), "right") - 1
#: Bits of a key that tell the context, and the word after it.
CONTEXT_BITS, NEXT_BITS = 40, 24
TRAINING, HELD, TUNING = 0, 1, 2
#: Training rows from which the weights start, tuned against the counts of the others: at most so many, and this share of all.
MAX_TUNING, TUNING_SHARE = 2000, 8
BLOCK_BYTES, SLICE_BYTES = 4 << 20, 4 << 20
BLOCK = "block long, kind int, doc_ids array<long>, n_bytes binary, n_total long, texts binary"


class Endings(dict):
    """The last three characters of a word -> their hash, as a class."""

    def __missing__(self, end: str) -> int:
        value = self[end] = 1 + xxhash.xxh32_intdigest(end.encode()) % (CLASSES - 1)
        return value


def endings(words: list[bytes]) -> list[int]:
    """The class of each word: the hash of its last three characters, without punctuation behind them."""
    known = Endings()
    return [known[(w.rstrip(".,;:!?") or w)[-3:]] for w in b" ".join(words).decode().split(" ")] if words else []


def _planes(x: np.ndarray) -> bytes:
    """Packed numbers, byte by byte of all of them, so that bytes that are mostly 0 cost nothing."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1) if len(x) else b""


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _deltas(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _undeltas(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unplanes(data, kind), dtype=kind)


def _list(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _unlist(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(data, np.int64, n, 8)) + 8 + 8 * n
    return [data[a:b] for a, b in zip([8 + 8 * n, *ends[:-1]], ends, strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for about BLOCK_BYTES of texts of one kind (training, held out, tuning): their words, and whose they are."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[list] = [[], [], []]

    def row(kind: int) -> pa.RecordBatch:
        ids, texts = zip(*held[kind], strict=True)
        packed = zstandard.compress(b"\n".join(b" ".join(t.lower().split()) for t in texts), 6)
        size = np.array([len(t) for t in texts], np.int64)
        data = {"block": (part << 24) + seq, "kind": kind, "doc_ids": list(ids), "n_bytes": size.tobytes(), "n_total": int(size.sum()), "texts": packed}
        return pa.RecordBatch.from_pylist([data], schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.binary()), ("n_total", pa.int64()), ("texts", pa.binary())]))

    sizes = [0, 0, 0]
    for batch in batches:
        for doc_id, kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            held[kind].append((doc_id, text))
            sizes[kind] += len(text)
            if sizes[kind] >= BLOCK_BYTES:
                yield row(kind)
                held[kind], sizes[kind], seq = [], 0, seq + 1
    for kind in (TRAINING, HELD, TUNING):
        if held[kind]:
            yield row(kind)
            seq += 1


class Words:
    """The words of a block: all tokens as places in the list of different words, by text; each text has an end."""

    def __init__(self, texts: bytes):
        texts = pa.array(zstandard.decompress(texts).split(b"\n"), pa.large_binary())
        split = pc.split_pattern(texts, b" ")
        known = split.flatten()
        # an empty text is split into one empty word
        known = known.filter(pc.greater(pc.binary_length(known), 0)).dictionary_encode()
        self.sizes = (pc.list_value_length(split).to_numpy() * (pc.binary_length(texts).to_numpy() > 0) + 1).astype(np.int32)
        self.ids = np.zeros(int(self.sizes.sum()), np.int32)
        inner = np.ones(len(self.ids), bool)
        inner[np.cumsum(self.sizes, dtype=np.int64) - 1] = False
        self.ids[inner] = known.indices.to_numpy() + 1
        words = [b"\n", *known.dictionary.to_numpy(zero_copy_only=False).tolist()]
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.cls = np.array([END, *endings(words[1:])], np.int32)[self.ids]
        self._placed()

    def _placed(self) -> None:
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.place = np.arange(len(self.cls), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)

    def contexts(self) -> np.ndarray:
        """CONTEXT_BITS of the hash of the two words before each token; before the start of a text, ends are thought."""
        h = self.hashes[self.ids]
        one, two = np.full(len(h), self.hashes[0]), np.full(len(h), self.hashes[0])
        one[1:] = np.where(self.place[1:] >= 1, h[:-1], one[1:])
        two[2:] = np.where(self.place[2:] >= 2, h[:-2], two[2:])
        x = (two * np.uint64(0x9E3779B97F4A7C15) + one) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CONTEXT_BITS)

    def next_word(self) -> np.ndarray:
        """The NEXT_BITS that tell a word after a context: the first bits of its hash."""
        return self.hashes[self.ids] >> np.uint64(64 - NEXT_BITS)

    def before(self, k: int) -> np.ndarray:
        """The class k words before; END before the start."""
        out = np.full(len(self.cls), END, np.int32)
        if k < len(self.cls):
            out[k:] = np.where(self.place[k:] >= k, self.cls[:-k], END)
        return out


def _cuts(keys: np.ndarray, bits: int, slices: int) -> np.ndarray:
    """Where each slice starts in sorted keys of so many bits: slice i has those with key * slices >> bits == i."""
    starts = np.array([-(-(i << bits) // slices) for i in range(slices)], np.uint64)
    return np.r_[np.searchsorted(keys, starts), len(keys)]


def _requests(slices: int, pieces: int):
    """(slice, block, kind, words, pairs): of each block the sorted hashes of its words, with their number in training rows,
    and the sorted (context, next word) keys, with theirs; held-out blocks ask for contexts alone. After the slices come
    the pieces of the class tables, added up in the task: of training blocks, and of tuning blocks."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, len(BACK), CLASSES * CLASSES), np.int32)
        used = [False, False]
        for batch in batches:
            for block, kind, texts in zip(*(batch.column(i) for i in range(3)), strict=True):
                block, kind, w = block.as_py(), kind.as_py(), Words(texts.as_py())
                n = np.bincount(w.ids, minlength=len(w.hashes)) if kind != HELD else np.zeros(len(w.hashes), np.int64)
                order = np.argsort(w.hashes)
                hashes, n = w.hashes[order], n[order].astype(np.uint32)
                keys = w.contexts() << np.uint64(NEXT_BITS)
                if kind == HELD:
                    keys, times = np.unique(keys), None
                else:
                    keys, times = np.unique(keys | w.next_word(), return_counts=True)
                    times = times.astype(np.uint32)
                    which = int(kind == TUNING)
                    used[which] = True
                    for t, k in zip(tables[which], BACK, strict=True):
                        t += np.bincount((w.before(k) if k else 0) * CLASSES + w.cls, minlength=CLASSES * CLASSES).astype(np.int32)
                a, b = _cuts(hashes, 64, slices), _cuts(keys, CONTEXT_BITS + NEXT_BITS, slices)
                rows = [(i, block, kind, _list([_deltas(hashes[a[i] : a[i + 1]]), _planes(n[a[i] : a[i + 1]])]), _list([_deltas(keys[b[i] : b[i + 1]]), _planes(times[b[i] : b[i + 1]]) if times is not None else b""])) for i in range(slices) if a[i] < a[i + 1] or b[i] < b[i + 1]]
                yield _rows(rows)
        for which, kind in ((0, TRAINING), (1, TUNING)):
            if used[which]:
                yield _rows([(slices + i, 0, kind, _planes(x), b"") for i, x in enumerate(np.split(tables[which].reshape(-1), pieces))])

    return apply


REQUEST = "slice int, block long, kind int, words binary, pairs binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "block", "kind", "words", "pairs"])


def coded(count: np.ndarray) -> np.ndarray:
    """The code of the largest of COUNTS that isn't above each count. Small counts are exact, others within an eighth."""
    return (np.searchsorted(COUNTS, count, "right") - 1).astype(np.uint8)


class Successors:
    """By context: how often it was seen, and the word that came most often after it (of equal ones the smallest key).

    Above the NEXT_BITS of that word stands what becomes of it when it comes once less: 0 it stays, 1 another takes its
    place that came once less too, 2 another that came as often as it did before."""

    def __init__(self, keys: list[np.ndarray], times: list[np.ndarray]):
        key, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([np.zeros(0), *times]), minlength=len(key)).astype(np.int64)
        context = key >> np.uint64(NEXT_BITS)
        start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.context = context[start]
        self.total = np.add.reduceat(n, start) if len(start) else n
        order = np.lexsort((key, -n, context))
        best, more = order[start] if len(start) else start, np.diff(start, append=len(key)) > 1
        second = order[start[more] + 1]
        after = np.zeros(len(start), np.uint32)
        after[more] = np.where(n[second] == n[best[more]], 2, (n[second] == n[best[more]] - 1) & (second < best[more]))
        self.top, self.times = (key[best] & np.uint64((1 << NEXT_BITS) - 1)).astype(np.uint32) | after << np.uint32(NEXT_BITS), n[best]

    def answer(self, asked: np.ndarray, least: int) -> bytes:
        """Of the contexts asked for that were seen `least` times or more: place, next word, and the codes of both counts."""
        at = np.minimum(np.searchsorted(self.context, asked), max(len(self.context) - 1, 0))
        known = (self.context[at] == asked) & (self.total[at] >= least) if len(self.context) else np.zeros(len(asked), bool)
        at, place = at[known] if len(self.context) else np.zeros(0, np.int64), np.flatnonzero(known).astype(np.uint32)
        return _list([np.int64(len(asked)).tobytes(), _deltas(place), _planes(self.top[at]), _planes(coded(self.times[at])), _planes(coded(self.total[at] - self.times[at]))])


def _answers(slices: int):
    """A slice's sums, sent back to every block that asked. Row -1 has what all words of the slice say together, rows -2 and
    -3 the sums of a piece of the class tables, of all training rows and of those that don't tune."""

    def apply(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = key[0].as_py()
        if number >= slices:
            sums = [0, 0]
            for batch in batches:
                for kind, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x = _unplanes(data, np.int32).astype(np.int64)
                    sums = [sums[0] + x, sums[1] + x * (kind == TRAINING)]
            yield _rows([(number - slices, row, 0, _planes(x), b"") for row, x in zip((-2, -3), sums, strict=True)])
            return
        rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True)]
        words, pairs = [[_unlist(x) for x in c] for c in list(zip(*rows, strict=True))[2:]]
        hashes, n = [_undeltas(h, np.uint64) for h, _ in words], [_unplanes(c, np.uint32) for _, c in words]
        one, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(n), minlength=len(one)).astype(np.int64)
        _, same = np.unique(one >> np.uint64(64 - NEXT_BITS), return_inverse=True)
        others = np.bincount(same, weights=total)[same].astype(np.int64) - total if len(one) else total
        keys, times = [_undeltas(k, np.uint64) for k, _ in pairs], [_unplanes(c, np.uint32) for _, c in pairs]
        kinds = [r[1] for r in rows]
        everything = Successors([k for k, c in zip(keys, kinds, strict=True) if c != HELD], [t for t, c in zip(times, kinds, strict=True) if c != HELD])
        base = Successors([k for k, c in zip(keys, kinds, strict=True) if c == TRAINING], [t for t, c in zip(times, kinds, strict=True) if c == TRAINING]) if TUNING in kinds else everything
        yield _rows([(number, -1, 0, np.array([total.sum(), (total > 0).sum(), (total == 1).sum()], np.int64).tobytes(), b"")])
        end = np.cumsum([len(h) for h in hashes])
        for (block, kind, *_), h, e, k in zip(rows, hashes, end, keys, strict=True):
            mine = back[e - len(h) : e]
            # a training text knows its own contexts, so those that only one text had are for the others
            found = (base if kind == TUNING else everything).answer(np.unique(k >> np.uint64(NEXT_BITS)), 2 if kind == TRAINING else 1)
            yield _rows([(number, block, kind, _list([_planes(total[mine].astype(np.uint64)), _planes(others[mine].astype(np.uint64))]), found)])

    return apply


class Answered(Words):
    """A block with its answers: count of each token's word, its share among words with the same NEXT_BITS, and what the
    two words before it let expect: known (0 or 1), hit (0 or 1), and the codes of the counts times and rest."""

    def __init__(self, row: dict):
        super().__init__(row["texts"])
        self.doc_ids, self.kind = row["doc_ids"], row["kind"]
        self.n_bytes = np.frombuffer(row["n_bytes"], np.int64)
        parts = sorted(row["answers"], key=lambda a: a["slice"])
        words = [_unlist(a["words"]) for a in parts]
        count, others = (np.concatenate([_unplanes(w[i], np.uint64) for w in words]).astype(np.int64) for i in (0, 1))
        at = np.empty(len(count), np.int64)
        at[np.argsort(self.hashes)] = np.arange(len(count))
        self.count, self.others = count[at][self.ids], others[at][self.ids]
        self._shared()
        _, mine = np.unique(self.contexts(), return_inverse=True)
        top, times, rest, base = np.full(int(mine.max()) + 1, -1, np.int64), np.zeros(int(mine.max()) + 1, np.uint8), np.zeros(int(mine.max()) + 1, np.uint8), 0
        for a in parts:
            n, place, word, t, r = _unlist(a["pairs"])
            place = _undeltas(place, np.uint32).astype(np.int64) + base
            top[place], times[place], rest[place] = _unplanes(word, np.uint32), _unplanes(t, np.uint8), _unplanes(r, np.uint8)
            base += int(np.frombuffer(n, np.int64)[0])
        self.known = (top[mine] >= 0).astype(np.int8)
        self.after = (np.maximum(top, 0) >> NEXT_BITS).astype(np.uint8)[mine]
        top = np.where(top >= 0, top & ((1 << NEXT_BITS) - 1), -1)
        self.hit = ((top[mine] == self.next_word().astype(np.int64)) & (self.count > 0)).astype(np.int8)
        self.times, self.rest = times[mine], rest[mine]


    def _shared(self) -> None:
        self.share = np.divide(self.count, self.count + self.others, out=np.ones(len(self.count)), where=self.count > 0)

    def packed(self) -> bytes:
        """What Packed reads: the tokens without their words."""
        return _list([_planes(getattr(self, c).astype(kind)) for c, kind in Packed.COLUMNS])


class Packed(Answered):
    """An answered block as it was packed by the pass that learns, so that scoring needn't split and look up its words again."""

    COLUMNS = (("sizes", np.int32), ("cls", np.int16), ("known", np.int8), ("hit", np.int8), ("times", np.uint8), ("rest", np.uint8), ("count", np.int64), ("others", np.int64))

    def __init__(self, row: dict):
        self.doc_ids, self.kind = row["doc_ids"], row["kind"]
        self.n_bytes = np.frombuffer(row["n_bytes"], np.int64)
        for (c, kind), data in zip(self.COLUMNS, _unlist(row["tokens"]), strict=True):
            setattr(self, c, _unplanes(data, kind))
        self.cls = self.cls.astype(np.int32)
        self._placed()
        self._shared()


#: What the mixer reads of each token.
COLUMNS = ("cls", "back1", "back2", "doc", "place", "known", "hit", "times", "rest")


class Tokens:
    """Tokens of whole texts as the mixer reads them."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.__dict__.update(columns)

    @classmethod
    def of(cls, b: Answered) -> Tokens:
        return cls({"back1": b.before(1), "back2": b.before(2), **{c: getattr(b, c) for c in COLUMNS if not c.startswith("back")}})

    @classmethod
    def without_own(cls, b: Answered) -> Tokens:
        """Of a training block, as counts without the token itself would have it."""
        t = cls.of(b)
        less = lambda code: code - ((code > 0) & (code < 64))  # noqa: E731 - one less hardly changes what larger codes stand for
        hit, as_often = t.hit == 1, (t.hit == 1) & (b.after == 2)
        t.times = np.where(hit & ~as_often, less(t.times), t.times).astype(np.uint8)
        t.rest = np.where(hit & ~as_often, t.rest, less(t.rest)).astype(np.uint8)
        t.hit = (hit & (b.after == 0)).astype(np.int8)
        return t

    def part(self, a: int, b: int) -> Tokens:
        return Tokens({c: getattr(self, c)[a:b] for c in COLUMNS})


def parts(sizes: np.ndarray, tokens: int = 1 << 17) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end, first token, end): parts of whole texts of about so many tokens, so what is computed stays small."""
    ends = np.cumsum(sizes, dtype=np.int64)
    d = t = 0
    while d < len(ends):
        e = max(d + 1, int(np.searchsorted(ends, t + tokens, "right")))
        yield d, e, t, int(ends[e - 1])
        d, t = e, int(ends[e - 1])


def history(doc: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """ln(p / (1 - p)) of a 1, by the bits before in the same text; doc is sorted."""
    if not len(bit):
        return np.zeros(0, np.float32)
    ones, seen = np.cumsum(bit) - bit, np.arange(len(bit))
    origin = np.maximum.accumulate(np.where(np.r_[True, doc[1:] != doc[:-1]], seen, 0))
    ones, seen = ones - ones[origin], seen - origin
    return np.log((ones + PRIOR) / (seen - ones + PRIOR)).astype(np.float32)


def stretched(counts: np.ndarray) -> np.ndarray:
    """(context table, class before, node) -> ln(p / (1 - p)) of the bit after node, from counts of (class before, class)."""
    sums = np.concatenate([np.zeros((*counts.shape[:2], 1), np.int64), np.cumsum(counts, axis=2)], axis=2)
    out = np.zeros(counts.shape, np.float32)
    for level in range(LEVELS):
        edges = np.arange(0, CLASSES + 1, CLASSES >> (level + 1))
        n = np.diff(sums[:, :, edges], axis=2)
        out[:, :, 1 << level : 2 << level] = np.log((n[:, :, 1::2] + PRIOR) / (n[:, :, ::2] + PRIOR))
    return out


def left_out(counts: np.ndarray) -> np.ndarray:
    """`stretched` for tokens that are among the counts, each without its own: (context table, bit, class before, node)."""
    sums = np.concatenate([np.zeros((*counts.shape[:2], 1), np.int64), np.cumsum(counts, axis=2)], axis=2)
    out = np.zeros((len(counts), 2, *counts.shape[1:]), np.float32)
    for level in range(LEVELS):
        n = np.diff(sums[:, :, np.arange(0, CLASSES + 1, CLASSES >> (level + 1))], axis=2)
        ones, zeros = n[:, :, 1::2], n[:, :, ::2]
        out[:, 0, :, 1 << level : 2 << level] = np.log((ones + PRIOR) / (np.maximum(zeros - 1, 0) + PRIOR))
        out[:, 1, :, 1 << level : 2 << level] = np.log((np.maximum(ones - 1, 0) + PRIOR) / (zeros + PRIOR))
    return out


class Sums:
    """What tokens add up to at given weights: gradients and Hessians by gate, and the maps. They are one vector, so that the
    sums of tasks can be added up."""

    SHAPES = ((GATES, INPUTS), (GATES, INPUTS, INPUTS), (FIRST_GATES, FIRST_INPUTS), (FIRST_GATES, FIRST_INPUTS, FIRST_INPUTS), (LEVELS + 1, BUCKETS, 2))

    def __init__(self, values: np.ndarray | None = None):
        ends = np.cumsum([int(np.prod(x)) for x in self.SHAPES])
        self.values = np.zeros(ends[-1]) if values is None else values
        self.gradient, self.hessian, self.first, self.first_hessian, self.refine = (x.reshape(n) for x, n in zip(np.split(self.values, ends[:-1]), self.SHAPES, strict=True))


class Mixer:
    """Weights and refining maps. `learn` goes through texts once, predicting before it adjusts. `add` and `adjusted` do the
    same with all texts at once, wherever they are."""

    def __init__(self) -> None:
        self.weights = np.zeros((GATES, INPUTS))
        self.weights[:, 1 : len(BACK)] = 0.4
        self.hessian = np.tile(np.eye(INPUTS) * 50.0, (GATES, 1, 1))
        self.first = np.zeros((FIRST_GATES, FIRST_INPUTS))
        self.first[:, 0] = 0.8
        self.first_hessian = np.tile(np.eye(FIRST_INPUTS) * 20.0, (FIRST_GATES, 1, 1))
        self.refine = np.ones((LEVELS + 1, BUCKETS, 2))

    def state(self) -> bytes:
        return np.concatenate([self.weights.ravel(), self.first.ravel(), self.refine.ravel()]).tobytes()

    @classmethod
    def load(cls, state: bytes) -> Mixer:
        m, x = cls(), np.frombuffer(state)
        a, b = m.weights.size, m.weights.size + m.first.size
        m.weights, m.first, m.refine = x[:a].reshape(m.weights.shape), x[a:b].reshape(m.first.shape), x[b:].reshape(m.refine.shape)
        return m

    @staticmethod
    def first_bits(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens with a known context, predictions, bit, gate)."""
        at = np.flatnonzero(t.known)
        hits = np.where(t.known == 1, t.hit, 0)
        broken = np.maximum.accumulate(np.where((hits == 0) | (t.place == 0), np.arange(len(hits)), 0)) if len(hits) else hits
        ended = np.r_[0, (np.arange(len(hits)) - broken + ((hits == 1) & (t.place == 0)))[:-1]]
        run = np.where(t.place > 0, ended[: len(hits)], 0)[at]
        x = np.empty((FIRST_INPUTS, len(at)), np.float32)
        times, rest = t.times[at], t.rest[at]
        x[0] = LOGS[times] - LOGS[rest]
        x[1] = history(t.doc[at], t.hit[at].astype(np.int64))
        x[2] = 0.3
        gate = (np.searchsorted(RUNS, run, "right") - 1) * len(SEEN) + SEEN_GATE[FEW[times] + FEW[rest]]
        return at, x, t.hit[at].astype(np.int64), gate

    @staticmethod
    def class_bits(t: Tokens, tables: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(predictions, bit, gate) of all tokens at one level."""
        node = (t.cls >> (LEVELS - level)) | (1 << level)
        bit = ((t.cls >> (LEVELS - 1 - level)) & 1).astype(np.int64)
        x = np.empty((INPUTS, len(t.cls)), np.float32)
        for i, k in enumerate(BACK):
            x[i] = tables[i][(0, t.back1, t.back2)[k], node]
        x[len(BACK)] = Mixer.own(t, level) if level < OWN_LEVELS else 0
        x[-1] = 0.3
        return x, bit, level * len(AGES) + np.searchsorted(AGES, t.place, "right") - 1

    @staticmethod
    def mix(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(x.shape[1])
        for i in range(len(x)):
            z += weights[gate, i] * x[i]
        return np.clip(z, -20, 20)

    @staticmethod
    def bucket(z: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(z * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)

    def refined(self, which: int, z: np.ndarray) -> np.ndarray:
        """The mixed probability of a 1, averaged with how often a 1 came at such a mixed value."""
        n = self.refine[which]
        return (1 / (1 + np.exp(-z)) + (n[:, 1] / n.sum(axis=1))[self.bucket(z)]) / 2

    def _adjust(self, weights: np.ndarray, hessian: np.ndarray, which: int, x: np.ndarray, bit: np.ndarray, gate: np.ndarray) -> None:
        z = self.mix(weights, x, gate)
        p = 1 / (1 + np.exp(-z))
        for g in np.unique(gate):
            s = np.flatnonzero(gate == g)
            xs = x[:, s].astype(np.float64)
            hessian[g] += (xs * (p[s] * (1 - p[s]))) @ xs.T
            weights[g] += np.linalg.solve(hessian[g], xs @ (bit[s] - p[s]))
        self.refine[which] += np.bincount(self.bucket(z) * 2 + bit, minlength=2 * BUCKETS).reshape(BUCKETS, 2)

    def learn(self, t: Tokens, tables: np.ndarray) -> None:
        _, x, bit, gate = self.first_bits(t)
        self._adjust(self.first, self.first_hessian, LEVELS, x, bit, gate)
        for level in range(LEVELS):
            self._adjust(self.weights, self.hessian, level, *self.class_bits(t, tables, level))

    def add(self, t: Tokens, tables: np.ndarray, sums: Sums) -> None:
        """Adds to sums what these tokens say at the weights at hand."""
        _, x, bit, gate = self.first_bits(t)
        z = self.mix(self.first, x, gate)
        order = np.argsort(gate, kind="stable")
        edges = np.searchsorted(gate[order], np.arange(FIRST_GATES + 1))
        self._sum(sums.first, sums.first_hessian, 0, edges, x[:, order].astype(np.float64), bit[order], z[order])
        sums.refine[LEVELS] += np.bincount(self.bucket(z) * 2 + bit, minlength=2 * BUCKETS).reshape(BUCKETS, 2)
        for level, _, edges, x, bit, z in self.levels(t, tables):
            self._sum(sums.gradient, sums.hessian, level * len(AGES), edges, x, bit, z)
            sums.refine[level] += np.bincount(self.bucket(z) * 2 + bit, minlength=2 * BUCKETS).reshape(BUCKETS, 2)

    @staticmethod
    def _sum(gradient: np.ndarray, hessian: np.ndarray, start: int, edges: np.ndarray, x: np.ndarray, bit: np.ndarray, z: np.ndarray) -> None:
        p = 1 / (1 + np.exp(-z))
        off, bent = bit - p, x * (p * (1 - p))
        for g, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            gradient[start + g] += x[:, a:b] @ off[a:b]
            hessian[start + g] += bent[:, a:b] @ x[:, a:b].T

    def adjusted(self, sums: Sums) -> Mixer:
        """The mixer after one Newton step over all texts that were added; new weights pull as in `learn`. The maps are theirs."""
        new, out = Mixer(), Mixer()
        for name, gradient, hessian in (("weights", sums.gradient, sums.hessian), ("first", sums.first, sums.first_hessian)):
            pull, w = getattr(new, "hessian" if name == "weights" else "first_hessian"), getattr(self, name)
            off = gradient - np.einsum("gij,gj->gi", pull, w - getattr(new, name))
            setattr(out, name, w + np.linalg.solve(hessian + pull, off[:, :, None])[:, :, 0])
        out.refine = new.refine + sums.refine
        return out

    def levels(self, t: Tokens, tables: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, order, edges, predictions, bit, mixed) of the class bits, with the tokens in order of their age, which is at
        edges. tables: of `stretched`, or of `left_out`."""
        age = np.searchsorted(AGES, t.place, "right") - 1
        order = np.argsort(age.astype(np.int8), kind="stable")
        edges = np.searchsorted(age[order], np.arange(len(AGES) + 1))
        cls, flat = t.cls[order], tables.reshape(len(BACK), -1)
        before = [0, *(np.multiply(b[order], CLASSES, dtype=np.int64) for b in (t.back1, t.back2))]
        for level in range(LEVELS):
            node = (cls >> (LEVELS - level)) | (1 << level)
            bit = ((cls >> (LEVELS - 1 - level)) & 1).astype(np.int64)
            at = node + bit * (CLASSES * CLASSES) if tables.ndim == 4 else node
            x = np.empty((INPUTS, len(cls)))
            for i, k in enumerate(BACK):
                x[i] = flat[i].take(at + before[k])
            x[len(BACK)] = self.own(t, level)[order] if level < OWN_LEVELS else 0
            x[-1] = 0.3
            z = np.empty(len(cls))
            for w, a, b in zip(self.weights[level * len(AGES) :], edges, edges[1:], strict=False):
                z[a:b] = w @ x[:, a:b]
            yield level, order, edges, x, bit, np.clip(z, -20, 20)

    @staticmethod
    def own(t: Tokens, level: int) -> np.ndarray:
        """What the text's own history predicts of the bit at one level."""
        node, out = (t.cls >> (LEVELS - level)) | (1 << level), np.zeros(len(t.cls), np.float32)
        bit = ((t.cls >> (LEVELS - 1 - level)) & 1).astype(np.int64)
        for v in range(1 << level, 2 << level):
            here = np.flatnonzero(node == v)
            out[here] = history(t.doc[here], bit[here])
        return out

    def score(self, t: Tokens, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln of the probability that the first bit of each token has (1 without one), and of its class bits."""
        at, x, bit, gate = self.first_bits(t)
        p = self.refined(LEVELS, self.mix(self.first, x, gate))
        first = np.zeros(len(t.cls))
        first[at] = np.log(np.where(bit == 1, p, 1 - p))
        rest, product = np.zeros(len(t.cls)), np.ones(len(t.cls))
        for level, order, _, _, bit, z in self.levels(t, tables):
            p = self.refined(level, z)
            product *= np.where(bit == 1, p, 1 - p)  # ten numbers of 1e-12 or more
        rest[order] = np.log(product)
        return first, rest


def _tuning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tuning text: what the mixer reads of it."""
    for batch in batches:
        for r in range(batch.num_rows):
            b = Answered({c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)})
            t = Tokens.of(b)
            at = np.r_[0, np.cumsum(b.sizes)]
            rows = [[int(d) if d is not None else None, _list([_planes(getattr(t.part(i, j), c)) for c in COLUMNS])] for d, i, j in zip(b.doc_ids, at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], names=["doc_id", "tokens"])


KINDS = (np.int32, np.int32, np.int32, np.int32, np.int32, np.int8, np.int8, np.uint8, np.uint8)


def _fit(counts: object):
    """The mixer after going twice through the tuning texts, in the order of their ids; the maps count the second time."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, m = stretched(_class_counts(counts.value)), Mixer()
        texts = [[_unplanes(x, kind) for x, kind in zip(_unlist(d), KINDS, strict=True)] for batch in batches for d in batch.column(1).to_pylist()]
        for i, t in enumerate(texts):
            t[COLUMNS.index("doc")] = np.full(len(t[0]), i, np.int32)
        sizes = np.array([len(t[0]) for t in texts], np.int64)
        for _ in range(2):
            m.refine = np.ones_like(m.refine)
            for d, e, _, _ in parts(sizes):
                m.learn(Tokens({c: np.concatenate([t[i] for t in texts[d:e]]) for i, c in enumerate(COLUMNS)}), tables)
        yield pa.RecordBatch.from_arrays([pa.array([m.state()], pa.binary())], names=["state"])

    return apply


ADDED = "i int, v double, kind int, doc_ids array<long>, n_bytes binary, tokens binary"


def _added(shared: object):
    """A row for each block, as Packed reads it; then (i, v), the vector of Sums over the task's blocks. Training blocks are
    seen by counts without the token itself, tuning blocks by the counts of the others."""
    types = (pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())

    def rows(n: int, *columns: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["i", "v", "kind", "doc_ids", "n_bytes", "tokens"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, *packed = shared.value
        m, sums, tables = Mixer.load(state) if state else Mixer(), Sums(), {}
        for batch in batches:
            for r in range(batch.num_rows):
                b = Answered({c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)})
                if b.kind not in tables:
                    tables[b.kind] = stretched(_class_counts(packed[1])) if b.kind == TUNING else left_out(_class_counts(packed[0]))
                t = Tokens.of(b) if b.kind == TUNING else Tokens.without_own(b)
                for _, _, i, j in parts(b.sizes):
                    m.add(t.part(i, j), tables[b.kind], sums)
                yield rows(1, None, None, [b.kind], [b.doc_ids], [b.n_bytes.tobytes()], [b.packed()])
        if tables:
            yield rows(len(sums.values), np.arange(len(sums.values)), sums.values, None, None, None, None)

    return apply


def _class_counts(packed: list[bytes]) -> np.ndarray:
    flat = np.concatenate([_unplanes(x, np.int64) for x in packed]) if packed else np.zeros(len(BACK) * CLASSES * CLASSES, np.int64)
    return flat.reshape(len(BACK), CLASSES, CLASSES)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _scorer(shared: object, total: int, distinct: int, once: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, packed = shared.value
        counts = _class_counts(packed)
        tables, m, size = stretched(counts), Mixer.load(state) if state else Mixer(), np.maximum(counts[0, 0], 1)
        unseen = (once + 1) / (total + 2)  # the share of new words among all, as Good and Turing estimate it
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
                b = Answered(row) if "answers" in row else Packed(row)
                t, token = Tokens.of(b), np.zeros(len(b.cls))
                for _, _, i, j in parts(b.sizes):
                    first, rest = m.score(t.part(i, j), tables)
                    n, cls = b.count[i:j], b.cls[i:j]
                    word = np.where(cls == END, 0.0, np.where(n > 0, np.log1p(-unseen) + np.log(np.maximum(n, 1)) - np.log(size[cls]), np.log(unseen)))
                    hit = (b.known[i:j] == 1) & (b.hit[i:j] == 1)
                    token[i:j] = first + np.where(hit, np.log(b.share[i:j]), rest + word)
                base = np.log10((b.count + 0.5) / (total + 0.5 * (distinct + 1)))
                per_doc = lambda x, docs=b.doc, n=len(b.sizes): np.bincount(docs, weights=x, minlength=n)
                score = per_doc(token) / np.log(10)
                bits = np.divide(-score * np.log2(10), b.n_bytes, out=np.full(len(score), np.nan), where=b.n_bytes > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.doc_ids, pa.int64()), pa.array(np.full(len(score), b.kind == HELD)), pa.array(b.sizes.astype(np.int64)), pa.array(per_doc(b.count > 0).astype(np.int64)), pa.array(np.full(len(score), total)), pa.array(per_doc(base)), pa.array(score), pa.array(b.n_bytes), pa.array(bits, from_pandas=True)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
                )

    return apply


class Counted(NamedTuple):
    sums: tuple[int, int, int]  # tokens of training rows, different ones, those that came once
    classes: list[bytes]  # pieces of the class tables of all training rows
    base: list[bytes]  # and of those that don't tune
    tuning: int  # how many ids tune
    blocks: DataFrame
    answers: DataFrame

    @property
    def ready(self) -> DataFrame:
        """The blocks, each with its answers."""
        return _with_answers(self.blocks, self.answers)

    def of(self, *kinds: int) -> DataFrame:
        """The blocks of these kinds with their answers; only those are shuffled."""
        return _with_answers(self.blocks.filter(F.col("kind").isin(*kinds)), self.answers.filter(F.col("kind").isin(*kinds)))


def _with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    of_block = answers.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("slice", "words", "pairs")).alias("answers"))
    return blocks.select("block", "kind", "doc_ids", "n_bytes", "texts").join(of_block, "block")


def counted(rows: DataFrame) -> Counted:
    """All counts of rows (doc_id, held, text): texts as blocks, and what each block needs to know of all others."""
    place = F.xxhash64("doc_id", F.lit("tuning"))
    ids = rows.filter("NOT held AND doc_id IS NOT NULL").select(place.alias("place")).distinct()
    # a narrow job over ids: the hash up to which training rows tune
    tuning = min(MAX_TUNING, ids.count() // TUNING_SHARE)
    last = ids.orderBy("place").limit(tuning).agg(F.max("place")).first()[0] if tuning else None
    tunes = F.lit(False) if last is None else F.col("doc_id").isNotNull() & (place <= last)
    kinds = rows.select("doc_id", F.when(F.col("held"), HELD).when(tunes, TUNING).otherwise(TRAINING).cast("int").alias("kind"), "text")
    blocks = written(kinds.mapInArrow(_blocks, BLOCK), "lm-blocks")
    size = blocks.agg(F.sum("n_total")).first()[0] or 0
    slices, pieces = max(64, -(-size // SLICE_BYTES)), 3 * min(1024, 1 << max(4, (size // (64 << 20)).bit_length()))
    asked = blocks.select("block", "kind", "texts").mapInArrow(_requests(slices, pieces), REQUEST)
    answers = written(asked.groupBy("slice").applyInArrow(_answers(slices), REQUEST), "lm-answers")
    sums = [np.frombuffer(bytes(r["words"]), np.int64) for r in answers.filter("block = -1").select("words").collect()]  # three numbers a slice
    # tables of fixed size, whatever the corpus: three of CLASSES * CLASSES counts
    packed = {row: [bytes(r["words"]) for r in answers.filter(F.col("block") == row).orderBy("slice").select("words").collect()] for row in (-2, -3)}
    return Counted(tuple(int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0, 0), packed[-2], packed[-3], tuning, blocks, answers)


def started(c: Counted) -> bytes:
    """The state of the mixer after the tuning texts, from which the weights start; empty without any."""
    if not c.tuning:
        return b""
    texts = c.of(TUNING).mapInArrow(_tuning, "doc_id long, tokens binary")
    # a start of bounded size, so one task goes through it in the order of the ids
    in_order = texts.repartition(1).sortWithinPartitions("doc_id", "tokens")
    return bytes(in_order.mapInArrow(_fit(c.blocks.sparkSession.sparkContext.broadcast(c.base)), "state binary").first()[0])


def learned(c: Counted) -> tuple[bytes, DataFrame | None]:
    """The state of the mixer after all training texts, and their blocks as Packed reads them; empty without any."""
    if not c.sums[0]:
        return b"", None
    state = started(c)
    shared = c.blocks.sparkSession.sparkContext.broadcast((state, c.classes, c.base))
    added = written(c.of(TRAINING, TUNING).mapInArrow(_added(shared), ADDED), "lm-tokens")
    # a row for each number of Sums, whatever the corpus
    sums = added.filter("i IS NOT NULL").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    state = (Mixer.load(state) if state else Mixer()).adjusted(Sums(np.array([r["v"] for r in sums]))).state()
    return state, added.filter("i IS NULL").select("kind", "doc_ids", "n_bytes", "tokens")


def tuned(c: Counted) -> bytes:
    """The state of the mixer after all training texts; empty without any."""
    return learned(c)[0]


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    held_out: crc32 of the id as text is 1 modulo 5; the model learns from all other rows. A text's tokens are its words,
    lower-cased in A-Z, and one end. base_score: the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))). score: log10
    of the probability that the model gives the same tokens; as in the base, words that training rows don't have are told
    apart from others only (here, by class). bits_per_byte: the bits of score by the bytes of the text, null without bytes.

    All counts are those of all training rows, and so are the weights and maps: from a start (MAX_TUNING ids, by a hash, or
    one in TUNING_SHARE where there are few, against the counts of the others) one Newton step goes over all training rows,
    each token predicted by counts without itself; the maps count how those predictions came out. A score follows from the rows alone,
    whatever their partitions; a training row may use contexts that were seen twice, a held-out one those seen once.

    Null and empty texts have the end alone; null ids count as the text ''; repeated rows score alike; without training
    rows all words are unknown; an empty table gives an empty result; other columns are not read. Words are told apart
    by 64-bit hashes, pairs of words by CONTEXT_BITS.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(doc_id) == 1).alias("held"), F.col(text).cast("string").alias("text"))
    c = counted(rows)
    state, packed = learned(c)
    score = _scorer(docs.sparkSession.sparkContext.broadcast((state, c.classes)), *c.sums)
    held = c.of(HELD).mapInArrow(score, RESULT)
    return held if packed is None else held.unionByName(packed.mapInArrow(score, RESULT))
