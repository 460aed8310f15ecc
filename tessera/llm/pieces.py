"""Encoding texts with a SentencePiece model by a streaming Viterbi search, and decoding the ids.

The model file that is at hand is of the BPE kind: its result is defined by merges, not by a sum of scores. The search
below is a Viterbi pass with a backpointer per boundary, in which a piece may follow another only if the merges would
leave exactly these two side by side. Under that rule each boundary has one surviving piece at most (if there were more,
the longest would stay), and the path through the survivors is the model's own segmentation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import chunks

SPACE = "▁"
START = -2_000_000
HEAD = 7
#: A stretch of text that pieces cannot cross: some spaces, then what follows up to the next space.
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


#: Runs of letters, and other characters one by one.
RUNS = re.compile(r"[^\W\d_]+|[\W\d_]")


class Stretches(dict):
    """Stretch, without the space it starts with -> its ids; short ones are remembered, up to a bounded number.

    Merges never cross two characters that no piece has side by side, so a stretch is put together from parts that end
    there, which are remembered too: words with marks behind them share the search of the bare word.
    """

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.fronts, self.others = pieces, {}, {}

    def clear(self) -> None:
        for cache in (super(), self.fronts, self.others):
            cache.clear()

    def part(self, known: dict, front: str, text: str) -> tuple[int, ...]:
        """Ids of front + text; known has those of one front."""
        ids = known.get(text)
        if ids is None:
            ids = tuple(self.pieces.search(front + text))
            if len(text) < 64:
                if len(known) >= Pieces.PARTS:
                    known.clear()
                known[text] = ids
        return ids

    def __missing__(self, rest: str) -> tuple[int, ...]:
        if rest.isalpha():
            ids = self.part(self.fronts, SPACE, rest)
        else:
            beside, parts = self.pieces.side_by_side, [""]
            for run in RUNS.findall(rest):
                if (parts[-1][-1:] or SPACE) + run[0] in beside:
                    parts[-1] += run
                else:
                    parts.append(run)
            ids = self.part(self.fronts, SPACE, parts[0])
            for text in parts[1:]:
                ids += self.part(self.others, "", text)
        if len(rest) < 64:
            if len(self) >= Pieces.REMEMBERED:
                super().clear()
            self[rest] = ids
        return ids


class Pieces:
    """The vocabulary of a SentencePiece model, and the search over it."""

    #: Entries of a cache, some 40 MB, and of one of parts, some 60 MB; a task forgets the texts at its end, as its worker goes on to other work, and keeps
    #: which pieces may stand side by side, which are numbers.
    REMEMBERED, PARTS = 200_000, 300_000

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        self.text = [m.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_ids.items()}
        self.special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        self.ids = {self.text[i]: i for i in range(n) if i not in self.special and i not in self.id_byte}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that hold a space after other characters aren't supported")
        self.starts = {p[:k]: self.ids.get(p[:k], -1) for p in self.ids for k in range(1, len(p) + 1)}
        self.bytes_of = [b"" if i in self.special else bytes([self.id_byte[i]]) if i in self.id_byte else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.side_by_side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.ends = {p[k:]: self.ids.get(p[k:], -1) for p in self.ids for k in range(len(p))}
        self._beside: dict[int, bool] = {}
        self._heads: dict[str, tuple[list, list]] = {}
        self._known = Stretches(self)

    def forget(self) -> None:
        """Empty the caches of texts."""
        for cache in (self._heads, self._known):
            cache.clear()

    def merged(self, text: str) -> list[str]:
        """The merges in order of score, leftmost first; used for two pieces at most."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def beside(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b side by side (a is '' at the start)."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def _follows(self, a: int, b: int) -> bool:
        """`beside` for two codes, remembered. A code is an id, or -1 minus a character's code point where no piece has it."""
        key = a * 2_097_152 + b
        found = self._beside.get(key)
        if found is None:
            if len(self._beside) >= self.REMEMBERED:
                self._beside.clear()
            found = self._beside[key] = self.beside(self._piece(a), self._piece(b))
        return found

    def _piece(self, code: int) -> str:
        return "" if code == START else self.text[code] if code >= 0 else chr(-1 - code)

    def search(self, text: str, log: list[tuple[int, int]] | None = None) -> list[int]:
        """Ids of a stretch. last[i] is the code of the piece that survives at boundary i, and back[i] where it starts.

        Only the boundaries that a piece may still start from are open. Whenever the backpointer paths of all of them meet
        in one boundary, the ids up to there are committed and what is before it is forgotten. log gets (boundary, ids
        committed so far).
        """
        if len(text) <= 4 * self.longest and log is None:
            return self._one_window(text)
        n, out, done = len(text), [], 0
        last, back = {0: START}, {}
        starts, longest, follows = self.starts, self.longest, self._follows
        for i in range(n):
            before = last.get(i)
            if before is None:
                continue
            for end in range(i + 1, min(i + longest, n) + 1):
                code = starts.get(text[i:end])
                if code is None:  # no piece starts like this
                    if end > i + 1:
                        break
                    code = -1 - ord(text[i])
                elif code < 0:  # a start, but no piece
                    if end > i + 1:
                        continue
                    code = -1 - ord(text[i])
                if end not in last and follows(before, code):
                    last[end], back[end] = code, i
            if i - done >= 4 * longest:
                done = self._commit(last, back, [b for b in range(i + 1, min(i + longest, n) + 1) if b in last], done, out, log)
        if n:
            self._commit(last, back, [n], done, out, log)
        return out

    def _one_window(self, text: str) -> list[int]:
        """`search` where the whole stretch fits the window: nothing is committed before its end. The survivors of the
        first HEAD boundaries depend on those characters alone, and are remembered."""
        last, back = [START], [0]
        if len(text) > HEAD:
            head = text[:HEAD]
            known = self._heads.get(head)
            if known is None:
                self._survivors(head, last, back)
                if len(self._heads) >= self.REMEMBERED // 4:
                    self._heads.clear()
                self._heads[head] = (last, back)
            else:
                last, back = known
            last, back = last.copy(), back.copy()
        self._survivors(text, last, back)
        out: list[int] = []
        n = len(text)
        while n:
            code = last[n]
            if code >= 0:
                out.append(code)
            else:
                out.extend(self.byte_ids[x] for x in reversed(chr(-1 - code).encode()))
            n = back[n]
        out.reverse()
        return out

    def _survivors(self, text: str, last: list, back: list) -> None:
        """Append to last and back what survives at each boundary of text that they don't have yet."""
        ends, beside, longest = self.ends.get, self._beside.get, self.longest
        for end in range(len(last), len(text) + 1):
            start = end - 1
            char = text[start]
            code = single = ends(char)
            if single is None or single < 0:
                single = -1 - ord(char)
            low = end - longest if end > longest else 0
            found = None
            while code is not None and start > low:
                start -= 1
                code = ends(text[start:end])
                if code is not None and code >= 0:
                    found = [(start, code)] if found is None else [(start, code), *found]
            if found is not None:
                for start, code in found:
                    before = last[start]
                    ok = beside(before * 2_097_152 + code)
                    if ok or (ok is None and self._follows(before, code)):
                        last.append(code)
                        back.append(start)
                        break
                else:
                    found = None
            if found is None:  # every boundary has a survivor, so the single character is it
                last.append(single)
                back.append(end - 1)

    def _commit(self, last: dict[int, int], back: dict[int, int], heads: list[int], done: int, out: list[int], log: list | None) -> int:
        """Put out the ids up to the boundary in which the paths from all heads meet; the new first boundary."""
        paths = set(heads)
        while len(paths) > 1:
            top = max(paths)
            paths.discard(top)
            paths.add(back[top])
        meet = paths.pop()
        codes, b = [], meet
        while b > done:
            codes.append(last[b])
            b = back[b]
        for code in reversed(codes):
            if code >= 0:
                out.append(code)
            else:
                out.extend(self.byte_ids[x] for x in chr(-1 - code).encode())
        for b in range(done, meet):
            last.pop(b, None)
            back.pop(b, None)
        if log is not None and meet > done:
            log.append((meet, len(out)))
        return meet

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text. All paths meet where a run of spaces starts, so each stretch is committed by itself."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            stretches = [s[1:] for s in STRETCH.findall(SPACE + text.replace(" ", SPACE))]
        else:
            stretches = text.split(" ")
        return list(chain.from_iterable(map(self._known.__getitem__, stretches)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; byte pieces are joined before they are read as UTF-8, and the space put first is dropped."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def pieces(model_file: str) -> Pieces:
    """The vocabulary, read once by each Python worker."""
    if model_file not in _loaded:
        _loaded[model_file] = Pieces(model_file)
    return _loaded[model_file]


def _encoder(model_file: str, keep_ids: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_file)
        for batch, texts in chunks(batches):
            missing = batch.column(1).is_null().to_pylist()
            ids = [np.array(p.encode(t.decode()), np.int32) for t in texts]
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            if keep_ids:
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])
            else:
                same = [p.decode(x.tolist()) == t.decode() for x, t in zip(ids, texts, strict=True)]
                digest = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(digest), pa.array(same)], names=["doc_id", "n_ids", "ids_sha256", "round_trip"])
        p.forget()

    return apply


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per row of docs. Null texts give null, empty texts an empty list."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_encoder(model_file, True), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Exact for texts without U+2581, which a SentencePiece model can't tell from a space."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_file)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(apply, "doc_id long, text string")


def round_trips(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_sha256 of the ids as little-endian int32, round_trip: decoding gives the text back).

    Null and empty texts have no ids and return as ''. Null ids stay null, repeated rows give equal rows, an empty table
    gives an empty result, other columns are not read. Each text is encoded alone: no shuffle.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_encoder(model_file, False), "doc_id long, n_ids long, ids_sha256 string, round_trip boolean")
