"""Repairing the structure of conversations: generalised LR parsing with weighted edits over the grammar of roles.

A conversation is nothing, or an optional system message and then pairs of user and assistant. The parser reads the rows
in order with a graph-structured stack. Each row may be kept, given another role or deleted, and messages may be inserted
anywhere; every edit has a cost. Where two ways lead to equal tops of the stack, the one with the smaller (cost, audit)
stays. That loses nothing: what may still come depends on the top alone, as each nonterminal is reduced to one symbol
whatever lies below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grammar of role initials; nonterminals in capitals, the first one is the start.
GRAMMAR = {"C": ("", "P", "sP"), "P": ("ua", "Pua")}
ROLES = {"u": "user", "a": "assistant"}
#: Costs of edits, by their initials, and of a truncated row that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
END = "$"


class Parser:
    """SLR tables of a grammar without hidden left recursion, and the moves of a stack."""

    def __init__(self, grammar: dict[str, tuple[str, ...]]):
        start = next(iter(grammar))
        self.rules = [("'", start), *((n, r) for n, rights in grammar.items() for r in rights)]
        follow = self._follow(grammar, start)
        states, self.goto, self.reduce = [self._closed({(0, 0)})], {}, {}
        for i, items in enumerate(states):  # grows while it is read
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                to = self._closed({(r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == symbol})
                if to not in states:
                    states.append(to)
                self.goto[i, symbol] = states.index(to)
            for r, d in items:
                if d == len(self.rules[r][1]):
                    for symbol in END if r == 0 else follow[self.rules[r][0]]:
                        self.reduce.setdefault((i, symbol), []).append(r)
        self.size = len(states)
        self.terminals = {x for _, right in self.rules for x in right} - set(grammar)
        self._moves: dict[tuple[tuple[int, ...], str], tuple[int, ...] | None] = {}

    def _closed(self, items: set) -> frozenset:
        while True:
            more = {(r, 0) for i, d in items for r, (n, _) in enumerate(self.rules) if self.rules[i][1][d : d + 1] == n}
            if more <= items:
                return frozenset(items)
            items = items | more

    @staticmethod
    def _follow(grammar: dict, start: str) -> dict[str, set]:
        """What may come after each nonterminal; no nonterminal but the start is empty here."""
        first = {n: set() for n in grammar}
        follow = {n: {END} if n == start else set() for n in grammar}
        for _ in range(len(grammar) + 1):
            for n, rights in grammar.items():
                for right in rights:
                    if right:
                        first[n] |= first.get(right[0], {right[0]})
                    for x, y in zip(right, right[1:] + " ", strict=False):
                        if x in grammar:
                            follow[x] |= follow[n] if y == " " else first.get(y, {y})
        return follow

    def move(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        """The stack after all reductions that the symbol calls for and its shift; None if it can't come here. For END, the
        stack itself if the input may end."""
        key = (stack, symbol)
        if key not in self._moves:
            self._moves[key] = self._moved(stack, symbol)
        return self._moves[key]

    def _moved(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        for r in self.reduce.get((stack[-1], symbol), ()):
            left, right = self.rules[r]
            if r == 0:
                return stack
            below = stack[: len(stack) - len(right)]
            found = self._moved((*below, self.goto[below[-1], left]), symbol)
            if found is not None:
                return found
        to = self.goto.get((stack[-1], symbol))
        return None if to is None else (*stack, to)


class Repair:
    """The frontier of the graph-structured stack over the rows of one conversation.

    A node is (cost, rank, tail, stack, parent, emitted, digest): `rank` orders the audits of the frontier as they were
    after the row before, `tail` has the letters since then. Audits of equal cost are never a prefix of each other, as
    they have the same number of rows and each insertion costs, so (cost, rank, tail) is the order of (cost, audit). The
    audit itself is read off at the end from two bytes per row and top; the digest of the repaired rows goes along with
    each node. So texts are read once and never held.
    """

    def __init__(self, parser: Parser):
        self.parser = parser
        self.nodes = {0: (0, 0, "", (0,), 0, "", hashlib.sha256())}
        self.records = bytearray()
        self.tails: dict[str, int] = {}

    @staticmethod
    def _better(found: dict, node: tuple) -> bool:
        """Merge a node with the one of an equal top, by (cost, audit)."""
        other = found.get(node[3][-1])
        if other is None or node[:3] < other[:3]:
            found[node[3][-1]] = node
            return True
        return False

    def _inserted(self) -> dict:
        """The frontier with what insertions before the next row reach."""
        found = dict(self.nodes)
        todo = list(found.values())
        while todo:
            cost, rank, tail, stack, parent, emitted, digest = todo.pop()
            for symbol in ROLES:
                to = self.parser.move(stack, symbol)
                if to:
                    node = (cost + INSERT, rank, tail + "I", to, parent, emitted + symbol, digest)
                    if self._better(found, node):
                        todo.append(node)
        return found

    def row(self, role: str, text: str, fault: int) -> None:
        """Read a row: keep it, give it another role, or delete it."""
        found: dict[int, tuple] = {}
        least = TRUNCATED if fault == CUT_OFF else 0
        for cost, rank, tail, stack, parent, emitted, digest in self._inserted().values():
            self._better(found, (cost + DELETE, rank, tail + "D", stack, parent, emitted, digest))
            if fault in (BLANK, DUPLICATE):
                continue
            for letter, symbol, more in (("K", role[:1], KEEP), *(("R", s, REROLE) for s in ROLES)):
                to = self.parser.move(stack, symbol) if symbol in self.parser.terminals else None
                if to:
                    self._better(found, (cost + least + more, rank, tail + letter, to, parent, emitted + letter + symbol, digest))
        ranks = {a: i for i, a in enumerate(sorted({n[1:3] for n in found.values()}))}
        record = bytearray(2 * self.parser.size)
        for top, n in found.items():
            record[2 * top : 2 * top + 2] = n[4], self.tails.setdefault(n[2], len(self.tails))
        self.records += record
        self.nodes = {top: (n[0], ranks[n[1:3]], "", n[3], top, "", self._digest(n, role, text)) for top, n in found.items()}

    def _digest(self, node: tuple, role: str = "", text: str = ""):
        """The digest of the repaired rows with those of this step. Nothing was put out before if the parent is the bottom."""
        emitted = node[5]
        if not emitted:
            return node[6]
        digest, i, between = node[6].copy(), 0, "" if len(self.nodes[node[4]][3]) == 1 else "\n"
        while i < len(emitted):
            if emitted[i] in "KR":
                line = f"{role if emitted[i] == 'K' else ROLES[emitted[i + 1]]}:{text}"
                i += 2
            else:
                line = f"{ROLES[emitted[i]]}:"
                i += 1
            digest.update(f"{between}{line}".encode())
            between = "\n"
        return digest

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the cheapest repair."""
        best = min((n for n in self._inserted().values() if self.parser.move(n[3], END)), key=lambda n: n[:3])
        digest, parts, top = self._digest(best).hexdigest(), [best[2]], best[4]
        tails, width = list(self.tails), 2 * self.parser.size
        for at in range(len(self.records) - width, -1, -width):
            parts.append(tails[self.records[at + 2 * top + 1]])
            top = self.records[at + 2 * top]
        return best[0], "".join(reversed(parts)), digest


_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Conversation:
    """What is reported of a conversation, from its rows in order."""

    def __init__(self, parser: Parser):
        self.repair = Repair(parser)
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.first = self.last = None
        self.distinct = 0

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.last:  # rows come by turn
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.repair.row(role, text, fault)

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        cost, audit, digest = self.repair.result()
        return gaps, *self.faults[1:], self.illegal, cost, audit, digest


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (conv_id, turn, role, text, fault, gone), those of a conversation in order and next to each other."""
    parser, out, now, current = Parser(GRAMMAR), [], None, None
    schema = None

    def batch() -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in out], schema.field("conv_id").type), *(pa.array([r[1 + i] for r in out], pa.int64()) for i in range(6)), *(pa.array([r[7 + i] for r in out], pa.string()) for i in range(2))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_COLUMNS, "audit", "repaired_sha256"])

    for rows in batches:
        schema = rows.schema
        for key, turn, role, text, fault, gone in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if current is None or key != now:
                if current is not None:
                    out.append((now, *current.report()))
                now, current = key, Conversation(parser)
            if not gone:
                current.row(turn, role, text, fault)
        if len(out) >= 1000:
            yield batch()
    if current is not None:
        out.append((now, *current.report()))
    if out:
        yield batch()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with known faults, dealt out by crc32(conv_id:turn) % 20: 0 takes the row away
    (gone), 1 empties its text, 2 removes its [.!?], 3 repeats it next to it, 4 makes it a user's. A null is one space."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    nr = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), nr.alias("nr"))
    text = F.when(F.col("nr").isin(0, 1), "").when(F.col("nr") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("nr") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("nr") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("nr") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def _ordered(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def faulty(rows: DataFrame) -> DataFrame:
    """rows of (conv_id, turn, role, text, gone) with `fault`, each row's first one: 1 blank, 2 duplicate (role and text seen
    earlier in its conversation), 3 truncated, else 0; `seen` orders equal rows. Rows of a conversation are in one
    partition afterwards."""
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(*_ordered("turn")))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("seen") > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF)
        .otherwise(0)
    )
    together = rows.repartition("conv_id").withColumn("seen", seen)
    return together.select("conv_id", "turn", "role", "text", fault.alias("fault"), "gone", "seen")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, and `gone` for rows that count for nothing but their
    conv_id): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are in order of turn (nulls first), then role, then text. Other columns aren't read. Null roles and texts are one
    space, a null conv_id is a conversation of its own, repeated rows are duplicates, an empty table gives an empty result.
    A conversation is read as a stream by one task, as its audit and digest are defined in order; the task holds one Arrow
    batch, seven digests and some 20 bytes per row, however long the conversation is.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, gone.alias("gone"))
    ready = faulty(plain).sortWithinPartitions(*_ordered("conv_id", "turn", "role", "text", "seen")).drop("seen")
    kind = plain.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COLUMNS)
    return ready.mapInArrow(_reports, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def applied(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, nr, edit, role, text) from rows and what `repaired` says of them.

    Deleted rows are left out. The letters of an audit that aren't insertions meet the rows in order; roles of reroled and
    inserted messages follow from their place. Rows and letters are joined by (conv_id, row number).
    """
    order = Window.partitionBy("conv_id").orderBy(*_ordered("turn", "role", "text"))
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    present = rows.filter(~F.col("gone")) if "gone" in rows.columns else rows
    numbered = present.select("conv_id", F.col("turn").cast("long").alias("turn"), *text).withColumn("row", F.row_number().over(order))
    letters = reports.select("conv_id", F.posexplode(F.split("audit", ""))).filter("col <> ''").select("conv_id", F.col("pos").alias("at"), F.col("col").alias("edit"))
    so_far = Window.partitionBy("conv_id").orderBy("at")
    letters = letters.withColumn("row", F.when(F.col("edit") != "I", F.sum(F.when(F.col("edit") == "I", 0).otherwise(1)).over(so_far)))
    n = numbered.select(F.col("conv_id").alias("c"), F.col("row").alias("r"), "role", "text")
    both = letters.filter("edit <> 'D'").join(n, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("row") == F.col("r")), "left")
    nr = F.row_number().over(so_far)
    system = F.first(F.coalesce((F.col("edit") == "K") & F.col("role").startswith("s"), F.lit(False))).over(so_far)
    both = both.select("conv_id", "edit", "role", "text", nr.alias("nr"), system.alias("system"))
    turn = F.when((F.col("nr") - F.col("system").cast("int")) % 2 == 1, ROLES["u"]).otherwise(ROLES["a"])
    return both.select("conv_id", "nr", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
