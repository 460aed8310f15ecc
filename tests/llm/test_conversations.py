"""Repair and formatting of conversations: brute force, exact round trips, hostile tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format
from tessera.llm.chat_format import Template, digests, formatted, parts_of, read_back, with_probe
from tessera.llm.conversation_repair import GRAMMAR, Parser, Repair, applied, damaged, repaired

SCHEMA = "conv_id long, turn long, role string, text string, cost long, nr long, fault string, spans string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def brute(rows):
    """(cost, audit, digest) from all strings of edits, kept per place in the grammar."""
    ways = {0: {(0, "", ())}}

    def with_insertions(ways):
        found = {k: set(v) for k, v in ways.items()}
        for _ in range(3):
            for place, some in [(k, list(v)) for k, v in found.items()]:
                for cost, audit, out in some:
                    for symbol, name in NAMES.items():
                        to = STEP.get((place, symbol))
                        if to is not None and not audit.endswith("III"):
                            found.setdefault(to, set()).add((cost + 3, audit + "I", (*out, f"{name}:")))
        return found

    for role, text, fault in rows:
        after = {}
        for place, some in with_insertions(ways).items():
            for cost, audit, out in some:
                after.setdefault(place, set()).add((cost + 4, audit + "D", out))
                moves = [] if fault in (1, 2) else [("K", role[:1], 0, role), *(("R", s, 3, n) for s, n in NAMES.items())]
                for letter, symbol, more, name in moves:
                    to = STEP.get((place, symbol))
                    if to is not None:
                        after.setdefault(to, set()).add((cost + more + (3 if fault == 3 else 0), audit + letter, (*out, f"{name}:{text}")))
        least = min(c for some in after.values() for c, _, _ in some)
        ways = {k: {w for w in some if w[0] <= least + 14} for k, some in after.items()}
    ends = with_insertions(ways)
    cost, audit, out = min(w for place in (0, 3) for w in ends.get(place, ()))
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repairs_are_the_cheapest_and_the_least():
    rng, parser = random.Random(11), Parser(GRAMMAR)
    for _ in range(250):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "P", "$", ""]), rng.choice("xyz"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5))]
        repair = Repair(parser)
        for row in rows:
            repair.row(*row)
        assert repair.result() == brute(rows), rows


def test_long_conversation_takes_few_bytes_a_row():
    repair = Repair(Parser(GRAMMAR))
    for i in range(20_001):
        repair.row("user" if i % 2 else "assistant", "x" * 50, 0)
    cost, audit, _ = repair.result()
    assert (cost, audit) == (4, "D" + "K" * 20_000) or (cost, len(audit)) == (3, 20_002)
    assert len(repair.records) < 25 * 20_001


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    table = [(None, None, None, None), (None, 1, "user", "q."), (1, None, "user", ""), (1, 2, None, "  \t"), (2, 5, "user", "a.\n"), (2, 5, "user", "a.\n"), (2, 9, "assistant", "no end"), (3, 0, "system", "s."), (4, 1, "tool", "t!"), (4, 1, "user", "t!"), (5, 7, "assistant", "Ä?  "), (5, -7, "user", "日本.")]
    for c in range(20, 160):
        turn = 0
        for _ in range(rng.randint(1, 6)):
            table.append((c, turn, rng.choice(["user", "assistant", "system", "other"]), rng.choice(["yes.", "no", "who?", " ", "so be it!", "a" * 5000 + "."])))
            turn += rng.choice([0, 1, 1, 2])
    return table


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "f", "s") for r in rows], SCHEMA).repartition(4)


def faults_of(conversation):
    """[(turn, role, text, fault)] in order."""
    seen, out = set(), []
    for turn, role, text in sorted(conversation, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        inked = [c for c in text if c not in "\x20\t\n\x0b\x0c\r"]
        out.append((turn, role, text, 1 if not inked else 2 if (role, text) in seen else 3 if inked[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def wanted(rows):
    kept = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        some = kept.setdefault(conv, [])
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        some += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, some in kept.items():
        found = faults_of(some)
        turns = {t for t, _, _, _ in found if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [sum(f[3] == k for f in found) for k in (1, 2, 3)]
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), *brute([f[1:] for f in found]))
    return out


def test_repaired_conversations(spark, table, rows):
    found = repaired(damaged(table))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = found.collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == wanted(rows)
    assert repaired(damaged(table.limit(0))).isEmpty()
    again = repaired(damaged(table.repartition(1))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_applied_edits_give_the_digest(table):
    ready = damaged(table)
    reports = repaired(ready)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nr", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    found = {r["conv_id"]: r["d"] for r in applied(ready, reports).groupBy("conv_id").agg(F.sha2(lines, 256).alias("d")).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(found.get(r["conv_id"], empty) == r["repaired_sha256"] for r in reports.collect())


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<|turn|>\\", "<<|end|>|end|>", "[[INST]", "<|image|>", "![image 3](a.png)", "x ![audio](b\\<s>.wav)![document 2](c.pdf) y\n", "![image](a b)", "", "<|", "é日本🎉\n\r\x00", "<|text|>" * 3, "<\\s>", "</s\\>"]


def test_formatting_is_read_back_exactly(spark):
    rows = [(i // 3, i % 3, r, t) for i, (r, t) in enumerate((r, t) for t in [*HOSTILE, None] for r in ["user", "assistant", "<|turn|>sy\\stem", None])]
    table = spark.createDataFrame([(*r, 1, 2, "f", "s") for r in rows] + [(None, None, "assistant", "x", 1, 1, "f", "s")] * 2, SCHEMA).repartition(3)
    form = formatted(table)
    got = {r["conv_id"]: r for r in read_back(form).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted(r for r in rows if r[0] == conv)]
        assert [tuple(t) for t in got[conv]["turns"]] == own
        assert got[conv]["loss_text"] == "".join(t for r, t in own if r == "assistant")
        text, template = got[conv]["formatted"], Template()
        assert text.count(template.turn) == text.count(template.end) == len(own)
        assert not any(x in text for x in template.reserved)
        spans = got[conv]["spans"]
        assert [text[s["turn_start"] :].startswith(template.turn) for s in spans] == [True] * len(own)
        assert all(text[s["end"] :].startswith(template.end) and text[: s["start"]].endswith(template.text) for s in spans)
    assert got[None]["loss_text"] == "xx"
    assert formatted(table.limit(0)).isEmpty() and digests(form).count() == len(got)


def test_typed_parts(spark):
    parts = [("text", "see ", None, None, None), ("image", None, "a.png", 576.0, None), ("audio", None, "b.wav", 1.5, None), (None, "<s>", None, None, None), ("video", None, "c.mp4", None, None), ("document", None, "d.pdf", 2.0, "<d.pdf>")]
    table = spark.createDataFrame([(1, 0, "user", "not used", parts), (1, 1, "assistant", "plain ![image](e.png)", None)], f"conv_id long, turn long, role string, text string, parts {chat_format.PARTS}")
    form = formatted(table, parts="parts")
    row = read_back(form).first()
    assert row["formatted"].startswith("<|turn|>user<|text|>see <|image|><|audio|><\\s><|document|><|document|><|end|>")
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, "image", "a.png", 578), (1, "audio", "b.wav", 40), (1, "document", "c.mp4", 602), (1, "document", "d.pdf", 1202), (2, "image", "e.png", 258)]
    assert row["n_tokens_attached"] == 578 + 40 + 602 + 1202 + 258
    assert [t["text"] for t in row["turns"]] == ["see a.pngb.wav<s>c.mp4<d.pdf>", "plain ![image](e.png)"]
    shown = spark.createDataFrame([("a ![image 2](x) b",), (None,)], "t string").select(parts_of(F.col("t")).alias("p")).collect()
    assert [(p["kind"], p["text"], p["ref"], p["units"]) for p in shown[0]["p"]] == [("text", "a ", None, None), ("image", None, "x", 2.0), ("text", " b", None, None)]
    assert [(p["kind"], p["text"]) for p in shown[1]["p"]] == [("text", "")]


def test_marks_are_checked():
    for mark in ("x", "<|a<b|>", "<\\>"):
        with pytest.raises(ValueError):
            Template(turn=mark)


def test_plan_of_formatting_is_native(spark, sf_dir):
    df = digests(formatted(with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
