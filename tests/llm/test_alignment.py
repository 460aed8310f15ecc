"""Alignment of two tokenizers against the plain two-pointer pass over whole texts."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment
from tessera.llm.queries import BYTE_BPE_FILE, MODEL_FILE

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("few,many", [(0, 0), (1, 1), (3, 500), (64, 64), (65, 3), (1000, 900), (129, 20_000)])
def test_gallop(few, many):
    rng = np.random.default_rng(few + many)
    for spread in (1, 7, 1000):
        a, b = (np.unique(rng.integers(0, spread * 50 + 50, n)) for n in (few, many))
        assert (alignment.gallop(a, b) == np.searchsorted(b, a)).all()
    assert (alignment.gallop(np.arange(few), np.arange(5_000, 5_000 + many)) == 0).all()


@pytest.fixture(scope="module")
def vocabularies():
    t = alignment.tokenizers(BYTE_BPE_FILE, MODEL_FILE)
    with open(BYTE_BPE_FILE, encoding="utf-8") as f:
        assert sum(1 for x in t.a_bytes if x) >= len(json.load(f)["model"]["vocab"]) - 1
    return t


def brute(rows, t):
    """{doc_id: the columns} by whole texts and two pointers."""
    found, counts = [], Counter()
    for doc, text in rows:
        whole = b" " + (text or "").encode()
        a, b = (t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)) if text else ([], [])
        x, y = [t.a_bytes[i] for i in a], [t.b_bytes[i] for i in b]
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            found.append((doc, None))
            continue
        i = j = 0
        links, groups, own_a, own_b = [(a[0], b[0])], [], [a[0]], [b[0]]
        end_a, end_b = len(x[0]), len(y[0])
        while True:
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a and step_b:
                groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
                own_a, own_b = [], []
            i, j = i + step_a, j + step_b
            if i == len(a):
                break
            if step_a:
                end_a += len(x[i])
                own_a.append(a[i])
            if step_b:
                end_b += len(y[j])
                own_b.append(b[j])
            links.append((a[i], b[j]))
        counts.update(links)
        found.append((doc, (len(a), len(b), groups, links)))
    best = Counter()
    for (_, i), c in counts.items():
        best[i] = max(best[i], c)
    return Counter((d, *((0, 0, 0, 0, 0, 0, "") if v is None else (v[0], v[1], len(v[2]), len(v[3]), sum(counts[x] == best[x[1]] for x in v[3]), sum(counts[x] for x in v[3]), hashlib.sha256(";".join(v[2]).encode()).hexdigest()))) for d, v in found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    pieces = ["the", " ", "  ", "\n", "\n ", "\t", "don't", "été", "日本語", "🎉", "▁", "<s>", "</s>", "<|endoftext|>", "123", "...", "\x00", " ", "\x1c", "  \n  ", "Überraschung", "a" * 60, "'s", "x_y", "\r\n", "ﬁ", "<0x41>", "​", "　"]
    table = [(None, "two words"), (1, None), (2, ""), (3, " "), (4, "   "), (5, "\n"), (6, "one"), (7, "one "), (8, " one"), (9, "a  b"), (10, "a \n b"), (11, "same text here"), (11, "same text here"), (12, "x▁y z"), (13, "word " * 3000), (14, "q" * 20_000), (15, "".join(rng.choice(pieces) for _ in range(20_000)).replace("▁", ""))]
    return table + [(100 + i, "".join(rng.choice(pieces) if rng.random() < 0.5 else rng.choice(pieces[:2]) for _ in range(rng.randint(1, 40)))) for i in range(300)]


@pytest.mark.parametrize("block_bytes,parts", [(1, 3), (5_000, 2), (1 << 24, 4)])
def test_alignment(spark, rows, vocabularies, block_bytes, parts):
    schema = "doc_id long, text string, block long, pair long, total long, place string, texts string"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "p", "t") for r in rows], schema).repartition(parts)
    if block_bytes == 1:
        docs, rows = docs.filter("doc_id < 14 OR doc_id > 380"), [r for r in rows if r[0] is not None and (r[0] < 14 or r[0] > 380)]
    found = alignment.alignment(docs, BYTE_BPE_FILE, MODEL_FILE, block_bytes=block_bytes).select("doc_id", *COLUMNS)
    assert Counter(map(tuple, found.collect())) == brute(rows, vocabularies)
    assert alignment.alignment(docs.limit(0), BYTE_BPE_FILE, MODEL_FILE).isEmpty()


def test_groups(spark, rows, vocabularies):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = alignment.groups(docs, BYTE_BPE_FILE, MODEL_FILE)
    digest = F.sha2(F.array_join(F.transform("groups", lambda g: F.concat(F.array_join(g["a"].cast("array<string>"), ","), F.lit("|"), F.array_join(g["b"].cast("array<string>"), ","))), ";"), 256)
    got = Counter(map(tuple, found.select("doc_id", F.size("groups"), F.when(F.size("groups") > 0, digest).otherwise("")).collect()))
    want = Counter()
    for row, times in brute(rows, vocabularies).items():
        want[row[0], row[3], row[7]] += times
    assert got == want


def test_alignment_of_the_corpus(spark, sf_dir, vocabularies):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], vocabularies)
    found = alignment.alignment(docs, BYTE_BPE_FILE, MODEL_FILE).select("doc_id", *COLUMNS)
    assert Counter(map(tuple, found.collect())) == want


def test_a_block_is_aligned_part_by_part(vocabularies, monkeypatch):
    rests = ["the", "naïve", "", "zebra ", "x\ty", "and", "😀", "of", "control</s>", "a" * 50]
    whole = alignment.Aligned(vocabularies, rests)
    seen, plain = [], alignment.Part
    monkeypatch.setattr(alignment, "PART", 3)
    monkeypatch.setattr(alignment, "Part", lambda t, part: (seen.append(len(part)), plain(t, part))[1])
    parts = alignment.Aligned(vocabularies, rests)
    assert seen == [3, 3, 3, 1] and parts.shown == whole.shown
    for name in ("good", "n_a", "n_b", "n_groups", "n_links", "links"):
        assert (getattr(parts, name) == getattr(whole, name)).all(), name
    assert alignment.Aligned(vocabularies, []).shown == []
