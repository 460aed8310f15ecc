"""Small and hostile tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, jaccard_join, line_dedup, mixing_lm, mixture, pieces, quality, sharding, substring_dedup, toxicity
from tessera.llm.queries import MODEL_FILE, QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, copies long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    base = " ".join(rng.choice(vocabulary) for _ in range(120))
    edited = base.split()
    edited[50] = "changed"
    rows = [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (5, "one"), (6, "One two"), (7, base), (8, base.replace(" ", "  ", 5)), (9, " ".join(edited)), (9, " ".join(edited)), (10, "a " * 400), (11, passage), (None, passage), (None, None), (12, "x y z " + passage + " tail"), (13, ("line one here\nline two here\nline three here\n" * 3) + "end"), (14, "q\nline one here\nline two here\nline three here\nr"), (15, "é日本 ▁ \x00   ﬁ\r\n" + passage), (-3, base.upper()), (16, " ".join(rng.choice(vocabulary) for _ in range(30_000)))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "d", 7) for i, t in texts], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i, _ in texts if i is not None] + [(None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, agree):
    agree(name)


def test_exact_groups(docs, texts, none):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in texts:
        groups[norm(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    assert exact_dedup.exact_groups(none).isEmpty()
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.keep_first(none).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_covers_all(spark, n):
    a, b = sharding.sides(n)
    assert n <= a * b < n + a or a * b == n
    images = [r[0] for r in spark.range(a * b).select(sharding.feistel(F.col("id"), a, b, 5)).collect()]
    assert sorted(images) == list(range(a * b))


def test_shards(spark, docs, texts, none):
    out = sharding.shards(docs, 6).collect()
    assert len(out) == len(texts) and all(r["law"] == "rows" and r["grown_shard"] is None for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    known = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in out} == known
    again = sharding.shards(docs.repartition(3), 6)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out))
    assert sharding.shards(none, 6).isEmpty()


def test_substrings(docs, texts, none):
    windows = defaultdict(list)
    rows = [(i, words_of(t)) for i, t in texts]
    for i, w in rows:
        if i is not None:
            for s in range(len(w) - 12):
                windows[tuple(w[s : s + 13])].append(i)
    want = Counter()
    for i, w in rows:
        gone = set()
        if i is not None:
            for s in range(len(w) - 12):
                if min(windows[tuple(w[s : s + 13])]) < i:
                    gone.update(range(s, s + 13))
        kept = [x for p, x in enumerate(w) if p not in gone]
        want[i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    found = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, found.collect())) == want
    assert any(k[2] > 50 for k in want)
    assert substring_dedup.substring_dedup(none).isEmpty()


def test_hot_passages_are_dealt_out(spark):
    """More documents than HOT with one passage: the first keeps it, whatever the salts."""
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join([*passage, *(f"o{rng.randrange(10**6)}" for _ in range(15))] if i % 2 else [f"x{i}", *passage])) for i in range(3, 3 + 2 * substring_dedup.HOT)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {i: 0 if i == 3 else 20 for i, _ in rows}


def test_every_window_selects_an_anchor_by_content():
    import numpy as np

    a = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    at = substring_dedup.selected(a, 8)
    for i, j in enumerate(at):
        assert i <= j < i + 8 and a[j] == a[i : i + 8].min()


def test_components_by_brute_force(docs, texts, none):
    sets = {}
    for i, t in texts:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, set()).add(frozenset(tuple(w[s : s + 5]) for s in range(max(len(w) - 4, 1))) if w else frozenset())
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[i] for y in sets[j]):
                    label[j] = min(label[i], label[j])
    found = jaccard_join.components(docs)
    for r in found.collect():
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(next(iter(sets[r["doc_id"]]))), label[r["doc_id"]])
    assert found.count() == len(texts)
    assert jaccard_join.components(none).isEmpty()
    kept = jaccard_join.one_per_component(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 3, -3, 4} and 9 not in {r["doc_id"] for r in kept.collect()}


def test_join_over_large_groups(spark):
    """More near copies than a group may pair at once, beside documents that share one long passage and nothing else."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(80)]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(80)] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    for i in range(150, 300):
        rows.append((i, " ".join(passage + [rng.choice(words) for _ in range(rng.randrange(5, 60))])))
    sets = {i: {tuple(t.split()[s : s + 5]) for s in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    found = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == label


def test_texts_without_an_id_link(spark):
    """Two texts that only a text without an id joins, and two near copies without ids."""
    words, other = [f"k{i}" for i in range(100)], [f"o{i}" for i in range(60)]
    changed = lambda *at: " ".join(f"new{i}" if i in at else w for i, w in enumerate(words))
    rows = [(1, changed(10, 20)), (None, changed()), (2, changed(70, 80)), (None, " ".join(other)), (None, " ".join([*other, "more"]))]
    found = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)]


def test_long_chains_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (5, 5)], "a long, b long")
    found = {r["v"]: r["label"] for r in components.connected_components(edges).collect()}
    assert {found[i] for i in range(71)} == {0} and found[201] == 200


def test_rounds_of_components_take_nothing_of_the_driver(spark, docs, monkeypatch):
    """No round broadcasts, and links that end up in the result are labelled once: two tables of labels for a whole join."""
    plans, tables = [], []

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    def counted(linked):
        tables.append(linked)
        return components.connected_components(linked)

    written = components.written
    monkeypatch.setattr(components, "written", spied)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r["label"] for r in components.connected_components(edges).collect()} == {0}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
    monkeypatch.setattr(jaccard_join, "connected_components", counted)
    jaccard_join.components(docs)
    assert len(tables) == 2


def test_quality_by_brute_force(docs, texts, none):
    def repeats(w):
        longest = [max((next((k for k in range(len(w) - max(i, j)) if w[i + k] != w[j + k]), len(w) - max(i, j)) for j in range(len(w)) if j != i), default=0) for i in range(len(w))]
        spots = lambda least, size: {p for i, n in enumerate(longest) if n >= least for p in range(i, i + (size or n))}
        return len(spots(3, 3)), len(spots(quality.MIN_REPEAT, 0)), max(longest, default=0)

    small = [(i, t) for i, t in texts if len(t or "") < 3000]
    want = Counter()
    for i, t in small:
        w = words_of(t)
        again, cover, most = repeats(w)
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), again, failed, not failed and cover <= quality.MAX_COVERED * len(w) and most <= quality.MAX_LONGEST, cover, most] += 1
    found = quality.quality(docs.filter("text IS NULL OR length(text) < 3000"))
    assert Counter(map(tuple, found.collect())) == want
    assert quality.quality(none).isEmpty() and quality.quality(docs).count() == len(texts)


def test_repeats_by_levels_and_by_place():
    """Both ways to common prefixes, over documents that share words, against all pairs; and one very long repeat."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 50))
        words, docs = rng.integers(0, rng.integers(1, 5), n), np.sort(rng.integers(0, rng.integers(1, 4), n))
        pairs = list(zip(docs.tolist(), words.tolist(), strict=True))
        same = lambda i, j: next((k for k in range(n - max(i, j)) if pairs[i + k] != pairs[j + k]), n - max(i, j))
        want = [max((same(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
        for kept in (0, 1, 2, 50):
            longest, again = quality.repeat_lengths(words, docs, kept)
            assert longest.tolist() == want and again.tolist() == [x >= quality.REPEAT_WINDOW for x in want]
    longest, _ = quality.repeat_lengths(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64))
    assert longest.tolist() == [99_999, *range(99_999, 0, -1)]  # the nearest other copy starts one word before, or after


def test_lines(docs, texts, none):
    out = line_dedup.line_dedup(docs, keep_text=True).collect()
    assert len(out) == len(texts)
    by = {r["doc_id"]: r for r in out}
    assert by[13]["kept_text"] == "line one here\nline two here\nline three here\nend" and by[13]["n_removed"] == 6
    assert by[14]["kept_text"] == "q\nr" and by[1]["n_lines"] == 0
    assert line_dedup.line_dedup(none).isEmpty()


@pytest.mark.parametrize("long_words", [None, 6])
def test_lines_by_brute_force(spark, long_words):
    rng = random.Random(17)
    pool = [f"  line {c} " + "w " * rng.randrange(6) for c in "abcdefgh"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(60)] + [(61, None), (62, ""), (7, "line a\n\nline b\nline c"), (None, pool[0] * 3)]
    lines = {(i, t): [x for x in (y.strip(" \t\n\v\f\r") for y in (t or "").split("\n")) if x] for i, t in rows if i is not None}
    first, all_windows = {}, []
    for (i, t), x in sorted(lines.items(), key=lambda kv: kv[0][0]):
        for k in range(1, 4):
            for s in range(len(x) - k + 1):
                if k == 3 or (long_words and len(" ".join(x[s : s + k]).split()) >= long_words):
                    all_windows.append((i, t, s, k, tuple(x[s : s + k])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    copies = {(r["doc_id"], r["text"]): r["copy"] for r in docs.withColumn("copy", F.xxhash64("text")).collect()}
    for i, t, s, k, c in all_windows:
        first[k, c] = min(first.get((k, c), (i, copies[i, t], s)), (i, copies[i, t], s))
    gone = defaultdict(set)
    for i, t, s, k, c in all_windows:
        f = first[k, c]
        if f[:2] != (i, copies[i, t]) or s - f[2] >= k:
            gone[i, t].update(range(s, s + k))
    want = Counter((i, len(lines.get((i, t), [0])), len(gone[i, t]), "\n".join(y for p, y in enumerate(lines.get((i, t), [(t or "").strip()])) if p not in gone[i, t])) for i, t in rows)
    found = line_dedup.line_dedup(docs, long_words=long_words, keep_text=True)
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in found.collect()) == want
    assert sum(map(len, gone.values())) > 20


def test_long_lines_that_come_again_go(spark):
    long, half = " ".join(f"a{i}" for i in range(60)), [" ".join(f"{c}{i}" for i in range(30)) for c in "bc"]
    rows = [(1, f"first\n{long}\n" + "\n".join(half) + "\nshort line"), (2, long), (3, f"x\n{half[0]}\n\n {half[1]} \ny"), (4, f"{half[1]}\n{half[0]}\nshort line"), (5, f"new\n{long} more\n{long} more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept_text"] for r in line_dedup.line_dedup(docs, keep_text=True).collect()}
    assert kept == {1: rows[0][1], 2: "", 3: "x\ny", 4: rows[3][1], 5: f"new\n{long} more"}


def test_pieces_equal_the_library(docs, texts, none):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE), pieces.pieces(MODEL_FILE)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abe éß日\n\t  thing<>0\x00🙂") for _ in range(rng.randrange(90)))
        assert own.encode(t) == lib.encode(t) and own.decode(own.encode(t)) == t
    long, log = "".join(rng.choice("abcdeth") for _ in range(3000)), []
    assert own.search("▁" + long, log) == lib.encode(long)
    assert max(b - a for (a, _), (b, _) in zip(log, log[1:], strict=False)) <= 8 * own.longest
    encoded = pieces.encode(docs, MODEL_FILE)
    assert Counter((r["doc_id"], tuple(r["ids"]) if r["ids"] is not None else None) for r in encoded.collect()) == Counter((i, None if t is None else tuple(lib.encode(t))) for i, t in texts)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, MODEL_FILE).collect()}
    assert all(back[i] == t for i, t in texts if i not in (None, 15))
    trips = {r["doc_id"]: r["round_trip"] for r in pieces.round_trips(docs, MODEL_FILE).collect()}
    assert all(v for k, v in trips.items() if k not in (None, 15)) and not trips[15]
    assert pieces.round_trips(none, MODEL_FILE).isEmpty() and pieces.encode(none, MODEL_FILE).isEmpty()


def test_words_with_marks_share_a_search():
    own, asked = pieces.Pieces(MODEL_FILE), []
    search = own.search
    own.search = lambda text, log=None: asked.append(text) or search(text, log)
    first = own.encode("ofanbleedan ofanbleedan, ofanbleedan.\nofanbleedan,")
    assert asked.count("▁ofanbleedan") == 1 and len(asked) == len(set(asked)) and "▁ofanbleedan," not in asked
    assert own.decode(first) == "ofanbleedan ofanbleedan, ofanbleedan.\nofanbleedan,"
    beside = len(own._beside)
    own.forget()
    assert not own._known and not own._known.fronts and len(own._beside) == beside


def test_language_model(docs, texts, none):
    out = mixing_lm.lm_scores(docs).collect()
    assert len(out) == len(texts)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter(x for i, t in texts if not held(i) for x in tokens(t))
    total, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        x = tokens(t)
        want[i, held(i), len(x), sum(counts[k] > 0 for k in x), total, round(sum(math.log10((counts[k] + 0.5) / (total + 0.5 * (v + 1))) for k in x), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    assert mixing_lm.lm_scores(none).isEmpty()


def lm_rows(docs):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return docs.select("doc_id", held.alias("held"), "text")


@pytest.fixture(scope="module")
def phrases(spark):
    """Texts that share passages, so that two words often say what comes next."""
    rng = random.Random(21)
    words = [f"{rng.choice(['ba', 'Ke', 'zo', 'lú'])}{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(40)] for _ in range(12)]
    rows = [(i, " ".join(rng.choice(passages)[: rng.randrange(3, 40)] + [rng.choice(words) for _ in range(rng.randrange(30))])) for i in range(160)]
    return spark.createDataFrame([*rows, (160, rows[3][1]), (None, None), (161, "")], "doc_id long, text string")


def test_counts_of_the_model_by_brute_force(phrases):
    c = mixing_lm.counted(lm_rows(phrases.repartition(3)))
    texts, kinds = {r["doc_id"]: r["text"] for r in phrases.collect()}, {}
    rows = c.ready.collect()
    for r in rows:
        kinds.update(dict.fromkeys(r["doc_ids"], r["kind"]))
    tokens = {i: [*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in texts.items()}
    assert set(kinds) == set(texts) and sum(k == mixing_lm.TUNING for k in kinds.values()) == c.tuning == len([i for i in texts if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]) // mixing_lm.TUNING_SHARE
    after = lambda i: zip([None, None, *tokens[i]], [None, *tokens[i]], tokens[i], strict=False)
    count = Counter(w for i, k in kinds.items() if k != mixing_lm.HELD for w in tokens[i])
    assert c.sums == (sum(count.values()), len(count), sum(v == 1 for v in count.values()))
    follows = {}
    for which, of in (("all", (mixing_lm.TRAINING, mixing_lm.TUNING)), ("base", (mixing_lm.TRAINING,))):
        follows[which] = defaultdict(Counter)
        for i, k in kinds.items():
            if k in of:
                for a, b, w in after(i):
                    follows[which][a, b][w] += 1
    seen = 0
    for r in rows:
        block = mixing_lm.Answered(r.asDict(recursive=True))
        at = 0
        for i in r["doc_ids"]:
            for a, b, w in after(i):
                n = follows["base" if r["kind"] == mixing_lm.TUNING else "all"][a, b]
                most, known = max(n.values(), default=0), sum(n.values()) >= (2 if r["kind"] == mixing_lm.TRAINING else 1)
                assert block.count[at] == count[w] and block.share[at] == 1 and block.known[at] == known
                if known:
                    assert (block.times[at], block.rest[at]) == tuple(mixing_lm.coded(np.array([most, sum(n.values()) - most])))
                    assert not block.hit[at] or n[w] == most
                    assert block.hit[at] or n[w] < most or sum(v == most for v in n.values()) > 1
                    seen += int(block.hit[at])
                at += 1
        assert at == len(block.ids)
    assert seen > 500
    classes = mixing_lm._class_counts(c.classes)
    assert (classes.sum(axis=(1, 2)) == sum(count.values())).all()


def test_scores_follow_from_the_rows_alone(phrases):
    found = [{(r["doc_id"], r["n_bytes"]): r["score"] for r in mixing_lm.lm_scores(phrases.repartition(n)).collect()} for n in (1, 3, 8)]
    assert all(f.keys() == found[0].keys() and all(abs(f[k] - found[0][k]) < 1e-9 for k in f) for f in found)


def test_weights_are_learned_on_a_small_table(phrases):
    import numpy as np

    new, m = mixing_lm.Mixer(), mixing_lm.Mixer.load(mixing_lm.tuned(mixing_lm.counted(lm_rows(phrases))))
    assert np.abs(m.weights - new.weights)[:, :3].max() > 0.1 and np.abs(m.first - new.first).max() > 0.1 and m.refine.sum() > new.refine.sum()


def test_weights_and_maps_count_all_training_tokens(phrases):
    """Against brute force: the maps hold each training token once, and a token without itself in the counts."""
    c = mixing_lm.counted(lm_rows(phrases.repartition(3)))
    state, packed = mixing_lm.learned(c)
    refine = mixing_lm.Mixer.load(state).refine - 1
    rows = [r.asDict(recursive=True) for r in c.ready.collect() if r["kind"] != mixing_lm.HELD]
    assert len(rows) > 1 and {r["kind"] for r in rows} == {mixing_lm.TRAINING, mixing_lm.TUNING}
    assert [x.sum() for x in refine[: mixing_lm.LEVELS]] == [c.sums[0]] * mixing_lm.LEVELS
    blocks = [mixing_lm.Answered(r) for r in rows]
    assert refine[mixing_lm.LEVELS].sum() == sum(int(b.known.sum()) for b in blocks)
    again = {tuple(r["doc_ids"]): mixing_lm.Packed(r.asDict(recursive=True)) for r in packed.collect()}
    for b, r in zip(blocks, rows, strict=True):
        for x in (*mixing_lm.COLUMNS[3:], "cls", "count", "share", "n_bytes"):
            assert (getattr(b, x) == getattr(again[tuple(r["doc_ids"])], x)).all()
    follows = defaultdict(Counter)
    pairs = {id(b): list(zip(b.contexts().tolist(), b.next_word().tolist(), strict=True)) for b in blocks}
    for x in pairs.values():
        for context, word in x:
            follows[context][word] += 1
    seen = 0
    for b in blocks:
        if b.kind == mixing_lm.TRAINING:
            t = mixing_lm.Tokens.without_own(b)
            for i in np.flatnonzero(t.known):
                context, word = pairs[id(b)][i]
                n = Counter(follows[context])
                n[word] -= 1
                top = min(n, key=lambda w: (-n[w], w))
                assert t.hit[i] == (top == word)
                for code, most in ((t.times[i], n[top]), (t.rest[i], n.total() - n[top])):
                    assert mixing_lm.COUNTS[code] == most if most < 63 else abs(mixing_lm.COUNTS[code] / most - 1) < 0.14
                seen += int(top != min(follows[context], key=lambda w: (-follows[context][w], w)))
    assert seen


def test_sums_are_those_of_one_token_at_a_time():
    rng = np.random.default_rng(2)
    n, size = mixing_lm.CLASSES, 300
    cls = rng.integers(0, n, size).astype(np.int32)
    t = mixing_lm.Tokens({"cls": cls, "back1": np.roll(cls, 1), "back2": np.roll(cls, 2), "doc": np.repeat(np.arange(2), size // 2), "place": np.tile(np.arange(size // 2), 2), "known": rng.integers(0, 2, size).astype(np.int8), "hit": rng.integers(0, 2, size).astype(np.int8), "times": rng.integers(0, 9, size).astype(np.uint8), "rest": rng.integers(0, 9, size).astype(np.uint8)})
    counts = np.stack([np.bincount(b * n + cls, minlength=n * n).reshape(n, n) for b in (np.zeros(size, int), t.back1, t.back2)])
    m, sums = mixing_lm.Mixer(), mixing_lm.Sums()
    m.add(t, mixing_lm.left_out(counts), sums)
    gradient = np.zeros_like(sums.gradient)
    for level in range(mixing_lm.LEVELS):
        x, bit, gate = m.class_bits(t, mixing_lm.stretched(counts), level)
        node = (cls >> (mixing_lm.LEVELS - level)) | (1 << level)
        for i in range(size):
            for k, b in enumerate((0, t.back1[i], t.back2[i])):
                one = counts[k].copy()
                one[b, cls[i]] -= 1
                low = (node[i] << (mixing_lm.LEVELS - level)) - n
                half = n >> (level + 1)
                x[k, i] = math.log((one[b, low + half : low + 2 * half].sum() + mixing_lm.PRIOR) / (one[b, low : low + half].sum() + mixing_lm.PRIOR))
            gradient[gate[i]] += x[:, i] * (bit[i] - 1 / (1 + np.exp(-m.weights[gate[i]] @ x[:, i])))
    assert np.allclose(sums.gradient, gradient, atol=1e-4) and sums.refine[: mixing_lm.LEVELS].sum() == size * mixing_lm.LEVELS
    better = m.adjusted(sums)
    assert np.isfinite(better.state() and better.weights).all() and np.abs(better.weights - m.weights).max() > 1e-3


def test_bits_of_all_classes_add_up_to_one():
    import numpy as np

    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (3, mixing_lm.CLASSES, mixing_lm.CLASSES))
    tables, m = mixing_lm.stretched(counts), mixing_lm.Mixer()
    n = mixing_lm.CLASSES

    def tokens(cls, hit=0):
        whole = lambda x, kind=np.int32: np.full(n * 3, x, kind)
        seq = np.stack([np.full(n, 5), np.full(n, 9), cls], axis=1).ravel().astype(np.int32)
        back = lambda k: np.concatenate([np.zeros((n, k), int), seq.reshape(n, 3)[:, : 3 - k]], axis=1).ravel()
        return mixing_lm.Tokens({"cls": seq, "back1": back(1), "back2": back(2), "doc": np.repeat(np.arange(n), 3), "place": np.tile(np.arange(3), n), "known": whole(1, np.int8), "hit": np.tile([1, 1, hit], n).astype(np.int8), "times": whole(4), "rest": whole(1)})

    t = tokens(np.arange(n))
    m.learn(t, tables)
    first, rest = m.score(t, tables)
    assert abs(np.exp(rest[2::3]).sum() - 1) < 1e-6
    hit, _ = m.score(tokens(np.arange(n), 1), tables)
    assert np.allclose(np.exp(first[2::3]) + np.exp(hit[2::3]), 1)


def test_model_beats_the_base_on_held_out_texts(spark, sf_dir):
    out = QUERIES["op3_lm_scoring"](spark, sf_dir).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > out["b"]


def test_toxicity(spark, docs, texts, labels, none):
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert toxicity.toxicity(none, labels).isEmpty()
    without = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {round(r["score"], 9) for r in without} == {0.1}


def spelled_ratios(texts):
    """ln(P(word | toxic) / P(word | ordinary)) of any word, by the definition: texts are (words, toxic)."""
    own, (mid, low, _) = toxicity.OWN, toxicity.SHARED
    grams = lambda w, k: [(s[max(0, j - k) : j], s[j]) for s in ["^" + w + "$"] for j in range(1, len(s))]
    n = [Counter(), Counter()]
    for words, label in texts:
        for w in words:
            n[label].update(grams(w, own))
    seen = set(n[0]) | set(n[1])
    cut = lambda g, k: (g[0][-k:] if k else "", g[1])
    shared = []
    for k in (mid, low, 0):
        counts = Counter(cut(g, k) for g in (shared[-1] if shared else seen))
        shared.append(counts)
    d = lambda c: toxicity.discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()))
    ds, dk = [d(c) for c in shared], [d(c) for c in n]

    def sums(counts):
        total, types = Counter(), Counter()
        for (h, _), v in counts.items():
            total[h], types[h] = total[h] + v, types[h] + (v > 0)
        return total, types

    shared_sums, own_sums = [sums(c) for c in shared], [sums(c) for c in n]

    def lower(g, level):
        if level == 2:
            return shared[2][g] / sum(shared[2].values())
        total, types = (x[g[0]] for x in shared_sums[level])
        below = lower(cut(g, (mid, low, 0)[level + 1]), level + 1)
        return (max(shared[level][g] - ds[level], 0) + ds[level] * types * below) / total

    def of(w):
        out = 0.0
        for g in grams(w, own):
            weight = [dk[k] * own_sums[k][1][g[0]] / own_sums[k][0][g[0]] if own_sums[k][0][g[0]] else 1.0 for k in (0, 1)]
            if g in seen:
                p = [max(n[k][g] - dk[k], 0) / max(own_sums[k][0][g[0]], 1) + weight[k] * lower(cut(g, mid), 0) for k in (0, 1)]
                out += math.log(p[1] / p[0])
            else:
                out += math.log(weight[1] / weight[0])
        return out

    return of


def test_class_models_by_brute_force(spark):
    """The ratios of all words, by broadcast and by join, and the features of texts."""
    import numpy as np

    rng = random.Random(11)
    rows, marks = [], []
    for i in range(150):
        toxic = int(rng.random() < 0.3)
        w = [rng.choice(["über", "The", "cat", "concatenation", "vilest", "vileness", "日本", "a"][: 8 - 2 * (1 - toxic)]) + rng.choice(["", "s", "ing", ",", "xyzzyxyzzy"]) for _ in range(rng.randrange(0, 25))]
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    texts = {}
    for (i, t), (_, label) in zip(rows, marks, strict=True):
        if part(i) != 0:
            texts[t] = (max(label, texts.get(t, (0, 0))[0]), min(part(i) == 4, texts.get(t, (0, True))[1]))
    of = spelled_ratios([(set(toxicity.tokens(t.encode())), label) for t, (label, checks) in texts.items() if not checks])
    model = toxicity.fit(docs, labels)
    table = toxicity.Table(*model.sent.value)
    assert len(table.keys) == model.entries.count() and (table.keys[1:] > table.keys[:-1]).all()
    words = sorted({w for _, t in rows for w in toxicity.tokens(t.encode())} | {"never", "cats", "vi", "x"})
    assert np.allclose(table.ratios(words), [of(w) for w in words], atol=1e-4)
    want = {}
    for i, t in rows:
        r = [of(w) for w in toxicity.tokens(t.encode())]
        top = sorted({w: of(w) for w in toxicity.tokens(t.encode())}.values(), reverse=True)[: toxicity.STRONGEST]
        want[i] = (sum(r) / max(len(r), 1), sum(top) / max(len(top), 1), math.log(1 + len(set(toxicity.tokens(t.encode())))))
    for m in (model, model._replace(sent=None)):
        found = toxicity._with_features(docs, m).collect()
        assert all(np.allclose([r[c] for c in toxicity.FEATURES], want[r["doc_id"]], atol=1e-4) for r in found) and len(found) == len(rows)
    w = model.weights
    for r in toxicity.toxicity(docs, labels).collect():
        assert abs(r["score"] - 1 / (1 + math.exp(-(w[0] + sum(a * b for a, b in zip(w[1:], want[r["doc_id"]], strict=True)))))) < 1e-4


def test_the_cut_has_the_best_f1():
    import numpy as np

    rng = np.random.default_rng(3)
    z, y = rng.integers(0, 20, 200).astype(float), rng.integers(0, 2, 200).astype(float)
    weight = np.where(y == 1, 0.4, 1.7)
    f1 = lambda cut: 2 * weight @ (y * (z > cut)) / (weight @ (z > cut) + weight @ y)
    assert abs(f1(toxicity.best_cut(z, y, weight)) - max(f1(c) for c in np.arange(-1, 20, 0.5))) < 1e-12


def test_long_texts_are_not_toxic_by_length(spark):
    """Ordinary texts of two to 2,000 words: the largest ratios of a long one are larger by chance."""
    rng = random.Random(17)
    rows, marks = [], []
    for i in range(700):
        bad = i % 5 == 0
        w = ["".join(rng.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.choice([2, 40, 100]) if bad else rng.choice([2, 40, 400, 2000]))]
        for _ in range(2 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    held = toxicity.toxicity(docs, labels).filter("held_out").collect()
    assert all(r["predicted"] == 0 for r in held if len(rows[r["doc_id"]][1].split()) >= 400)
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) >= 0.95 * len(held)


def test_toxic_words_are_found(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = [f"u{rng.randrange(500)}" for _ in range(rng.randrange(30, 120))]
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = toxicity.toxicity(docs, labels).filter("held_out").collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)


def test_toxic_words_are_found_in_a_balanced_sample(spark):
    """Both classes have more rows than are read, so the sample has as many toxic rows as ordinary ones."""
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(1600):
        w = [f"u{rng.randrange(500)}" for _ in range(rng.randrange(30, 120))]
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = toxicity.toxicity(docs, labels, max_labelled=300).filter("held_out").collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)


CLASHES = [
    "features", "raw", "prediction", "probability", "rawPrediction", "f_words", "p", "rate", "n_tokens", "label", "domain", "_digest", "digest", "kept_id", "kept_digest", "_kept_id", "keep_id", "kept", "dropped", "_dropped", "number",
    "_copy", "mean", "strongest", "row", "score", "toxicity", "_toxicity", "_whole", "whole", "c0", "c1", "v", "key", "a", "b", "ids", "block", "slice", "held", "kind", "place", "lines", "starts", "gone", "seeds", "anchor", "first", "salt", "body", "n",
]


def test_columns_with_names_of_temporaries_stay(spark, texts, labels):
    """Every operator on a table that has all its temporary names as columns; those that return the table return it whole."""
    import corpus_pipeline

    rows = [(i, t, "en", "s", 0) for i, t in texts if t is None or len(t) < 9000]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    folder = written_labels(spark, labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert [found[0][c] for c in CLASHES] == [f"own {c}" for c in CLASHES], name
        assert Counter(tuple(r[c] for c in plain.columns) for r in found) == Counter(map(tuple, stage(spark, plain, folder).collect())), name
    assert corpus_pipeline.encoded(spark, docs, folder).count() == len(rows)
    kept = [c for c in CLASHES if c not in ("n_tokens", "p", "rate", "copies")]
    assert mixture.mix(docs, labels, {0: 0.5, 1: 0.5}).filter(" OR ".join(f"`{c}` <> 'own {c}'" for c in kept)).isEmpty()
    for f in (substring_dedup.substring_dedup, mixing_lm.lm_scores, jaccard_join.components, quality.quality, lambda d: sharding.shards(d, 6), exact_dedup.exact_groups, lambda d: toxicity.toxicity(d, labels), line_dedup.line_dedup):
        assert f(docs).count() == len(rows)


def written_labels(spark, labels):
    from tessera.llm.shared import shared_folder

    folder = f"{shared_folder(spark)}/clash-labels"
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return folder


def test_texts_without_tokens_keep_their_rate(spark, texts, labels):
    """Targets out of reach move rates along a direction in which a blank text is far out; it has no tokens to give."""
    plain = spark.createDataFrame([(i, t) for i, t in texts if t is None or len(t) < 9000], "doc_id long, text string")
    for least in (0.0, 1.0, 2.0):
        out = mixture.mix(plain, labels, {0: 0.15, 1: 0.85}, least=least)
        assert {r["copies"] for r in out.filter("n_tokens = 0").collect()} == {max(1, int(least))}


def test_steps_of_the_solver_share_a_plan(spark):
    """Steps differ in one literal only, so that neither plans nor generated code grow with their number and vectors."""
    import numpy as np

    scored = spark.range(50).selectExpr("id % 7 + 1 AS n_tokens", "array(id / 50D, 1 - id / 50D) AS p").cache()
    asked, first = [], type(scored).collect
    type(scored).collect = lambda df: asked.append(df.columns) or first(df)
    try:
        mixture.solve_rates(scored, np.array([200.0, 60.0]))
    finally:
        type(scored).collect = first
    assert asked and {tuple(c) for c in asked} == {("i", *(f"s{i}" for i in range(8)))}


def least_squares(n, p, targets, least):
    """Rates by accelerated projected gradients over all documents in memory, restarted where they overshoot."""
    import numpy as np

    a = p * np.sqrt(n)[:, None]
    length = 1 / np.linalg.eigvalsh(a.T @ a)[-1]
    rates = ahead = np.ones(len(n))
    t = 1.0
    for _ in range(60_000):
        new = np.maximum(least, ahead - length * (p @ ((ahead * n) @ p - targets)))
        if ((ahead - new) * (new - rates) * n).sum() > 0:
            t = 1.0
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, rates, t = new + (t - 1) / u * (new - rates), new, u
    return rates


def test_rates_are_the_least_squares(spark):
    """At both bounds, where the targets can't be met, and where most documents end at the bound."""
    import numpy as np

    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.6] * 4, 400)
    n = rng.integers(0, 400, 400).astype(float)
    scored = spark.createDataFrame([(int(x), [float(y) for y in q]) for x, q in zip(n, p, strict=True)], "n_tokens long, p array<double>").cache()
    have = (n @ p).sum()
    cases = [(1.0, (n * (1 + rng.exponential(1.0, 400))) @ p), (1.0, np.array([0.1, 0.1, 0.1, 0.7]) * have * 2)]
    cases += [(0.0, np.array(w) * have) for w in ((1.0, 0, 0, 0), (0.7, 0.2, 0.1, 0), (0.5, 0.3, 0.15, 0.05))]
    for least, targets in cases:
        solved = mixture.solve_rates(scored, targets, least)
        best = ((targets - (least_squares(n, p, targets, least) * n) @ p) ** 2).sum()
        squares = ((targets - solved.totals) ** 2).sum()
        assert solved.converged and squares <= best * (1 + 1e-6) + 1e-9 * (targets**2).sum(), (least, targets, squares, best, solved)
        found = scored.select("p", (F.col("n_tokens") * solved.rate).alias("x"), solved.rate.alias("rate")).collect()
        assert np.allclose(sum(np.array(r["p"]) * r["x"] for r in found), solved.totals, rtol=1e-6, atol=1e-3) and min(r["rate"] for r in found) >= least


def test_counts_keep_their_ratio():
    import numpy as np

    n = np.array([0, 1, 63, 64, 100, 255, 300, 1_000_000, 2_000_000, 2**37])
    back = mixing_lm.COUNTS[mixing_lm.coded(n)]
    assert list(back[:4]) == [0, 1, 63, 64] and (np.diff(mixing_lm.COUNTS) > 0).all()
    assert (back <= n).all() and (back[4:] > n[4:] * 0.875).all()
    s = mixing_lm.Successors([np.array([(5 << mixing_lm.NEXT_BITS) + 7, (5 << mixing_lm.NEXT_BITS) + 9], np.uint64)], [np.array([2_000_000, 300])])
    times, rest = (mixing_lm.COUNTS[mixing_lm._unplanes(x, np.uint8)] for x in mixing_lm._unlist(s.answer(np.array([5], np.uint64), 1))[3:])
    assert 6000 < times[0] / rest[0] < 7500


def test_many_lines(spark):
    """The time of a text follows its lines: a copy of 60,000 lines, and a text of repeats."""
    lines = [f"line {i} of many that are not alike" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["first of all", *lines])), (3, "\n".join(["again and again"] * 9))]
    found = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()}
    assert [found[i]["n_removed"] for i in (1, 2, 3)] == [0, 60_000, 6]
    assert found[2]["kept_text"] == "first of all"


def test_mixture(docs, texts, labels, none):
    out = mixture.mix(docs, labels, {0: 0.4, 1: 0.6})
    r = out.agg(*(F.sum(F.expr(f"rate * n_tokens * p[{i}]")).alias(f"t{i}") for i in (0, 1)), F.min("rate").alias("least"), F.count("*").alias("n")).first()
    assert r["n"] == len(texts) and r["least"] >= 0 and abs(r["t0"] / (r["t0"] + r["t1"]) - 0.4) < 1e-3
    assert out.filter("abs(copies - rate) >= 1").isEmpty()
    one = mixture.mix(docs, labels.limit(0), {0: 1.0}).collect()
    assert {x["rate"] for x in one} == {1.0}
    least = mixture.mix(docs, labels, {0: 0.5, 1: 0.5}, least=1.0, keep_text=True)
    assert least.filter("rate < 1 OR copies < 1").isEmpty()
    assert mixture.repeated(least, docs.columns).columns == docs.columns
    assert mixture.mix(none, labels, {0: 0.5, 1: 0.5}).isEmpty()
