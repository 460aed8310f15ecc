"""The registered queries of this package, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, chat_format, conversation_repair, exact_dedup, jaccard_join, line_dedup, mixing_lm, mixture, pieces, quality, sharding, substring_dedup, toxicity
from tessera.llm.shared import conversations, documents

N_SHARDS = 40
#: Folder of the tokenizer files; in it, the SentencePiece model.
TOKENIZERS = "/opt/tokenizers"
MODEL_FILE = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_BPE_FILE = f"{TOKENIZERS}/byte_bpe_50k.json"


#: Target shares of tokens: of texts labelled as good, and of the others.
MIX_WEIGHTS = {0: 0.15, 1: 0.85}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX_WEIGHTS)
    return mixed.select("doc_id", "n_tokens", "p", "rate", "copies")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).drop("kept_text")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.lm_scores(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir), MODEL_FILE)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir)).drop("class_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), N_SHARDS)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).drop("kept_text")


def op10_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only runs of three lines go, whatever their length: shorter repeats of long lines stay."""
    return line_dedup.line_dedup(documents(spark, sf_dir), long_words=None).drop("kept_text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(conversation_repair.damaged(conversations(spark, sf_dir)))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(documents(spark, sf_dir), BYTE_BPE_FILE, MODEL_FILE)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.formatted(chat_format.with_probe(spark, conversations(spark, sf_dir))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op10_line_dedup_runs": op10_line_dedup_runs,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_alignment": op12_alignment,
    "op13_chat_format": op13_chat_format,
}

SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d),
x AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS c FROM s),
f AS (SELECT c, min(doc_id) AS m FROM x GROUP BY c),
later AS (SELECT x.doc_id, x.s FROM x JOIN f USING (c) WHERE f.m < x.doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM later) GROUP BY doc_id),
runs AS (SELECT doc_id, sum(CASE WHEN before IS NULL OR s - before > 13 THEN 1 ELSE 0 END) AS r
  FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM later) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, CAST(coalesce(r, 0) AS BIGINT) AS n_repeats,
 sha256(array_to_string(list_filter(w, lambda x, i: g IS NULL OR NOT list_contains(g, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op10_line_dedup_runs": r"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
  lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS s FROM d),
x AS (SELECT doc_id, s, array_to_string(l[s:s + 2], chr(10)) AS c FROM s),
f AS (SELECT c, min(struct_pack(d := doc_id, s := s)) AS m FROM x GROUP BY c),
later AS (SELECT x.doc_id, x.s FROM x JOIN f USING (c) WHERE f.m.d <> x.doc_id OR x.s - f.m.s >= 3),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM later) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_filter(l, lambda x, i: g IS NULL OR NOT list_contains(g, i)), chr(10))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
  lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS s FROM d),
k AS (SELECT doc_id, s, k, array_to_string(l[s:s + k - 1], chr(10)) AS c FROM s, range(1, 4) t(k) WHERE s + k - 1 <= len(l)),
x AS (SELECT * FROM k WHERE k = 3 OR len(regexp_extract_all(c, '[^\x20\x09-\x0D]+')) >= 50),
f AS (SELECT k, c, min(struct_pack(d := doc_id, s := s)) AS m FROM x GROUP BY k, c),
later AS (SELECT x.doc_id, x.s, x.k FROM x JOIN f USING (k, c) WHERE f.m.d <> x.doc_id OR x.s - f.m.s >= x.k),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM later) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
 sha256(array_to_string(list_filter(l, lambda x, i: g IS NULL OR NOT list_contains(g, i)), chr(10))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM d)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v WHERE r.m < l.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(m) AS component_id FROM d LEFT JOIN z USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY 1, 2""",
    "op11_conversation_repair": r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
crc AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM crc, range(2) t(n) WHERE h <> 0 AND n <= CASE WHEN h = 3 THEN 1 ELSE 0 END),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM i),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM n),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, [struct_pack(c := CAST(0 AS BIGINT), a := '', o := '', st := 0)] AS w FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT r.conv_id, f.i, list_filter(list_transform([0, 1, 2, 3], lambda s: list_min(list_filter(
    list_transform(g, lambda x: struct_pack(c := x.c + 4, a := x.a || 'D', o := x.o, st := x.st))
    || list_transform(list_filter(g, lambda x: fault NOT IN (1, 2) AND CASE left(role, 1) WHEN 's' THEN x.st = 0 WHEN 'u' THEN x.st <> 2 WHEN 'a' THEN x.st = 2 ELSE false END),
      lambda x: struct_pack(c := x.c + fault, a := x.a || 'K', o := x.o || chr(10) || role || ':' || text, st := CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END))
    || list_transform(list_filter(g, lambda x: fault NOT IN (1, 2)),
      lambda x: struct_pack(c := x.c + fault + 3, a := x.a || 'R', o := x.o || chr(10) || CASE WHEN x.st = 2 THEN 'assistant:' ELSE 'user:' END || text, st := CASE WHEN x.st = 2 THEN 3 ELSE 2 END)),
    lambda x: x.st = s))), lambda x: x IS NOT NULL)
  FROM (SELECT conv_id, i, w || list_transform(w, lambda x: struct_pack(c := x.c + 3, a := x.a || 'I', o := x.o || chr(10) || CASE WHEN x.st = 2 THEN 'assistant:' ELSE 'user:' END, st := CASE WHEN x.st = 2 THEN 3 ELSE 2 END)) AS g FROM r) r
  JOIN (SELECT conv_id, i, role, text, CAST(fault AS BIGINT) AS fault FROM f) f ON f.conv_id = r.conv_id AND f.i = r.i + 1),
best AS (SELECT conv_id, list_min(list_filter(w || list_transform(list_filter(w, lambda x: x.st = 2), lambda x: struct_pack(c := x.c + 3, a := x.a || 'I', o := x.o || chr(10) || 'assistant:', st := 3)),
  lambda x: x.st IN (0, 3))) AS b FROM r WHERE i = (SELECT count(*) FROM f WHERE f.conv_id = r.conv_id)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 b.c AS cost, b.a AS audit, sha256(substr(b.o, 2)) AS repaired_sha256 FROM best LEFT JOIN g USING (conv_id)""",
    "op13_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, role || chr(1) || text AS joined, regexp_extract_all(text, '!\[(image|audio|document)(?: ([0-9]{1,9}))?\]\(([^()\s]{1,1000})\)') AS att FROM c),
e AS (SELECT *, list_sum(list_transform(['\', '<|turn|>', '<|text|>', '<|end|>', '<|image|>', '<|audio|>', '<|document|>', '<s>', '</s>', '[INST]', '[/INST]', '<|endoftext|>'],
  lambda x: (length(joined) - length(replace(joined, x, ''))) // length(x))) AS escapes,
 list_sum(list_transform(att, lambda x: CASE x[3] WHEN 'i' THEN 9 WHEN 'a' THEN 9 ELSE 12 END - length(x))) AS shown,
 list_sum(list_transform(att, lambda x: CASE x[3] WHEN 'i' THEN 2 + coalesce(TRY_CAST(regexp_extract(x, ' ([0-9]+)\]', 1) AS BIGINT), 256)
   WHEN 'a' THEN 2 + 25 * coalesce(TRY_CAST(regexp_extract(x, ' ([0-9]+)\]', 1) AS BIGINT), 30) ELSE 2 + 600 * coalesce(TRY_CAST(regexp_extract(x, ' ([0-9]+)\]', 1) AS BIGINT), 1) END)) AS tokens FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(role) + length(text) + escapes + coalesce(shown, 0) + 23) AS BIGINT) AS formatted_chars, CAST(sum(len(att)) AS BIGINT) AS n_attachments, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS n_tokens_attached
FROM e GROUP BY conv_id""",
}
