"""The stages of the pipeline against brute force over what each one got."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.pieces import pieces
from tessera.llm.queries import MODEL_FILE
from tessera.llm.shared import documents, written


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[s : s + 5]) for s in range(max(len(w) - 4, 1))) if w else frozenset()


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == documents(spark, sf_dir).columns
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in kept["toxicity"]} == {i for i, p in scored.items() if not p}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in kept["toxicity"]:
        first[norm(r["text"])] = min(r["doc_id"], first.get(norm(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in kept["exact_dedup"]} == set(first.values())
    sets = {r["doc_id"]: shingled(r["text"]) for r in kept["exact_dedup"]}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in range(10):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert {r["doc_id"] for r in kept["near_dedup"]} == set(label.values())
    assert {r["doc_id"] for r in kept["mixing"]} == {r["doc_id"] for r in kept["near_dedup"]}
    text = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    p = pieces(MODEL_FILE)
    assert len(kept["sentencepiece"]) == len(kept["mixing"])
    assert all(p.decode(r["ids"]) == text[r["doc_id"]] for r in kept["sentencepiece"])


def test_texts_go_to_python_in_small_batches(spark, sf_dir):
    """By default Spark hands 64 MB of texts to Python at once, which each task of an executor holds twice."""
    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    docs = documents(spark, sf_dir)
    for stage in (corpus_pipeline.clean, corpus_pipeline.without_near_copies, corpus_pipeline.encoded):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, sf_dir)
        assert max(r["n"] for r in long.mapInArrow(size, "n long").collect()) < corpus_pipeline.BATCH_BYTES + 10_000
