"""Very long texts in the operators on pairs, and the pipeline on null ids and on an empty table."""

import random

import corpus_pipeline
from langshift.llm import shingles, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def long_text(seed, words=150_000):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randint(0, 999)) for _ in range(words))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


def test_very_long_texts_are_compared_whole(spark):
    text = long_text(1)
    other_end = text + " " + long_text(2, 60_000)  # the same for the first 150 000 words, 0.71 of all shingles
    rows = [(1, text), (2, text.upper()), (3, text + " one more word at the end"), (4, other_end), (5, long_text(3))]
    near = {r.doc_id: r.component_id for r in shingles.near_duplicates(documents(spark, rows)).collect()}
    assert near == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    prints = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint and prints[2].component_id == 1 and prints[5].component_id == 5


def test_the_pipeline_takes_null_ids_and_an_empty_table(spark, tmp_path):
    english = "this is some plain english text about the weather and the news of the day"
    rows = [(k, f"{english}, written {k} times over and over again by people number {k * 31}") for k in range(20)]
    rows += [(None, f"{english} without an id"), (None, f"{english} without an id"), (30, None), (31, ""), (32, rows[3][1])]
    documents(spark, rows).write.parquet(f"{tmp_path}/some/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert None in ids and 32 in ids and 3 not in ids and not ids & {30, 31}
    documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.count() == 0 and empty.columns == out.columns
