"""Near-duplicates by shingle sets, against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from langshift.llm import shingles, simhash


def brute_components(texts, similarity=Fraction(4, 5)):
    sets = {}
    for i, text in texts:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    found = {i: i for i in sets}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and sets[i] and sets[j]):
                a, b = root(i), root(j)
                found[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def made(rng):
    """Texts, edited copies from just below to just above the similarity, a common passage, a large group."""
    words = [f"w{k}" for k in range(500)]
    texts = [[rng.choice(words) for _ in range(rng.randint(3, 150))] for _ in range(40)]
    for base in texts[:30]:
        for edits in (1, 2, 3, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "new" + str(rng.random())
            texts.append(copy)
    passage = [rng.choice(words) for _ in range(80)]
    texts += [passage + [rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(50)]
    group = [rng.choice(words) for _ in range(120)]
    for _ in range(60):
        copy = list(group)
        copy[rng.randrange(120)] = "new" + str(rng.random())
        texts.append(copy)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None), (902, texts and " ".join(texts[0]).upper())]


@pytest.mark.parametrize("block", [2048, 16])
def test_all_similar_pairs_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "PAIRED", block // 2)
    texts = made(random.Random(block))
    out = shingles.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(texts) and len(out) == len(texts)
    assert shingles.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_histograms_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 17, 300, 5000):
        for shared in (0, n // 2, n):
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2)])) for common in [rng.integers(0, 1 << 63, shared, dtype=np.uint64)] for m in (n - shared, n - shared + n // 8))
            bound = shingles.overlap_bound(shingles.histogram(a), shingles.histogram(b))
            assert bound >= len(np.intersect1d(a, b))
    close = np.arange(3000, dtype=np.uint64)
    assert shingles.histogram(close) == b"" and shingles.overlap_bound(b"", shingles.histogram(close[:20])) is None


def test_no_set_with_a_partner_is_left_out():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([base[: int(rng.integers(10, 700))], rng.integers(0, 1 << 63, int(rng.integers(1, 120)), dtype=np.uint64) * np.uint64(2)])) for _ in range(150)]
    groups = rng.integers(0, 40, len(sets))
    sizes = np.array([len(s) for s in sets])
    fps = rng.permutation(len(sets))
    found = shingles.partners(fps, sizes, [shingles.histogram(s) for s in sets], groups, Fraction(4, 5))
    for i in range(len(sets)):
        for j in range(len(sets)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if groups[i] != groups[j] and shared * 9 >= 4 * (sizes[i] + sizes[j]):
                assert found[i] <= fps[j] and found[j] <= fps[i]
    assert 0 < (found != shingles.NONE).sum() < len(sets)


def test_pipeline_stage_takes_five_words_and_similarity(spark):
    rng = random.Random(5)
    texts = made(rng)
    expected = brute_components(texts)
    wide = [i for i, root in expected.items() if root != i and (simhash.fingerprint(dict(texts)[root] or "", 4) ^ simhash.fingerprint(dict(texts)[i] or "", 4)).bit_count() > 4]
    assert wide  # four bits wouldn't link these to their first
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(expected.values())


def test_pipeline_stage_links_through_the_covering_tables(spark, monkeypatch):
    """Without the prefix filter, whatever lies within the radius is linked, and nothing that isn't similar."""
    texts = made(random.Random(6))
    near = {i: simhash.majority(shingles.shingle_set(t or "", 5)) for i, t in texts}
    none = "src long, dst long, shingle long"
    monkeypatch.setattr(shingles, "meetings", lambda rows, similarity: rows.sparkSession.createDataFrame([], none))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, "").collect()}
    whole = brute_components(texts)
    sets = {i: set(shingles.shingle_set(t or "", 5).tolist()) for i, t in texts}
    links = [(i, j) for i in sets for j in sets if i < j and (near[i] ^ near[j]).bit_count() <= shingles.RADIUS and sets[i] != sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    assert links and set(whole.values()) <= kept and not {j for i, j in links if near[i] == near[j]} & kept
    copies = sum(i != next(j for j in sets if sets[j] == sets[i]) for i in sets)
    assert len(kept) < len(texts) - copies


def test_fingerprints_of_sets_are_those_of_texts():
    for text in ("", "one", "a b c d e f g", " ".join(f"w{k}" for k in range(900))):
        assert simhash.majority(shingles.shingle_set(text, 5)) == simhash.fingerprint(text, 5)
