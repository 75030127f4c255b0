"""Exact and near duplicates, nearest neighbours, HTML, WARC, the pipeline: against brute force."""

import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from langshift.llm import ann, common, exact_dedup, html_extract, simhash, warc_zip

DOCS = "doc_id bigint, text string, digest string, fp int, keep_id int, component_id int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in texts], DOCS)


def test_exact_duplicates(spark):
    texts = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "abc"), (None, "ABC"), (8, "abc"), (None, "lone")]
    out = exact_dedup.deduplicate(documents(spark, texts)).collect()
    groups = {}
    for i, t in texts:
        key = "".join(c.lower() if c.isascii() else c for c in t or "")
        groups.setdefault(key, []).append(i)
    expected = []
    for i, t in texts:
        key = "".join(c.lower() if c.isascii() else c for c in t or "")
        keep = max((x for x in groups[key] if x is not None), default=None)
        expected.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    order = lambda r: (str(r[0]), r[4])
    assert sorted(map(tuple, out), key=order) == sorted(expected, key=order)
    kept = exact_dedup.keep_one(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["8", "8", "3", "5", "6", "7", "None"])
    assert exact_dedup.deduplicate(documents(spark, [])).count() == 0


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_a_whole_table_goes_through_the_index_in_batches(spark, batches, monkeypatch):
    rng = random.Random(4)
    texts = [(rng.randint(-50, 400), rng.choice(["a", "A", "b", "C c", None, "", f"own {k}"])) for k in range(300)] + [(None, "a"), (None, "lone"), (None, "lone")]
    sizes = []
    add = exact_dedup.add_digests
    monkeypatch.setattr(exact_dedup, "add_digests", lambda digests, index, *rest: sizes.append(index.read().count()) or add(digests, index, *rest))
    whole = exact_dedup.deduplicate_whole(documents(spark, texts), batches=batches)
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, whole.collect()), key=order) == sorted(map(tuple, exact_dedup.deduplicate(documents(spark, texts)).collect()), key=order)
    # Every batch but the first meets an index that has something to hold it against.
    assert len(sizes) == batches and sizes[0] == 0 and all(sizes[1:])
    assert exact_dedup.deduplicate_whole(documents(spark, []), batches=batches).count() == 0


def test_a_batch_needs_a_name_and_an_index_is_compacted(spark, tmp_path):
    table = "digests_to_compact"
    for name in (table, f"{table}_aside", f"{table}_compact"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    index = exact_dedup.DigestIndex.open(spark, table, buckets=2, location=f"{tmp_path}/index")
    for n in range(4):
        exact_dedup.add_batch(documents(spark, [(10 * n + k, f"{n} {k}") for k in range(8)]), index, f"b{n}", f"{tmp_path}/{n}")
    for call in (exact_dedup.deduplicate, exact_dedup.keep_one):
        with pytest.raises(ValueError, match="name"):
            call(documents(spark, [(1, "x")]), index=index)
    before = sorted(map(str, index.read().collect()))
    assert len(index.read().inputFiles()) > 4
    index.compact(f"{tmp_path}/compacted")
    assert sorted(map(str, index.read().collect())) == before and len(index.read().inputFiles()) == 2 and index.buckets == 2
    assert [r.kept for r in exact_dedup.add_batch(documents(spark, [(99, "0 0"), (98, "new")]), index, "b9", f"{tmp_path}/9").orderBy("doc_id").collect()] == [True, False]
    # A compaction that ended between its two renames is undone by the next open.
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}_aside")
    assert exact_dedup.DigestIndex.open(spark, table).read().count() == 33
    index.drop()


def test_index_outlives_batches(spark, tmp_path):
    table = "digests_of_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    index = exact_dedup.DigestIndex.open(spark, table, location=f"{tmp_path}/index")
    exact_dedup.add_batch(documents(spark, [(1, "a"), (2, "b"), (3, "A")]), index, "one", f"{tmp_path}/one")
    second = documents(spark, [(10, "a"), (11, "c"), (12, "c"), (13, None)])

    def rows(frame):
        return {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in frame.collect()}

    expected = {10: (3, False, 1), 11: (12, False, 2), 12: (12, True, 2), 13: (13, True, 1)}
    # A run that ends before its output is written leaves nothing behind; one that ends before or after
    # the append gives the same rows again.
    assert rows(exact_dedup.deduplicate(second, index=index, batch="two")) == expected
    assert index.read().count() == 2
    for _ in range(2):
        assert rows(exact_dedup.add_batch(second, index, "two", f"{tmp_path}/two")) == expected
        assert index.read().count() == 4 and index.read().select("digest").distinct().count() == 4
    assert {r.doc_id for r in exact_dedup.keep_one(second, index=index, batch="two").collect()} == {12, 13}
    # Another session opens the table with the buckets that it has.
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex.open(spark, table)
        assert again.buckets == int(partitions)
        assert rows(exact_dedup.add_batch(documents(spark, [(20, "B"), (21, "new")]), again, "three", f"{tmp_path}/three")) == {20: (2, False, 1), 21: (21, True, 1)}
        groups = common.cut_lineage(exact_dedup.digest_groups(second.select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest")), "doc_id"))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = exact_dedup.held_against(groups, again, "four")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Bucketed: true" in plan and "LeftAnti" in plan
    anti = plan[plan.index("LeftAnti") : plan.index("Inner")]
    assert anti.count("Exchange hashpartitioning") == 1  # that of the groups; the index lies as it is needed
    index.drop()


def test_text_that_is_hot_in_a_later_batch_only(spark, tmp_path):
    index = exact_dedup.DigestIndex.open(spark, "digests_of_hot_texts", location=f"{tmp_path}/index")
    exact_dedup.add_batch(documents(spark, [(1, "same"), (2, "b")]), index, "one", f"{tmp_path}/one")
    rows = spark.range(6000).select((F.col("id") % 50 + 10).alias("doc_id"), F.when(F.col("id") % 3 > 0, "SAME").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.add_batch(rows, index, "two", f"{tmp_path}/two")
    assert out.count() == 6000 and out.where("group_size = 4000 and keep_id = 1 and not kept").count() == 4000
    assert out.where("kept").count() == 2000
    index.drop()


def test_no_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    long = "x" * 3_000_000
    out = exact_dedup.deduplicate_whole(documents(spark, [(1, long), (2, long.upper()), (3, None)]))
    assert {(r.doc_id, r.keep_id, r.kept) for r in out.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("sent", [200_000, 0])
def test_rows_are_dropped_by_key(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "SENT_KEYS", sent)
    docs = documents(spark, [(1, "a"), (None, "b"), (2, None), (2, "c")])
    gone = spark.createDataFrame([(1,), (None,)], "id bigint").select(F.struct("id").alias("x"))
    assert sorted(r.text or "" for r in common.without(docs, F.struct(F.col("doc_id").alias("id")), gone).collect()) == ["", "c"]


def test_hot_groups_take_the_broadcast_side(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 900)).alias("key"))
    groups = rows.groupBy("key").agg(F.max("doc_id").alias("m"), F.count("*").alias("n"))
    out = common.attach_group(rows, groups, "key", "n", 4000)
    assert out.count() == 4000
    assert out.join(groups.withColumnsRenamed({"m": "m2", "n": "n2"}), "key").where("m = m2 and n = n2").count() == 4000


def brute_components(fps, radius):
    parent = {f: f for f in set(fps.values())}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for i, f in fps.items():
        least[root(f)] = min(least.get(root(f), i), i)
    return {i: least[root(f)] for i, f in fps.items()}


def test_covering_masks_miss_no_pair():
    rng = random.Random(4)
    for radius, within in ((1, -1), (2, -1), (4, -1), (4, 0x0F0F_FFFF_0000_1234)):
        masks = simhash.covering_masks(radius, within=within)
        bits = [b for b in range(64) if within >> b & 1]
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            flips = sum(1 << b for b in rng.sample(bits, rng.randint(0, radius)))
            assert any(not (m & flips) for m in masks)


@pytest.mark.parametrize("block", [2048, 8, 3])
def test_near_duplicate_components(spark, monkeypatch, block):
    """With small blocks, large buckets go through the second family and the pairs of blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    values = {}
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            values[len(values)] = centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
    chain = rng.getrandbits(64)
    for _ in range(40):  # a chain whose ends are far apart, and a dense group
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        values[len(values)] = chain
        values[len(values)] = 0xABCD ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(set(values.values()))]
    nodes = spark.createDataFrame(signed, "fp bigint")
    roots = {r.node: r.root for r in simhash.components(nodes, simhash.near_edges(nodes, 4)).collect()}
    found = {i: roots.get(v - (1 << 64) if v >> 63 else v, v - (1 << 64) if v >> 63 else v) for i, v in values.items()}
    expected = brute_components(values, 4)
    assert {(found[a] == found[b]) for a in values for b in values if expected[a] == expected[b]} == {True}
    assert {(found[a] == found[b]) for a in values for b in values if expected[a] != expected[b]} == {False}


def test_simhash_rows(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    texts = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace(" ", "\t", 3).upper()) for i, t in enumerate(base[:4])] + [(200 + i, t + " extra") for i, t in enumerate(base[:6])]
    texts += [(300, None), (301, ""), (302, " \t "), (303, "one"), (304, "one two"), (0, base[0]), (None, "lonely words here and there")]
    out = simhash.near_duplicates(documents(spark, texts)).collect()
    fps = {i: simhash.fingerprint(t or "", 4) for i, t in texts if i is not None}
    expected = brute_components(fps, 4)
    assert len(out) == len(texts)
    for r in out:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == expected[r.doc_id]
    assert {r.component_id for r in out if r.doc_id in (300, 301, 302)} == {300}
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert kept == set(expected.values()) | {None}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_fingerprint_by_definition():
    import re

    import xxhash

    for text in ("A b c D e f g", "one", "one two", "x y z w", "É é A a é  b", ""):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text, 4) == sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    x = (centres[rng.integers(0, 6, 900)] + 0.8 * rng.standard_normal((900, 16))).astype(np.float32)
    x[100:130] = x[100]  # copies: ties go to smaller ids
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [float("nan")] * 16, 1), (2150, [None] * 16, 1), (None, x[5].tolist(), 1), (0, x[0].tolist(), 1), (2200, [1.0, 2.0], 1), (2201, [1.0, 2.5], 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    out = ann.nearest(vectors, F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        score = unit @ unit[q]
        score[q] = -9
        truth = np.lexsort((np.arange(900), -np.round(score, 12)))[:5]
        got = sorted(found[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(abs(g[2] - score[g[1]]) < 1e-12 for g in got)
        hits += len({g[1] for g in got} & set(truth.tolist()))
    assert hits / 90 >= 0.9
    assert [g[1] for g in sorted(found[100])] == [101, 102, 103, 104, 105]
    assert [g[1] for g in found[2200]] == [2201] and set(found) == {*range(0, 900, 50), 2200}
    assert ann.nearest(vectors.where("false"), F.lit(True)).count() == 0


def forest_by_hand(strings, limit):
    """(tree, prefix as text) -> size of the shortest prefixes that at most ``limit`` strings share, or all bits."""
    out = {}
    for tree in range(strings.shape[1]):
        texts = [format(int(v), f"0{ann.BITS}b") for v in strings[:, tree]]
        shared = {}
        for text in texts:
            for length in range(ann.BITS + 1):
                shared[text[:length]] = shared.get(text[:length], 0) + 1
        for text in texts:
            length = next((i for i in range(ann.BITS) if shared[text[:i]] <= limit), ann.BITS)
            out[tree, text[:length]] = shared[text[:length]]
    return out


def some_strings(rng, n, trees):
    """Strings of any density: some spread, some that share long prefixes, some equal."""
    strings = rng.integers(0, 1 << ann.BITS, (n, trees))
    strings[n // 2 :] = strings[0] ^ rng.integers(0, 64, (n - n // 2, trees))
    strings[-n // 5 :] = strings[-1]
    return strings


def text_of(forest, leaf):
    bits = format(int(forest.starts[forest.tree[leaf]][leaf - forest.first[forest.tree[leaf]]]), f"0{ann.BITS}b")
    length = sum(int(node[at == leaf][0]).bit_length() - 1 for at, node in forest.nodes if (at == leaf).any())
    return bits[:length]


def test_leaves_are_the_shortest_prefixes_that_few_share(spark, monkeypatch):
    """Counted in several rounds, longer prefixes below crowded ones alone."""
    for counted in (20, 6):
        monkeypatch.setattr(ann, "COUNTED", counted)
        strings = some_strings(np.random.default_rng(counted), 200, 3)
        table = spark.createDataFrame([(t, int(v)) for t in range(3) for v in strings[:, t]], "tree int, hash long")
        forest = ann.counted_forest(table, 200, 3)
        assert {(int(t), text_of(forest, i)): int(forest.sizes[i]) for i, t in enumerate(forest.tree)} == forest_by_hand(strings, ann.LEAF)
        for row, found in zip(strings, forest.leaves_of(strings), strict=True):
            assert all(format(int(v), f"0{ann.BITS}b").startswith(text_of(forest, leaf)) and forest.tree[leaf] == t for t, (v, leaf) in enumerate(zip(row, found, strict=True)))


def test_ascent_in_order_of_what_differing_bits_cost():
    rng = np.random.default_rng(1)
    for wanted in (1, 40, 300, 10_000):
        strings, margins = some_strings(rng, 150, 3), rng.standard_normal((3, ann.BITS))
        forest = ann.Forest([ann.labels(*np.unique(strings[:, t], return_counts=True), 3) for t in range(3)], 20)
        own = [(margins[t], text_of(forest, i)) for i, t in enumerate(forest.tree)]
        cost = np.array([sum(m[b] ** 2 for b, bit in enumerate(prefix) if (bit == "1") != (m[b] > 0)) for m, prefix in own])
        assert np.allclose(forest.costs(margins), cost, rtol=1e-4, atol=1e-5)
        chosen = np.isin(np.arange(len(cost)), forest.ascend(margins, wanted))
        assert forest.sizes[chosen].sum() >= min(wanted, forest.sizes.sum())
        if not chosen.all():
            assert cost[chosen].max() <= cost[~chosen].min() + 1e-4 and forest.sizes[chosen & (cost < cost[chosen].max() - 1e-3)].sum() < wanted


def test_nearest_where_the_forest_prunes(spark, monkeypatch):
    """Against the SQL that compares all vectors, with many salts and chunks, and a dense cluster of nearly equal
    vectors that holds a third of all."""
    import duckdb

    from langshift.llm import oracles

    monkeypatch.setattr(ann, "BLOCK", 500)
    monkeypatch.setattr(ann, "CHUNK", 10)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[::3] = x[0] + 1e-3 * rng.standard_normal((1000, 32)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    out = ann.nearest(vectors, F.col("vec_id") % 50 == 0).toPandas()
    con = duckdb.connect()
    con.register("given", vectors.toPandas())
    con.execute("CREATE TABLE embeddings AS SELECT vec_id, embedding::FLOAT[] AS embedding FROM given")
    truth = con.execute(oracles.NEAREST).df()
    assert len(out) == len(truth) == 60 * 5
    worst = truth.groupby("query_id")["score"].min()
    assert (out["score"] >= out["query_id"].map(worst) - 1e-9).mean() >= 0.9
    both = out.merge(truth, on=["query_id", "vec_id"], suffixes=("", "_sql"))
    assert np.allclose(both["score"], both["score_sql"], atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_few_vectors_are_all_found(spark, n):
    rows = [(50 * i, [float(i + 1), 1.0, 0.5]) for i in range(n)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.lit(True)).collect()
    assert len(out) == n * min(5, n - 1)


@pytest.mark.parametrize("n, size", [(40, 1.0), (300, 1.0), (700, 1.0), (300, 1e200), (300, 1e-200)])
def test_small_tables_and_components_of_any_size(spark, n, size):
    """Data without any structure, searched alike at every size; squares may leave the range of doubles."""
    x = np.random.default_rng(n).standard_normal((n, 48)) * size
    out = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 5 == 0).toPandas()
    unit = x / size / np.linalg.norm(x / size, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 5):
        score = unit @ unit[q]
        score[q] = -9
        got = out[out["query_id"] == q].sort_values("rank")
        assert len(got) == 5 and np.allclose(got["score"], score[got["vec_id"]], atol=1e-12)
        hits += len(set(got["vec_id"]) & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 0.9 * n


PAGE = """<!DOCTYPE html><html><head><title>A title here</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name and motto</h2></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href=/b>Menu two</a></li></ul></nav><!-- ad -->
<div class="ad">Buy this thing now</div><article><h1>The   headline &amp; more</h1><p><b>First paragraph of the text with many words in it.<br><p>Second &eacute;l&#233;ment
 goes on <i>and</i> on for a while.</p><div class="share-bar">Share this page</div><aside>An aside box</aside><form><input name=x> <label>Your mail</label></form><p>Third one closes the matter for good.</p></article>
<section id="comments"><p>What a great page, says a reader.</p></section><div class="cookie-notice">We use cookies</div><footer>&copy; somebody</footer></body></html>"""
TEXT = "The headline & more\nFirst paragraph of the text with many words in it.\nSecond élément goes on and on for a while.\nThird one closes the matter for good."


def pages(spark, values):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "clash") for i, h in values], "page_id bigint, url string, html string, text string")


def test_main_text(spark):
    many = [(i, PAGE) for i in range(20)]
    odd = [(30, None), (31, ""), (32, "<p>"), (33, "no markup at all"), (34, "<nav>only a menu</nav>"), (35, PAGE[:700]), (36, "<" * 500), (None, PAGE), (0, PAGE)]
    out = html_extract.extract_pages(pages(spark, many + odd)).collect()
    assert len(out) == 29 and all(r.n_chars == len(r.text) for r in out)
    texts = {r.page_id: r.text for r in out}
    assert texts[0] == texts[None] == TEXT
    assert [texts[i] for i in (30, 31, 32, 34)] == [""] * 4 and TEXT.startswith(texts[35][:20])
    assert html_extract.extract_pages(pages(spark, [])).count() == 0
    assert html_extract.extract(PAGE, html_extract.Weights()).startswith("The headline") or html_extract.extract(PAGE, html_extract.Weights())


def test_best_region_is_the_largest_sum():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 0, 1, 2, 4]) for _ in range(rng.randint(0, 25))]
        start, end = html_extract.best_region(scores)
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        assert sum(scores[start:end]) == max(best, 0)


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_members_are_found_and_read_in_place(zip64):
    file = io.BytesIO()
    writer = warc_zip.ZipWriter(file, zip64)
    members = {"a/one.bin": b"x" * 1000, "empty": b"", "ünï.txt": "é".encode() * 50}
    for name, data in members.items():
        writer.add(name, data)
    writer.begin("streamed")
    for part in (b"one", b"", b"two" * 100):
        writer.append(part)
    writer.end()
    members["streamed"] = b"one" + b"two" * 100
    writer.close()
    found = warc_zip.directory(file, len(file.getvalue()))
    for name, data in members.items():
        at = warc_zip.data_offset(file, found[name])
        assert warc_zip.read_at(file, at, found[name].size) == data
    with zipfile.ZipFile(file) as archive:  # another reader agrees
        assert archive.testzip() is None and {n: archive.read(n) for n in archive.namelist()} == members
    for other in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):  # and a file of another writer, with a comment
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", other) as archive:
            archive.writestr("m", b"abc" * 100)
            archive.comment = b"hello"
        member = warc_zip.directory(made, len(made.getvalue()))["m"]
        if other == zipfile.ZIP_STORED:
            assert warc_zip.read_at(made, warc_zip.data_offset(made, member), 300) == b"abc" * 100
        else:
            with pytest.raises(ValueError, match="compressed"):
                warc_zip.data_offset(made, member)
    with pytest.raises(ValueError, match="no ZIP"):
        warc_zip.directory(io.BytesIO(b"nothing"), 7)


def test_warc_round_trip(spark):
    long, short = "x" * 150, "y" * 99
    values = [(5, long), (2, long), (9, long), (3, short), (4, short), (6, None), (7, ""), (8, "é" * 200), (2, long), (None, long), (None, "z" * 300), (10, "w" * 200_000)]
    table = pages(spark, values).withColumn("url", F.when(F.col("page_id") != 7, F.concat("url", F.lit("?a b\n c"))))
    folder = common.shared_dir(spark)
    manifest = warc_zip.write_packages(table, folder, zip64=True, records_per_package=3)
    raw = warc_zip.read_packages(manifest, folder).collect()
    out = warc_zip.read_packages(manifest, folder).withColumns({"page_id": warc_zip.page_key("record_id", "bigint"), "refers_to": warc_zip.page_key("refers_to", "bigint")}).collect()
    assert len(raw) == len(out) and all(r.record_id.startswith("<urn:page:") for r in raw)
    assert len(out) == len(values)
    for r in out:
        revisit = r.payload_digest == hashlib.sha256(long.encode()).hexdigest() and r.page_id != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert (r.payload is None) == revisit
    expected = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, h in values)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in out) == expected
    assert warc_zip.round_trip(pages(spark, [])).count() == 0


def test_package_by_the_published_format(spark, tmp_path):
    """A package made by hand: a deflated gzipped index with a header line, records of other types, SHA-1 in
    Base32, chunked coding, no digest, an uncompressed archive."""
    import base64
    import gzip
    import json

    body = b"<p>hello there</p>" * 9
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()

    def raw(fields, block):
        lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
        return f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"

    http = ("Content-Type", "application/http; msgtype=response")
    ok = b"HTTP/1.1 200 OK\r\nX: y\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    records = [
        raw([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>"), ("Content-Type", "application/warc-fields")], b"software: hands\r\n"),
        raw([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://x/1"), ("WARC-Payload-Digest", sha1), http], ok + b"\r\n" + body),
        raw([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Target-URI", "http://x/2"), ("WARC-Payload-Digest", sha1), http], chunked),
        raw([("WARC-Type", "metadata"), ("WARC-Record-ID", "<urn:uuid:3>"), ("Content-Type", "text/plain")], b"note"),
        raw([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:4>"), ("WARC-Refers-To", "<urn:uuid:1>"), http], ok + b"\r\n"),
        raw([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:5>"), http], ok + b"\r\n" + b"no digest"),
    ]
    archives = {"one.warc.gz": [gzip.compress(r) for r in records[:4]], "two.warc": records[4:]}
    lines = []
    for name, held in archives.items():
        at = 0
        for r in held:
            lines.append(f"com,x)/ 2020 {json.dumps({'url': 'http://x', 'filename': name, 'offset': str(at), 'length': str(len(r))})}")
            at += len(r)
    index = gzip.compress(b'!meta {"format": "cdxj"}\n') + gzip.compress("\n".join(sorted(lines)).encode())
    with zipfile.ZipFile(f"{tmp_path}/hand.wacz", "w") as archive:
        for name, held in archives.items():
            archive.writestr(f"archive/{name}", b"".join(held))
        archive.writestr("indexes/index.cdx.gz", index, zipfile.ZIP_DEFLATED)
        archive.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
    manifest = spark.createDataFrame([("hand.wacz", 5000)], "package string, bytes long")
    out = {r.record_id[-2]: r for r in warc_zip.read_packages(manifest, str(tmp_path), records_per_row=2).collect()}
    assert sorted(out) == list("012345")
    assert [out[i].payload for i in "012345"] == [b"software: hands\r\n", body, body, b"note", None, b"no digest"]
    assert out["1"].payload_digest == sha1 and out["5"].payload_digest is None and out["4"].payload_bytes is None
    assert [out[i].record_type for i in "034"] == ["warcinfo", "metadata", "revisit"] and out["4"].refers_to == "<urn:uuid:1>"
    broken = raw([("WARC-Type", "response"), ("WARC-Payload-Digest", sha1), http], ok + b"\r\nother")
    with zipfile.ZipFile(f"{tmp_path}/broken.wacz", "w") as archive:
        archive.writestr("archive/a.warc", broken)
        archive.writestr("indexes/index.cdx", f'x 1 {json.dumps({"filename": "a.warc", "offset": 0, "length": len(broken)})}\n')
    with pytest.raises(Exception, match="not what was written"):
        warc_zip.read_packages(spark.createDataFrame([("broken.wacz", 1)], "package string, bytes long"), str(tmp_path)).collect()


def test_records_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "TASK_BYTES", 2000)
    out = warc_zip.round_trip(pages(spark, [(i, f"{i} " * 400) for i in range(300)]))
    assert out.rdd.getNumPartitions() > 4 and out.count() == 300


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = {"aa": ["lorum", "opsit", "dalor", "remit", "sanct", "velon"], "bb": ["kwixz", "zyqqk", "wvixk", "qkyzz", "xwqik", "qxzzk"]}
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) + str(rng.randint(0, 99)) for _ in range(120)), lang, "s", 1))
    rows += [(200, rows[0][1].upper(), rows[0][2], "s", 1), (201, "123 456", "aa", "s", 1), (202, None, "aa", "s", 1), (203, rows[1][1], rows[1][2], "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stage, columns = dict(corpus_pipeline.STAGES), docs.columns
    named = stage["language ID"](spark, docs, "")
    assert named.columns == columns and {r.doc_id for r in named.collect()} == {*range(120), 200, 203}
    once = stage["exact dedup"](spark, named, "")
    assert once.columns == columns and {r.doc_id for r in once.collect()} == {*range(2, 120), 200, 203}
    near = stage["near dedup"](spark, once, "")
    fps = {r.doc_id: simhash.fingerprint(r.text, 4) for r in once.collect()}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == set(brute_components(fps, 4).values())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(brute_components(fps, 4).values())
