"""Quality classifier, hard negatives, filter audit: against brute force, held-out accuracy, edge cases."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from langshift.llm import filter_audit, hard_negatives, quality

SF = "/root/testdata/sf0.01"

# Hard negatives


def brute_force(rows, is_anchor, positives=5, negatives=5, least=(80, 100)):
    """Rows: (id, label, vector), as they take part."""
    rows = sorted({(i, label, tuple(math.floor(256.0 * x) for x in v)) for i, label, v in rows})
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in rows if len(w) == len(v)]
        found = sorted((s, j) for s, j, other in scored if other == label and j != i)[:positives]
        for p, j in found:
            fit = sorted((s, k) for s, k, other in scored if other != label and least[0] * -p <= least[1] * -s <= least[1] * -p)
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    schema = "vec_id bigint, label int, embedding array<double>, anchor int, positive_id string, home string, v int"
    frame = spark.createDataFrame([(i, label, v, 1, "x", "y", 2) for i, label, v in rows], schema)
    return sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, **options).collect()))


def clustered(n, dim, seed, labels=4, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [(i, int(rng.integers(labels)), (centres[rng.integers(6)] + spread * rng.standard_normal(dim)).round(3).tolist()) for i in range(n)]


def test_hard_negatives_equal_brute_force_in_many_cells(spark):
    rows = clustered(500, 8, 1)
    rows += [(1000 + i, 0, rows[0][2]) for i in range(60)] + [(2000 + i, i % 3, rows[10][2]) for i in range(40)]  # copies, ties
    assert mined(spark, rows, cell_anchors=8) == brute_force(rows, lambda i: i % 10 == 0)


def test_candidates_go_only_to_cells_they_might_serve(spark):
    rows = clustered(900, 6, 2, spread=0.02)
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, v array<double>").select("label", F.array(F.col("vec_id")).alias("ids"), hard_negatives.scaled(F.col("v")).cast("array<int>").alias("v"))
    frame = frame.select("v", "ids", "label", F.lit(0).alias("bucket"), F.size("v").alias("dim"))
    points = np.array([r.v for r in frame.select("v").collect()])
    cells = hard_negatives.Cells({6: hard_negatives.place_pivots(points, 6)}, float((points.astype(float) ** 2).sum(axis=1).max()))
    near = hard_negatives.with_cells(frame, cells, True).collect()
    radius = {c: max(r.away for r in near if r.home == c) for c in {r.home for r in near}}
    # Each cell's anchors need all that is nearer than a tenth of the way between the clusters.
    reach = math.sqrt(cells.square) * 0.5
    bounds = {(6, c, 0): (radius[c], reach) for c in radius}
    sent = hard_negatives.served(hard_negatives.with_cells(frame, cells, False), cells, bounds, False, True).select("ids", "cell").collect()
    got = {(r.ids[0], r.cell) for r in sent}
    assert len(got) == len(sent) < 0.75 * len(rows) * len(radius)
    ids = [r[0] for r in rows]
    norms = (points.astype(float) ** 2).sum(axis=1)
    order = {tuple(p): k for k, p in enumerate(points.tolist())}
    for anchor in near[::30]:
        a = points[order[tuple(anchor.v)]].astype(float)
        distance = np.sqrt(np.maximum((a**2).sum() + cells.square - 2 * points @ a, 0))
        assert all((ids[k], anchor.home) in got for k in np.flatnonzero(distance <= reach).tolist())
    assert norms.max() <= cells.square


def test_hard_negatives_with_salts_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SALT", 40)
    monkeypatch.setattr(hard_negatives, "CHUNK", 5)
    rows = clustered(300, 4, 3, labels=2)
    assert mined(spark, rows, cell_anchors=16) == brute_force(rows, lambda i: i % 10 == 0)


def test_hard_negatives_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.9, 0.4]), (3, 2, [0.95, 0.45]), (10, 2, [-1.0, 0.1]), (11, 2, [0.1, 1.0]), (20, 3, [3.0] * 5), (21, 3, [2.5] * 5), (22, 1, [2.4] * 5), (30, 7, [0.0, 0.0]), (31, 7, [0.0, 0.0]), (32, 8, [0.0, 0.0]), (40, 5, []), (41, 5, []), (42, 6, [])]
    lost = [(None, 1, [1.0, 0.5]), (4, None, [1.0, 0.5]), (5, 1, None), (6, 1, [1.0, None]), (7, 1, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [1e200, 1.0])]
    assert mined(spark, fine + lost) == brute_force(fine, lambda i: i % 10 == 0)
    assert mined(spark, lost) == [] and mined(spark, []) == []
    # Beyond doubles' whole numbers, products are exact longs.
    large = [(i, i % 2, [3.0e5 + i, 2.0e5 - 3 * i, 1.0 / 256]) for i in range(24)]
    assert mined(spark, large) == brute_force(large, lambda i: i % 10 == 0)
    assert len(mined(spark, large)) > 0


# Filter audit


def audited(docs, labels):
    """The audit by plain loops. ``docs``: (id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in orders:
            left = own
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone) - sum(f in r[1] for r in left)
                out[part, order, step + 1] = (len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {(p, o, s): (*x, shares[p, o[s - 1]]) for (p, o, s), x in out.items()}


AUDIT_DOCS = "doc_id bigint, text string, source string, fails int, digest string, part string, first int, step int"


def run_audit(spark, docs, labels):
    frame = spark.createDataFrame([(*d, 1, "x", "y", 3, 4) for d in docs], AUDIT_DOCS)
    found = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = found.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_audit_equals_plain_loops(spark):
    rng = random.Random(5)
    docs = []
    for i in range(120):
        words = [rng.choice(["ab", "cd", "Ef", "GH", "i#j", "k|", "é", "ÄÖ"] if i % 3 else [f"w{k}" for k in range(300)]) for _ in range(rng.choice([0, 3, 49, 50, 51, 400]))]
        docs.append((i, rng.choice([" ", "\n", "\x0b \t"]).join(words) + rng.choice(["", " ", " "]), rng.choice(["a", "b", "b", None])))
    docs += [(200 + i, docs[i % 7][1], "c") for i in range(30)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 230, 2)] + [(2, 1, 0), (None, 1, 1)]
    assert run_audit(spark, docs, labels) == audited(docs, labels)


def test_filter_audit_edge_cases(spark):
    long = "word " * 400_000
    docs = [(None, "same", "x"), (None, "same", "x"), (5, "same", None), (5, "same", ""), (6, "same", "x"), (7, None, "x"), (8, "", "x"), (9, long, "hot"), (1, long, "hot"), (-3, "A", "x")]
    labels = [(5, 1, 1), (6, None, None), (9, 1, 0), (9, 0, 0)]
    assert run_audit(spark, docs, labels) == audited(docs, labels)
    assert run_audit(spark, [], labels) == {} and len(run_audit(spark, docs, [])) == 600 * 3


def test_hot_copies_and_other_filters(spark, monkeypatch):
    docs = [(i, "copy" if i % 2 else f"text {i}", "p") for i in range(3000)]  # a hot group, by the bound of attach_group
    found = run_audit(spark, docs, [])
    assert found["p", "EABCD", 1][:2] == (1501, 1499)
    flags = spark.createDataFrame([("p", f, f % 2 == 0, False) for f in range(8)], "part string, fails int, good boolean, toxic boolean")
    rows = filter_audit.replay(flags, "XYZ").collect()
    assert len(rows) == 6 * 3 and all(r.shapley == sum(x.removed for x in rows if x.filter_order[x.step - 1] == r.filter_order[r.step - 1]) for r in rows)
    with pytest.raises(ValueError):
        filter_audit.replay(flags, "ABCDEFG")


# Quality

DOCS = "doc_id bigint, text string, id string, score string, predicted int, label string, stats string, lang string, source string"


def judged(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "1", "2", 3, "4", "5", "6", "7") for d in docs], DOCS)
    return quality.classify(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_quality_is_learned_and_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 50
    right = [np.mean([r.predicted == label for r in held if r.quality == label]) for label in (0, 1)]
    assert min(right) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_model_equals_plain_numpy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    label_of = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    x = {i: np.array(quality.statistics(t or "")) / quality.UNIT for i, t in texts.items()}
    train = [i for i in texts if i in label_of and zlib.crc32(str(i).encode()) % 5]
    every = np.array([x[i] for i in train])
    centre, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    log_density = {}
    for label in (0, 1):
        own = (np.array([x[i] for i in train if label_of[i] == label]) - centre) / scale
        s = np.cov(own.T, bias=True)
        amount = max(quality.LEAST_SHRINKAGE, quality.shrinkage(s, len(own)))
        s = (1 - amount) * s + amount * np.trace(s) / len(s) * np.eye(len(s))
        inverse, constant = np.linalg.inv(s), math.log(len(own) / len(train)) - 0.5 * np.linalg.slogdet(s)[1]
        mean = own.mean(axis=0)
        log_density[label] = {i: constant - 0.5 * float(((v - centre) / scale - mean) @ inverse @ ((v - centre) / scale - mean)) for i, v in x.items()}
    for r in quality.classify(docs, labels).collect():
        difference = np.clip(log_density[1][r.doc_id] - log_density[0][r.doc_id], -500, 500)
        assert r.score == pytest.approx(1 / (1 + math.exp(-difference)), abs=1e-6)


def test_same_rows_give_the_same_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    other = {r.doc_id: r.score for r in quality.classify(docs.repartition(7), labels.repartition(3)).collect()}
    assert one == other


def test_quality_edge_cases(spark):
    long = "This is a long text, with many words.\n" * 60_000
    docs = [(i, f"A good text number {i}, written by hand with various other words {i * 7}.", ) for i in range(40)] + [(100 + i, f"BUY {i} $$$ BUY {i} $$$ !!!") for i in range(40)]
    docs += [(200, None), (201, ""), (202, long), (None, "no id"), (3, "A good text again"), (204, " \n\t")]
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0), (6, 7, 0), (2, 0, 0), (1, 1, 0), (999, 1, 1)]
    rows = judged(spark, docs, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    same = {r.doc_id: r.score for r in rows}
    assert same[200] == same[201]
    assert np.mean([r.predicted for r in rows if r.doc_id is not None and r.doc_id < 40]) > 0.9 > 0.1 > np.mean([r.predicted for r in rows if r.doc_id is not None and 100 <= r.doc_id < 140])
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert {(r.score, r.predicted) for r in judged(spark, docs, [(i, 1, 0) for i in range(40)]).collect()} == {(1.0, 1)}
    assert {(r.score, r.predicted) for r in judged(spark, docs, []).collect()} == {(0.5, 1)}
    # Classes without any variance.
    assert judged(spark, [(i, "same") for i in range(9)], [(i, i % 2, 0) for i in range(9)]).count() == 9
    assert judged(spark, [], labels).count() == 0
