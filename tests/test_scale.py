"""What keeps the work of large tables spread over tasks and done once."""

import random

import pytest

from langshift import rules, shared
from langshift.adapters import COMMITS, Tables
from langshift.functions import text
from langshift.operators import history
from langshift.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_rows_of_one_block_are_dealt_over_the_cores(spark):
    rows = Tables(spark, SF).base("customer")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert shared.spread(spark.range(1000).coalesce(1), 10).rdd.getNumPartitions() == 100


def test_places_in_groups(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(50), k) for k, g in enumerate(rng.choices([3, 4, 7], [90, 9, 1], k=900))]
    found = shared.ranked(spark.createDataFrame(rows, "g int, a int, b int").repartition(5), "g", "a", "b", name="n").collect()
    expected = {(*row, n) for g in (3, 4, 7) for n, row in enumerate(sorted(r for r in rows if r[0] == g))}
    assert {tuple(r) for r in found} == expected and len(found) == 900
    assert shared.ranked(spark.createDataFrame([], "g int, a int"), "g", "a", name="n").count() == 0


def test_commits_are_numbered_without_a_window_over_the_repositories(spark):
    t = Tables(spark, SF)
    own, stated = t.raw("commits"), spark.sql(COMMITS, orders=spark.read.parquet(f"{SF}/orders.parquet"))
    assert own.dtypes == stated.dtypes and sorted(map(str, own.collect())) == sorted(map(str, stated.collect()))
    assert "Window" not in own._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("clear", [True, False])
def test_an_analysis_reads_the_changes_once(spark, clear):
    commits = spark.createDataFrame([("a", n, 86400 * (n + 1), "s", []) for n in range(20)], "repo string, commit_seq bigint, ts bigint, subject string, coauthors array<string>")
    rows = [("a", n, 0, "x.rs" if n % 2 and (not clear or n > 9) else "x.py", 1000 if n > 9 else 10, 5) for n in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    fields = "repo string, commit_seq bigint, file_seq bigint, path string, added bigint, removed bigint"
    changes = spark.createDataFrame(rows, fields).mapInArrow(count, fields)
    assert history.analyse(commits, changes).count() == 1 and seen.value == len(rows)


def test_numbers_too_large_for_one_long_give_the_same(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice("xyz"), n // 3, n % 3, rng.randrange(90), rng.randrange(90)) for n in range(300)]
    fields = "repo string, lang string, commit_seq bigint, file_seq bigint, added bigint, removed bigint"
    small = history.running_net_lines(spark.createDataFrame(rows, fields)).collect()
    far = 1 << history.COMMIT_BITS
    large = history.running_net_lines(spark.createDataFrame([(a, b, c + far, *d) for a, b, c, *d in rows], fields)).collect()
    assert sorted((*r[:2], r[2] + far, *r[3:]) for r in small) == sorted(map(tuple, large)) and len(small) == 300


def test_ignored_endings(spark):
    names = ["a" + s for s in rules.IGNORED_SUFFIXES + rules.IGNORED_FILES] + ["x/vendor/a.rs", "a.rs", "amd", "a.md.rs", "vendor/a.rs", "cargolock", "gosum"]
    old = f"(?:{text.any_of(rules.IGNORED_SUFFIXES + rules.IGNORED_FILES)})$|{text.any_of(rules.IGNORED_FOLDERS)}"
    from pyspark.sql import functions as F

    from langshift.functions import paths

    rows = spark.createDataFrame([(n,) for n in names], "p string").select(paths.is_ignored_path(F.col("p")).alias("a"), F.lower("p").rlike(old).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {True, False}


def test_four_orders_are_published_from_one_listing(spark, monkeypatch):
    calls, before = [], shared.cut_lineage
    monkeypatch.setattr(shared, "cut_lineage", lambda rows: calls.append(1) or before(rows))
    QUERIES["listing_sorts"](spark, SF)
    assert len(calls) == 1
