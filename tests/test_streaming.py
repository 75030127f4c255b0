"""The project table: batch jobs and streams in one order, copy-on-write by bucket, deliveries twice, two writers."""

import pytest
from pyspark.sql import functions as F

from langshift.jobs import workflows
from langshift.operators import merge
from langshift.sources import readers, tables
from langshift.streaming import upserts
from tests.test_domain import projects


def rows_of(spark, root, *columns):
    return {r.repo_url: tuple(r[c] for c in columns) for r in tables.current(spark, root).collect()}


def upsert(spark, root, rows, **options):
    return workflows.upsert_projects(projects(spark, rows), root, **options)


def test_landed_shards_become_the_table(spark, tmp_path):
    landing, root = f"{tmp_path}/landing", f"{tmp_path}/root"
    projects(spark, [{"repo_url": "a", "stars": 1, "first_detected": "1"}, {"repo_url": "b", "stars": 1}]).write.parquet(landing)
    upserts.stream_upserts(spark, landing, root).awaitTermination()
    projects(spark, [{"repo_url": "a", "stars": 5, "first_detected": "2"}, {"repo_url": "a", "stars": 7, "history_status": "ok"}, {"repo_url": "c"}]).write.mode("append").parquet(landing)
    upserts.stream_upserts(spark, landing, root).awaitTermination()
    assert rows_of(spark, root, "stars", "history_status", "first_detected") == {"a": (7, "ok", "1"), "b": (1, None, "f"), "c": (0, None, "f")}


def test_batches_and_streams_are_one_chain(spark, tmp_path):
    landing, root = f"{tmp_path}/landing", f"{tmp_path}/root"
    for n in range(3):
        upsert(spark, root, [{"repo_url": f"batch{n}", "stars": n}])
    projects(spark, [{"repo_url": "streamed", "stars": 10}, {"repo_url": "batch0", "stars": 11}]).write.parquet(landing)
    upserts.stream_upserts(spark, landing, root).awaitTermination()
    assert tables.numbers(spark, root) == [3, 2, 1, 0]
    assert rows_of(spark, root, "stars") == {"batch0": (11,), "batch1": (1,), "batch2": (2,), "streamed": (10,)}
    upsert(spark, root, [{"repo_url": "later"}])
    # The stream restarts with its checkpoint, and another one with a checkpoint of its own counts from 0.
    projects(spark, [{"repo_url": "streamed", "stars": 20}]).write.mode("append").parquet(landing)
    upserts.stream_upserts(spark, landing, root).awaitTermination()
    other = f"{tmp_path}/other"
    projects(spark, [{"repo_url": "other", "stars": 5}]).write.parquet(other)
    upserts.stream_upserts(spark, other, root, progress=f"{tmp_path}/progress").awaitTermination()
    now = tables.head(spark, root)
    assert now.number == 6 and sorted(now.streams.values()) == [0, 1]
    assert rows_of(spark, root, "stars") == {"batch0": (11,), "batch1": (1,), "batch2": (2,), "streamed": (20,), "later": (0,), "other": (5,)}


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/root"
    upserts.upsert_batch(projects(spark, [{"repo_url": "a", "stars": 1}]), 0, root, "s")
    upserts.upsert_batch(projects(spark, [{"repo_url": "a", "stars": 2}]), 1, root, "s")
    upsert(spark, root, [{"repo_url": "a", "stars": 3}])
    for again in (0, 1):
        upserts.upsert_batch(projects(spark, [{"repo_url": "a", "stars": 9}]), again, root, "s")
    assert tables.numbers(spark, root) == [2, 1, 0] and rows_of(spark, root, "stars") == {"a": (3,)}
    upserts.upsert_batch(projects(spark, [{"repo_url": "a", "stars": 4}]), 0, root, "another")
    assert rows_of(spark, root, "stars") == {"a": (4,)}


def test_only_buckets_with_changed_keys_are_written(spark, tmp_path):
    root = f"{tmp_path}/root"
    first = upsert(spark, root, [{"repo_url": f"r{k}", "stars": k} for k in range(200)], buckets=16)
    assert len(first.folders) == 16
    second = upsert(spark, root, [{"repo_url": "r7", "stars": 1000}, {"repo_url": "new"}])
    buckets = {r[0] for r in spark.createDataFrame([("r7",), ("new",)], "repo_url string").select(tables.bucket_of(16)).collect()}
    assert {b for b in first.folders if first.folders[b] != second.folders[b]} == buckets
    table = rows_of(spark, root, "stars")
    assert len(table) == 201 and table["r7"] == (1000,) and table["r8"] == (8,) and table["new"] == (0,)
    # Nothing of the stored rows is shuffled or sorted while a small batch is merged.
    stored = spark.read.parquet(*first.folders.values())
    plan = merge.merge_sent_batch(stored, projects(spark, [{"repo_url": "r7"}]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def shown(rows):
    return sorted((r.repo_url, r.stars, r.lines_added, r.first_detected) for r in rows.select("repo_url", "stars", F.coalesce("lines_added", F.lit(-1)).alias("lines_added"), "first_detected").collect())


def test_large_and_small_batches_merge_alike(spark, tmp_path, monkeypatch):
    old = [{"repo_url": f"r{k}", "stars": k, "lines_added": k, "first_detected": "1"} for k in range(60)] + [{"repo_url": None, "stars": 5}]
    new = [{"repo_url": f"r{k}", "stars": -k, "first_detected": "2"} for k in range(40, 80)] + [{"repo_url": None, "stars": 6}]
    gone = spark.createDataFrame([("r3",), ("r45",), ("r79",), ("nobody",)], "repo_url string")
    out = []
    for bound in (50_000, 0):
        monkeypatch.setattr(tables, "SENT_ROWS", bound)
        root = f"{tmp_path}/{bound}"
        upsert(spark, root, old, buckets=8)
        upsert(spark, root, new, deletes=gone)
        out.append(shown(tables.current(spark, root)))
    assert out[0] == out[1] and len(out[0]) == 77 and ("r50", -50, 50, "1") in out[0]
    expected = merge.merge_upsert_rules(projects(spark, old[:-1]), projects(spark, new[:-1])).join(gone, "repo_url", "left_anti")
    assert shown(expected) == out[0]


def test_of_two_writers_the_second_merges_again(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/root"
    upsert(spark, root, [{"repo_url": "a", "stars": 1}], buckets=2)
    now = tables.head(spark, root)
    taken = tables.Version(now.number, now.buckets, now.folders)
    with pytest.raises(tables.VersionTaken):
        tables.commit(spark, root, taken)
    assert tables.numbers(spark, root) == [0]
    # Another writer commits between this one's read and its commit.
    commit, others = tables.commit, [{"repo_url": "b", "stars": 2}]

    def late(spark, root, new):
        if others:
            row = others.pop()
            upsert(spark, root, [row])
        commit(spark, root, new)

    monkeypatch.setattr(tables, "commit", late)
    made = upsert(spark, root, [{"repo_url": "a", "stars": 3}, {"repo_url": "c", "stars": 4}])
    assert made.number == 2 and rows_of(spark, root, "stars") == {"a": (3,), "b": (2,), "c": (4,)}


def test_old_versions_are_retired_and_forgotten(spark, tmp_path):
    root = f"{tmp_path}/root"
    assert tables.current(spark, root) is None and tables.retire(spark, root) == 0
    for stars in (1, 2, 3):
        upsert(spark, root, [{"repo_url": "a", "stars": stars, "first_detected": str(stars)}, {"repo_url": f"b{stars}"}], buckets=4)
    expected = {"a": (3, "1"), "b1": (0, "f"), "b2": (0, "f"), "b3": (0, "f")}
    assert rows_of(spark, root, "stars", "first_detected") == expected
    before = tables.version(spark, root, 1)
    assert tables.retire(spark, root) == 1 and tables.numbers(spark, root) == [2, 1]
    assert rows_of(spark, root, "stars", "first_detected") == expected
    assert spark.read.parquet(*before.folders.values()).count() == 3  # the version before is whole
    assert tables.retire(spark, root) == 0 and tables.retire(spark, root, keep=1) == 1
    assert rows_of(spark, root, "stars", "first_detected") == expected
    kept = {str(p) for p in (tmp_path / "root/data").glob("*/*") if p.is_dir()}
    assert kept == {f.removeprefix("file:") for f in tables.head(spark, root).folders.values()}
    upsert(spark, root, [{"repo_url": "z"}])
    assert tables.numbers(spark, root) == [3, 2] and len(rows_of(spark, root, "stars")) == 5


def test_a_table_whose_rows_are_all_deleted(spark, tmp_path):
    root = f"{tmp_path}/root"
    upsert(spark, root, [{"repo_url": "a"}])
    gone = spark.createDataFrame([("a",)], "repo_url string")
    assert upsert(spark, root, [], deletes=gone).folders == {}
    schema = ", ".join(f"{n} {k}" for n, k in readers.PROJECT.items())
    assert tables.current(spark, root, schema).count() == 0
    upsert(spark, root, [{"repo_url": "b"}])
    assert tables.current(spark, root).select(F.col("repo_url")).first()[0] == "b"
