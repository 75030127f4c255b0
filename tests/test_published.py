"""Publication in ordered parts with an index, pages by rank, and the incremental reclassification."""

import json

import pytest
from pyspark.sql import functions as F

from langshift import rules
from langshift.jobs import workflows
from langshift.operators import listing, merge
from langshift.sources import published, tables
from tests.test_domain import projects


def listed(spark, n):
    rows = [{"repo_url": f"u{i:04d}", "name": f"n{i}", "confidence": (i * 7 % 50) / 50, "stars": i % 3, "original_language": "C" if i % 2 else "Go", "description": "two\nlines   “quoted”" if i % 5 else None} for i in range(n)]
    return merge.flag_exemplars(listing.listing_filter(projects(spark, rows)), spark.createDataFrame([("u0003",)], "slug string"))


@pytest.mark.parametrize("part_rows", [7, 10_000])
def test_pages_and_lines_are_the_listing(spark, tmp_path, part_rows):
    rows, root = listed(spark, 120), f"{tmp_path}/root"
    order = listing.listing_order()
    expected = [r.repo_url for r in rows.orderBy(*order).collect()]
    made = published.publish(rows, order, root, line=listing.json_line(rows.columns), part_rows=part_rows)
    assert sum(n for _, _, n in made.index) == len(expected) == 117 and (len(made.index) > 10) == (part_rows == 7)
    assert [first for _, first, _ in made.index] == [sum(n for _, _, n in made.index[:k]) for k in range(len(made.index))]
    for size in (5, 24):
        last = -(-117 // size)
        found = [[r.repo_url for r in published.page(spark, root, rows.schema, number, size).collect()] for number in range(1, last + 1)]
        assert sum(found, []) == expected and all(len(p) == size for p in found[:-1])
        for outside, inside in ((0, 1), (-3, 1), (last + 1, last), (10**9, last)):
            assert [r.repo_url for r in published.page(spark, root, rows.schema, outside, size).collect()] == found[inside - 1]
    lines = sorted(published.lines(spark, root).collect())
    assert [r.rank for r in lines] == list(range(117)) and [json.loads(r.value)["repo_url"] for r in lines] == expected
    # The files in the order of their parts are the listing, line by line.
    base = next(iter(made.folders.values())).removeprefix("file:").rsplit("/rows/", 1)[0]
    whole = ""
    for part, _, _ in made.index:
        files = [p for p in (tmp_path.__class__(base) / f"lines/_part={part}").iterdir() if p.name.startswith("part-")]
        assert len(files) == 1
        whole += files[0].read_text()
    assert whole.split("\n")[:-1] == [r.value for r in lines]


def test_printed_nulls_and_left_out_lists(spark):
    rows = listed(spark, 12)
    out = [json.loads(r.value) for r in rows.select(listing.json_line(rows.columns).alias("value")).collect()]
    assert all(r["unsafe_percentage"] is None and "description" in r and r["original_language"] in ("C", "Go") and "lines_added" not in r and "ai_agents" not in r for r in out)


def test_a_page_reads_only_the_parts_that_hold_it(spark, tmp_path):
    rows, root = listed(spark, 120), f"{tmp_path}/root"
    made = published.publish(rows, listing.listing_order(), root, part_rows=10)
    page = published.page(spark, root, rows.schema, 3, 10)
    held = [part for part, first, n in made.index if first < 30 and first + n > 20]
    assert {f.split("_part=")[1].split("/")[0] for f in page.inputFiles()} == {str(p) for p in held} and len(held) < len(made.index)
    assert "hashpartitioning" not in page._jdf.queryExecution().executedPlan().toString()


def test_a_newer_publication_is_served_and_an_empty_one_is_empty(spark, tmp_path):
    rows, root = listed(spark, 30), f"{tmp_path}/root"
    assert published.page(spark, root, rows.schema, 1, 5).count() == 0 and published.lines(spark, root).count() == 0
    old = published.publish(rows, listing.listing_order(), root)
    published.publish(rows.where("stars = 1"), listing.listing_order(), root)
    assert {r.stars for r in published.page(spark, root, rows.schema, 1, 50).collect()} == {1}
    assert published.page(spark, root, rows.schema, 1, 50, old).count() == rows.count()
    published.publish(rows.where("false"), listing.listing_order(), root, line=listing.json_line(rows.columns))
    assert published.page(spark, root, rows.schema, 7, 5).count() == 0 and published.lines(spark, root).count() == 0
    assert tables.numbers(spark, root) == [2, 1, 0]


# Reclassification

ORIGINS = "slug string, label string"


def stored(spark):
    rows = [{"repo_url": f"https://github.com/o{k}/tool{k}", "description": "Rust port of yjs" if k % 3 else "just notes", "original_language": "C", "last_seen": f"l{k}", "history_status": "ok"} for k in range(12)]
    # Scoring takes the displaced language of this one from its history, which is an input of the next score.
    rows += [{"repo_url": "https://github.com/a/turned", "description": "Rust port of abc", "history_from_language": "Go", "transition_magnitude": 60.0, "history_rust_before": 5.0, "history_rust_after": 65.0}]
    return projects(spark, rows)


def table(spark, root):
    return {r.repo_url: r for r in tables.current(spark, root).collect()}


def test_reclassify_scores_only_what_has_changed(spark, tmp_path, monkeypatch):
    root, origins = f"{tmp_path}/root", spark.createDataFrame([], ORIGINS)
    workflows.upsert_projects(stored(spark), root)
    expected = {r.repo_url: r for r in workflows.reclassify(stored(spark), origins).collect()}
    assert workflows.reclassify_stored(spark, root, origins) == {"scored": 13, "deleted": 4}
    found = table(spark, root)
    assert len(found) == 9 and {k: r.asDict() for k, r in found.items()} == {k: r.asDict() for k, r in expected.items()}
    # The one row whose own inputs were changed is scored once more, then nothing is.
    again = {r.repo_url: r.asDict() for r in workflows.reclassify(tables.current(spark, root), origins).collect()}
    assert workflows.reclassify_stored(spark, root, origins) == {"scored": 1, "deleted": 0}
    assert {k: r.asDict() for k, r in table(spark, root).items()} == again
    before = tables.numbers(spark, root)
    assert workflows.reclassify_stored(spark, root, origins) == {"scored": 0, "deleted": 0} and tables.numbers(spark, root) == before
    # A changed row, a new one and a curated origin each lead to their own rows alone.
    workflows.upsert_projects(projects(spark, [{"repo_url": "https://github.com/o1/tool1", "description": "nothing"}, {"repo_url": "https://github.com/n/new", "description": "Rust port of q", "original_language": "C"}]), root)
    assert workflows.reclassify_stored(spark, root, origins) == {"scored": 2, "deleted": 1}
    curated = spark.createDataFrame([("o2/tool2", "Curated")], ORIGINS)
    assert workflows.reclassify_stored(spark, root, curated) == {"scored": 1, "deleted": 0}
    assert table(spark, root)["https://github.com/o2/tool2"].named_origin == "Curated"
    # Other rules: all anew.
    monkeypatch.setattr(rules, "MIN_CONFIDENCE", 0.16)
    assert workflows.reclassify_stored(spark, root, curated)["scored"] == 9


def test_reclassify_of_nothing(spark, tmp_path):
    root, origins = f"{tmp_path}/root", spark.createDataFrame([], ORIGINS)
    assert workflows.reclassify_stored(spark, root, origins) == {"scored": 0, "deleted": 0}
    workflows.upsert_projects(stored(spark).where(F.col("description") == "just notes"), root)
    assert workflows.reclassify_stored(spark, root, origins)["deleted"] == 4
    assert table_is_empty(spark, root) and workflows.reclassify_stored(spark, root, origins) == {"scored": 0, "deleted": 0}


def table_is_empty(spark, root):
    return tables.head(spark, root).folders == {}
