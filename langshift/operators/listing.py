"""The published listing: filters, orders, pages, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def listing_filter(projects: DataFrame) -> DataFrame:
    """Rewrites and replacements with some confidence."""
    return projects.where((F.col("project_kind") != "neither") & (F.col("confidence") > 0))


def curated_origin_override(projects: DataFrame, origins: DataFrame) -> DataFrame:
    """Projects whose origin is the curated one (slug, label; broadcast), where there is one."""
    curated = F.broadcast(origins.select(F.col("slug").alias("_slug"), F.col("label").alias("_label")))
    rows = projects.join(curated, text.normalize_slug(F.col("repo_url")) == F.col("_slug"), "left")
    return rows.withColumn("named_origin", F.coalesce("_label", "named_origin")).select(*projects.columns)


def rewrite_first() -> Column:
    return (F.col("project_kind") == "rewrite").desc()


def listing_order() -> list[Column]:
    """Exemplars, rewrites, confidence, stars; equals by url."""
    return [F.col("exemplar").desc(), rewrite_first(), F.col("confidence").desc(), F.col("stars").desc(), F.col("repo_url").asc()]


def listing_sorts(order: str) -> list[Column]:
    """The orders that a reader can choose; equals stay in the order of the listing."""
    first = {
        "rewrites": [F.col("exemplar").desc(), rewrite_first(), F.col("confidence").desc()],
        "confidence": [F.col("exemplar").desc(), F.col("confidence").desc()],
        "stars": [F.col("stars").desc()],
        "recent": [F.col("first_detected").desc()],
    }
    return first[order] + listing_order()


def search_listing(projects: DataFrame, query: str) -> DataFrame:
    """Projects with the query in name, description or language, case and outer white space aside."""
    wanted = query.strip().lower()
    if not wanted:
        return projects
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("name", "description", "original_language")]
    return projects.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(wanted)))


def display_metrics(projects: DataFrame) -> DataFrame:
    """Whole percentages as shown: confidence, added and removed lines, agents' share, language shares."""

    def whole(x: Column) -> Column:
        return F.floor(x + F.lit(0.5)).cast("bigint")

    added, removed = F.coalesce("lines_added", F.lit(0)), F.coalesce("lines_removed", F.lit(0))
    total = F.when(added + removed == 0, 1).otherwise(added + removed)
    add = whole(added / total * 100.0)
    known = F.col("history_rust_before").isNotNull() & F.col("history_rust_after").isNotNull()
    before, after = F.when(known, whole(F.col("history_rust_before"))), F.when(known, whole(F.col("history_rust_after")))
    return projects.select(
        "repo_url",
        whole(F.coalesce("confidence", F.lit(0.0)) * 100.0).alias("confidence_pct"),
        add.alias("added_pct"),
        (F.lit(100) - add).alias("removed_pct"),
        whole(F.col("ai_assist_score") * 100.0).alias("ai_pct"),
        before.alias("before_pct"),
        after.alias("after_pct"),
        (after - before).alias("delta_pct"),
        whole(F.coalesce("rust_percentage", F.lit(0.0))).alias("rust_pct"),
    )


#: Columns that a published row has even where they are null.
PRINTED_NULLS = ["description", "original_language", "unsafe_percentage"]


def json_line(columns: list[str]) -> Column:
    """A listing row of these columns as a line of JSON. Lists are left out where empty, and so are nulls but those of
    ``PRINTED_NULLS``."""
    nulls = [F.when(F.col(c).isNull(), F.lit(f'"{c}":null,')) for c in PRINTED_NULLS if c in columns]
    values = [F.when(F.size(c) > 0, F.col(c)).alias(c) if c in ("rewrite_prs", "ai_agents") else F.col(c) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws("", *nulls), F.substring(F.to_json(F.struct(*values)), 2, 2**31 - 1))
