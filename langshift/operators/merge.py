"""Keeping the project table: upserts, shards, history attempts, the backlog.

Tables are Parquet and immutable: each function returns the new rows, keyed by repo_url; the job
writes them beside the old ones and swaps the paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: Columns that a new row fills only where it has a value, and that no new row changes.
KEPT_IF_NULL = [
    "unsafe_percentage", "lines_added", "lines_removed", "rewrite_velocity", "ai_assist_score", "rewrite_duration_days", "commit_count",
    "total_commits_analyzed", "history_status", "history_error", "history_attempted_at", "history_attempts",
]
NEVER_CHANGED = ["first_detected"]


def merged_columns(names: list[str]) -> list[Column]:
    """The columns of a join of stored rows (alias o) and batch rows (alias n) by repo_url, either of which may be missing."""
    both = F.col("o.repo_url").isNotNull() & F.col("n.repo_url").isNotNull()

    def value(name: str) -> Column:
        o, n = F.col(f"o.{name}"), F.col(f"n.{name}")
        if name == "repo_url" or name in KEPT_IF_NULL:
            out = F.coalesce(n, o)
        elif name in NEVER_CHANGED:
            out = F.when(F.col("o.repo_url").isNotNull(), o).otherwise(n)
        elif name == "ai_agents":
            out = F.when(both & (F.coalesce(F.size(n), F.lit(0)) <= 0), o).when(F.col("n.repo_url").isNotNull(), n).otherwise(o)
        else:
            out = F.when(F.col("n.repo_url").isNotNull(), n).otherwise(o)
        return out.alias(name)

    return list(map(value, names))


def merge_upsert_rules(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The table after the batch (one row for each repo_url) is written into it.

    Batch rows replace stored ones, but for ``KEPT_IF_NULL``, ``NEVER_CHANGED`` and agents, which an
    empty list doesn't replace. One full outer join by key; both sides may be bucketed by it."""
    joined = stored.alias("o").join(batch.alias("n"), F.col("o.repo_url") == F.col("n.repo_url"), "full_outer")
    return joined.select(*merged_columns(stored.columns))


def merge_sent_batch(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """``merge_upsert_rules`` for a batch that is small enough to be sent to every task (the caller has checked that):
    stored rows stay where they are. What is new is what no stored row has met; only keys are read for that."""
    updated = stored.alias("o").join(F.broadcast(batch.alias("n")), F.col("o.repo_url") == F.col("n.repo_url"), "left").select(*merged_columns(stored.columns))
    keys = batch.select("repo_url")
    met = stored.select("repo_url").join(F.broadcast(keys), "repo_url", "left_semi")
    return updated.unionByName(batch.select(*stored.columns).join(F.broadcast(met), "repo_url", "left_anti"))


def preserve_first_seen(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch rows with the stored first_detected, where there is one."""
    first = stored.select("repo_url", F.col("first_detected").alias("_first"))
    return batch.join(first, "repo_url", "left").withColumn("first_detected", F.coalesce("_first", "first_detected")).select(*batch.columns)


def shard_rank() -> Column:
    """How far a row's history came: status, then time of the attempt."""
    status = F.when(F.col("history_status") == "ok", 2).when(F.col("history_status") == "failed", 1).otherwise(0)
    return F.struct(status.alias("status"), F.coalesce("history_attempted_at", F.lit("")).alias("at"))


def prefer_enriched(rows: DataFrame) -> DataFrame:
    """Of the rows of each repo_url (with source_no), the furthest; of equals that of the earliest source.

    An aggregate, so that each task keeps one row for each key before the shuffle."""
    rank = F.struct(shard_rank().alias("r"), (-F.col("source_no")).alias("s"))
    best = rows.groupBy("repo_url").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "repo_url"]), rank).alias("x"))
    return best.select(*(F.col("repo_url") if c == "repo_url" else F.col(f"x.{c}").alias(c) for c in rows.columns))


def merge_shards(base: DataFrame, shards: list[DataFrame]) -> DataFrame:
    """The base table after the furthest row of base and shards is written into it for each key."""
    rows = base.withColumn("source_no", F.lit(0))
    for n, shard in enumerate(shards):
        rows = rows.unionByName(shard.withColumn("source_no", F.lit(n + 1)))
    return merge_upsert_rules(base, prefer_enriched(rows).drop("source_no"))


def merged_counts(base: DataFrame, shards: list[DataFrame]) -> DataFrame:
    """source_no (of the shard, from 1) and merged: how many of its rows came further than the row that base and
    earlier shards have for the same key."""
    rows = base.select("repo_url", F.lit(0).alias("source_no"), shard_rank().alias("r"))
    for n, shard in enumerate(shards):
        rows = rows.unionByName(shard.select("repo_url", F.lit(n + 1).alias("source_no"), shard_rank().alias("r")))
    earlier = Window.partitionBy("repo_url").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("further", F.coalesce(F.col("r") > F.max("r").over(earlier), F.lit(False)))
    return rows.where("source_no > 0").groupBy("source_no").agg(F.count_if("further").alias("merged"))


def mark_history_attempt(projects: DataFrame, attempts: DataFrame) -> DataFrame:
    """Projects after attempts (repo_url, ok, error, attempted_at): success resets the count, failure
    adds one. Rows without an attempt stay as they are."""
    a = attempts.select("repo_url", F.col("ok").alias("_ok"), F.col("error").alias("_error"), F.col("attempted_at").alias("_at"))
    rows = projects.join(a, "repo_url", "left")
    tried = F.col("_ok").isNotNull()
    count = F.when(F.col("_ok"), F.lit(0).cast("bigint")).otherwise(F.coalesce("history_attempts", F.lit(0)) + 1)
    return rows.withColumns(
        {
            "history_status": F.when(tried, F.when(F.col("_ok"), "ok").otherwise("failed")).otherwise(F.col("history_status")),
            "history_error": F.when(tried, F.when(~F.col("_ok"), F.col("_error"))).otherwise(F.col("history_error")),
            "history_attempted_at": F.when(tried, F.col("_at")).otherwise(F.col("history_attempted_at")),
            "history_attempts": F.when(tried, count).otherwise(F.col("history_attempts")),
        }
    ).select(*projects.columns)


def flag_exemplars(projects: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Projects with exemplar: whether their slug is in the list (slug; curated, so broadcast)."""
    listed = F.broadcast(exemplars.select(F.col("slug").alias("_slug"), F.lit(True).alias("_listed")).distinct())
    rows = projects.join(listed, text.normalize_slug(F.col("repo_url")) == F.col("_slug"), "left")
    return rows.select(*[c for c in projects.columns if c != "exemplar"], F.coalesce("_listed", F.lit(False)).alias("exemplar"))


def pending_exemplars(exemplars: DataFrame, projects: DataFrame) -> DataFrame:
    """Exemplars without a project whose history is done."""
    done = projects.where("history_status = 'ok'").select(text.normalize_slug(F.col("repo_url")).alias("slug"))
    return exemplars.join(done, "slug", "left_anti")


def backlog_pending(force: bool = False, retry_failed: bool = False, measure_unsafe: bool = True, max_attempts: int = 3) -> Column:
    """Whether a project (with exemplar) waits for work on its history."""
    if force:
        return F.lit(True)
    unmeasured = F.lit(measure_unsafe) & F.col("unsafe_percentage").isNull() & (F.col("original_language").isNull() | (F.col("rust_percentage") >= 50.0)) & ~F.col("exemplar")
    given_up = F.lit(not retry_failed) & (F.col("history_status") == "failed") & (F.coalesce("history_attempts", F.lit(0)) >= max_attempts)
    return F.when(F.coalesce(F.col("history_status") == "ok", F.lit(False)), unmeasured).otherwise(~F.coalesce(given_up, F.lit(False)))


def star_cap_filter(projects: DataFrame, max_stars: int) -> DataFrame:
    """Projects below the cap; no cap at 0."""
    return projects.where(F.col("stars") < max_stars) if max_stars > 0 else projects


def backfill_order() -> list[Column]:
    """Exemplars first, then stars, then confidence in millionths; equals by url."""
    rest = F.floor((F.lit(1.0) - F.greatest(F.least(F.col("confidence"), F.lit(1.0)), F.lit(0.0))) * F.lit(1_000_000.0))
    return [F.col("exemplar").desc(), F.col("stars").desc(), rest.asc(), F.col("repo_url").asc()]


def backfill_batch(projects: DataFrame, size: int = 25, **pending) -> DataFrame:
    """The first ``size`` pending projects."""
    return projects.where(backlog_pending(**pending)).orderBy(*backfill_order()).limit(size)


def backlog_counts(projects: DataFrame, max_stars: int = 0, **pending) -> DataFrame:
    """One row: pending, skipped (done), dead_lettered, star_capped, and the watchdog's own count."""
    capped = (F.col("stars") >= max_stars) if max_stars > 0 else F.lit(False)
    waits = backlog_pending(**pending)
    ok = F.coalesce(F.col("history_status") == "ok", F.lit(False))
    small = F.col("original_language").isNull() | (F.col("rust_percentage") >= 50.0)
    watched = (
        F.col("history_status").isNull()
        | ((F.col("history_status") == "failed") & (F.coalesce("history_attempts", F.lit(0)) < 3))
        | (ok & F.col("unsafe_percentage").isNull() & small)
    )
    return projects.agg(
        F.count_if(waits).alias("pending"),
        F.count_if(~capped & ~waits & ok).alias("skipped"),
        F.count_if(~capped & ~waits & ~ok).alias("dead_lettered"),
        F.count_if(capped).alias("star_capped"),
        F.count_if(F.coalesce(watched, F.lit(False))).alias("watchdog_pending"),
    )


def kind_counts(projects: DataFrame) -> DataFrame:
    """One row: total, rewrites, replacements, dropped."""
    kind = F.coalesce("project_kind", F.lit("neither"))
    rewrites, replacements = F.count_if(kind == "rewrite"), F.count_if(kind == "replacement")
    return projects.agg(F.count(F.lit(1)).alias("total"), rewrites.alias("rewrites"), replacements.alias("replacements"), (F.count(F.lit(1)) - rewrites - replacements).alias("dropped"))


