"""Confidence and the stored row of a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import numbers, paths, text

HISTORY = ["lines_added", "lines_removed", "rewrite_velocity", "ai_assist_score", "ai_agents", "rewrite_duration_days", "commit_count"]


def of_kind(signals: Column, kind: str) -> Column:
    return F.filter(signals, lambda s: s["kind"] == kind)


def text_evidence(signals: Column) -> Column:
    """Weights of the signals by kind, added as whole hundredths, with a cap."""
    points = F.lit(0)
    counted = F.lit(0)
    for kind, weight in rules.SIGNAL_WEIGHTS.items():
        n = F.size(of_kind(signals, kind))
        points, counted = points + n * weight, counted + n
    points = points + (F.size(signals) - counted) * rules.OTHER_WEIGHT
    return F.coalesce(F.least(points / F.lit(100.0), F.lit(rules.TEXT_CAP)), F.lit(0.0))


def confidence(kind: Column, signals: Column, description: Column) -> Column:
    """From the columns rust_percentage, original_language, rust_is_primary, strong, magnitude and from_language."""
    displaced = F.col("original_language").isNotNull()
    share = F.col("rust_percentage") / 100.0
    language = F.when(displaced, share * 0.4).otherwise(share * 0.1) + F.when(F.col("rust_is_primary"), F.when(displaced, 0.15).otherwise(0.05)).otherwise(0.0)
    swing = F.coalesce(F.least(F.col("magnitude") / 100.0 * 0.25, F.lit(0.15)), F.lit(0.0))
    history = F.when(F.coalesce("strong", F.lit(False)), F.lit(0.20) + swing + F.when(F.col("from_language").isNotNull(), 0.05).otherwise(0.0)).otherwise(0.0)
    total = text_evidence(signals) + F.least(language, F.lit(rules.LANGUAGE_CAP)) + F.least(history, F.lit(rules.HISTORY_CAP))
    total = F.least(total, F.lit(1.0))
    total = F.when(kind == "rewrite", F.least(total + rules.REWRITE_BONUS, F.lit(1.0))).otherwise(total)
    cap = F.when(text.strong_rewrite_signal(description, signals), rules.STRONG_CAP).otherwise(rules.NO_DISPLACED_CAP)
    total = F.when(displaced, total).otherwise(F.least(total, cap))
    return numbers.round_half_up(F.when(kind == "neither", 0.0).otherwise(total))


def select_migration_prs(signals: Column, most: int = 5) -> Column:
    """The relevant pull requests (title, url) by number, each url once, at most ``most``.

    Without a number they come last; equal numbers keep the order of the signals."""
    prs = F.filter(signals, lambda s: (s["kind"] == "pull-request") & (text.pr_relevance(text.signal_title(s["detail"])) > 0))
    numbered = F.transform(prs, lambda s, i: F.struct(F.coalesce(text.pr_number(s["url"]), F.lit(2**63 - 1)).alias("number"), i.alias("place"), text.signal_title(s["detail"]).alias("title"), s["url"].alias("url")))
    ordered = F.array_sort(numbered)
    urls = F.transform(ordered, lambda p: p["url"])
    # An entry is the first of its url if the url's first position is its own.
    first = F.filter(ordered, lambda p, i: F.array_position(urls, p["url"]) == i + 1)
    return F.transform(F.slice(first, 1, most), lambda p: F.struct(p["title"].alias("title"), p["url"].alias("url")))


def source_link(signals: Column, repo_url: Column) -> Column:
    """The first signal's url by kind of signal, else the repository."""
    by_kind = [F.try_element_at(of_kind(signals, kind), F.lit(1))["url"] for kind in ("repo-search", "pull-request", "issue")]
    return F.coalesce(*by_kind, F.try_element_at(signals, F.lit(1))["url"], repo_url)


def project_row(rows: DataFrame, now: Column) -> DataFrame:
    """The stored row of classified candidates with language mix, history and enrichment columns."""
    url = F.when(F.coalesce("html_url", F.lit("")) == "", F.concat(F.lit("https://github.com/"), F.col("full_name"))).otherwise(F.col("html_url"))
    strong = F.coalesce("strong", F.lit(False))
    original = F.coalesce("original_language", F.when(strong, F.col("from_language")))
    prs = select_migration_prs(F.col("signals"))
    total = F.when(F.col("total_commits") > 0, F.col("total_commits"))
    out = rows.withColumns({"_url": url, "_prs": prs})
    return out.select(
        text.repo_name(F.col("full_name")).alias("name"),
        F.col("_url").alias("repo_url"),
        "description",
        "stars",
        "forks",
        "open_issues",
        "open_prs",
        paths.sanitize_language(original).alias("original_language"),
        numbers.round_half_up(F.col("rust_percentage")).alias("rust_percentage"),
        confidence(F.col("project_kind"), F.col("signals"), F.col("description")).alias("confidence"),
        "signals",
        F.col("_prs").alias("rewrite_prs"),
        F.try_element_at("_prs", F.lit(1)).alias("rewrite_pr"),
        F.lit(None).cast("double").alias("unsafe_percentage"),
        "project_kind",
        "named_origin",
        *HISTORY,
        F.when(strong, F.col("from_language")).alias("history_from_language"),
        F.when(strong, F.col("rust_before")).alias("history_rust_before"),
        F.when(strong, F.col("rust_after")).alias("history_rust_after"),
        F.col("magnitude").alias("transition_magnitude"),
        total.alias("total_commits_analyzed"),
        F.lit(None).cast("string").alias("history_status"),
        F.lit(None).cast("string").alias("history_error"),
        F.lit(None).cast("string").alias("history_attempted_at"),
        F.lit(None).cast("bigint").alias("history_attempts"),
        source_link(F.col("signals"), F.col("_url")).alias("source_url"),
        now.alias("first_detected"),
        now.alias("last_seen"),
    )


def min_confidence_filter(projects: DataFrame, least: float = rules.MIN_CONFIDENCE) -> DataFrame:
    return projects.where(F.col("confidence") >= least)
