"""The three workflows: scan listings, backfill histories, merge and publish.

Each takes and returns DataFrames. Tables are written by ``upsert_projects``, beside the old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import rules, shared
from ..functions import numbers, text, vectorized
from ..operators import classify, discovery, history, listing, merge, scoring
from ..sources import tables

#: History and enrichment columns of a candidate without any.
NO_HISTORY = {
    "from_language": "string", "rust_before": "double", "rust_after": "double", "magnitude": "double", "total_commits": "bigint", "strong": "boolean",
    "lines_added": "bigint", "lines_removed": "bigint", "rewrite_velocity": "double", "ai_assist_score": "double", "rewrite_duration_days": "bigint", "commit_count": "bigint",
}


def candidates(repos: DataFrame, issues: DataFrame, exemplars: DataFrame, limit: int = rules.CANDIDATE_LIMIT) -> DataFrame:
    """The ranked candidates of a scan."""
    repo_hits = discovery.rule_top_k(discovery.match_repo_rules(repos), [F.desc("stars"), F.col("full_name")])
    issue_hits = discovery.rule_top_k(discovery.match_issue_rules(issues, repos), [F.col("url"), F.col("full_name")])
    signals = discovery.union_signals(repo_hits, issue_hits, exemplars.select("slug"))
    return discovery.rank_candidates(discovery.collect_signals(signals), limit)


def enriched(found: DataFrame, repos: DataFrame, issues: DataFrame, languages: DataFrame) -> DataFrame:
    """Candidates with metadata, open pull requests and language mix. The facts are cut to the
    candidates before they are aggregated."""
    names = F.broadcast(found.select("full_name"))  # at most the limit of the scan
    rows = discovery.enrich_metadata(found, repos.join(names, "full_name", "left_semi"))
    rows = discovery.open_pr_counts(rows, issues.join(names, "full_name", "left_semi"))
    return discovery.attach_languages(rows, discovery.language_mix(languages.join(names, "full_name", "left_semi")))


def with_history(rows: DataFrame, analysis: DataFrame | None) -> DataFrame:
    """Candidates with their history columns; enrichment counts only with lines or agents."""
    if analysis is None:
        return rows.withColumns({n: F.lit(None).cast(k) for n, k in NO_HISTORY.items()}).withColumn("ai_agents", F.array().cast("array<string>"))
    named = {"velocity": "rewrite_velocity", "score": "ai_assist_score", "days": "rewrite_duration_days", "agents": "ai_agents"}
    history_columns = analysis.withColumnsRenamed(named).withColumnRenamed("repo", "full_name")
    joined = rows.join(history_columns, "full_name", "left")
    return joined.withColumn("ai_agents", F.coalesce("ai_agents", F.array().cast("array<string>")))


def histories(found: DataFrame, commits: DataFrame, changes: DataFrame, points: int = rules.SAMPLE_POINTS) -> DataFrame:
    """The histories of candidates (full_name; a bounded number), as ``repo``. ``commits`` and ``changes`` carry the
    repository's slug as ``repo``; they are cut to the candidates before anything is dealt or sorted."""
    names = shared.cut_lineage(found.select("full_name", text.normalize_slug(F.col("full_name")).alias("repo")))
    slugs = F.broadcast(names.select("repo").distinct())
    analysis = history.analyse(commits.join(slugs, "repo", "left_semi"), changes.join(slugs, "repo", "left_semi"), points)
    return analysis.join(F.broadcast(names), "repo").drop("repo").withColumnRenamed("full_name", "repo")


def scan(
    repos: DataFrame, issues: DataFrame, languages: DataFrame, exemplars: DataFrame, origins: DataFrame, now: str, *,
    commits: DataFrame | None = None, changes: DataFrame | None = None, stored: DataFrame | None = None, limit: int = rules.CANDIDATE_LIMIT,
) -> DataFrame:
    """Listings to scored projects of at least ``MIN_CONFIDENCE``; with ``commits`` and ``changes`` (by slug, as ``repo``) the
    candidates' histories count as well. Projects that ``stored`` has keep the time they were first seen."""
    found = shared.cut_lineage(candidates(repos, issues, exemplars, limit))
    rows = enriched(found, repos, issues, languages)
    analysis = histories(found, commits, changes) if commits is not None and changes is not None else None
    judged = classify.classify_kind(with_history(rows, analysis), origins)
    out = scoring.min_confidence_filter(scoring.project_row(judged, F.lit(now)))
    return out if stored is None else merge.preserve_first_seen(out, stored)


def scan_exemplars(
    exemplars: DataFrame, stored: DataFrame | None, repos: DataFrame, issues: DataFrame, languages: DataFrame, origins: DataFrame, now: str, *,
    commits: DataFrame | None = None, changes: DataFrame | None = None, force: bool = False,
) -> DataFrame:
    """Scored projects of the curated list (slug), whatever their confidence, to be written by ``upsert_projects``.

    Exemplars whose history is done in ``stored`` are left out unless ``force``; those that the listings don't know are as
    well. Their histories, where there are any, are sampled more finely than others', and such projects are marked as done. Slugs
    are in lower case, so listings meet them without regard to case. Everything is cut to the list first.
    """
    asked = exemplars.select("slug") if force or stored is None else merge.pending_exemplars(exemplars.select("slug"), stored)
    url = F.concat(F.lit("https://github.com/"), "slug")
    signal = F.struct(F.lit("exemplar").alias("kind"), F.lit(discovery.EXEMPLAR_DETAIL).alias("detail"), url.alias("url"))
    found = shared.cut_lineage(asked.distinct().select(F.col("slug").alias("full_name"), url.alias("html_url"), F.lit(None).cast("string").alias("description"), F.lit(0).cast("bigint").alias("stars"), F.array(signal).alias("signals")))
    facts = [rows.withColumn("full_name", F.lower("full_name")) for rows in (repos, issues, languages)]
    rows = enriched(found, *facts)
    analysis = histories(found, commits, changes, rules.EXEMPLAR_SAMPLE_POINTS) if commits is not None and changes is not None else None
    judged = classify.classify_kind(with_history(rows, analysis), origins)
    out = scoring.project_row(judged, F.lit(now))
    done = F.col("total_commits_analyzed").isNotNull()
    out = out.withColumns({"history_status": F.when(done, "ok"), "history_attempted_at": F.when(done, F.lit(now)), "history_attempts": F.when(done, F.lit(0).cast("bigint"))})
    return out if stored is None else merge.preserve_first_seen(out, stored)


def candidates_of(projects: DataFrame) -> DataFrame:
    """Stored projects as candidates with their stored language mix, history and enrichment."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text.trim_space(F.col("repo_url")), "^(https://github\\.com/)+", ""), "^(http://github\\.com/)+", ""), "/+$", "")
    strong = numbers.strong_from_stored(F.col("transition_magnitude"), F.col("history_rust_before"), F.col("history_rust_after"), F.col("history_from_language"))
    return projects.select(
        bare.alias("full_name"),
        F.col("repo_url").alias("html_url"),
        "description", "stars", "forks", "open_issues", "open_prs", "signals", "rust_percentage", "original_language",
        (F.col("original_language").isNull() | (F.col("rust_percentage") >= 50.0)).alias("rust_is_primary"),
        *scoring.HISTORY,
        F.col("history_from_language").alias("from_language"),
        F.col("history_rust_before").alias("rust_before"),
        F.col("history_rust_after").alias("rust_after"),
        F.col("transition_magnitude").alias("magnitude"),
        F.coalesce("total_commits_analyzed", F.lit(0)).alias("total_commits"),
        strong.alias("strong"),
        F.col("first_detected").alias("_first"),
        F.col("last_seen").alias("_last"),
    )


def rescore(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Candidates of stored projects, judged and scored anew; the times stay."""
    judged = classify.classify_kind(rows, origins)
    stamped = scoring.project_row(judged, F.struct("_first", "_last"))
    return stamped.withColumns({"first_detected": F.col("first_detected._first"), "last_seen": F.col("last_seen._last")})


def reclassify(projects: DataFrame, origins: DataFrame) -> DataFrame:
    """The table after all rows are judged anew: rewrites and replacements are written over their old
    rows, the rest is gone."""
    rescored = shared.cut_lineage(rescore(candidates_of(projects), origins).where(F.col("project_kind").isin("rewrite", "replacement")))
    kept = projects.join(rescored.select("repo_url"), "repo_url", "left_semi")
    return merge.merge_upsert_rules(kept.select(*rescored.columns), rescored)


def score_digest(projects: DataFrame, origins: DataFrame) -> DataFrame:
    """repo_url and digest of all that a stored project's kind, origin and score follow from: its own columns, its curated
    origin, and the rules."""
    inputs = [c for c in candidates_of(projects).columns if not c.startswith("_")]
    rows = candidates_of(projects).withColumn("_slug", text.normalize_slug(F.col("full_name")))
    labels = origins.select(F.col("slug").alias("_slug"), F.col("label").alias("_label"))  # curated
    rows = rows.join(F.broadcast(labels), "_slug", "left")
    digest = F.sha2(F.to_json(F.struct(*inputs, "_label"), {"ignoreNullFields": "false"}), 256)
    return rows.select(F.col("html_url").alias("repo_url"), F.concat(F.lit(rules.version() + "-"), digest).alias("digest"))


def reclassify_stored(spark: SparkSession, root: str, origins: DataFrame) -> dict[str, int]:
    """Judge the table below ``root`` anew where that can change anything, and commit the result: rewrites and
    replacements are written over their old rows, the rest is deleted by key. Returns how many rows were scored and deleted.

    The digest of what a row was scored from is kept in a table of its own (below ``root``/scored). Rows whose digest
    is the same are left alone; a row whose own inputs the scoring changes (a displaced language taken from its history)
    is scored again by the next run. The digests are committed last, so a job that ends before scores these rows again.
    """
    projects = tables.current(spark, root)
    if projects is None:
        return {"scored": 0, "deleted": 0}
    marks = f"{root}/scored"
    digests = score_digest(projects, origins)
    known = tables.current(spark, marks, MARKS)
    stale = digests if known is None else digests.join(known, ["repo_url", "digest"], "left_anti")
    stale = shared.cut_lineage(stale)
    n = stale.count()
    if not n:
        return {"scored": 0, "deleted": 0}
    keys = stale.select("repo_url")
    asked = projects.join(F.broadcast(keys) if n <= tables.SENT_ROWS else keys.hint("merge"), "repo_url", "left_semi")
    rescored = shared.cut_lineage(rescore(candidates_of(asked), origins))
    stays = F.col("project_kind").isin("rewrite", "replacement")
    gone = shared.cut_lineage(rescored.where(~stays).select("repo_url"))
    upsert_projects(rescored.where(stays), root, deletes=gone)
    tables.change(stale, marks, newest, newest, deletes=gone)
    return {"scored": n, "deleted": gone.count()}


MARKS = StructType([StructField("repo_url", StringType()), StructField("digest", StringType())])


def newest(stored: DataFrame, rows: DataFrame) -> DataFrame:
    return stored.join(rows.select("repo_url"), "repo_url", "left_anti").unionByName(rows)


def with_unsafe_share(projects: DataFrame, reports: DataFrame | None) -> DataFrame:
    """Projects with ``_slug`` and ``_unsafe``: the share that a landed report (repo, report) gives to one that is
    unmeasured and mostly in the target language, else null. Of several reports, the one with the largest share."""
    rows = projects.withColumn("_slug", text.normalize_slug(F.col("repo_url")))
    if reports is None:
        return rows.withColumn("_unsafe", F.lit(None).cast("double"))
    wanted = F.col("unsafe_percentage").isNull() & (F.col("original_language").isNull() | (F.col("rust_percentage") >= 50.0))
    asked = reports.join(rows.where(wanted).select(F.col("_slug").alias("repo")), "repo", "left_semi")
    shares = asked.select("repo", vectorized.unsafe_share(F.col("report")).alias("_found")).groupBy("repo").agg(F.max("_found").alias("_found"))
    joined = rows.join(shares, F.col("_slug") == F.col("repo"), "left")
    return joined.select(*rows.columns, F.when(wanted, F.col("_found")).alias("_unsafe"))


def backfill(
    projects: DataFrame, exemplars: DataFrame, origins: DataFrame, commits: DataFrame, changes: DataFrame, now: str, batch: int = 25, *,
    reports: DataFrame | None = None, max_stars: int = 0, force: bool = False, **pending
) -> DataFrame:
    """The table after one batch of histories: analysed ones are rescored, those without commits are
    marked as failed, and those whose history is done get their unsafe share. ``commits``, ``changes`` and
    ``reports`` carry the repository's slug as ``repo``.

    A project whose history is done waits only for its unsafe share, so it is part of a batch only where a
    landed report gives one: what the job can't finish never takes another's place, run after run.
    """
    flagged = with_unsafe_share(merge.flag_exemplars(merge.star_cap_filter(projects, max_stars), exemplars), reports)
    done = F.coalesce(F.col("history_status") == "ok", F.lit(False)) & F.lit(not force)
    chosen = shared.cut_lineage(merge.backfill_batch(flagged.where(~done | F.col("_unsafe").isNotNull()), batch, force=force, measure_unsafe=reports is not None, **pending))
    measured = chosen.where(done).select("repo_url", F.col("_unsafe").alias("_measured"))
    projects = projects.join(measured, "repo_url", "left").withColumn("unsafe_percentage", F.coalesce("_measured", "unsafe_percentage")).select(*projects.columns)
    shares = chosen.select("repo_url", "_unsafe")
    chosen = chosen.where(~done).drop("_slug", "_unsafe")
    slugs = F.broadcast(chosen.select(text.normalize_slug(F.col("repo_url")).alias("repo"), "exemplar"))
    points = F.when(F.col("exemplar"), rules.EXEMPLAR_SAMPLE_POINTS).otherwise(rules.SAMPLE_POINTS)
    own = commits.join(slugs, "repo").withColumn("points", points).drop("exemplar")
    analysis = history.analyse(own, changes.join(slugs.select("repo"), "repo", "left_semi"), F.col("points"))
    stored = [*scoring.HISTORY, "from_language", "rust_before", "rust_after", "magnitude", "total_commits", "strong"]
    rows = candidates_of(chosen).withColumn("_slug_", text.normalize_slug(F.col("full_name")))
    old = rows.select("_slug_", *(F.col(c).alias(f"_old_{c}") for c in scoring.HISTORY))
    fresh = with_history(rows.drop(*stored).withColumn("_name", F.col("full_name")).withColumn("full_name", F.col("_slug_")), analysis).where("total_commits is not null")
    fresh = fresh.withColumn("full_name", F.col("_name")).drop("_name").join(old, "_slug_")
    has_lines = F.col("lines_added").isNotNull()
    fresh = fresh.withColumns({c: F.when(has_lines, F.col(c)).otherwise(F.col(f"_old_{c}")) for c in scoring.HISTORY}).drop(*old.columns)
    rescored = rescore(fresh, origins).join(shares, "repo_url", "left").withColumn("unsafe_percentage", F.col("_unsafe")).drop("_unsafe")
    rescored = shared.cut_lineage(rescored.withColumns({"history_status": F.lit("ok"), "history_attempted_at": F.lit(now), "history_attempts": F.lit(0).cast("bigint")}))
    written = merge.merge_upsert_rules(projects.select(*rescored.columns), rescored)
    failed = chosen.select("repo_url").join(rescored.select("repo_url"), "repo_url", "left_anti")
    done = rescored.select("repo_url").withColumn("ok", F.lit(True)).unionByName(failed.withColumn("ok", F.lit(False)))
    error = F.lit("no commits analyzed (clone/log failed or empty)")
    return merge.mark_history_attempt(written, done.withColumns({"error": error, "attempted_at": F.lit(now)}))


def published(projects: DataFrame, exemplars: DataFrame, origins: DataFrame) -> DataFrame:
    """The listing's rows in order."""
    rows = listing.listing_filter(projects)
    rows = listing.curated_origin_override(merge.flag_exemplars(rows, exemplars), origins)
    return rows.orderBy(*listing.listing_order())


def upsert_projects(batch: DataFrame, root: str, *, deletes: DataFrame | None = None, stream: tuple[str, int] | None = None, buckets: int = tables.BUCKETS) -> tables.Version:
    """Merge scored projects into the table below ``root``, drop the keys in ``deletes`` (repo_url), and make the result
    current; returns its version. Of rows with one repo_url the furthest counts, rows without one don't. ``stream``: see
    ``tables.change``."""
    rows = merge.prefer_enriched(batch.where("repo_url is not null").withColumn("source_no", F.lit(0))).drop("source_no")
    return tables.change(rows, root, merge.merge_upsert_rules, merge.merge_sent_batch, deletes=deletes, stream=stream, buckets=buckets)
