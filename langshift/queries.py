"""One query for each operator of the domain, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules, shared
from .adapters import Tables
from .functions import numbers, paths, text, vectorized
from .jobs import workflows
from .operators import classify, discovery, history, listing, merge, scoring
from .sources import published, readers, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NOW = "2025-01-01"
SHOWN = ["repo_url", "stars", "confidence", "project_kind", "original_language", "unsafe_percentage", "lines_added", "history_status", "history_attempted_at", "history_attempts", "first_detected", "last_seen", "transition_magnitude", "history_from_language"]


def query(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[function.__name__] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
    return function


def joined(array: str | Column, sep: str = ",") -> Column:
    return F.coalesce(F.array_join(array, sep), F.lit(""))


def rounded(name: str, digits: int = 4) -> Column:
    return numbers.round_half_up(F.col(name), digits).alias(name)


def flat(rows: DataFrame) -> DataFrame:
    """All columns of stored projects, with lists as text."""
    texts = {
        "signals": joined(F.transform("signals", lambda s: F.concat_ws("=", s["kind"], s["detail"], s["url"])), ";"),
        "rewrite_prs": joined(F.transform("rewrite_prs", lambda p: F.concat_ws("=", p["title"], p["url"])), ";"),
        "rewrite_pr": F.concat_ws("=", F.col("rewrite_pr.title"), F.col("rewrite_pr.url")),
        "ai_agents": joined("ai_agents"),
    }
    return rows.select(*(texts[c].alias(c) if c in texts else F.col(c) for c in readers.PROJECT))


def stored(rows: DataFrame) -> DataFrame:
    return rows.select(*SHOWN, joined("ai_agents").alias("agents"))


# Sources and sinks


@query
def read_repo_listing(t: Tables) -> DataFrame:
    names = {"stars": "stargazers_count", "forks": "forks_count", "open_issues": "open_issues_count"}
    gaps = F.col("k") % 7 == 0
    rows = t.repos.select("k", "full_name", "html_url", "description", "readme", "language", *(F.when(~gaps, F.col(c)).alias(n) for c, n in names.items()))
    lines = rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "k"])).alias("value"))
    return readers.repos_of(lines.select(F.from_json("value", readers.REPO_LISTING).alias("x")).select("x.*"))


@query
def read_issue_listing(t: Tables) -> DataFrame:
    lines = t.raw("issues").select(F.to_json(F.struct("title", "html_url", "repository_url", "pull_request", "state")).alias("value"))
    return readers.issues_of(lines.select(F.from_json("value", readers.ISSUE_LISTING).alias("x")).select("x.*"))


@query
def read_languages(t: Tables) -> DataFrame:
    maps = t.languages.groupBy("full_name").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "bytes")))).alias("languages"))
    return readers.languages_of(maps)


def landed_logs(t: Tables) -> str:
    """The log of each repository as the log command prints it, landed as text below ``repo=<name>``."""
    nul = F.lit("\0")
    heads = t.commits.select("repo", "commit_seq", F.lit(-1).cast("bigint").alias("f"), F.concat(F.lit("abc"), nul, F.col("ts"), nul, "subject", nul, F.array_join("coauthors", "\u0001")).alias("line"))
    number = F.when(F.col("added") % 50 == 0, F.lit("-")).otherwise(F.col("added").cast("string"))
    changes = shared.cut_lineage(t.changes)  # sampled for the ranges, and dealt
    files = changes.select("repo", "commit_seq", F.col("file_seq").cast("bigint").alias("f"), F.concat(number, F.lit("\t"), F.col("removed"), F.lit("\t"), "path").alias("line"))
    path = shared.shared_dir(t.spark)
    ordered = heads.unionByName(files).repartitionByRange("repo", "commit_seq", "f").sortWithinPartitions("repo", "commit_seq", "f")
    ordered.select("repo", F.col("line").alias("value")).write.partitionBy("repo").text(path)
    return path


@query
def parse_numstat_log(t: Tables) -> DataFrame:
    lines = shared.cut_lineage(readers.read_logs(t.spark, landed_logs(t)))  # read for commits and for changes
    sums = readers.changes_of(lines).groupBy("repo", "commit_seq").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max("path").alias("last_path"))
    return readers.commits_of(lines).select("repo", "commit_seq", "ts", "subject", joined("coauthors").alias("coauthors")).join(sums, ["repo", "commit_seq"], "left")


@query
def read_exemplars(t: Tables) -> DataFrame:
    return t.exemplars


@query
def read_origins(t: Tables) -> DataFrame:
    return t.origins


@query
def load_projects(t: Tables) -> DataFrame:
    rows = readers.projects_of(t.raw("stored").drop("forks", "last_seen"))
    kinds = F.transform("signals", lambda s: s["kind"])
    return rows.select("repo_url", "forks", "stars", "confidence", joined(kinds).alias("kinds"), joined("ai_agents").alias("agents"), F.col("rewrite_pr.title").alias("pr_title"), F.size("rewrite_prs").alias("prs"))


@query
def upsert_projects(t: Tables) -> DataFrame:
    """Two batches through the table on disk: the second changes what it names and leaves the rest."""
    root = shared.shared_dir(t.spark)
    for name in ("stored", "shard_2"):
        workflows.upsert_projects(t.projects(name), root)
    return stored(tables.current(t.spark, root))


@query
def publish_listing(t: Tables) -> DataFrame:
    """The published text, read back by rank: which keys each line has, and some of their values."""
    root = shared.shared_dir(t.spark)
    rows = listed(t)
    published.publish(rows, listing.listing_order(), root, line=listing.json_line(rows.columns))
    lines = published.lines(t.spark, root)
    value = F.from_json("value", "repo_url string, description string, confidence double, stars bigint, exemplar boolean, unsafe_percentage double, rewrite_pr struct<title: string>, ai_agents array<string>").alias("x")
    keys = joined(F.array_sort(F.json_object_keys("value")))
    return lines.select("rank", keys.alias("keys"), value).select("rank", "keys", "x.repo_url", "x.description", "x.confidence", "x.stars", "x.exemplar", "x.unsafe_percentage", F.col("x.rewrite_pr.title").alias("pr_title"), joined("x.ai_agents").alias("agents"))


@query
def unsafe_share(t: Tables) -> DataFrame:
    return unsafe_reports(t).select("k", vectorized.unsafe_share(F.col("report")).alias("unsafe_percentage"))


def unsafe_reports(t: Tables) -> DataFrame:
    """A report for each repository: a third in JSON, a third as text, a third without numbers."""
    k = F.col("k")
    a, b, c = (k % 9).cast("string"), (k % 13).cast("string"), (k % 90).cast("string")
    tree = F.concat(F.lit('{"packages":[{"functions":{"safe":'), c, F.lit(',"unsafe_":'), a, F.lit('}},{"deep":[{"functions":{"safe":'), b, F.lit(',"unsafe":1}}]}]}'))
    lines = F.concat(F.lit("Functions  "), a, F.lit("/"), c, F.lit(" 9/9 x\n  none here\n"), b, F.lit("/20 x"))
    report = F.when(k % 3 == 0, tree).when(k % 3 == 1, lines).otherwise(F.lit("nothing to see"))
    return t.repos.select("k", text.normalize_slug(F.col("full_name")).alias("repo"), report.alias("report"))


# Scalar functions


@query
def normalize_slug(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("  https://github.com/"), "full_name", F.when(F.col("k") % 2 == 0, "//").otherwise(" "))
    return t.repos.select("k", text.normalize_slug(raw).alias("slug"))


@query
def normalize_repo_url(t: Tables) -> DataFrame:
    raw = F.when(F.col("k") % 2 == 0, F.concat("html_url", F.lit("//"))).otherwise(F.concat(F.lit("/"), "full_name", F.lit("/")))
    return t.repos.select("k", text.normalize_repo_url(raw).alias("url"))


def path_query(column: Callable[[Column], Column], name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t.changes.select("repo", "commit_seq", "file_seq", "path", column(F.col("path")).alias(name))


@query
def is_ignored_path(t: Tables) -> DataFrame:
    return path_query(paths.is_ignored_path, "ignored")(t)


@query
def language_from_path(t: Tables) -> DataFrame:
    return path_query(paths.language_from_path, "lang")(t)


@query
def is_application_language(t: Tables) -> DataFrame:
    return t.languages.select("full_name", "lang", paths.is_application_language(F.col("lang")).alias("application"))


@query
def sanitize_language(t: Tables) -> DataFrame:
    return t.languages.select("full_name", "lang", paths.sanitize_language(F.col("lang")).alias("sanitized"))


@query
def truncate_title(t: Tables) -> DataFrame:
    return t.raw("issues").select("k", text.truncate_title(F.col("title")).alias("title"))


@query
def combined_text(t: Tables) -> DataFrame:
    return t.projects().select("repo_url", text.combined_text(F.col("description"), F.col("signals")).alias("body"))


@query
def phrase_flags(t: Tables) -> DataFrame:
    body = F.col("body")
    flags = {"in_place": text.in_place, "external_port": text.external_port, "competitor": text.competitor, "targeted": text.targeted, "api": text.about_api}
    return t.texts.select("doc_id", *(f(body).alias(n) for n, f in flags.items()))


@query
def named_migration_verb(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", text.named_migration_verb(F.col("body")).alias("named"))


@query
def extract_named_origin(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", text.extract_named_origin(F.col("body")).alias("origin"))


@query
def extract_rewritten_subject(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", text.extract_rewritten_subject(F.col("body")).alias("subject"))


@query
def named_origin(t: Tables) -> DataFrame:
    rows = classify.with_origin(workflows.candidates_of(t.projects()), t.origins)
    return rows.select("full_name", "named_origin")


@query
def strong_rewrite_signal(t: Tables) -> DataFrame:
    return t.projects().select("repo_url", text.strong_rewrite_signal(F.col("description"), F.col("signals")).alias("strong_signal"))


@query
def significant_tokens(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", joined(text.significant_tokens(F.col("body"))).alias("tokens"))


@query
def product_slug(t: Tables) -> DataFrame:
    return t.repos.select("full_name", text.product_slug(F.col("full_name")).alias("slug"))


@query
def token_overlap(t: Tables) -> DataFrame:
    a, b = text.significant_tokens(F.col("description")), text.significant_tokens(F.col("full_name"))
    return t.repos.select("k", text.tokens_overlap(a, b).alias("overlap"))


@query
def compact_identity(t: Tables) -> DataFrame:
    first = F.substring_index(F.lower("description"), " ", 1)
    return t.repos.select("k", text.compact_identity(first, text.product_slug(F.col("full_name")), 3).alias("same"))


@query
def product_before_phrase(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", text.product_before_phrase(F.col("body")).alias("product"))


def titled(t: Tables, **columns: Column) -> DataFrame:
    rows = t.raw("issues").withColumn("detail", F.concat(F.lit("PR titled: "), "title"))
    return rows.select("k", *(c.alias(n) for n, c in columns.items()))


@query
def signal_title(t: Tables) -> DataFrame:
    return titled(t, title=text.signal_title(F.col("detail")))


@query
def migration_discussion(t: Tables) -> DataFrame:
    return titled(t, discussed=text.migration_discussion(F.col("detail")), wishful=text.wishful(F.col("detail")))


@query
def pr_relevance(t: Tables) -> DataFrame:
    return titled(t, points=text.pr_relevance(F.col("title")).cast("bigint"))


@query
def pr_number(t: Tables) -> DataFrame:
    url = F.when(F.col("k") % 4 == 0, F.concat("html_url", F.lit("/files"))).otherwise(F.col("html_url"))
    return titled(t, number=text.pr_number(url))


def evidence(t: Tables) -> DataFrame:
    return classify.with_evidence(classify.with_origin(workflows.candidates_of(t.projects()), t.origins))


@query
def product_migration_signal(t: Tables) -> DataFrame:
    rows = workflows.candidates_of(t.projects()).withColumn("_slug", text.product_slug(F.col("full_name")))
    own, owners = text.significant_tokens(F.col("_slug")), text.significant_tokens(classify.owner(F.col("full_name")))
    rows = rows.select("full_name", "_slug", own.alias("own"), owners.alias("owners"), F.posexplode("signals").alias("n", "s")).where("s.kind <> 'repo-search'")
    return rows.select("full_name", F.col("s.url").alias("url"), text.product_migration_signal(F.col("s.detail"), F.col("_slug"), F.col("own"), F.col("owners")).alias("own_migration"))


@query
def identity_continuity(t: Tables) -> DataFrame:
    return evidence(t).select("full_name", "identity")


@query
def classify_kind(t: Tables) -> DataFrame:
    return classify.classify_kind(workflows.candidates_of(t.projects()), t.origins).select("full_name", "project_kind")


@query
def match_ai_agent(t: Tables) -> DataFrame:
    return t.raw("commits").select("o_orderkey", text.match_agent(F.col("trailer")).alias("agent"))


@query
def duration_days(t: Tables) -> DataFrame:
    spans = t.commits.groupBy("repo").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("repo", numbers.duration_days(F.col("a"), F.col("b")).alias("days"), numbers.duration_days(F.lit(0).cast("bigint"), F.col("b")).alias("unknown"))


@query
def round_half_up(t: Tables) -> DataFrame:
    x = F.col("k").cast("double") / 7.0
    return t.repos.select("k", numbers.round_half_up(x, 1).alias("one"), numbers.round_half_up(x, 2).alias("two"))


@query
def strong_from_stored(t: Tables) -> DataFrame:
    c = [F.col(x) for x in ("transition_magnitude", "history_rust_before", "history_rust_after", "history_from_language")]
    return t.projects().select("repo_url", numbers.strong_from_stored(*c).alias("strong"))


@query
def display_metrics(t: Tables) -> DataFrame:
    return listing.display_metrics(t.projects())


# Filters


@query
def match_repo_rules(t: Tables) -> DataFrame:
    return discovery.match_repo_rules(t.repos).select("full_name", "rule_no", "label")


@query
def match_issue_rules(t: Tables) -> DataFrame:
    return discovery.match_issue_rules(t.issues, t.repos).select("full_name", "url", "rule_no", "detail")


@query
def min_confidence_filter(t: Tables) -> DataFrame:
    return scoring.min_confidence_filter(t.projects()).select("repo_url", "confidence")


@query
def listing_filter(t: Tables) -> DataFrame:
    return listing.listing_filter(t.projects()).select("repo_url", "project_kind", "confidence")


@query
def search_listing(t: Tables) -> DataFrame:
    return listing.search_listing(t.projects(), " Python ").select("repo_url", "description", "original_language")


@query
def backlog_pending(t: Tables) -> DataFrame:
    rows = merge.flag_exemplars(t.projects(), t.exemplars)
    return rows.select("repo_url", merge.backlog_pending().alias("pending"), merge.backlog_pending(retry_failed=True, measure_unsafe=False).alias("pending_retry"))


@query
def star_cap_filter(t: Tables) -> DataFrame:
    return merge.star_cap_filter(t.projects(), 500).select("repo_url", "stars")


@query
def shard_filter(t: Tables) -> DataFrame:
    return t.repos.where(vectorized.shard_owns(F.col("html_url"), 2, 5)).select("html_url")


# Joins


def scanned(t: Tables) -> DataFrame:
    return workflows.candidates(t.repos, t.issues, t.exemplars)


def bare_candidates(t: Tables) -> DataFrame:
    """Two candidates for each repository: one that the listings know, with some facts of its own or none, and one
    that they don't."""
    known = t.repos.select("full_name", F.when(F.col("k") % 2 == 0, F.col("description")).alias("description"), F.when(F.col("k") % 4 < 2, F.col("stars")).otherwise(0).alias("stars"))
    lost = t.repos.select(F.concat("full_name", F.lit("-gone")).alias("full_name"), F.when(F.col("k") % 2 == 0, F.lit("kept")).alias("description"), F.lit(0).cast("bigint").alias("stars"))
    return known.unionByName(lost).withColumn("html_url", F.lit("")).select("full_name", "html_url", "description", "stars")


@query
def enrich_metadata(t: Tables) -> DataFrame:
    return discovery.enrich_metadata(bare_candidates(t), t.repos)


@query
def open_pr_counts(t: Tables) -> DataFrame:
    return discovery.open_pr_counts(t.repos.select("full_name", "open_issues"), t.issues)


@query
def language_mix(t: Tables) -> DataFrame:
    return discovery.with_rounded_share(discovery.language_mix(t.languages))


@query
def attach_languages(t: Tables) -> DataFrame:
    return discovery.with_rounded_share(discovery.attach_languages(bare_candidates(t), discovery.language_mix(t.languages)))


@query
def preserve_first_seen(t: Tables) -> DataFrame:
    return merge.preserve_first_seen(t.projects("shard_2"), t.projects("shard_1")).select("repo_url", "first_detected", "last_seen")


@query
def flag_exemplars(t: Tables) -> DataFrame:
    return merge.flag_exemplars(t.projects(), t.exemplars).select("repo_url", "exemplar")


@query
def curated_origin_override(t: Tables) -> DataFrame:
    return listing.curated_origin_override(t.projects(), t.origins).select("repo_url", "named_origin")


@query
def pending_exemplars(t: Tables) -> DataFrame:
    return merge.pending_exemplars(t.exemplars, t.projects()).select("slug")


@query
def path_language_join(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(list(rules.EXTENSIONS.items()), "ext string, lang string")
    rows = history.path_language_join(t.changes, table)
    return rows.groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"))


# History


def composition(t: Tables, points: int = rules.SAMPLE_POINTS, changes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    samples = shared.cut_lineage(history.composition_samples(t.commits, points))
    changes = history.kept(t.changes) if changes is None else changes
    mix = history.composition_asof(history.placed_net_lines(history.with_language(changes)), samples, t.commits)
    return shared.cut_lineage(mix), samples  # small, and read by several steps


def series(t: Tables) -> DataFrame:
    return history.rust_share_series(*composition(t))


@query
def running_net_lines(t: Tables) -> DataFrame:
    return history.running_net_lines(history.with_language(history.kept(t.changes)))


@query
def composition_samples(t: Tables) -> DataFrame:
    return history.composition_samples(t.commits).withColumn("sample_no", F.col("sample_no").cast("bigint"))


@query
def composition_asof(t: Tables) -> DataFrame:
    return composition(t)[0].withColumn("sample_no", F.col("sample_no").cast("bigint"))


@query
def rust_share_series(t: Tables) -> DataFrame:
    return series(t).select("repo", F.col("sample_no").cast("bigint").alias("sample_no"), "commit_seq", "net_total", rounded("share"))


@query
def segment_shares(t: Tables) -> DataFrame:
    return history.segment_shares(*composition(t)).select("repo", "lang", rounded("before"), rounded("after"))


@query
def language_transition(t: Tables) -> DataFrame:
    mix, samples = composition(t)
    return history.language_transition(history.segment_shares(mix, samples), history.rust_share_series(mix, samples), t.commits)


@query
def steepest_rise(t: Tables) -> DataFrame:
    return history.steepest_rise(series(t)).select("repo", rounded("slope"), "rise_start", "rise_end")


@query
def transition_window(t: Tables) -> DataFrame:
    shares = series(t)
    return history.transition_window(shares, history.steepest_rise(shares))


@query
def transition_churn(t: Tables) -> DataFrame:
    return history.transition_churn(t.changes)


def transition_commits(t: Tables) -> DataFrame:
    changes = history.kept(t.changes)
    mix, samples = composition(t, changes=changes)
    shares = history.rust_share_series(mix, samples)
    window = shared.cut_lineage(history.transition_window(shares, history.steepest_rise(shares)))  # a row for each repository at most
    return history.commit_lines(history.window_commits(t.commits, window, samples, history.transition_churn(changes)), changes)


@query
def window_totals(t: Tables) -> DataFrame:
    return history.window_totals(transition_commits(t))


@query
def ai_agents(t: Tables) -> DataFrame:
    return history.ai_agents(t.commits).select("repo", joined("agents").alias("agents"))


@query
def commit_burst(t: Tables) -> DataFrame:
    return history.commit_burst(t.commits)


@query
def ai_assist_score(t: Tables) -> DataFrame:
    window = transition_commits(t)
    return history.ai_assist_score(window, history.commit_burst(window))


# Candidates and scores


def repo_hits(t: Tables, k: int = rules.RULE_LIMIT) -> DataFrame:
    return discovery.rule_top_k(discovery.match_repo_rules(t.repos), [F.desc("stars"), F.col("full_name")], k)


def issue_hits(t: Tables, k: int = rules.RULE_LIMIT) -> DataFrame:
    return discovery.rule_top_k(discovery.match_issue_rules(t.issues, t.repos), [F.col("url"), F.col("full_name")], k)


@query
def rule_top_k(t: Tables) -> DataFrame:
    return repo_hits(t).select("rule_no", "rank", "full_name", "stars")


@query
def union_signals(t: Tables) -> DataFrame:
    rows = discovery.union_signals(repo_hits(t), issue_hits(t), t.exemplars.select("slug"))
    return rows.select("full_name", "rule_no", "rank", "kind", "detail", "url")


@query
def collect_signals(t: Tables) -> DataFrame:
    rows = discovery.collect_signals(discovery.union_signals(repo_hits(t), issue_hits(t), t.exemplars.select("slug")))
    details = F.transform("signals", lambda s: F.concat(s["kind"], F.lit("="), s["detail"]))
    return rows.select("full_name", "stars", "description", "html_url", joined(details, ";").alias("signals"))


@query
def rank_candidates(t: Tables) -> DataFrame:
    return scanned(t).select("full_name", F.size("signals").alias("n_signals"), "stars")


@query
def text_evidence(t: Tables) -> DataFrame:
    return t.projects().select("repo_url", scoring.text_evidence(F.col("signals")).alias("evidence"))


@query
def score_confidence(t: Tables) -> DataFrame:
    rows = workflows.candidates_of(t.projects()).withColumn("kind", F.element_at(F.array(*map(F.lit, ("rewrite", "replacement", "neither"))), F.length("full_name") % 3 + 1))
    return rows.select("full_name", "kind", scoring.confidence(F.col("kind"), F.col("signals"), F.col("description")).alias("confidence"))


@query
def select_migration_prs(t: Tables) -> DataFrame:
    signals = discovery.collect_signals(discovery.union_signals(repo_hits(t), issue_hits(t), t.exemplars.select("slug")))
    prs = scoring.select_migration_prs(F.col("signals"))
    return signals.select("full_name", joined(F.transform(prs, lambda p: p["url"])).alias("urls"))


@query
def source_link(t: Tables) -> DataFrame:
    return t.projects().select("repo_url", scoring.source_link(F.filter("signals", lambda s: s["kind"] != "repo-search"), F.col("repo_url")).alias("link"))


@query
def project_row(t: Tables) -> DataFrame:
    judged = classify.classify_kind(workflows.candidates_of(t.projects()), t.origins)
    return flat(scoring.project_row(judged, F.lit(NOW)))


@query
def scan(t: Tables) -> DataFrame:
    rows = workflows.scan(t.repos, t.issues, t.languages, t.exemplars, t.origins, NOW)
    return rows.select("name", "repo_url", "stars", "open_issues", "open_prs", "original_language", "rust_percentage", "confidence", "project_kind", "named_origin", F.size("signals").alias("n_signals"))


@query
def scan_with_histories(t: Tables) -> DataFrame:
    projects, commits, changes = with_histories(t)
    return flat(workflows.scan(t.repos, t.issues, t.languages, t.exemplars, t.origins, NOW, commits=commits, changes=changes, stored=projects))


@query
def scan_exemplars(t: Tables) -> DataFrame:
    projects, commits, changes = with_histories(t)
    return flat(workflows.scan_exemplars(t.exemplars, projects, t.repos, t.issues, t.languages, t.origins, NOW, commits=commits, changes=changes))


# Keeping the table


@query
def kind_counts(t: Tables) -> DataFrame:
    return merge.kind_counts(t.projects())


@query
def backlog_counts(t: Tables) -> DataFrame:
    return merge.backlog_counts(merge.flag_exemplars(t.projects(), t.exemplars), max_stars=700)


@query
def merge_upsert_rules(t: Tables) -> DataFrame:
    return stored(merge.merge_upsert_rules(t.projects("shard_1"), t.projects("shard_2")))


@query
def merge_shards(t: Tables) -> DataFrame:
    return stored(merge.merge_shards(t.projects(), [t.projects("shard_1"), t.projects("shard_2")]))


@query
def merged_counts(t: Tables) -> DataFrame:
    return merge.merged_counts(t.projects(), [t.projects("shard_1"), t.projects("shard_2")])


@query
def mark_history_attempt(t: Tables) -> DataFrame:
    # An attempt for each repository; a third are for others, so that their projects stay untried.
    url = F.when(F.col("k") % 3 > 0, F.col("html_url")).otherwise(F.concat("html_url", F.lit("/moved")))
    tried = t.repos.select(url.alias("repo_url"), (F.col("k") % 3 == 1).alias("ok"), F.lit("lost").alias("error"), F.lit(NOW).alias("attempted_at"))
    return merge.mark_history_attempt(t.projects(), tried).select("repo_url", "history_status", "history_error", "history_attempted_at", "history_attempts")


@query
def reclassify(t: Tables) -> DataFrame:
    """The table on disk after it is judged anew."""
    root = shared.shared_dir(t.spark)
    workflows.upsert_projects(t.projects(), root)
    workflows.reclassify_stored(t.spark, root, t.origins)
    return flat(tables.current(t.spark, root, t.projects().schema))


def with_histories(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects for the repositories that have commits, and those commits under the projects' slugs."""
    named = t.repos.select(F.concat(F.lit("org/repo"), "k").alias("repo"), text.normalize_slug(F.col("full_name")).alias("slug"))
    names = named.join(F.broadcast(t.commits.select("repo").distinct()), "repo", "left_semi")  # 25 stand-in histories

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(names), "repo").drop("repo").withColumnRenamed("slug", "repo")

    return t.projects(), renamed(t.commits), renamed(t.changes)


@query
def backfill(t: Tables) -> DataFrame:
    projects, commits, changes = with_histories(t)
    return stored(workflows.backfill(projects, t.exemplars, t.origins, commits, changes, NOW, batch=200, reports=unsafe_reports(t)))


@query
def history_analysis(t: Tables) -> DataFrame:
    rows = history.analyse(t.commits, t.changes)
    return rows.select("repo", "from_language", "rust_before", "rust_after", "magnitude", "total_commits", "strong", "lines_added", "lines_removed", "commit_count", "velocity", "days", "score", joined("agents").alias("agents"))


# Orders and pages


def listed(t: Tables) -> DataFrame:
    return merge.flag_exemplars(listing.listing_filter(t.projects()), t.exemplars)


@query
def backfill_priority(t: Tables) -> DataFrame:
    return merge.flag_exemplars(t.projects(), t.exemplars).orderBy(*merge.backfill_order()).select("repo_url", "exemplar", "stars", "confidence")


@query
def backfill_batch(t: Tables) -> DataFrame:
    return merge.backfill_batch(merge.flag_exemplars(t.projects(), t.exemplars)).select("repo_url", "exemplar", "stars", "confidence")


@query
def listing_order(t: Tables) -> DataFrame:
    return workflows.published(t.projects(), t.exemplars, t.origins).select("repo_url", "exemplar", "project_kind", "confidence", "stars", "named_origin")


def served(t: Tables, rows: DataFrame, order: str | None, page: int, size: int) -> DataFrame:
    """A page of the listing (written rows), published in an order that a reader chose (or its own)."""
    root = shared.shared_dir(t.spark)
    published.publish(rows, listing.listing_sorts(order) if order else listing.listing_order(), root, written=True)
    return published.page(t.spark, root, rows.schema, page, size)


@query
def listing_sorts(t: Tables) -> DataFrame:
    """The second page in each of the four orders."""
    rows = shared.cut_lineage(listed(t))
    pages = [served(t, rows, order, 2, 36).select(F.lit(order).alias("sort"), "repo_url") for order in ("rewrites", "confidence", "stars", "recent")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@query
def listing_page(t: Tables) -> DataFrame:
    """The last page, asked for by a number that is too large."""
    return served(t, shared.cut_lineage(listed(t)), None, 10**6, 24).select("repo_url")
