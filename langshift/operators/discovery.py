"""From listings to candidates: rule matches, signals, ranking, metadata.

All rules are tested in one scan of each listing. Signals meet by repository once, after the matches
have been cut and deduplicated; facts are read only for the candidates that remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules
from ..functions import numbers, paths, text

SIGNAL = ["full_name", "rule_no", "rank", "kind", "detail", "url"]

#: Fixed value: what the signal of a curated project says.
EXEMPLAR_DETAIL = "curated exemplar rewrite (priority target)"


def _matches(conditions: list[Column], labels: list[str], first_no: int) -> Column:
    cases = [F.when(c, F.struct(F.lit(n + first_no).alias("rule_no"), F.lit(label).alias("label"))) for n, (c, label) in enumerate(zip(conditions, labels, strict=True))]
    return F.explode(F.array_compact(F.array(*cases)))


def match_repo_rules(repos: DataFrame) -> DataFrame:
    """Repositories with each rule that they match: all columns, rule_no (from 0) and label.

    Phrases are case-insensitive substrings of name and description, or of description and readme."""
    plain = F.lower(F.concat_ws(" ", "full_name", "description"))
    long = F.lower(F.concat_ws(" ", "description", "readme"))

    def holds(rule: rules.Rule) -> Column:
        found = F.lit(True)
        for phrase in rule.phrases:
            found = found & F.contains(F.col("_long" if rule.readme else "_plain"), F.lit(phrase))
        if rule.language:
            found = found & F.coalesce(F.col("language") == rule.language, F.lit(False))
        return found if rule.stars is None else found & F.coalesce(F.col("stars") > rule.stars, F.lit(False))

    rows = repos.withColumns({"_plain": plain, "_long": long})
    matched = rows.withColumn("_m", _matches([holds(r) for r in rules.REPO_RULES], [r.label for r in rules.REPO_RULES], 0))
    return matched.select(*repos.columns, "_m.rule_no", "_m.label")


def match_issue_rules(issues: DataFrame, repos: DataFrame) -> DataFrame:
    """Issues (full_name, kind, title, url) with each rule that their title matches: rule_no (after the
    repository rules), detail. Stars are looked up only for titles that a rule asks them for."""
    title = F.lower("title")

    def holds(rule: rules.Rule) -> Column:
        found = F.col("kind") == rule.kind
        for phrase in rule.phrases:
            found = found & F.contains(title, F.lit(phrase))
        return F.coalesce(found, F.lit(False))

    least = [-1 if r.stars is None else r.stars for r in rules.ISSUE_RULES]
    matched = issues.withColumn("_m", _matches([holds(r) for r in rules.ISSUE_RULES], [r.label for r in rules.ISSUE_RULES], len(rules.REPO_RULES)))
    wanted = F.element_at(F.array(*map(F.lit, least)), F.col("_m.rule_no") - len(rules.REPO_RULES) + 1)
    matched = matched.select(*issues.columns, F.col("_m.rule_no").alias("rule_no"), F.concat(F.col("_m.label"), F.lit(": "), text.truncate_title(F.col("title"))).alias("detail"), wanted.alias("_least"))
    starred = matched.where("_least >= 0").join(repos.select("full_name", "stars"), "full_name").where("stars > _least").drop("stars")
    return matched.where("_least < 0").unionByName(starred).drop("_least")


def rule_top_k(matches: DataFrame, order: list[Column], k: int = rules.RULE_LIMIT) -> DataFrame:
    """At most ``k`` rows for each rule_no in the given order, with their rank (from 1).

    Each task cuts its own rows first (Spark does so for a rank with an upper bound), so that the few
    keys meet few rows."""
    rank = F.row_number().over(Window.partitionBy("rule_no").orderBy(*order))
    return matches.withColumn("rank", rank).where(F.col("rank") <= k)


def union_signals(repo_hits: DataFrame, issue_hits: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Signals of all three sources, and what repositories' own hits know of them.

    ``exemplars``: slug. Columns: full_name, rule_no, rank, kind, detail, url, stars, description, html_url.
    """
    none = F.lit(None).cast("string")
    repo = repo_hits.select("full_name", "rule_no", "rank", F.lit("repo-search").alias("kind"), F.col("label").alias("detail"), F.col("html_url").alias("url"), "stars", "description", "html_url")
    issue = issue_hits.select("full_name", "rule_no", "rank", "kind", "detail", "url", F.lit(0).cast("bigint").alias("stars"), none.alias("description"), none.alias("html_url"))
    page = F.concat(F.lit("https://github.com/"), F.col("slug"))
    seeds = exemplars.select(
        F.col("slug").alias("full_name"), F.lit(-1).alias("rule_no"), F.lit(1).alias("rank"), F.lit("exemplar").alias("kind"),
        F.lit(EXEMPLAR_DETAIL).alias("detail"), page.alias("url"), F.lit(0).cast("bigint").alias("stars"), none.alias("description"), page.alias("html_url"),
    )
    return repo.unionByName(issue).unionByName(seeds)


def collect_signals(signals: DataFrame) -> DataFrame:
    """One candidate for each repository: full_name, html_url, description, stars, signals.

    Of signals with the same url and detail the first by rule and rank stays; signals keep that order.
    Deduplicated before they are gathered, so that a list holds distinct signals only."""
    place = F.struct("rule_no", "rank", "kind")
    once = signals.groupBy("full_name", "url", "detail").agg(
        F.min(place).alias("p"),
        F.max("stars").alias("stars"),
        F.min(F.when(F.col("description").isNotNull(), F.struct("rule_no", "rank", "description"))).alias("d"),
        F.max(F.when(F.col("html_url").isNotNull(), F.struct("rule_no", "rank", "html_url"))).alias("h"),
    )
    entry = F.struct(F.col("p.rule_no").alias("rule_no"), F.col("p.rank").alias("rank"), "url", "detail", F.col("p.kind").alias("kind"))
    out = once.groupBy("full_name").agg(F.sort_array(F.collect_list(entry)).alias("s"), F.max("stars").alias("stars"), F.min("d").alias("d"), F.max("h").alias("h"))
    plain = F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["detail"].alias("detail"), s["url"].alias("url")))
    return out.select("full_name", F.coalesce("h.html_url", F.lit("")).alias("html_url"), F.col("d.description").alias("description"), "stars", plain.alias("signals"))


def rank_candidates(candidates: DataFrame, limit: int = rules.CANDIDATE_LIMIT) -> DataFrame:
    """The candidates with the most signals, then stars; equals by name."""
    return candidates.orderBy(F.size("signals").desc(), F.desc("stars"), "full_name").limit(limit)


def enrich_metadata(candidates: DataFrame, repos: DataFrame) -> DataFrame:
    """Candidates with stars (the larger), forks and open issues of their repository. A candidate that has
    neither stars nor description gets url and description too, and goes if no repository is known."""
    facts = repos.select("full_name", F.col("html_url").alias("_url"), F.col("description").alias("_d"), F.col("stars").alias("_s"), "forks", "open_issues", F.lit(True).alias("_known"))
    rows = candidates.join(facts, "full_name", "left")
    bare = (F.col("stars") == 0) & F.col("description").isNull()
    known = F.coalesce("_known", F.lit(False))
    rows = rows.where(known | ~bare)
    return rows.select(
        "full_name",
        F.when(bare & known, F.col("_url")).otherwise(F.col("html_url")).alias("html_url"),
        F.when(bare & known, F.col("_d")).otherwise(F.col("description")).alias("description"),
        F.greatest("stars", F.coalesce("_s", F.lit(0))).alias("stars"),
        F.coalesce("forks", F.lit(0)).alias("forks"),
        F.coalesce("open_issues", F.lit(0)).alias("open_issues"),
        *[c for c in candidates.columns if c not in ("full_name", "html_url", "description", "stars")],
    )


def open_pr_counts(candidates: DataFrame, issues: DataFrame) -> DataFrame:
    """Candidates with open_prs, and open_issues less those. ``issues``: full_name, kind, state."""
    wanted = issues.where((F.col("kind") == "pull-request") & (F.col("state") == "open"))
    prs = wanted.groupBy("full_name").agg(F.count(F.lit(1)).alias("open_prs"))
    rows = candidates.join(prs, "full_name", "left").withColumn("open_prs", F.coalesce("open_prs", F.lit(0)))
    return rows.withColumn("open_issues", F.greatest(F.col("open_issues") - F.col("open_prs"), F.lit(0)))


def language_mix(languages: DataFrame) -> DataFrame:
    """full_name, rust_percentage, original_language, rust_is_primary from bytes by language.

    Equal sizes: the smallest name is the primary one, the greatest name the displaced one."""
    target = F.lower("lang") == rules.TARGET.lower()
    other = ~target & paths.is_application_language(F.col("lang"))
    sums = languages.groupBy("full_name").agg(
        F.sum("bytes").alias("total"),
        F.sum(F.when(target, F.col("bytes")).otherwise(0)).alias("t"),
        F.min(F.struct((-F.col("bytes")).alias("b"), "lang")).alias("first"),
        F.max(F.when(other, F.struct("bytes", "lang"))).alias("o"),
    )
    full = F.col("total") > 0
    displaced = full & (F.col("o.bytes") / F.col("total") * 100.0 >= rules.MIN_DISPLACED)
    return sums.select(
        "full_name",
        F.when(full, F.col("t") / F.col("total") * 100.0).otherwise(0.0).alias("rust_percentage"),
        F.when(displaced, F.col("o.lang")).alias("original_language"),
        (full & (F.lower("first.lang") == rules.TARGET.lower())).alias("rust_is_primary"),
    )


def attach_languages(candidates: DataFrame, mix: DataFrame) -> DataFrame:
    """Candidates with their language mix; without bytes: 0, null, false."""
    rows = candidates.join(mix, "full_name", "left")
    return rows.withColumns({"rust_percentage": F.coalesce("rust_percentage", F.lit(0.0)), "rust_is_primary": F.coalesce("rust_is_primary", F.lit(False))})


def with_rounded_share(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rust_percentage", numbers.round_half_up(F.col("rust_percentage")))
