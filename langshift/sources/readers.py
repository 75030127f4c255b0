"""Readers of landed listings, logs, lists and stored tables: files to DataFrames with fixed schemas.

Each reader is a thin ``spark.read`` with an explicit schema (so nothing is inferred by a second scan)
and a function on DataFrames that does the work, which jobs can apply to rows from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import shared
from ..functions import text

#: Blocks of logs (about 128 MB each) whose counts are sent to every task at most.
MOST_BLOCKS = 500_000

REPO_LISTING = "full_name string, html_url string, description string, readme string, language string, stargazers_count bigint, forks_count bigint, open_issues_count bigint"
ISSUE_LISTING = "title string, html_url string, repository_url string, pull_request string, state string"
LANGUAGES = "full_name string, languages map<string, bigint>"
SIGNALS = "array<struct<kind: string, detail: string, url: string>>"
PULL_REQUESTS = "array<struct<title: string, url: string>>"

#: Columns of a stored project with their types; what an older table lacks gets the default.
PROJECT = {
    "name": "string", "repo_url": "string", "description": "string", "stars": "bigint", "forks": "bigint", "open_issues": "bigint", "open_prs": "bigint",
    "original_language": "string", "rust_percentage": "double", "confidence": "double", "signals": SIGNALS, "rewrite_prs": PULL_REQUESTS,
    "rewrite_pr": "struct<title: string, url: string>", "unsafe_percentage": "double", "project_kind": "string", "named_origin": "string",
    "lines_added": "bigint", "lines_removed": "bigint", "rewrite_velocity": "double", "ai_assist_score": "double", "ai_agents": "array<string>",
    "rewrite_duration_days": "bigint", "commit_count": "bigint", "history_from_language": "string", "history_rust_before": "double",
    "history_rust_after": "double", "transition_magnitude": "double", "total_commits_analyzed": "bigint", "history_status": "string",
    "history_error": "string", "history_attempted_at": "string", "history_attempts": "bigint", "source_url": "string", "first_detected": "string", "last_seen": "string",
}
DEFAULTS = {"stars": 0, "forks": 0, "open_issues": 0, "open_prs": 0, "rust_percentage": 0.0, "confidence": 0.0, "project_kind": "replacement", "source_url": ""}


def repos_of(listing: DataFrame) -> DataFrame:
    """Repositories of listing rows; missing counts are 0."""
    counts = {"stars": "stargazers_count", "forks": "forks_count", "open_issues": "open_issues_count"}
    return listing.select("full_name", "html_url", "description", "readme", "language", *(F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()))


def read_repo_listing(spark: SparkSession, path: str) -> DataFrame:
    return repos_of(spark.read.schema(REPO_LISTING).json(path))


def issues_of(listing: DataFrame) -> DataFrame:
    """Issues and pull requests of listing rows: full_name, kind, title, url, state. Rows whose
    repository URL names no owner and name are dropped."""
    name = F.regexp_extract("repository_url", "(?s)^.*/repos/(.*)$", 1)
    name = F.when(F.contains(F.col("repository_url"), F.lit("/repos/")), name).otherwise(F.col("repository_url"))
    kind = F.when(F.col("pull_request").isNotNull(), "pull-request").otherwise("issue")
    rows = listing.select(name.alias("full_name"), kind.alias("kind"), "title", F.col("html_url").alias("url"), "state")
    return rows.where(F.contains("full_name", F.lit("/")))


def read_issue_listing(spark: SparkSession, path: str) -> DataFrame:
    return issues_of(spark.read.schema(ISSUE_LISTING).json(path))


def languages_of(listing: DataFrame) -> DataFrame:
    """full_name, lang, bytes from a map, or from its JSON text."""
    column = F.col("languages")
    if dict(listing.dtypes)["languages"] == "string":
        column = F.from_json(column, "map<string, bigint>")
    return listing.select("full_name", F.explode(column).alias("lang", "bytes"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    return languages_of(spark.read.schema(LANGUAGES).json(path))


def _whole(token: Column, sign: str) -> Column:
    return F.when(token.rlike(rf"^{sign}[0-9]+$"), token.try_cast("bigint"))


BLOCK = ["repo", "part", "file", "start"]


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with place (from 0) and inside (headers so far), both counted within each block.

    The lines of a block follow each other in one task, as a file or a cell gives them, so this is a pass over the
    tasks as they are: nothing is shuffled or sorted, and a batch is held at a time."""
    fields = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in lines.columns)
    names = [c for c in BLOCK if c in lines.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, inside = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            keys = [batch.column(c) for c in names]
            for key in keys:
                same = pc.equal(key.slice(1), key.slice(0, batch.num_rows - 1))
                new[1:] |= ~np.asarray(pc.fill_null(same, False))
            first = tuple(k[0].as_py() for k in keys)
            if first != last:
                place = inside = 0
            starts = np.flatnonzero(new)
            at = np.arange(batch.num_rows)
            since = np.maximum.accumulate(np.where(new, at, -place))
            counts = np.cumsum(np.asarray(batch.column("header")).astype(np.int64))
            before = np.concatenate([[-inside], counts[starts - 1]])[np.cumsum(new)]
            places, headers = at - since, counts - before
            last, place, inside = tuple(k[-1].as_py() for k in keys), int(places[-1]) + 1, int(headers[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(headers)], [*batch.schema.names, "place", "inside"])

    return lines.mapInArrow(run, f"{fields}, place long, inside long")


def lines_of(lines: DataFrame) -> DataFrame:
    """The lines of each log with the number of the commit that they belong to (from 0; lines before the
    first header are dropped): repo, line_no, commit_seq, parts (of a header, else null), line.

    ``lines``: repo, part, file, start (which tell blocks apart and give their order) and line, block by block in the
    order of the log. A line is a header if its second NUL-separated part is a time. Headers are counted for each
    block, and the counts (one row for each) carried over a repository's blocks; a block never has to be held, so a single long log
    is spread over many tasks.
    """
    parts = F.split("line", "\0", 4)
    header = F.coalesce((F.size(parts) >= 3) & _whole(F.element_at(parts, 2), "[+-]?").isNotNull(), F.lit(False))
    lines = lines.where("line <> ''").withColumn("header", header)
    earlier = Window.partitionBy("repo").orderBy("part", "file", "start")
    blocks = lines.groupBy(*BLOCK).agg(F.count_if("header").alias("n"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = shared.cut_lineage(blocks.withColumn("block", F.row_number().over(earlier).cast("bigint")).drop("n"))
    met = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in BLOCK]
    place = F.col("place")
    if blocks.count() <= MOST_BLOCKS:
        # Sent to the lines, so that only short keys go along with them.
        joined = lines.alias("l").join(F.broadcast(blocks.alias("b")), met).select("l.repo", F.col("b.block").alias("part"), "b.before", "l.line", "l.header")
        found, block = numbered(joined), F.col("part")
    else:
        found = numbered(lines).alias("l").join(blocks.alias("b"), met).select("l.*", "b.before", "b.block")
        block = F.col("block")
    found = found.withColumn("commit_seq", F.col("before") + F.col("inside") - 1).where("commit_seq >= 0")
    return found.select("repo", (F.shiftleft(block, 40) + place).alias("line_no"), "commit_seq", F.when(F.col("header"), parts).alias("parts"), "line")


def log_lines(logs: DataFrame) -> DataFrame:
    """``lines_of`` logs that are cells: repo, log and, where a log comes in parts (cut between lines), part, its number."""
    part = F.col("part").cast("bigint") if "part" in logs.columns else F.lit(0).cast("bigint")
    return lines_of(logs.select("repo", part.alias("part"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("start"), F.explode(F.split("log", "\r?\n")).alias("line")))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``lines_of`` landed log files, read by blocks: ``<repo>.log``, for long logs also ``<repo>.log.<part>``, or
    files in folders ``repo=<repo>`` in the order of their names. A file needn't be cut: each task reads the lines that begin in its block."""
    raw = spark.read.option("lineSep", "\n").text(path)
    own = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "\r$", "").alias("line")]
    if "repo" in raw.columns:
        return lines_of(raw.select(F.col("repo").cast("string").alias("repo"), F.lit(0).cast("bigint").alias("part"), *own))
    name = r"([^/]+?)(?:\.log(?:\.([0-9]+))?)?$"
    file = F.col("_metadata.file_name")
    part = F.coalesce(F.regexp_extract(file, name, 2).try_cast("bigint"), F.lit(0).cast("bigint"))
    return lines_of(raw.select(F.regexp_extract(file, name, 1).alias("repo"), part.alias("part"), *own))


def commits_of(lines: DataFrame) -> DataFrame:
    """repo, commit_seq, ts, subject, coauthors from ``log_lines``."""
    heads = lines.where("parts is not null")
    trailers = F.split(F.coalesce(F.try_element_at("parts", F.lit(4)), F.lit("")), "\u0001")
    people = F.filter(F.transform(trailers, text.trim_space), lambda t: t != "")
    return heads.select("repo", "commit_seq", F.element_at("parts", 2).cast("bigint").alias("ts"), F.element_at("parts", 3).alias("subject"), people.alias("coauthors"))


def changes_of(lines: DataFrame) -> DataFrame:
    """repo, commit_seq, file_seq, path, added, removed from ``log_lines``; what is no number counts 0."""
    files = lines.where("parts is null").withColumn("cols", F.split("line", "\t")).where(F.size("cols") >= 3)
    number = [F.coalesce(_whole(F.element_at("cols", i), r"\+?"), F.lit(0)) for i in (1, 2)]
    return files.select("repo", "commit_seq", F.col("line_no").cast("bigint").alias("file_seq"), F.element_at("cols", 3).alias("path"), number[0].alias("added"), number[1].alias("removed"))


def parse_exemplars(lines: DataFrame) -> DataFrame:
    """slug, place from list lines (value, line_no): comments cut, blanks and later repeats dropped."""
    slug = text.trim_space(F.substring_index("value", "#", 1))
    rows = lines.where(slug != "").select(text.normalize_slug(slug).alias("slug"), "line_no")
    return rows.groupBy("slug").agg(F.min("line_no").alias("place"))


def parse_origins(lines: DataFrame) -> DataFrame:
    """slug, label from list lines (value, line_no) ``slug | label``; the last of repeated slugs counts."""
    plain = text.trim_space(F.col("value"))
    parts = F.split(plain, r"\|", 2)
    rows = lines.where(~plain.startswith("#") & (F.size(parts) == 2))
    rows = rows.select(text.normalize_slug(F.element_at(parts, 1)).alias("slug"), text.trim_space(F.element_at(parts, 2)).alias("label"), "line_no")
    return rows.where("slug <> '' and label <> ''").groupBy("slug").agg(F.max_by("label", "line_no").alias("label"))


def list_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line_no of a list file: one small file, read whole."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def read_exemplars(spark: SparkSession, path: str) -> DataFrame:
    return parse_exemplars(list_lines(spark, path))


def read_origins(spark: SparkSession, path: str) -> DataFrame:
    return parse_origins(list_lines(spark, path))


def projects_of(stored: DataFrame) -> DataFrame:
    """Project rows of a stored table of any age: missing columns get defaults, JSON text is parsed (bad
    JSON is an empty list), an older single pull request fills an empty list."""

    def parsed(name: str, kind: str) -> Column:
        if name not in stored.columns:
            return F.array().cast(kind)
        column = F.col(name)
        if dict(stored.dtypes)[name] == "string":
            column = F.from_json(column, kind)
        return F.coalesce(column, F.array().cast(kind))

    prs = parsed("rewrite_prs", PULL_REQUESTS)
    if "rewrite_pr_title" in stored.columns and "rewrite_pr_url" in stored.columns:
        single = F.array(F.struct(F.col("rewrite_pr_title").alias("title"), F.col("rewrite_pr_url").alias("url")))
        prs = F.when((F.size(prs) == 0) & F.col("rewrite_pr_title").isNotNull() & F.col("rewrite_pr_url").isNotNull(), single).otherwise(prs)

    def column(name: str, kind: str) -> Column:
        if name == "rewrite_prs":
            return prs
        if name == "rewrite_pr":
            return F.try_element_at(prs, F.lit(1))
        if kind.startswith("array"):
            return parsed(name, kind)
        value = F.col(name).cast(kind) if name in stored.columns else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(DEFAULTS[name])) if name in DEFAULTS else value

    return stored.select(*(column(n, k).alias(n) for n, k in PROJECT.items()))


def load_projects(spark: SparkSession, path: str) -> DataFrame:
    """Stored projects, the most confident first."""
    return projects_of(spark.read.parquet(path)).orderBy(F.desc("confidence"), F.desc("stars"), "repo_url")
