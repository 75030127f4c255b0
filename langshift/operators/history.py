"""What a repository's commits say: language mix over time, transitions, and the work in between.

Commits and file changes stay in long form, one row each. The running line counts are a scan over ranges of
(repo, language, commit), everything after the sampling is small: at most about twice the sample points for
each repository and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules, shared
from ..functions import numbers, paths, text

ORDER = ["commit_seq", "file_seq"]

#: Repositories whose sample steps are sent to every task at most.
SENT_REPOS = 1_000_000

TWO_DAYS = 48 * 3600


def path_language_join(changes: DataFrame, extensions: DataFrame) -> DataFrame:
    """File changes with their language, by an extension table (ext, lang): a table of fixed small size,
    broadcast. Names without extension and ignored paths have none and are dropped."""
    file = F.substring_index("path", "/", -1)
    keyed = changes.where(~paths.is_ignored_path(F.col("path"))).withColumn("ext", F.substring_index(file, ".", -1))
    return keyed.where(F.col("ext") != file).join(F.broadcast(extensions), "ext").drop("ext")


def with_language(changes: DataFrame) -> DataFrame:
    """File changes that count for a language, with it as ``lang``."""
    return (changes if "lang" in changes.columns else named(changes)).where("lang is not null")


def named(changes: DataFrame) -> DataFrame:
    """All file changes with their language, or null, as ``lang``."""
    return changes.withColumn("lang", paths.language_from_path(F.col("path")))


def kept(changes: DataFrame) -> DataFrame:
    """All file changes with their ``lang`` in the place of the path, as written to the shared folder: several steps read
    them, and what they come from (joins, logs) and the search in paths are done once."""
    return shared.cut_lineage(named(changes).select("repo", *ORDER, "lang", "added", "removed"))


def segment_scan(delta: np.ndarray, new: np.ndarray, total: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of ``delta`` and their lowest values so far, both anew from each place where ``new`` holds; what comes
    before the first goes on from ``total`` and ``low``."""
    sums = np.cumsum(delta)
    starts = np.flatnonzero(new)
    segment = np.cumsum(new)
    before = np.concatenate([[-total], sums[starts] - delta[starts]])
    s = sums - before[segment]
    # Each segment lies below all earlier ones by more than they spread, so that one running minimum serves all.
    span = int(s.max()) - min(int(s.min()), low) + 1
    if span * (int(segment[-1]) + 2) < 1 << 62:
        shift = segment * span
        lowest = np.minimum.accumulate(np.concatenate([[low], s - shift]))[1:] + shift
    else:
        parts = np.split(s, starts)
        parts = [np.minimum.accumulate(p) if len(p) else p for p in parts]
        parts[0] = np.minimum(parts[0], low)
        lowest = np.concatenate(parts)
    return s, lowest


#: Above any sum: no low yet.
NO_LOW = 1 << 60


#: Bits of a commit's number, where it shares a long with the number of its (repo, lang).
COMMIT_BITS = 40


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the number of their (repo, lang) as ``g`` in the place of both, and the table of these (g, repo, lang);
    with ``at``, the commit after that number in one long, unless the numbers are too large for one."""
    found = shared.cut_lineage(rows.groupBy("repo", "lang").agg(F.min("commit_seq").alias("lowest"), F.max("commit_seq").alias("highest")))
    groups = shared.cut_lineage(shared.ranked(found.withColumn("all", F.lit(0)), "all", "repo", "lang", name="g"))
    seen = groups.agg(F.count(F.lit(1)).alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest")).first()
    names = groups.select("g", F.col("repo").alias("_repo"), F.col("lang").alias("_lang"))
    names = F.broadcast(names) if seen["n"] <= SENT_REPOS else names.hint("merge")
    coded = rows.join(names, F.col("repo").eqNullSafe(F.col("_repo")) & F.col("lang").eqNullSafe(F.col("_lang")))
    at = F.shiftleft(F.col("g").cast("bigint"), COMMIT_BITS) + F.col("commit_seq")
    fits = seen["n"] < 1 << (62 - COMMIT_BITS) and (seen["lowest"] or 0) >= 0 and (seen["highest"] or 0) < 1 << COMMIT_BITS
    coded = coded.withColumn("at", at) if fits else coded
    return coded.drop("repo", "lang", "_repo", "_lang"), groups.select("g", "repo", "lang")


def running_net_lines(changes: DataFrame) -> DataFrame:
    """Net lines of each (repo, lang) after every file, never below zero: repo, lang, commit_seq,
    file_seq, net.

    A sum that is clamped at zero after each step is the plain running sum less its lowest value so far,
    where that is negative. Both are prefixes of an associative operation, so that a segmented scan does: the changes are
    dealt and sorted once, by ranges of (repo, lang, commit, file), whatever share one repository has; each task
    takes sums and lows along its own rows; and for each task a pair for its first and its last
    (repo, lang) says what goes on in the next. Those pairs, two rows a task, are added up on the driver.
    Repositories and languages go by numbers, which sort faster than their names. ``changes`` are read twice, so they
    should be read from files.
    """
    return placed_net_lines(changes).drop("place")


def placed_net_lines(changes: DataFrame) -> DataFrame:
    """``running_net_lines`` with place: a number that grows along the changes of each (repo, lang)."""
    spark = changes.sparkSession
    kinds = {c: changes.schema[c].dataType.simpleString() for c in ORDER}
    rows = changes.select("repo", "lang", *ORDER, (F.col("added") - F.col("removed")).cast("bigint").alias("delta"))
    rows, groups = grouped(rows)
    order = ["at", "file_seq"] if "at" in rows.columns else ["g", *ORDER]
    names = ["g", *ORDER, "s", "low", "place", "task", "head", "lasts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        key, total, low, head, first, rows = None, 0, NO_LOW, True, None, 0
        kept: list[pa.DataType] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kept = [batch.column(c).type for c in range(3)]
            group = batch.column(0).to_numpy()
            new = np.zeros(n, dtype=bool)
            new[1:] = group[1:] != group[:-1]
            own = int(group[0])
            if key is not None and own != key:
                if head:
                    first, head = (key, total, low), False
                total, low = 0, NO_LOW
            s, lowest = segment_scan(batch.column(3).to_numpy(), new, total, low)
            heads = np.zeros(n, dtype=bool)
            if head:
                end = int(np.argmax(new)) if new.any() else n
                heads[:end] = True
                if end < n:
                    first, head = (own, int(s[end - 1]), int(lowest[end - 1])), False
            key, total, low = int(group[-1]), int(s[-1]), int(lowest[-1])
            place = (task << shared.PLACE_BITS) + rows + np.arange(n, dtype=np.int64)
            rows += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s), pa.array(lowest), pa.array(place), pa.array(np.full(n, task, np.int32)), pa.array(heads), pa.nulls(n, pa.bool_())], names)
        if key is None:
            return
        ends = [(key, total, low)] if first is None else [first, (key, total, low)]
        columns = [pa.array([e[0] for e in ends], kept[0]), *(pa.nulls(len(ends), k) for k in kept[1:])]
        columns += [pa.array([e[k] for e in ends], pa.int64()) for k in (1, 2)] + [pa.nulls(len(ends), pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(ends), pa.int32()), pa.array([True, False][: len(ends)]), pa.array([False, True][-len(ends) :])], names)

    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("g", *ORDER, "delta")
    fields = ", ".join(f"{c} {k}" for c, k in kinds.items())
    scanned = shared.cut_lineage(rows.mapInArrow(run, f"g int, {fields}, s bigint, low bigint, place bigint, task int, head boolean, lasts boolean"))
    ends: dict[int, dict[bool, tuple]] = {}
    for r in scanned.where("lasts is not null").collect():  # two for each task at most
        ends.setdefault(r.task, {})[r.lasts] = (r.g, r.s, r.low)
    carried, before = [], (None, 0, NO_LOW)
    for task in sorted(ends):
        last = ends[task][True]
        first = ends[task].get(False, last)
        if first[0] == before[0]:
            carried.append((task, before[1], before[2]))
        if False in ends[task] or last[0] != before[0]:
            before = last
        else:
            before = (last[0], before[1] + last[1], min(before[2], before[1] + last[2]))
    carry = F.broadcast(spark.createDataFrame(carried, "task int, base bigint, base_low bigint").withColumn("head", F.lit(True)))
    base, base_low = F.coalesce("base", F.lit(0)), F.coalesce("base_low", F.lit(0))
    net = base + F.col("s") - F.least(F.lit(0), base_low, base + F.col("low"))
    groups = F.broadcast(groups) if groups.count() <= SENT_REPOS else groups.hint("merge")
    out = scanned.where("lasts is null").join(carry, ["task", "head"], "left").join(groups, "g")
    return out.select("repo", "lang", *ORDER, net.alias("net"), "place")


def composition_samples(commits: DataFrame, points: int | Column = rules.SAMPLE_POINTS) -> DataFrame:
    """repo, sample_no, commit_seq: every n-th commit and the last of each repository.

    ``points`` (a number, or a column of ``commits`` by repository) bounds how many, about."""
    points = F.lit(points) if isinstance(points, int) else points
    n = commits.groupBy("repo").agg((F.max("commit_seq") + 1).alias("n"), F.max(points).alias("points"))
    cap = F.greatest(F.col("points"), F.lit(rules.MIN_POINTS))
    n = n.withColumn("step", F.greatest(F.floor(F.col("n") / cap), F.lit(1)))
    last = F.array(F.col("n") - 1)
    chosen = F.array_union(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("step")), last)
    return n.select("repo", F.posexplode(chosen).alias("sample_no", "commit_seq"))


def composition_asof(net: DataFrame, samples: DataFrame, commits: DataFrame) -> DataFrame:
    """repo, sample_no, commit_seq, lang, net: each language's last value at or before each sample.

    Each change goes to the first sample at or after it (arithmetic on the step, no range join). The last value of each
    bucket is taken where the change lies: the steps are sent to the changes (one row for each repository, if they are few
    enough), and the changes come out of ``running_net_lines`` in order, so that a task is left with a row for each
    bucket, and only those are shuffled to merge the buckets that tasks share. Then values are carried forward over
    the samples of the repository. The grid of samples and languages is bounded by the sample points.
    """
    shape = samples.groupBy("repo").agg(F.max("sample_no").alias("last_no"), F.max(F.when(F.col("sample_no") == 1, F.col("commit_seq"))).alias("second"))
    shape = shared.cut_lineage(shape)
    sent = F.broadcast(shape) if shape.count() <= SENT_REPOS else shape.hint("merge")
    step = F.coalesce("second", F.lit(1))
    placed = net.join(sent, "repo").withColumn("sample_no", F.least(F.ceil(F.col("commit_seq") / step), F.col("last_no")).cast("int"))
    # A number keeps the running maximum in place, where a struct would need another sort.
    place = F.col("place") if "place" in net.columns else F.col("commit_seq").cast("decimal(18,0)") * F.lit(Decimal(10) ** 19) + F.col("file_seq").cast("decimal(19,0)")
    latest = placed.groupBy("repo", "lang", "sample_no").agg(F.max_by("net", place).alias("net"))
    latest = shared.cut_lineage(latest)  # small, and read twice
    grid = samples.join(latest.select("repo", "lang").distinct(), "repo")
    so_far = Window.partitionBy("repo", "lang").orderBy("sample_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(latest, ["repo", "lang", "sample_no"], "left").withColumn("net", F.coalesce(F.last("net", True).over(so_far), F.lit(0)))
    return filled.select("repo", "sample_no", "commit_seq", "lang", "net")


def with_shares(composition: DataFrame) -> DataFrame:
    """The composition with each language's share (%) of the sample's lines; 0 for an empty sample."""
    total = F.sum("net").over(Window.partitionBy("repo", "sample_no"))
    return composition.withColumn("share", F.when(total > 0, F.col("net") / total * 100.0).otherwise(0.0))


def rust_share_series(composition: DataFrame, samples: DataFrame) -> DataFrame:
    """repo, sample_no, commit_seq, net_total, share: the target's share at each sample, 0 without lines."""
    target = F.sum(F.when(F.col("lang") == rules.TARGET, F.col("net")).otherwise(0))
    sums = composition.groupBy("repo", "sample_no").agg(F.sum("net").alias("net_total"), target.alias("_t"))
    joined = samples.join(sums, ["repo", "sample_no"], "left").withColumn("net_total", F.coalesce("net_total", F.lit(0)))
    share = F.when(F.col("net_total") > 0, F.col("_t") / F.col("net_total") * 100.0).otherwise(0.0)
    return joined.select("repo", "sample_no", "commit_seq", "net_total", share.alias("share"))


def segment_shares(composition: DataFrame, samples: DataFrame) -> DataFrame:
    """repo, lang, before, after: mean share over the first and the last fifth of the samples (at least
    one). Empty samples add nothing but count."""
    size = samples.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    size = size.withColumn("e", F.greatest(F.ceil(F.col("n") * F.lit(rules.SEGMENT)), F.lit(1)))
    rows = with_shares(composition).join(size, "repo")
    early = F.sum(F.when(F.col("sample_no") < F.col("e"), F.col("share")).otherwise(0.0)) / F.max("e")
    late = F.sum(F.when(F.col("sample_no") >= F.col("n") - F.col("e"), F.col("share")).otherwise(0.0)) / F.max("e")
    return rows.groupBy("repo", "lang").agg(early.alias("before"), late.alias("after"))


def language_transition(segments: DataFrame, series: DataFrame, commits: DataFrame) -> DataFrame:
    """One row for each repository: from_language, rust_before, rust_after, magnitude, total_commits, strong.

    Equal shares of dominant languages: the smaller name. Shares are rounded to one decimal at the end.
    """
    target = F.col("lang") == rules.TARGET
    dominant = ~(F.lower("lang") == rules.TARGET.lower()) & (F.col("before") >= rules.MIN_DOMINANT)
    by_repo = segments.groupBy("repo").agg(
        F.max(F.when(target, F.col("before"))).alias("b"),
        F.max(F.when(target, F.col("after"))).alias("a"),
        F.min(F.when(dominant, F.struct((-F.col("before")).alias("s"), "lang"))).alias("d"),
    )
    last = series.groupBy("repo").agg(F.max_by("net_total", "sample_no").alias("late_net"))
    total = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("total_commits"))
    rows = total.join(by_repo, "repo", "left").join(last, "repo", "left")
    rows = rows.withColumns({"b": F.coalesce("b", F.lit(0.0)), "a": F.coalesce("a", F.lit(0.0)), "late_net": F.coalesce("late_net", F.lit(0))})
    rising = F.col("a") > F.col("b") + rules.MIN_RISE
    rows = rows.withColumn("m", F.when(rising, F.col("a") - F.col("b")).otherwise(0.0))
    early = F.col("b") <= rules.MAX_BEFORE
    origin = F.when(rising & (F.col("m") >= 10.0) & early & paths.is_application_language(F.col("d.lang")), F.col("d.lang"))
    strong = rising & (F.col("m") >= rules.MIN_MAGNITUDE) & early & (F.col("a") >= rules.MIN_AFTER) & origin.isNotNull() & (F.col("late_net") >= rules.MIN_NET)
    return rows.select(
        "repo",
        origin.alias("from_language"),
        numbers.round_half_up(F.col("b"), 1).alias("rust_before"),
        numbers.round_half_up(F.col("a"), 1).alias("rust_after"),
        F.when(rising, numbers.round_half_up(F.col("m"), 1)).alias("magnitude"),
        "total_commits",
        strong.alias("strong"),
    )


def steepest_rise(series: DataFrame) -> DataFrame:
    """repo, slope, rise_start, rise_end: the largest rise from one sample to the next, the first of
    equals; repositories without a rise are absent."""
    order = Window.partitionBy("repo").orderBy("sample_no")
    rows = series.withColumns({"slope": F.col("share") - F.lag("share").over(order), "rise_start": F.lag("commit_seq").over(order)})
    rows = rows.where("slope > 0")
    best = F.min(F.struct((-F.col("slope")).alias("s"), "sample_no", "rise_start", F.col("commit_seq").alias("rise_end"))).alias("x")
    return rows.groupBy("repo").agg(best).select("repo", (-F.col("x.s")).alias("slope"), "x.rise_start", "x.rise_end")


def transition_window(series: DataFrame, rise: DataFrame) -> DataFrame:
    """repo, start_seq, end_seq for repositories with a slope of at least ``MIN_RISE``: from the earliest
    sample below 25 % up to the rise to the last one above 50 % from it on."""
    rows = series.join(rise.where(F.col("slope") >= rules.MIN_RISE), "repo")
    start = F.min(F.when((F.col("commit_seq") <= F.col("rise_start")) & (F.col("share") < 25.0), F.col("commit_seq")))
    end = F.max(F.when((F.col("commit_seq") >= F.col("rise_end")) & (F.col("share") > 50.0), F.col("commit_seq")))
    out = rows.groupBy("repo").agg(start.alias("s"), end.alias("e"), F.max("rise_start").alias("rs"), F.max("rise_end").alias("re"))
    return out.select("repo", F.least(F.coalesce("s", "rs"), "rs").alias("start_seq"), F.greatest(F.coalesce("e", "re"), "re").alias("end_seq"))


def transition_churn(changes: DataFrame) -> DataFrame:
    """repo, commit_seq, churn: lines added in the target plus lines removed elsewhere, where positive."""
    churn = F.sum(F.when(F.col("lang") == rules.TARGET, F.col("added")).otherwise(F.col("removed")))
    return with_language(changes).groupBy("repo", "commit_seq").agg(churn.alias("churn")).where("churn > 0")


def window_commits(commits: DataFrame, window: DataFrame, samples: DataFrame, churn: DataFrame) -> DataFrame:
    """The commits of each repository's transition: those of its window or, without a clear slope, those
    with churn. Repositories with fewer than two samples have none."""
    sampled = samples.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("repo")
    rows = commits.join(sampled, "repo").join(window, "repo", "left")
    inside = rows.where(F.col("commit_seq").between(F.col("start_seq"), F.col("end_seq")))
    unclear = rows.where("start_seq is null").join(churn.select("repo", "commit_seq"), ["repo", "commit_seq"], "left_semi")
    return inside.unionByName(unclear).drop("start_seq", "end_seq")


def commit_lines(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits with the lines that all their files add and remove."""
    lines = changes.groupBy("repo", "commit_seq").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    joined = commits.join(lines, ["repo", "commit_seq"], "left")
    return joined.withColumns({"added": F.coalesce("added", F.lit(0)), "removed": F.coalesce("removed", F.lit(0))})


def window_totals(window: DataFrame) -> DataFrame:
    """repo, lines_added, lines_removed, commit_count, velocity (lines a day), days over commits with lines."""
    sums = window.groupBy("repo").agg(
        F.sum("added").alias("lines_added"),
        F.sum("removed").alias("lines_removed"),
        F.count(F.lit(1)).alias("commit_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    days = numbers.duration_days(F.col("first_ts"), F.col("last_ts"))
    velocity = numbers.round_half_up((F.col("lines_added") + F.col("lines_removed")) / days.cast("double"))
    return sums.select("repo", "lines_added", "lines_removed", "commit_count", velocity.alias("velocity"), days.alias("days"))


def ai_agents(commits: DataFrame) -> DataFrame:
    """repo, agents: the distinct agents of all trailers, sorted; repositories without any are absent."""
    named = commits.select("repo", F.explode("coauthors").alias("c")).select("repo", text.match_agent(F.col("c")).alias("agent"))
    return named.where("agent is not null").groupBy("repo").agg(F.array_sort(F.collect_set("agent")).alias("agents"))


def commit_burst(window: DataFrame) -> DataFrame:
    """repo, burst, burst_score: most commits within 48 hours, both ends included.

    Counted in spans of 48 hours, each with the commits of the following one: no count reaches further,
    and a long history is spread over many tasks."""
    span = F.floor(F.col("ts") / F.lit(TWO_DAYS))
    rows = window.select("repo", "ts", span.alias("own"), F.explode(F.array(span, span - 1)).alias("span"))
    ahead = Window.partitionBy("repo", "span").orderBy("ts").rangeBetween(0, TWO_DAYS)
    counted = rows.withColumn("c", F.count(F.lit(1)).over(ahead)).where("own = span")
    most = counted.groupBy("repo").agg(F.max("c").alias("burst"))
    score = F.when(F.col("burst") >= 10, 0.25).when(F.col("burst") >= 5, 0.15).when(F.col("burst") >= 3, 0.08).otherwise(0.0)
    return most.select("repo", "burst", score.alias("burst_score"))


def ai_assist_score(window: DataFrame, burst: DataFrame) -> DataFrame:
    """repo, score: signs of generated code in the transition's commits, from 0 to 1."""
    n = F.count(F.lit(1)).cast("double")
    agent = F.exists("coauthors", lambda c: text.match_agent(c).isNotNull())
    templated = text.has_any(F.lower("subject"), rules.TEMPLATED)
    sums = window.groupBy("repo").agg(
        (F.sum(F.col("added") + F.col("removed")).cast("double") / n).alias("mean"),
        (F.count_if(templated).cast("double") / n).alias("templated"),
        (F.count_if(F.col("added") > 2000).cast("double") / n).alias("big"),
        F.max(F.coalesce(agent, F.lit(False))).alias("agent"),
    )
    size = F.when(F.col("mean") > 500.0, 0.30).when(F.col("mean") > 200.0, 0.15).otherwise(0.0)
    score = size + F.col("templated") * 0.25 + F.col("big") * 0.25 + F.coalesce("burst_score", F.lit(0.0)) + F.when(F.col("agent"), 0.20).otherwise(0.0)
    return sums.join(burst, "repo", "left").select("repo", numbers.round_half_up(F.least(score, F.lit(1.0))).alias("score"))


def analyse(commits: DataFrame, changes: DataFrame, points: int | Column = rules.SAMPLE_POINTS) -> DataFrame:
    """Everything about each repository's history in one row.

    Changes are written to the shared folder without their paths, because three steps read them. So is the composition:
    it takes the one large shuffle (of all file changes), is small itself, and is read by several of the steps that follow."""
    changes = kept(changes)
    samples = shared.cut_lineage(composition_samples(commits, points))
    composition = shared.cut_lineage(composition_asof(placed_net_lines(with_language(changes)), samples, commits))
    series = shared.cut_lineage(rust_share_series(composition, samples))
    transition = language_transition(segment_shares(composition, samples), series, commits)
    window = transition_window(series, steepest_rise(series))
    window = shared.cut_lineage(window)  # one row for a repository with a clear slope
    # Churn is asked for only where the slope is unclear, lines only of the commits that are left.
    churn = transition_churn(changes.join(window, "repo", "left_anti"))
    chosen = shared.cut_lineage(window_commits(commits, window, samples, churn))
    inside = shared.cut_lineage(commit_lines(chosen, changes.join(chosen.select("repo", "commit_seq"), ["repo", "commit_seq"], "left_semi")))
    enriched = window_totals(inside).join(ai_assist_score(inside, commit_burst(inside)), "repo", "left")
    return transition.join(enriched, "repo", "left").join(ai_agents(commits), "repo", "left")
