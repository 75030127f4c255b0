"""What each filter of a chain removes, and how much of that hangs on the order: direct relational replay.

Every document is reduced to one row of flags (which filters it fails, on its own). These rows are crossed
with all orders of the filters, a broadcast table of n! rows that doesn't grow with the data; each pair
knows the step of its first failure. The steps are exploded in place and summed up by part, order and step
within each task, so that what is shuffled is at most parts x orders x steps rows for each task, and one
part that holds most of the documents is still as many keys as there are orders and steps.

One flag looks at other documents: whether a smaller id has the same text. Texts meet as digests; the
smallest id of each text that repeats goes back to its documents, hot texts by broadcast (``attach_group``).
"""

from __future__ import annotations

from hashlib import sha256
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Fixed values of the five filters.
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"
CAPITALS = common.UPPER.encode()

FILTERS = "ABCDE"

#: Documents that one task crosses with the orders, about: narrow rows, so that Spark alone would put far more together.
DOCUMENTS = 16_384

#: More filters than this have too many orders to cross documents with.
MOST_FILTERS = 6


def own_flags(text: bytes, code_points: int) -> int:
    """Bits of the filters that need no other document, of those that ``text`` (UTF-8) fails."""
    words = text.split()  # at the same six characters as the definition of a word
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words),
        100 * capitals > MOST_CAPITAL_PERCENT * code_points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def text_flags(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, fails (of A to D) and digest (SHA-256) of each document: one scan, and texts leave no more."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, part_col)]

    def run(batches):
        for batch in batches:
            fails, digests = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                data = text.encode()
                fails.append(own_flags(data, len(text)))
                digests.append(sha256(data).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "fails", "digest"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(part_col).alias("part"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {kinds[0]}, part {kinds[1]}, fails int, digest binary")
    return found.withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))


def document_flags(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, fails (bit k: fails the k-th of ``FILTERS``), good and toxic for each document.

    Null text counts as empty, a null part as the empty string. E fails where a smaller id has the same text;
    null ids neither fail it nor make others fail. Rows that repeat id and text don't fail by each other. A label
    counts for every row of its id; where labels repeat an id, good and toxic hold if any of its rows says so. A
    text of any length is one row of flags.
    """
    rows = common.cut_lineage(text_flags(docs, id_col, text_col, part_col))
    repeated = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = common.attach_group(rows, repeated, "digest", "copies", rows.count())
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    rows = rows.select("id", "part", (F.col("fails") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("fails"))
    if labels is None:
        return rows.select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = rows.join(said.hint("merge"), rows.id == said.doc_id, "left")
    return joined.select("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """filter_order, at (step of each filter, in the order of ``filters``) and steps (step, filter) of every order."""
    rows = []
    for order in permutations(range(len(filters))):
        at = [order.index(k) + 1 for k in range(len(filters))]
        rows.append(("".join(filters[k] for k in order), at, [(s + 1, k) for s, k in enumerate(order)]))
    return spark.createDataFrame(rows, "filter_order string, at array<int>, steps array<struct<step: int, filter: int>>")


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley (see ``audit``), from the rows of ``document_flags`` for any ``filters``
    (one letter each, six at most)."""
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters have too many orders")
    n = len(filters)
    flags = common.cut_lineage(flags)
    flags = flags.repartition(max(1, -(-flags.count() // DOCUMENTS)))
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession, filters)))
    failed_at = [F.when(F.col("fails").bitwiseAND(1 << k) != 0, F.col("at")[k]) for k in range(n)]
    first = F.least(*failed_at, F.lit(n + 1)) if n else F.lit(1)
    stepped = crossed.select("part", "fails", "good", "toxic", "filter_order", first.alias("first"), F.explode("steps").alias("s"))
    stepped = stepped.select("part", "filter_order", F.col("s.step").alias("step"), F.col("s.filter").alias("filter"), "fails", "good", "toxic", "first")
    step, here = F.col("step"), F.col("first") == F.col("step")
    bit = F.expr("shiftleft(1, filter)")
    sums = stepped.groupBy("part", "filter_order", "step", "filter").agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if((F.col("first") < step) & (F.col("fails").bitwiseAND(bit) != 0)).alias("redundant"),
        F.count_if(F.col("fails") == bit).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    # One row for each order: a window over n! rows for each part and filter.
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return sums.withColumn("shapley", shapley).drop("filter")


def audit(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five filters in all 120 orders, for each part (value of ``part_col``; null: empty string).

    Filters fail a text with fewer than 50 words (A), with fewer than 65 % distinct words (B), with more than 5 %
    capitals (C), with a symbol (D), or equal to a smaller id's (E). Counts of the part's documents: kept (after
    the step), removed (by it), redundant (fail its filter, but were removed earlier), unique_fails (fail its
    filter alone), good_lost and toxic_lost (removed by it and labelled so), shapley (removed by its filter, summed
    over all orders). Every part has all 600 rows, zeros included. Nulls, ties and repeated rows: see
    ``document_flags``. No rows: none out. Other columns are not read.
    """
    return replay(document_flags(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
