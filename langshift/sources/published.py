"""The published listing on disk: rows in order, in parts, with an index of ranks.

A publication deals the rows by ranges of the order, sorts each range once, and writes each as a part of its own: a
Parquet folder that pages are served from and, if asked for, a folder with one text file of JSON lines. The index
(part, first rank, rows; one entry for each part) is kept in the version file that makes the publication current, so
that a page reads only the parts that hold it: nothing is counted or sorted as a whole again. Reading the
text parts by number gives the listing line by line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import shared
from . import readers, tables

#: Rows of a part, about.
PART_ROWS = 10_000

#: A row's place in its part, in the columns that a publication adds.
PLACE_BITS = 33


def publish(rows: DataFrame, order: list[Column], root: str, *, line: Column | None = None, part_rows: int = PART_ROWS, written: bool = False) -> tables.Version:
    """Write ``rows`` in ``order`` (which must leave no equals) below ``root`` and make them the current publication.
    ``line`` is a row's text (a string column), for the text parts. ``written``: the rows are read from files as they are."""
    spark = rows.sparkSession
    rows = rows if written else shared.cut_lineage(rows)  # counted, sampled for the ranges, and dealt
    parts = max(1, -(-rows.count() // part_rows))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    # Sorted by part as well, which is one number in each task, so that the writer has nothing to sort anew.
    ranged = ranged.sortWithinPartitions("_part", *order)
    placed = ranged.withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1))
    base = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    placed.write.partitionBy("_part").parquet(f"{base}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{base}/rows")
    counts = {r["_part"]: r["count"] for r in stored.groupBy("_part").count().collect()}  # one for each part
    index, first = [], 0
    for part in sorted(counts):
        index.append([part, first, counts[part]])
        first += counts[part]
    if line is not None:
        # A part's rows were written by one task as one file; the sort keeps them in place however they are read.
        text = stored.select("_part", "_place", line.alias("value")).repartition(len(index) or 1, "_part").sortWithinPartitions("_part", "_place")
        text.select("_part", "value").write.partitionBy("_part").text(f"{base}/lines")
    for _ in range(tables.ATTEMPTS):
        now = tables.numbers(spark, root)
        made = tables.Version(now[0] + 1 if now else 0, 0, {part: f"{base}/rows/_part={part}" for part, _, _ in index}, index=index)
        try:
            tables.commit(spark, root, made)
        except tables.VersionTaken:
            continue
        return made
    raise tables.VersionTaken(root)


def page(spark: SparkSession, root: str, schema, number: int, size: int, version: tables.Version | None = None) -> DataFrame:
    """Page ``number`` (from 1) of the current publication (or ``version``) with ranks as ``rank`` (from 0), in order;
    numbers before the first or after the last page give those. ``schema``: that of the published rows."""
    version = version or tables.head(spark, root)
    total = sum(n for _, _, n in version.index) if version is not None else 0
    number = min(max(number, 1), max(1, -(-total // size)))
    start, end = (number - 1) * size, min(number * size, total)
    held = [(part, first) for part, first, n in version.index if first < end and first + n > start] if version is not None else []
    out = spark.createDataFrame([], schema).withColumn("rank", F.lit(0).cast("bigint")) if not held else None
    for part, first in held:  # as many as a page spans
        rows = spark.read.schema(StructType([*schema.fields, StructField("_place", LongType())])).parquet(version.folders[part])
        rows = rows.where(F.col("_place").between(start - first, end - first - 1)).withColumn("rank", F.col("_place") + first).drop("_place")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("rank")


def lines(spark: SparkSession, root: str, version: tables.Version | None = None) -> DataFrame:
    """rank (from 0) and value of the text of the current publication (or ``version``), read by blocks."""
    version = version or tables.head(spark, root)
    if version is None or not version.folders:
        return spark.createDataFrame([], "rank bigint, value string")
    base = next(iter(version.folders.values())).rsplit("/rows/", 1)[0]
    raw = spark.read.option("lineSep", "\n").text(f"{base}/lines")
    raw = raw.select(F.lit("").alias("repo"), F.col("_part").cast("bigint").alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.lit(False).alias("header"))
    blocks = raw.groupBy("part", "file", "start").agg(F.count(F.lit(1)).alias("n")).orderBy("part", "file", "start").collect()
    first, known = 0, []
    for b in blocks:  # one for each part, or for each block of a large one
        known.append((b.part, b.file, b.start, first))
        first += b.n
    ranks = F.broadcast(spark.createDataFrame(known, "part bigint, file string, start bigint, first bigint"))
    return readers.numbered(raw).join(ranks, ["part", "file", "start"]).select((F.col("first") + F.col("place")).alias("rank"), "value")
