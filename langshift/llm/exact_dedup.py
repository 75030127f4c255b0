"""Exact deduplication against a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest. New documents are reduced to
digests once, deduplicated among themselves by aggregation, held against the index by a sort-merge
anti-join that reads the index as it lies (no exchange on its side), and the new digests are appended
once the batch's output is written. Digests carry the name of the batch that brought them: a batch that
runs again, for whatever reason, is held against the others alone and gives the same rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import common


#: Batches in which a whole table goes through an index.
BATCHES = 3


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z in lower case; null counts as empty."""
    return F.unhex(F.sha2(common.ascii_lower(text).cast("binary"), 256))


class DigestIndex:
    """A digest table: digest binary, keep_id, batch string. The number of buckets is fixed when it is made.

    ``location`` is a folder that all machines see; without one, the table lies in the warehouse."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    @classmethod
    def open(cls, spark: SparkSession, table: str, id_type: str = "bigint", *, buckets: int | None = None, location: str | None = None) -> DigestIndex:
        """The table as it is, or an empty one of ``buckets`` buckets (the session's shuffle partitions). A table that a
        ``compact`` has set aside and not replaced is taken back."""
        if not spark.catalog.tableExists(table) and spark.catalog.tableExists(f"{table}_aside"):
            spark.sql(f"ALTER TABLE {table}_aside RENAME TO {table}")
        if not spark.catalog.tableExists(table):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            place = f"LOCATION '{location}'" if location else ""
            spark.sql(f"CREATE TABLE {table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS {place}")
        return cls(spark, table)

    @property
    def buckets(self) -> int:
        described = self.spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
        return int(described["data_type"])

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def others(self, batch: str) -> DataFrame:
        return self.read().where(F.col("batch") != batch).select("digest", "keep_id")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests that no batch has brought yet, one sorted file in each bucket. Appending a batch
        again adds nothing."""
        new = groups.select("digest", "keep_id").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        rows = common.cut_lineage(new).repartition(self.buckets, "digest").withColumn("batch", F.lit(batch))
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def compact(self, location: str | None = None) -> None:
        """Write the table anew with one sorted file in each bucket, as each batch has added one. Nothing else may write
        meanwhile. The new table is whole before the old one is set aside, and takes its name before that goes."""
        new, aside = f"{self.table}_compact", f"{self.table}_aside"
        self.spark.sql(f"DROP TABLE IF EXISTS {new}")
        n = self.buckets
        # From a plain copy: dealing a bucketed table by its own key is no exchange to Spark, and the buckets aren't read as such.
        writer = common.cut_lineage(self.read()).repartition(n, "digest").write.format("parquet").bucketBy(n, "digest").sortBy("digest")
        (writer.option("path", location) if location else writer).saveAsTable(new)
        self.spark.sql(f"ALTER TABLE {self.table} RENAME TO {aside}")
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.table}")
        self.spark.sql(f"DROP TABLE {aside}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digest_groups(digests: DataFrame, id_col: str) -> DataFrame:
    """One row for each digest, summed up before the shuffle: digest, keep_id (largest id), group_size."""
    return digests.groupBy("digest").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def held_against(groups: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """``groups`` with ``fresh``: whether no other batch brought the digest. If one did, keep_id is its."""
    older = index.others(batch)
    fresh = groups.join(older.select("digest").hint("merge"), "digest", "left_anti").withColumn("fresh", F.lit(True))
    known = groups.drop("keep_id").join(older.hint("merge"), "digest").withColumn("fresh", F.lit(False))
    return fresh.unionByName(known)


def digests_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.cut_lineage(docs.select(F.col(id_col), text_digest(F.col(text_col)).alias("digest")))


def marked(digests: DataFrame, index: DigestIndex | None, batch: str | None, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(``id_col``, digest, keep_id, group_size, fresh) of each document, and the groups behind it."""
    if index is not None and not batch:
        raise ValueError("a batch that is held against an index needs a name of its own")
    groups = common.cut_lineage(digest_groups(digests, id_col))
    held = groups.withColumn("fresh", F.lit(True)) if index is None else held_against(groups, index, batch)
    return common.attach_group(digests, held, "digest", "group_size", digests.count()), groups


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row for each document: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. Of equal texts of this batch the row
    with the largest id stays; group_size counts the rows of this batch. With ``index`` (and then a name of the
    ``batch``), a text that another batch brought is dropped whole, and its keep_id is that of the index. The index is only read:
    write the result, then ``append`` (``add_batch`` does both).

    Null text equals empty text. A null id is smaller than any other; if a group has no other, its
    rows are all kept with keep_id null. Rows that repeat the id that stays are the same document and
    all marked kept. A text of any length is one digest. No rows: none out. Other columns are not read.
    """
    return shown(marked(digests_of(docs, id_col, text_col), index, batch, id_col)[0], id_col)


def shown(rows: DataFrame, id_col: str) -> DataFrame:
    kept = F.col(id_col).eqNullSafe(F.col("keep_id")) & F.col("fresh")
    return rows.select(id_col, "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def add_digests(digests: DataFrame, index: DigestIndex, batch: str, path: str, id_col: str) -> DataFrame:
    rows, groups = marked(digests, index, batch, id_col)
    out = shown(rows, id_col)
    out.write.mode("overwrite").parquet(path)
    index.append(groups, batch)
    return digests.sparkSession.read.schema(out.schema).parquet(path)


def add_batch(docs: DataFrame, index: DigestIndex, batch: str, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write what ``deduplicate`` says of this batch below ``path``, then append its digests to the index;
    returns the rows as written. If it ends anywhere in between, running it again gives the same."""
    return add_digests(digests_of(docs, id_col, text_col), index, batch, path, id_col)


def by_descending_id(digests: DataFrame, id_col: str, batches: int) -> list[DataFrame]:
    """The rows in about equal ranges of their ids, the largest ids first and null ids last."""
    if not isinstance(digests.schema[id_col].dataType, NumericType) or batches < 2:
        return [digests]
    cuts = sorted(set(digests.approxQuantile(id_col, [k / batches for k in range(1, batches)], 0.01)), reverse=True)
    bounds = [F.coalesce(F.col(id_col) > F.lit(c), F.lit(False)) for c in cuts]
    return [digests.where(above & ~before) for before, above in zip([F.lit(False), *bounds], [*bounds, F.lit(True)], strict=True)]


def deduplicate_whole(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """``deduplicate`` of all documents, in batches through an index of their own that goes away afterwards.

    The batches are ranges of ids, from the largest down: whatever batch brings a text first brings its largest id, so
    that the rows that later batches drop have the keep_id that holds for all. Ids that are no numbers are one
    batch. group_size is counted over all batches at the end."""
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    digests = digests_of(docs, id_col, text_col)
    index = DigestIndex.open(spark, f"digests_{uuid.uuid4().hex}", docs.schema[id_col].dataType.simpleString(), location=f"{folder}/index")
    try:
        parts = [add_digests(part, index, str(n), f"{folder}/rows/{n}", id_col) for n, part in enumerate(by_descending_id(digests, id_col, batches))]
    finally:
        index.drop()
    rows = reduce(DataFrame.unionByName, parts)
    sizes = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    return common.attach_group(rows.drop("group_size"), sizes, "text_sha256", "group_size", digests.count()).select(*parts[0].columns)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The documents that ``deduplicate`` keeps, with all their columns. Rows that repeat both id and
    text are the same document and all stay. What is dropped is looked up, so that the texts stay where
    they are as long as few are dropped (see ``common.without``)."""
    found = deduplicate(docs, id_col=id_col, text_col=text_col, index=index, batch=batch)
    gone = found.where(~F.col("kept")).select(F.struct(F.col(id_col).alias("id"), F.unhex("text_sha256").alias("digest")).alias("gone")).distinct()
    own = F.struct(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    return common.without(docs, own, gone)
