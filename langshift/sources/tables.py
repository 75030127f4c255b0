"""The project table on disk: immutable bucket folders, and a chain of numbered versions that name them.

A row lies in the bucket that the hash of its ``repo_url`` gives. A version is one small file: its number, a folder for each
bucket that has rows, and the last batch of each stream that is part of it. A writer reads the current version, writes
new folders for the buckets that it changes, and commits the next number with the other buckets named again. The
number's file appears only if none exists, so that all batch jobs and streams have one order: of two
writers that started from one version, the second gets ``VersionTaken`` and merges again from the new one.
Readers see whole versions only, and a job that dies leaves the table as it was.

Renaming must not overwrite in the file system (as in HDFS and, by Hadoop's FileContext, local ones); names of data
folders are never used twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .. import shared

#: Buckets of a new table.
BUCKETS = 64

#: A batch of at most so many rows and bytes (as written) is sent to the stored rows, which then stay where they lie.
SENT_ROWS, SENT_BYTES = 50_000, 32 << 20

#: How often a writer starts again from a newer version before it gives up.
ATTEMPTS = 5


class VersionTaken(RuntimeError):
    """Another writer committed the number first."""


@dataclass
class Version:
    number: int
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    index: list[list[int]] = field(default_factory=list)  # of a publication: part, first rank, rows

    def text(self) -> str:
        return json.dumps({"number": self.number, "buckets": self.buckets, "folders": {str(k): v for k, v in sorted(self.folders.items())}, "streams": self.streams, "index": self.index})

    @classmethod
    def of(cls, text: str) -> Version:
        x = json.loads(text)
        return cls(x["number"], x["buckets"], {int(k): v for k, v in x["folders"].items()}, x["streams"], x["index"])


def _path(spark: SparkSession, path: str):
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def _version_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/versions/{number:020d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions that are kept, the current one first."""
    path, files = _path(spark, f"{root.rstrip('/')}/versions")
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), reverse=True)


def version(spark: SparkSession, root: str, number: int) -> Version:
    path, files = _path(spark, _version_path(root, number))
    stream = files.open(path)
    try:
        return Version.of(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def head(spark: SparkSession, root: str) -> Version | None:
    """The current version, or None before the first."""
    kept = numbers(spark, root)
    return version(spark, root, kept[0]) if kept else None


def commit(spark: SparkSession, root: str, new: Version) -> None:
    """Make ``new`` the current version, or raise ``VersionTaken``. The file is written under another name and renamed
    without overwriting, so that nobody reads half a file and a writer that dies before leaves no trace but that name."""
    path, files = _path(spark, _version_path(root, new.number))
    draft, _ = _path(spark, f"{root.rstrip('/')}/versions/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(new.text().encode()))
    finally:
        out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    try:
        kind = getattr(fs, "Options$Rename")
        fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(path), spark.sparkContext._gateway.new_array(kind, 0))
    except Exception as error:  # py4j wraps whatever the file system raises
        files.delete(draft, False)
        if files.exists(path):
            raise VersionTaken(f"version {new.number} of {root} exists") from error
        raise


def named(spark: SparkSession, folder: str) -> str:
    """The name that ``folder`` was given when it was first asked for."""
    path, files = _path(spark, f"{folder.rstrip('/')}/name")
    if not files.exists(path):
        out = files.create(path, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    stream = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo_url"), F.lit(buckets)).cast("int")


def rows_of(spark: SparkSession, folders: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """The current table below ``root``, or None before the first version."""
    now = head(spark, root)
    if now is None:
        return None
    if not now.folders:
        return spark.createDataFrame([], schema) if schema is not None else None
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*now.folders.values())


def store(rows: DataFrame, root: str, buckets: int) -> dict[int, str]:
    """Write ``rows`` as new bucket folders below ``root``; returns the folder of each bucket that has rows."""
    spark, base = rows.sparkSession, f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    rows.withColumn("_bucket", bucket_of(buckets)).write.partitionBy("_bucket").parquet(base)
    path, files = _path(spark, base)
    names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
    return {int(n.split("=")[1]): f"{base}/{n}" for n in names if n.startswith("_bucket=")}


def small(spark: SparkSession, rows: DataFrame, path: str) -> bool:
    """Whether written rows may be sent to every task."""
    where, files = _path(spark, path)
    return files.getContentSummary(where).getLength() <= SENT_BYTES and rows.count() <= SENT_ROWS


def change(
    rows: DataFrame, root: str, merge: Callable[[DataFrame, DataFrame], DataFrame], merge_sent: Callable[[DataFrame, DataFrame], DataFrame], *,
    deletes: DataFrame | None = None, stream: tuple[str, int] | None = None, buckets: int = BUCKETS,
) -> Version:
    """Merge ``rows`` (one for each repo_url) into the table below ``root``, drop the keys in ``deletes`` (repo_url) and
    commit the result as the next version.

    Only buckets in which a key changes are read and written. ``merge`` (stored, rows) gives all rows after the merge;
    ``merge_sent`` gives the same for rows that are small enough to be sent to the stored ones. ``stream`` names the stream
    and its batch: a batch that the table has already, or that is older, changes nothing.
    """
    spark, schema = rows.sparkSession, rows.schema
    path = shared.shared_dir(spark)
    rows.withColumn("_gone", F.lit(False)).write.parquet(path)
    if deletes is not None:
        deletes.select("repo_url", F.lit(True).alias("_gone")).distinct().write.mode("append").parquet(path)
    changes = spark.read.schema(StructType([*schema.fields, StructField("_gone", BooleanType())])).parquet(path)
    new, gone = changes.where("not _gone").drop("_gone"), changes.where("_gone").select("repo_url")
    sent = small(spark, changes, path)
    for attempt in range(ATTEMPTS):
        now = head(spark, root)
        if now is not None and stream is not None and now.streams.get(stream[0], -1) >= stream[1]:
            return now
        n = now.buckets if now is not None else buckets
        folders = dict(now.folders) if now is not None else {}
        touched = sorted(r[0] for r in changes.select(bucket_of(n).alias("b")).distinct().collect())  # at most one for each bucket
        old = [folders.pop(b) for b in touched if b in folders]
        stored = rows_of(spark, old, new.schema)
        after = (merge_sent if sent else merge)(stored, new) if old else new.repartition(min(n, max(1, len(touched))), bucket_of(n))
        if deletes is not None:
            after = after.join(F.broadcast(gone) if sent else gone.hint("merge"), "repo_url", "left_anti")
        folders |= store(after, root, n)
        streams = (now.streams if now is not None else {}) | ({stream[0]: stream[1]} if stream is not None else {})
        made = Version(0 if now is None else now.number + 1, n, folders, streams)
        try:
            commit(spark, root, made)
        except VersionTaken:
            drop(spark, set(folders.values()) - set(now.folders.values() if now is not None else ()))
            if attempt + 1 == ATTEMPTS:
                raise
            continue
        return made
    raise VersionTaken(root)


def drop(spark: SparkSession, folders: set[str]) -> int:
    """Delete bucket folders, and what they lie in once it holds no other; returns how many went."""
    gone = 0
    for name in sorted(folders):
        path, files = _path(spark, name)
        gone += bool(files.delete(path, True))
        parent = path.getParent()
        if files.exists(parent) and not any(s.isDirectory() for s in files.listStatus(parent)):
            files.delete(parent, True)
    return gone


def retire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Forget all versions but the last ``keep``, and delete the bucket folders that no other names; returns how many
    versions went. A version's file goes last, so that a run that ends in between goes on where it was."""
    known = numbers(spark, root)
    kept, old = known[: max(1, keep)], known[max(1, keep) :]
    named = {f for n in kept for f in version(spark, root, n).folders.values()}
    for number in old:
        drop(spark, set(version(spark, root, number).folders.values()) - named)
        path, files = _path(spark, _version_path(root, number))
        files.delete(path, False)
    return len(old)
