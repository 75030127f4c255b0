"""A landing folder of scored projects as a stream into the project table.

The domain itself is batch work: there are no event times, windows or late rows. What a stream adds is
that shards of a scan can land as they are done. Each micro-batch is merged by the same rules as a batch
job, into the same chain of versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..jobs import workflows
from ..sources import readers, tables


def upsert_batch(batch: DataFrame, batch_id: int, root: str, stream: str) -> None:
    """Merge one micro-batch. One that the table has already, by the stream's name and number, changes nothing."""
    workflows.upsert_projects(readers.projects_of(batch), root, stream=(stream, batch_id))


def stream_upserts(spark: SparkSession, landing: str, root: str, *, progress: str | None = None, **trigger) -> StreamingQuery:
    """Follow the Parquet files in ``landing`` (stored projects) into the table below ``root``.

    ``progress`` is the stream's checkpoint (below ``root`` unless given). Its first start gives the stream a name that
    the table keeps beside the last batch: a restarted stream goes on with its numbers, one with a new checkpoint
    counts from 0 under another name."""
    progress = progress or f"{root}/progress"
    schema = ", ".join(f"{n} {k}" for n, k in readers.PROJECT.items())
    name = tables.named(spark, progress)
    stream = spark.readStream.schema(schema).parquet(landing)
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: upsert_batch(batch, batch_id, root, name))
    return writer.option("checkpointLocation", f"{progress}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
