"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut_lineage, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of texts that go to Python at once, about. A batch is held in memory whole, and one text is never parted.
BATCH_BYTES = 4 << 20

#: Keys that are sent to every task at most, where rows are dropped by key.
SENT_KEYS = 200_000

#: A group of copies counts as hot from this share of all rows. At most 1 / HOT_SHARE groups can.
HOT_SHARE = 0.001


def small_batches(spark: SparkSession) -> None:
    """Python stages take batches of at most about ``BATCH_BYTES`` from here on in this session (the
    setting is read when a plan runs, so that it can't be set for one plan alone)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def attach_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group in ``groups`` (unique ``key``, no null; ``size`` = its rows
    among ``rows``, ``total`` = all rows).

    A group that holds a share ``HOT_SHARE`` of the rows or more would fill one task of a shuffle on
    ``key``. There are at most ``1 / HOT_SHARE`` such groups, so these are broadcast; all other rows meet
    their group in a sort-merge join of even partitions. Rows of hot groups take part in that join under
    a hash of their place in the input, where they meet nothing.
    """
    least = max(1000, int(total * HOT_SHARE))
    extra = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) >= least).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_h_{c}") for c in extra))
    cold = groups.where(F.col(size) < least).select(F.xxhash64(key).alias("_cj"), F.col(key).alias("_ck"), *(F.col(c).alias(f"_c_{c}") for c in extra))
    marked = rows.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    marked = marked.withColumn("_j", F.when(F.col("_hot").isNull(), F.xxhash64(key)).otherwise(F.xxhash64("_place", F.lit("spread"))))
    joined = marked.join(cold.hint("merge"), (F.col("_j") == F.col("_cj")) & (F.col(key) == F.col("_ck")), "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in extra))


def without(rows: DataFrame, own: Column, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose key ``own`` (a struct, because null members are to meet as well) is in
    the only column of ``dropped``. Up to ``SENT_KEYS`` keys are counted and go to every task, so that no
    row is shuffled; more take a sort-merge anti-join."""
    dropped = cut_lineage(dropped.select(F.col(dropped.columns[0]).alias("gone")))
    gone = F.broadcast(dropped) if dropped.count() <= SENT_KEYS else dropped.hint("merge")
    # Rows are structs, so that no name can clash.
    packed = rows.select(F.struct(*rows.columns).alias("row"), own.alias("own"))
    return packed.join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")


@lru_cache(maxsize=4)
def rank_encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
    """A tiktoken encoding of a rank file, once per Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


#: Between these two characters every scan with a word pattern that never joins a non-blank with a
#: following blank has a boundary, whatever stands around them.
BLANK_EDGE = re.compile(r"(?<=[!-~¡-ᙿ、-퟿])(?=[ \n\r\t])")


def safe_chunks(text: str, size: int = 65536):
    """``text`` in pieces of about ``size`` characters, cut only where any tokenizer scan has a boundary."""
    start = 0
    while len(text) - start > size:
        edge = BLANK_EDGE.search(text, start + size)
        if edge is None:
            break
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]
