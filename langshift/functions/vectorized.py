"""The two functions that Spark's own can't express, both on Arrow batches: a shard's hash, and reports in JSON."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers

#: The first token ``x/y`` of a line, after its start or white space and before white space or its end.
METRIC = r"(?U)(?:^|\s)([0-9]+)/([0-9]+)(?=\s|$)"


def shard_hash(keys: pd.Series) -> np.ndarray:
    """64-bit FNV-1a of the UTF-8 bytes, column by column over the batch."""
    raw = [k.encode() for k in keys]
    lengths = np.array([len(r) for r in raw])
    table = np.frombuffer(b"".join(r.ljust(lengths.max(initial=1), b"\0") for r in raw), dtype=np.uint8).reshape(len(raw), -1)
    value = np.full(len(raw), 0xCBF29CE484222325, dtype=np.uint64)
    for i in range(table.shape[1]):
        value = np.where(i < lengths, (value ^ table[:, i]) * np.uint64(0x100000001B3), value)
    return value


def shard_owns(key: Column, index: int, total: int) -> Column:
    """Whether shard ``index`` of ``total`` owns a key. A null key belongs to the first shard."""

    @F.pandas_udf("boolean")
    def owns(keys: pd.Series) -> pd.Series:
        found = shard_hash(keys.fillna("")) % np.uint64(total) == index
        return pd.Series(np.where(keys.isna(), index == 0, found))

    return owns(key)


def unsafe_share(report: Column) -> Column:
    """Share of unsafe functions (%) in a report, as JSON or as text; null if it has no numbers.

    JSON of any shape: each object ``functions`` with whole numbers ``safe`` and ``unsafe_`` (or
    ``unsafe``) counts. Only such reports go to Python. Text: the first token ``x/y`` of each line; a number
    beyond a bigint counts 0."""

    @F.pandas_udf("double")
    def share(reports: pd.Series) -> pd.Series:
        return reports.map(json_share)

    json_like = F.ltrim(report).startswith("{") | F.ltrim(report).startswith("[")
    return F.coalesce(share(F.when(json_like, report)), text_share(report))


def text_share(report: Column) -> Column:
    def total(group: int) -> Column:
        found = F.transform(F.split(report, "\n"), lambda line: F.coalesce(F.regexp_extract(line, METRIC, group).try_cast("bigint"), F.lit(0)))
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return F.when(total(2) > 0, numbers.round_half_up(total(1) / total(2) * 100.0))


def json_share(report: str | None) -> float | None:
    if report is None:
        return None
    try:
        found = list(function_counts(json.loads(report)))
    except (ValueError, RecursionError):
        return None
    part, whole = sum(u for _, u in found), sum(s + u for s, u in found)
    return float(np.floor(part / whole * 100 * 100 + 0.5) / 100) if whole else None


def function_counts(value):
    """Pairs (safe, unsafe), depth first, without recursion."""
    rest = [value]
    while rest:
        node = rest.pop()
        if isinstance(node, dict):
            functions = node.get("functions")
            if isinstance(functions, dict):
                pair = functions.get("safe"), functions.get("unsafe_", functions.get("unsafe"))
                if all(type(n) is int and n >= 0 for n in pair):
                    yield pair
            rest.extend(node.values())
        elif isinstance(node, list):
            rest.extend(node)
