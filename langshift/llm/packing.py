"""Harmonic packing of documents into sequences of a fixed number of tokens.

Lengths fall into reciprocal-capacity classes: class ``j`` takes pieces of more than
``capacity / (j + 1)`` and at most ``capacity / j`` tokens, and each of its bins is filled with
exactly ``j`` pieces. A bin depends on nothing but its class, so every task fills its own bins as the
documents come by: no shuffle, no state beyond one open bin for each class, no coordination.

A document is cut at the capacity, and what remains lies in its class as it is, if it nearly fills its
share of a bin; if not, it is cut once more, so that both parts do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the one special token of the byte-level vocabulary.
SPECIAL = (("<|endoftext|>", 50256),)


#: A remainder that leaves more than this share of its room empty is cut, into parts of so many tokens at least.
EMPTY, LEAST = 0.02, 32


def token_ids(text: str | None, encoding, end: int) -> np.ndarray:
    """The ids of a whole text and the id ``end``; special strings inside become their token."""
    parts = [np.array(encoding.encode(part, allowed_special="all"), dtype="<u4") for part in common.safe_chunks(text or "")]
    return np.concatenate([*parts, np.array([end], dtype="<u4")])


def empty(length: int, capacity: int) -> float:
    """What a piece leaves of its share of a bin."""
    return capacity / (capacity // length) - length


@lru_cache(maxsize=4)
def remainders(capacity: int) -> list[tuple[int, ...]]:
    """The pieces of each length below ``capacity``: one, or two of which the first ends its class."""
    edges = sorted({capacity // j for j in range(2, capacity // LEAST + 1)}, reverse=True)
    found: list[tuple[int, ...]] = [()]
    for n in range(1, capacity):
        ways = [(n,)]
        if empty(n, capacity) > EMPTY * n:
            ways += [(e, n - e) for e in edges if n - e >= LEAST]
        found.append(min(ways, key=lambda way: sum(empty(x, capacity) for x in way)))
    return found


def harmonic_pieces(n: int, capacity: int) -> list[int]:
    """``n`` as full lengths and at most two more."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + [*remainders(capacity)[rest]]


def whole_pieces(n: int, capacity: int) -> list[int]:
    """``n`` as one length, after as many full ones as it holds."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + [rest] * (rest > 0)


class Bins:
    """The open bins of one task. A row is given out when its bin is complete."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open = capacity, first_id, {}

    def add(self, row: tuple, length: int) -> Iterator[tuple]:
        per_bin = self.capacity // length
        held = self.open.setdefault(per_bin, [])
        held.append((row, length))
        if len(held) == per_bin:
            del self.open[per_bin]
            yield from self.close(held)

    def close(self, held: list) -> Iterator[tuple]:
        offset = 0
        for row, length in held:
            yield (*row, self.next_id, offset)
            offset += length
        self.next_id += 1

    def finish(self) -> Iterator[tuple]:
        """Give out what is left: less than a bin of each class. These few pieces fill bins together, the
        longest first, each the first bin that has room."""
        rest = sorted((x for held in self.open.values() for x in held), key=lambda x: -x[1])
        bins: list[tuple[list, int]] = []
        for row, length in rest:
            at = next((i for i, (_, room) in enumerate(bins) if room >= length), len(bins))
            if at == len(bins):
                bins.append(([], self.capacity))
            held, room = bins[at]
            held.append((row, length))
            bins[at] = (held, room - length)
        self.open = {}
        for held, _ in bins:
            yield from self.close(held)


def pack(
    docs: DataFrame,
    *,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 0,
    cut: bool = True,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, per_bin.

    A document of up to ``capacity`` tokens is one piece or two, a longer one has its full pieces besides.
    ``cut=False`` keeps documents whole where they fit, and leaves more room empty. ``with_ids`` adds the
    piece's token ids.

    Null and empty text: one piece of the id ``end_id``. A null or repeated id is carried along as it
    is, each row being packed by itself. A text of any length is encoded in parts, and as many full pieces as
    it has. No rows: no pieces. Other columns are not read. Sequence ids
    hold the number of the input partition, so a task that runs again gives the same ids.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, per_bin int" + ", ids array<int>" * with_ids
    pieces = harmonic_pieces if cut else whole_pieces

    def run(batches):
        encoding = common.rank_encoding(ranks_path, pattern, SPECIAL)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        types = None

        def table(rows):
            rows = [(*row[:4], row[4], row[-2], row[-1], row[5], *row[6:-2]) for row in rows]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "per_bin"] + ["ids"] * with_ids
            kinds = [types, *[pa.int64()] * 6, pa.int32()] + [pa.list_(pa.int32())] * with_ids
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            types, out = batch.column(0).type, []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), encoding, end_id)
                raw, start = memoryview(ids).cast("B"), 0
                for length in pieces(len(ids), capacity):
                    part = raw[4 * start : 4 * (start + length)]
                    row = (key, start, length, zlib.crc32(part), len(ids), capacity // length)
                    out.extend(bins.add((*row, ids[start : start + length].tolist()) if with_ids else row, length))
                    start += length
                if len(out) > 20_000:
                    yield table(out)
                    out = []
            yield table(out)
        if types is not None:
            yield table(list(bins.finish()))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
