"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius ``r``, each of the 64 bits gets a vector of ``r + 1`` bits, and each non-zero vector ``v``
of ``r + 1`` bits gives a table whose mask has the bits whose vector has an odd product with ``v``.
The vectors of at most ``r`` differing bits don't span the space, so some ``v`` is orthogonal to all of
them: its mask has none of the differing bits. Every pair within the radius therefore collides in some
table, and none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Distinct fingerprints of a bucket that one task compares. Larger buckets are split.
BLOCK = 2048


def fingerprint(text: str, shingle_words: int) -> int:
    import xxhash

    words = WORD.findall(text.encode().translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle_words + 1)
    starts, ends = np.concatenate([[0], ends[: n - 1] + 1]).tolist(), ends[-n:].tolist()
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, 65536):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + 65536], ends[k : k + 65536], strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes that are held already: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """``id_col`` and fp (the 64 bits as a signed long) of each whole text; no words: 0."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle_words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def covering_masks(radius: int, bits: int = 64, within: int = -1) -> list[int]:
    """The masks, as signed longs, over the bits of ``within`` (all by default)."""
    own = [b for b in range(bits) if within >> b & 1]
    size = (1 << (radius + 1)) - 1
    # Vectors dealt out in turn: each mask has about half of the bits.
    vector = {b: k % size + 1 for k, b in enumerate(own)}
    masks = [sum(1 << b for b in own if (vector[b] & v).bit_count() & 1) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """Union-find over the members of a bucket."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def spanning_edges(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links between fingerprints of ``a`` (and ``b``) that connect whatever all links would connect."""
    members = a if b is None else np.concatenate([a, b])
    forest, left = Forest(len(members)), len(members) - 1
    for i in range(len(a)):
        first = i + 1 if b is None else len(a)
        near = np.flatnonzero(np.bitwise_count(members[first:] ^ a[i]) <= radius)
        for j in near.tolist():
            if forest.link(i, first + j):
                yield int(a[i]), int(members[first + j])
                left -= 1
        if not left:
            return


def bucket_edges(rows: DataFrame, key: list[str], radius: int) -> DataFrame:
    """src, dst: spanning links of every bucket of at most ``BLOCK`` fingerprints."""
    parted = rows.repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        def found(k, fp):
            new = np.ones(len(fp), dtype=bool)
            new[1:] = np.any(k[1:] != k[:-1], axis=1)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            out = [np.stack([fp[two], fp[two + 1]], axis=1).view(np.int64)]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if edges := list(spanning_edges(fp[s : s + n], None, radius)):
                    out.append(np.array(edges, dtype=np.uint64).view(np.int64))
            pairs = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

        keys, fps, held = np.empty((0, len(key)), dtype=np.int64), np.empty(0, dtype=np.uint64), []

        def joined():
            k = [np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(len(key))], axis=1) for b in held]
            return np.concatenate([keys, *k]), np.concatenate([fps, *(b.column(len(key)).to_numpy().view(np.uint64) for b in held)])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 16 * BLOCK:
                continue
            keys, fps = joined()
            held = []
            differ = np.any(keys != keys[-1], axis=1)  # the last bucket may go on
            if last := int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0:
                yield found(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        keys, fps = joined()
        if len(fps):
            yield found(keys, fps)

    return parted.select(*key, "fp").mapInArrow(run, "src long, dst long")


def block_edges(rows: DataFrame, sizes: DataFrame, key: list[str], radius: int) -> DataFrame:
    """src, dst for buckets of any size: each is dealt into blocks of about ``BLOCK``, and every pair of
    blocks is compared in a task of its own, which gives at most one link for each of its members."""
    dealt = rows.join(sizes, key).withColumn("_n", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int"))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select(*key, F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"), "_b", "fp")

    def compare(table: pa.Table) -> pa.Table:
        fp, block = table.column("fp").to_numpy().view(np.uint64), table.column("_b").to_numpy()
        lo = table.column("_lo")[0].as_py()
        same = lo == table.column("_hi")[0].as_py()
        edges = list(spanning_edges(fp[block == lo], None if same else fp[block != lo], radius))
        pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return dealt.groupBy(*key, "_lo", "_hi").applyInArrow(compare, "src long, dst long")


def near_edges(fps: DataFrame, radius: int) -> DataFrame:
    """Links of distinct fingerprints (column fp) within ``radius`` bits, enough to connect all that are.

    Buckets of the covering tables are counted first. Those with more than ``BLOCK`` members meet a
    second covering family over the bits that their mask left out, which splits them without losing
    a pair; what is still too large is compared in blocks.
    """
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)))
    rows = fps.select("fp", F.explode(tables).alias("x")).select(F.col("x.t").alias("t"), F.col("x.k").alias("k"), "fp")
    key = ["t", "k"]
    large = common.cut_lineage(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK))
    if large.isEmpty():
        return bucket_edges(rows, key, radius)
    edges = bucket_edges(rows.join(large, key, "left_anti"), key, radius)

    inner = F.array()
    for t, m in enumerate(masks):
        own = [F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(n)).alias("j")) for s, n in enumerate(covering_masks(radius, within=~m))]
        inner = F.when(F.col("t") == t, F.array(*own)) if t == 0 else inner.when(F.col("t") == t, F.array(*own))
    split = rows.join(large.drop("members"), key).select(*key, "fp", F.explode(inner).alias("y")).select(*key, F.col("y.s").alias("s"), F.col("y.j").alias("j"), "fp")
    fine = [*key, "s", "j"]
    still = common.cut_lineage(split.groupBy(*fine).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK))
    edges = edges.unionByName(bucket_edges(split.join(still, fine, "left_anti"), fine, radius))
    return edges if still.isEmpty() else edges.unionByName(block_edges(split, still, fine, radius))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for the nodes of ``edges``: the smallest node connected to each.

    ``edges`` (src, dst) are contracted in turns: every node links its larger neighbours, then its
    smaller ones, to the smallest node that it knows (large star, small star). The links shrink to
    stars in a number of rounds that grows as the square of the logarithm of the nodes. Each round is
    written to the shared folder.
    """
    edges = common.cut_lineage(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())

    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        linked = both.join(least, "u")
        if large:
            linked = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            linked = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own)
        return linked.where("a <> b").distinct()

    before = None
    for _ in range(rounds):
        edges = common.cut_lineage(star(star(edges, True), False))
        # All links are stars around roots, and stay so, when nothing changes any more.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the links did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id for each document.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest id that links lead to, the document's own included. Copies share a fingerprint and are
    one node of the search, so that a group of copies costs what one document does.

    Null and empty text, and text without words: fingerprint zero, linked like any other. A null id
    never is a component_id unless all ids of the component are null. Repeated rows count as copies.
    A text of any length is read whole, as one row of its task. No rows: none out. Other columns are not read.
    """
    marks = common.cut_lineage(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words))
    nodes = common.cut_lineage(marks.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")))
    roots = components(nodes, near_edges(nodes.select("fp"), radius))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    # Roots are few copies of long values: the smallest id of each component, then back to its fingerprints.
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("fp", "copies", "component_id")
    out = common.attach_group(marks, named, "fp", "copies", marks.count())
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """The documents whose id is the smallest of their component, with all their columns. Rows that
    repeat that id are the same document and all stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, radius=radius)
    kept = F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("kept")
    gone = found.groupBy(id_col).agg(kept).where("not kept").select(F.struct(F.col(id_col).alias("id")).alias("gone"))
    return common.without(docs, F.struct(F.col(id_col).alias("id")), gone)
