"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Each of ``trees`` trees gives every vector a string of 48 sign bits and keeps the vectors as an array
sorted by it. A vector's label in a tree is the shortest prefix of its string that few others share, as
short or as long as the density around it asks for, up to all bits. A query descends to its longest
prefix match in each array and ascends from there, in all trees at once, to labels with less and less in
common, until enough candidates are found; these are scored exactly. The way up goes by what a differing
bit costs: bits that the query itself hardly decides (its distance to their plane is small) are given up
first, so the branches off its path are met in the order of their cost, whatever tree they stand in.

On Spark, narrow aggregations count prefixes, longer ones only below prefixes that too many entries share.
Their leaves, a table whose size is bounded whatever n is, go to every task. The sorted arrays are
cut into blocks between leaves; a block is read once for each chunk of the queries that visit it, finds
their leaves by bisection and scores them by products. Blocks that hold many entries are salted, blocks
with many visitors repeated, so that no group outgrows a task.

Equal vectors are one entry with its smallest ids, which keeps large groups of copies in one row and
ties exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bits of a tree's strings.
BITS = 48

#: Entries that share a label at least before a longer prefix parts them, and labels of all trees at most, about.
LEAF, LEAVES = 3, 1 << 19

#: Prefixes that one aggregation counts at most, as a power of two.
COUNTED = 20

#: Entries of a block, about, and queries that one copy of it serves, about.
BLOCK, CHUNK = 8192, 20_000

#: Vectors over which the planes are fitted, at most.
SAMPLE = 4096

#: Entries, counted in each tree, to which a query ascends at least: all of 64 entries in 8 trees.
LEAST = 512


def candidates_wanted(n: int) -> int:
    """Entries, counted in each tree, to which a query ascends: in proportion to n ** 0.75."""
    return max(LEAST, math.ceil(4.5 * n**0.75))


def usable(vector: Column) -> Column:
    """Not null or empty, only finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def fit_planes(sample: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(planes, offsets): for each tree random directions, at right angles as far as there are so many,
    stretched along the directions in which the sample varies, and parting the sample at its middle."""
    dim, rng = sample.shape[1], np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim) if len(sample) > 1 else np.eye(dim))
    stretch = np.sqrt(np.maximum(values, values.max() * 0.05 + 1e-12))
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(trees * -(-BITS // dim))]
    each = -(-BITS // dim)
    turned = np.concatenate([np.concatenate(turns[t * each : (t + 1) * each], axis=1)[:, :BITS] for t in range(trees)], axis=1)
    planes = vectors @ (stretch[:, None] * turned)
    planes /= np.linalg.norm(planes, axis=0)
    return planes, sample.mean(axis=0) @ planes


def hash_strings(margins: np.ndarray, trees: int) -> np.ndarray:
    """One row of ``trees`` non-negative numbers of ``BITS`` bits for each vector's distances to the planes."""
    bits = (margins > 0).reshape(len(margins), trees, BITS)
    return bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def labels(starts: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, sizes) of one tree's leaves, sorted: the shortest prefixes that at most ``limit`` entries
    share, or all bits. Given are counted prefixes by their smallest string, each with its ``sizes``."""
    out = []
    for length in range(BITS + 1):
        prefix, own = np.unique(starts >> BITS - length, return_inverse=True)
        total = np.bincount(own, weights=sizes, minlength=len(prefix)).astype(np.int64)
        leaf = (total <= limit) | (length == BITS)
        out.append((prefix[leaf] << BITS - length, np.full(int(leaf.sum()), length), total[leaf]))
        starts, sizes = starts[~leaf[own]], sizes[~leaf[own]]
        if not len(starts):
            break
    found = [np.concatenate(column) for column in zip(*out, strict=True)]
    order = np.argsort(found[0])
    return found[0][order], found[1][order], found[2][order]


class Forest:
    """The leaves of all trees: smallest string, length, size, tree and block of each, sorted within trees."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], block: int):
        self.starts = [starts for starts, _, _ in trees]
        self.first = np.cumsum([0, *map(len, self.starts)])
        lengths, self.sizes = (np.concatenate([t[i] for t in trees]) for i in (1, 2))
        self.tree = np.repeat(np.arange(len(trees)), np.diff(self.first))
        # Leaves whose entries begin in the same stretch of ``block`` entries of a tree share a block.
        inside = np.concatenate([(np.cumsum(size) - size) // block for _, _, size in trees])
        self.block = np.cumsum(np.r_[0, (np.diff(inside) != 0) | (np.diff(self.tree) != 0)])
        # For each byte of a string the leaves that reach it, and the node of a binary tree over its bits where they end.
        self.nodes = []
        for byte in range(BITS // 8):
            at = np.flatnonzero(lengths > 8 * byte)
            bits = np.minimum(lengths[at] - 8 * byte, 8)
            value = np.concatenate(self.starts)[at] >> BITS - 8 * byte - 8 & 255
            self.nodes.append((at, (1 << bits) | value >> 8 - bits))

    def leaves_of(self, strings: np.ndarray) -> np.ndarray:
        """The leaf of each string (rows x trees): the longest prefix match, found by bisection."""
        return np.stack([self.first[t] + np.searchsorted(s, strings[:, t], side="right") - 1 for t, s in enumerate(self.starts)], axis=1)

    def costs(self, margins: np.ndarray) -> np.ndarray:
        """Cost of each leaf for a query's distances to the planes (trees x bits): the sum of their squares
        over the bits of the leaf's prefix in which the query differs."""
        w, one = np.float32(margins**2), margins > 0
        steps = np.stack([np.where(one, w, 0), np.where(one, 0, w)], axis=2).reshape(len(margins), BITS // 8, 8, 2)
        table = np.zeros((len(margins), BITS // 8, 512), dtype=np.float32)
        for bit in range(8):
            below = table[:, :, 1 << bit : 2 << bit, None] + steps[:, :, bit, None, :]
            table[:, :, 2 << bit : 4 << bit] = below.reshape(len(margins), BITS // 8, -1)
        cost = np.zeros(len(self.tree), dtype=np.float32)
        for byte, (at, node) in enumerate(self.nodes):
            cost[at] += table[self.tree[at], byte, node]
        return cost

    def ascend(self, margins: np.ndarray, wanted: int) -> np.ndarray:
        """The leaves to which a query ascends, over all trees at once in order of their cost, until they hold
        ``wanted`` entries; leaves of equal cost go together."""
        cost, sizes = self.costs(margins), self.sizes
        some = max(64, 2 * wanted * len(cost) // max(1, int(sizes.sum())))
        while True:  # the cheapest leaves are enough, mostly twice as many as would be of average size
            near = np.argpartition(cost, some)[:some] if some < len(cost) else np.arange(len(cost))
            order = near[np.argsort(cost[near])]
            total = np.cumsum(sizes[order])
            if total[-1] >= wanted or len(order) == len(cost):
                break
            some *= 2
        return np.flatnonzero(cost <= cost[order[min(int(np.searchsorted(total, wanted)), len(order) - 1)]])


def counted_forest(strings: DataFrame, n: int, trees: int) -> Forest:
    """The forest over ``strings`` (tree, hash; n rows for each tree). A first aggregation counts prefixes of about
    as many bits as ``n`` has, the next ones longer prefixes below those that more than the limit share. What
    comes back is bounded by ``COUNTED`` and ``LEAVES``, whatever ``n`` is."""
    limit = max(LEAF, -(-n * trees // LEAVES))
    depth = min(n.bit_length() + 2, COUNTED - (trees - 1).bit_length())
    parts, below = [], strings
    while True:
        start = F.shiftleft(F.shiftright("hash", BITS - depth), BITS - depth).alias("start")
        table = below.groupBy("tree", start).agg(F.count(F.lit(1)).alias("size")).toArrow()
        tree, start, size = (table.column(c).to_numpy() for c in ("tree", "start", "size"))
        heavy = (size > limit) & (depth < BITS)
        parts.append((tree[~heavy], start[~heavy], size[~heavy]))
        if not heavy.any():
            break
        shared = strings.sparkSession.createDataFrame(pa.table({"tree": tree[heavy].astype(np.int32), "start": start[heavy]}))
        own = F.shiftleft(F.shiftright("hash", BITS - depth), BITS - depth)
        below = strings.withColumn("start", own).join(F.broadcast(shared), ["tree", "start"], "left_semi")  # at most LEAVES rows
        depth = min(BITS, depth + max(1, COUNTED - int(heavy.sum()).bit_length()))
    tree, start, size = (np.concatenate(column) for column in zip(*parts, strict=True))
    return Forest([labels(start[tree == t], size[tree == t], limit) for t in range(trees)], max(BLOCK, n >> 14))


def listed(rows: np.ndarray) -> pa.Array:
    """A list of each row's numbers."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.reshape(-1)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return scaled(flat.reshape(len(column), -1).astype(np.float64))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """``vectors``, those whose squares could leave the range of doubles times a power of two, which changes no cosine."""
    largest = np.abs(vectors).max(axis=1, initial=0.0)
    far = (largest > 1e100) | (largest < 1e-100)
    if far.any():
        vectors[far] = np.ldexp(vectors[far], -np.frexp(largest[far])[1][:, None])
    return vectors


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    trees: int = 8,
    seed: int = 20,
    wanted=candidates_wanted,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine in double precision) of the ``k`` nearest found.

    Queries are the rows for which ``is_query`` holds, candidates all rows but the query's own; only
    vectors of one length are compared. Ties go to the smaller id. Rows with a null id or an unusable
    vector (see ``usable``) take no part. Rows that repeat an id and a vector count once; one id with
    several vectors is several candidates under one id, of which the best counts. Fewer candidates than
    ``k``: all of them. No rows: none out. Other columns are not read.

    A query goes up until its leaves hold ``wanted(n)`` of the ``n`` entries, counted in each tree, which keeps
    recall at 0.9 or more even on data without low-dimensional structure and grows slower than ``n``.
    Components of any finite size take part. Vectors of each length are searched by a plan of their own.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    order = Window.partitionBy("v").orderBy("id")
    small = rows.select("id", "v").withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= k + 1)
    entries = small.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    schema = f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, vec_id {rows.schema['id'].dataType.simpleString()}, score double"
    entries = common.cut_lineage(entries.withColumn("dim", F.size("v")).withColumn("entry", F.xxhash64("v")))
    dims = [(r[0], r[1]) for r in entries.groupBy("dim").count().collect()]
    # A stated number of tasks, which isn't made smaller for few bytes: a query's way up is work, however small its row.
    tasks = max(spark.sparkContext.defaultParallelism, sum(n for _, n in dims) >> 20)
    asked = rows.where("q").select(F.col("id").alias("query_id"), "v").repartition(tasks, "query_id", "v").distinct()
    out = spark.createDataFrame([], schema)
    for dim, n in sorted(dims):
        of_dim = entries.where(F.col("dim") == dim)
        out = out.unionByName(_nearest(of_dim, asked.where(F.size("v") == dim), n, k, trees, seed, wanted, schema))
    return out


def _nearest(entries: DataFrame, asked: DataFrame, n: int, k: int, trees: int, seed: int, wanted, schema: str) -> DataFrame:
    spark = entries.sparkSession
    sample = np.array([r[0] for r in entries.orderBy("entry").limit(SAMPLE).select("v").collect()], dtype=np.float64)
    planes, offsets = fit_planes(unit(scaled(sample)), trees, seed)
    id_type = asked.schema["query_id"].dataType.simpleString()
    array = "array<float>" if "float" in entries.schema["v"].dataType.simpleString() else "array<double>"
    asked = asked.select(F.col("v").cast(array), "query_id")

    def margins_of(column: pa.Array) -> np.ndarray:
        return unit(matrix(column)) @ planes - offsets

    def strings(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([listed(hash_strings(margins_of(batch.column(0)), trees))], ["strings"])

    hashed = common.cut_lineage(entries.select(F.col("v").cast(array)).mapInArrow(strings, "strings array<long>"))
    forest = counted_forest(hashed.select(F.posexplode("strings").alias("tree", "hash")), n, trees)
    sent = spark.sparkContext.broadcast(forest)

    def leaves(batches):
        for batch in batches:
            if batch.num_rows:
                found = sent.value.leaves_of(hash_strings(margins_of(batch.column(0)), trees))
                yield pa.RecordBatch.from_arrays([*batch.columns, listed(found), listed(sent.value.block[found])], [*batch.schema.names, "leaves", "blocks"])

    entries = entries.select(F.col("v").cast(array), "ids", "entry").mapInArrow(leaves, f"v {array}, ids array<{id_type}>, entry long, leaves array<long>, blocks array<long>")
    spread = entries.select("v", "ids", "entry", F.explode(F.arrays_zip("leaves", "blocks")).alias("at")).select("v", "ids", "entry", F.col("at.leaves").alias("leaf"), F.col("at.blocks").alias("block"))

    def visits(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, block, visited = [], [], []
            for row, own in enumerate(margins_of(batch.column(0)).reshape(-1, trees, BITS)):
                found = sent.value.ascend(own, wanted(n))
                blocks = sent.value.block[found]
                at = np.flatnonzero(np.r_[True, np.diff(blocks) != 0])
                rows += [row] * len(at)
                block += blocks[at].tolist()
                visited += np.split(found.astype(np.int32), at[1:])
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(block, pa.int64()), pa.array(visited, pa.list_(pa.int32()))], ["v", "query_id", "block", "visited"])

    visits = common.cut_lineage(asked.mapInArrow(visits, f"v {array}, query_id {id_type}, block long, visited array<int>"))
    per_block = np.bincount(forest.block, weights=forest.sizes)
    visitors = visits.groupBy("block").count().collect()  # at most 2 ** 14 for each tree and one for each BLOCK entries
    sized = [(b, math.ceil(int(per_block[b]) / BLOCK), math.ceil(c / CHUNK)) for b, c in visitors]
    blocks = F.broadcast(spark.createDataFrame(sized, "block long, salts int, chunks int"))

    in_block = spread.join(blocks, "block").select("block", F.pmod("entry", "salts").cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "leaf", "v", "ids", F.lit(None).cast(id_type).alias("query_id"), F.lit(None).cast("array<int>").alias("visited"))
    chunk = F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk")
    asking = visits.join(blocks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), chunk, F.lit(None).cast("long").alias("leaf"), "v", F.lit(None).cast(f"array<{id_type}>").alias("ids"), "query_id", "visited")

    def search(table: pa.Table) -> pa.Table:
        query = np.array(table.column("query_id").is_valid())
        empty = pa.table({"query_id": pa.array([], table.schema.field("query_id").type), "vec_id": pa.array([], table.schema.field("query_id").type), "score": pa.array([], pa.float64())})
        if query.all() or not query.any():
            return empty
        x = matrix(table.column("v").combine_chunks())
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        entry = np.flatnonzero(~query)
        leaf = table.column("leaf").take(pa.array(entry)).to_numpy()
        order = np.argsort(leaf, kind="stable")
        entry, leaf = entry[order], leaf[order]
        points, lengths, ids = x[entry], norm[entry], table.column("ids")
        keys, visited, out = table.column("query_id"), table.column("visited"), []
        for q in np.flatnonzero(query).tolist():
            own_leaves = visited[q].values.to_numpy()
            low, high = np.searchsorted(leaf, own_leaves), np.searchsorted(leaf, own_leaves, side="right")
            sizes = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            if not len(at):
                continue
            score = np.einsum("ij,j->i", points[at], x[q]) / (lengths[at] * norm[q])
            # One entry more than asked for, as the query's own may be among them, and all that tie with it.
            least = np.partition(score, -(k + 1))[-(k + 1)] if len(at) > k + 1 else -np.inf
            own, found = keys[q].as_py(), {}
            best = np.flatnonzero(score >= least)
            for i in best[np.argsort(-score[best], kind="stable")].tolist():
                for other in ids[int(entry[at[i]])].as_py():
                    if other != own:
                        found[other] = max(found.get(other, -2.0), float(score[i]))
            top = sorted(found.items(), key=lambda f: (-f[1], f[0]))[:k]
            out += [(own, other, s) for other, s in top]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({name: pa.array(c, empty.schema.field(name).type) for name, c in zip(empty.schema.names, columns, strict=True)})

    found = in_block.unionByName(asking).groupBy("block", "salt", "chunk").applyInArrow(search, f"query_id {id_type}, vec_id {id_type}, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
