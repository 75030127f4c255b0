"""Hard negatives by a distributed kNN join over a Voronoi partition.

The measure is an integer inner product. Vectors get one more component, which is 0 for anchors and
``sqrt(M^2 - |x|^2)`` for candidates (M: the largest norm): the squared distance of an anchor a to a candidate x
then is ``|a|^2 + M^2 - 2 a.x``, so that the largest products are the smallest distances, and whatever holds for
distances bounds products.

Pivots part the space into cells; anchors and candidates belong to the cell of their nearest pivot. Positives:
anchors first meet the candidates of their own cell. The products found there bound how far away what is still
missing can be, and a candidate of another cell is sent to a cell only if the triangle inequality, or its distance
to the plane between both cells, leaves room for an anchor of that cell that needs it. Negatives: the
smallest positive score gives the bound from the start. Within a cell the join is exact, so the result is.

Cells that hold many candidates are salted and those with many anchors cut into chunks, so that no task
outgrows its memory. Equal vectors of one label are one candidate with its smallest ids: no more of
them can be among the first k, and groups of copies stay in one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Anchors of a cell, about, until there are ``MOST_PIVOTS`` cells; vectors over which pivots are placed, at most.
CELL_ANCHORS, MOST_PIVOTS, SAMPLE = 128, 1024, 4096

#: Candidates and anchors that one task joins, about.
SALT, CHUNK = 32_768, 4096

#: Labels fall into so many buckets, each with bounds of its own for positives.
BUCKETS = 32

#: Products of a block that are held at once.
PRODUCTS = 1 << 22

SCALE = 256

#: Squared norms from here on have products that no long holds.
MOST_SQUARE = float(1 << 62)


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, only finite components, and of a length whose square is a long."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"), F.lit(2.0)))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (square < MOST_SQUARE)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``a`` and ``b`` as exact longs: in doubles where no sum can pass 2^53."""
    most = math.sqrt(float((a.astype(float) ** 2).sum(axis=1).max(initial=0.0))) * math.sqrt(float((b.astype(float) ** 2).sum(axis=1).max(initial=0.0)))
    if most < float(1 << 52):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def place_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of about ``wanted`` cells of the sample (a few rounds of means)."""
    points = sample.astype(np.float64)
    pivots = points[np.unique(np.linspace(0, len(points) - 1, min(wanted, len(points))).astype(int))]
    for _ in range(6 if len(pivots) > 1 else 1):
        near = ((pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(pivots))
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return np.unique(pivots, axis=0)


@dataclass
class Cells:
    """The pivots of each vector length (lengths that the sample lacks have one, the origin) and M^2."""

    pivots: dict[int, np.ndarray]
    square: float

    def of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim)))

    def distances(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        """Distances of the vectors (rows) to the pivots; these lie where anchors do, at 0 in the last component."""
        p, x = self.of(v.shape[1]), v.astype(np.float64)
        own = (x**2).sum(axis=1)[:, None] if anchors else self.square
        return np.sqrt(np.maximum(own + (p**2).sum(axis=1)[None, :] - 2 * x @ p.T, 0.0))

    def slack(self) -> float:
        """What rounding can add to a distance, and much more."""
        return 1e-6 * (1.0 + 2 * math.sqrt(self.square))


def by_length(column: pa.Array) -> list[np.ndarray]:
    """Places of the vectors of each length."""
    lengths = np.asarray(column.value_lengths())
    return [np.flatnonzero(lengths == n) for n in np.unique(lengths).tolist()]


def with_cells(rows: DataFrame, cells: Cells, anchors: bool) -> DataFrame:
    """``rows`` (first column v) with home (the cell) and away (the distance to its pivot)."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)

    def run(batches):
        for batch in batches:
            home, away = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for at in by_length(batch.column(0)):
                d = cells.distances(matrix(batch.column(0).take(pa.array(at))), anchors)
                home[at] = d.argmin(axis=1)
                away[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(away)], [*batch.schema.names, "home", "away"])

    return rows.mapInArrow(run, f"{fields}, home int, away double")


def served(candidates: DataFrame, cells: Cells, bounds: dict[tuple[int, int, int], tuple[float, float]], by_bucket: bool, home: bool) -> DataFrame:
    """The candidates once for each cell whose anchors they might serve, as ``cell``.

    ``bounds``: (length, cell, bucket) to (radius of its anchors, largest distance that one of them needs). With
    ``home`` a candidate's own cell counts as well, else that join has been made."""
    columns = ["v", "ids", "label", "bucket", "home", "away", "dim"]
    rows = candidates.select(*columns)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for (dim, cell, bucket), (radius, reach) in bounds.items():
        r, t = tables.setdefault((dim, bucket), (np.zeros(len(cells.of(dim))), np.full(len(cells.of(dim)), -1.0)))
        r[cell], t[cell] = radius, reach
    slack = cells.slack()

    def run(batches):
        for batch in batches:
            rows, found = [], []
            buckets, homes = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for at in by_length(batch.column(0)):
                v = matrix(batch.column(0).take(pa.array(at)))
                p = cells.of(v.shape[1])
                gaps = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(axis=2), 0.0)) if len(p) <= 64 else None
                for bucket in np.unique(buckets[at]).tolist() if by_bucket else [0]:
                    radius, reach = tables.get((v.shape[1], bucket), (None, None))
                    if radius is None:
                        continue
                    own = np.flatnonzero(buckets[at] == bucket) if by_bucket else np.arange(len(at))
                    for start in range(0, len(own), 4096):
                        some = own[start : start + 4096]
                        d = cells.distances(v[some], False)
                        h = homes[at[some]]
                        # Anchors of cell i lie within its radius of the pivot, and on its side of the plane to the home pivot.
                        least = d - radius[None, :]
                        gap = gaps[h] if gaps is not None else np.sqrt(((p[h][:, None] - p[None]) ** 2).sum(axis=2))
                        plane = (d**2 - (d[np.arange(len(some)), h] ** 2)[:, None]) / (2 * np.maximum(gap, 1e-300))
                        least = np.maximum(least, np.where(gap > 0, plane, -np.inf))
                        go = (reach[None, :] >= 0) & (least <= reach[None, :] + slack)
                        if not home:
                            go[np.arange(len(some)), h] = False
                        r, c = np.nonzero(go)
                        rows.append(at[some[r]])
                        found.append(c)
            picked = batch.take(pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32))], [*columns, "cell"])

    return rows.mapInArrow(run, f"{fields}, cell int")


def joined(candidates: DataFrame, anchors: DataFrame, by_bucket: bool, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``search`` (anchors, candidates) over each cell's (and bucket's) anchors and the candidates sent to it.

    ``candidates``: v, ids, label, bucket, dim, cell; ``anchors``: v, label, bucket, dim, home and other columns. Cells
    are cut into salts of candidates and chunks of anchors, by counts: a row for each cell and bucket at most."""
    spark = anchors.sparkSession
    bucket = F.col("bucket") if by_bucket else F.lit(0)
    key = ["dim", "cell", "bucket"]
    candidates = candidates.withColumn("bucket", bucket)
    anchors = anchors.withColumnRenamed("home", "cell").withColumn("bucket", bucket)
    asked = anchors.groupBy(*key).agg(F.count(F.lit(1)).alias("a"))
    sizes = candidates.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).join(asked, key).collect()
    sized = [(r.dim, r.cell, r.bucket, -(-r.c // SALT), -(-r.a // CHUNK)) for r in sizes]
    cut = F.broadcast(spark.createDataFrame(sized, "dim int, cell int, bucket int, salts int, chunks int"))
    rest = [c for c in anchors.columns if c not in (*key, "v", "label")]
    kinds = {f.name: f.dataType.simpleString() for f in (*anchors.schema, *candidates.schema)}
    own = F.pmod(F.xxhash64("v", "label"), F.col("salts")).cast("int").alias("salt")
    c = candidates.join(cut, key).select(*key, own, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "v", "label", "ids", *(F.lit(None).cast(kinds[x]).alias(x) for x in rest))
    own = F.pmod(F.xxhash64("anchor", "v", F.lit("chunk")), F.col("chunks")).cast("int").alias("chunk")
    a = anchors.join(cut, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), own, "v", "label", F.lit(None).cast(kinds["ids"]).alias("ids"), *rest)

    def run(table: pa.Table) -> pa.Table:
        candidate = np.asarray(table.column("ids").is_valid())
        return search(table.filter(pa.array(~candidate)), table.filter(pa.array(candidate)))

    return c.unionByName(a).groupBy(*key, "salt", "chunk").applyInArrow(run, schema)


def ordered(score: np.ndarray, at: np.ndarray, ids: list[list], k: int, without=None) -> list[tuple[int, object]]:
    """(score, id) of the first ``k`` of the candidates ``at``: higher scores first, ties by smaller id."""
    if len(at) > 4 * k + 8:
        least = np.partition(score[at], len(at) - (k + 1))[len(at) - (k + 1)]
        at = at[score[at] >= least]  # an entry more, as one may be the anchor's own, and all ties
    found = [(-int(score[i]), other) for i in at.tolist() for other in ids[i] if other != without]
    found.sort()
    return [(-s, other) for s, other in found[:k]]


def mine(
    vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, label_col: str = "label",
    positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), cell_anchors: int = CELL_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components x become floor(256 x); scores are inner products of these, as exact longs. The positives of an anchor
    (``is_anchor``) are its first ``positives`` other rows of the same label; for each, the first ``negatives`` rows
    of other labels whose score lies between ``least`` (a fraction) of the positive score and that score. Higher
    scores come first, ties by the smaller id; fewer rows: all of them. ``label`` may replace ``label_col``.

    No part take rows with a null id, label or vector, with a null or non-finite component, or with a norm whose
    square is 2^62 or more. Only vectors of one length are compared. Rows that repeat id, label and vector count
    once; rows of one id with another vector or label are rows of their own, as candidates and anchors. Positives
    with a negative score have no negatives. Anchors without positives, or positives without negatives, give no
    rows. No rows: none out. Other columns are not read.
    """
    label = F.col(label_col) if label is None else label
    spark, top, bottom = vectors.sparkSession, *least
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("a"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("v", scaled(F.col("v")).cast("array<int>"))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int").alias("bucket")
    k = max(positives + 1, negatives)

    asked = rows.where("a").select("v", F.col("id").alias("anchor"), "label", bucket, F.size("v").alias("dim")).distinct()
    asked = common.cut_lineage(asked)
    square = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    schema = f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score long, negative_score long"
    n_anchors = asked.count()
    if square is None or not n_anchors:
        return spark.createDataFrame([], schema)
    sample = asked.orderBy(F.xxhash64("v", "label"), "v", "label").limit(SAMPLE).select("v").collect()
    drawn: dict[int, list] = {}
    for (v,) in sample:
        drawn.setdefault(len(v), []).append(v)
    wanted = max(1, min(MOST_PIVOTS, n_anchors // cell_anchors))
    cells = Cells({dim: place_pivots(np.array(vs).reshape(len(vs), dim), max(1, wanted * len(vs) // len(sample))) for dim, vs in drawn.items()}, float(square))

    order = Window.partitionBy("label", "v").orderBy("id")
    few = rows.select("v", "label", "id").withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= k)
    entries = few.groupBy("label", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("v", "ids", "label", bucket, F.size("v").alias("dim"))
    entries = common.cut_lineage(with_cells(entries, cells, False))
    asked = common.cut_lineage(with_cells(asked, cells, True))

    pairs = f"anchor {id_type}, v array<int>, label {label_type}, positive_id {id_type}, score long"

    def find_positives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(anchors) and len(candidates):
            x, ids = matrix(candidates.column("v")), candidates.column("ids").to_pylist()
            labels, own = np.array(candidates.column("label").to_pylist(), dtype=object), anchors.column("label").to_pylist()
            names, q = anchors.column("anchor").to_pylist(), matrix(anchors.column("v"))
            step = max(1, PRODUCTS // len(x))
            for start in range(0, len(q), step):
                for i, scores in enumerate(products(q[start : start + step], x), start):
                    for s, other in ordered(scores, np.flatnonzero(labels == own[i]), ids, positives, names[i]):
                        out[0].append(i)
                        out[1].append(other)
                        out[2].append(s)
        kept = anchors.select(["anchor", "v", "label"]).take(pa.array(out[0], pa.int64()))
        return kept.append_column("positive_id", pa.array(out[1], anchors.schema.field("anchor").type)).append_column("score", pa.array(out[2], pa.int64()))

    def first_positives(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("anchor", "label", "v").orderBy(F.desc("score"), "positive_id"))
        return found.withColumn("p", rank).where(F.col("p") <= positives)

    def reaches(anchors: DataFrame, by_bucket: bool) -> dict[tuple[int, int, int], tuple[float, float]]:
        """Bounds of each cell from its anchors' ``need`` (the smallest product that still counts; null: any)."""
        far = F.sqrt(F.greatest(F.aggregate("v", F.lit(float(square)), lambda s, x: s + x.cast("double") * x.cast("double")) - 2.0 * F.col("need"), F.lit(0.0)))
        far = F.when(F.col("need").isNull(), float("inf")).otherwise(far)
        group = F.col("bucket") if by_bucket else F.lit(0).alias("bucket")
        bounds = anchors.groupBy("dim", "home", group).agg(F.max("away").alias("radius"), F.max(far).alias("reach")).collect()
        return {(r.dim, r.home, r.bucket): (r.radius, r.reach) for r in bounds}

    same = ["anchor", "label", "v"]
    # Positives: the own cell first, then what its products leave possible.
    near = common.cut_lineage(first_positives(joined(entries.withColumn("cell", F.col("home")), asked, True, find_positives, pairs)))
    known = near.groupBy(*same).agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("need"))
    bounded = asked.join(known.hint("merge"), same, "left")
    sent = common.cut_lineage(served(entries, cells, reaches(bounded, True), True, False))
    more = joined(sent, asked, True, find_positives, pairs)
    chosen = common.cut_lineage(first_positives(near.drop("p").unionByName(more)))

    # Negatives: what a positive score allows is known from the start.
    held = chosen.where("score >= 0").groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("p", "positive_id", "score"))).alias("own"), F.min("score").alias("low"))
    asking = common.cut_lineage(asked.join(held.hint("merge"), same).withColumn("need", F.floor(F.col("low").cast("double") * (top / bottom)) - 1))
    sent = common.cut_lineage(served(entries, cells, reaches(asking, False), False, True))
    triples = f"anchor {id_type}, v array<int>, label {label_type}, p int, positive_id {id_type}, positive_score long, negative_id {id_type}, score long"

    def find_negatives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        at, out = [], []
        if len(anchors) and len(candidates):
            x, ids = matrix(candidates.column("v")), candidates.column("ids").to_pylist()
            labels, label_of = np.array(candidates.column("label").to_pylist(), dtype=object), anchors.column("label").to_pylist()
            own, q = anchors.column("own").to_pylist(), matrix(anchors.column("v"))
            step = max(1, PRODUCTS // len(x))
            for start in range(0, len(q), step):
                for i, scores in enumerate(products(q[start : start + step], x), start):
                    # Whole numbers beyond 2^62 / bottom are rare and Python's own are exact.
                    lows = [-(-top * o["score"] // bottom) for o in own[i]]
                    some = np.flatnonzero((scores >= min(lows)) & (scores <= max(o["score"] for o in own[i])))
                    some = some[labels[some] != label_of[i]]
                    for o, low in zip(own[i], lows, strict=True):
                        fit = some[(scores[some] >= low) & (scores[some] <= o["score"])]
                        for s, other in ordered(scores, fit, ids, negatives):
                            at.append(i)
                            out.append((o["p"], o["positive_id"], o["score"], other, s))
        kept = anchors.select(["anchor", "v", "label"]).take(pa.array(at, pa.int64()))
        kinds = [pa.int32(), anchors.schema.field("anchor").type, pa.int64(), anchors.schema.field("anchor").type, pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * 5
        for name, column, kind in zip(("p", "positive_id", "positive_score", "negative_id", "score"), columns, kinds, strict=True):
            kept = kept.append_column(name, pa.array(column, kind))
        return kept

    found = joined(sent, asking.select(*(c for c in asking.columns if c not in ("low", "need", "away"))), False, find_negatives, triples)
    rank = F.row_number().over(Window.partitionBy("anchor", "label", "v", "p").orderBy(F.desc("score"), "negative_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
