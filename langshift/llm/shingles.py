"""Near-duplicates by the similarity of shingle sets, found through SimHash with covering hashing.

The similarity of two texts is the Jaccard index of their sets of word shingles. Fingerprints of the sets
(``simhash``: a bit is 1 if set in over half of a set's hashes) meet in the covering tables of ``RADIUS``, so that no two
within that many bits are missed, and the texts that meet are linked where their sets are similar enough.

Fingerprints of similar sets can differ in more bits (some ten at a Jaccard index of 0.8), and a covering family of that
radius would have thousands of tables. Prefix filtering is the exact way for these, between the components that the
fingerprints leave: no similar pair is missed. All sets are put in one order of shingles. Two sets that are similar enough share a shingle among the first
``n - ceil(similarity * n) + 1`` of each, whatever the order is, so that the texts that share a shingle
of these prefixes hold every pair, and none is missed. The order has shingles last that many texts of a
sample have; that only decides how many pairs are compared. Each pair that is linked has been compared
by its whole sets of 64-bit hashes.

Whole sets travel for few pairs only. A pair is first held against a bound by small histograms of both
sets (how many members each of some ranges of hashes has: the overlap can't be larger than the sum of the
smaller counts). Then each text is compared with the first of its partners alone; whatever is linked
by that needs no other link, so that a group of copies costs as many comparisons as it has members. The
pairs that lie in different components afterwards are compared as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Texts that are counted for the order of shingles, about; from how many of them a shingle is a frequent
#: one; how many of these the order holds.
SAMPLE, FREQUENT, ORDERED = 4096, 3, 50_000

#: Texts that share a prefix shingle are paired in place up to so many; above, they meet with their sets.
PAIRED = 128

#: Texts of a shingle that one task compares. More are dealt into blocks.
BLOCK = 2048

#: No partner: larger than any fp.
NONE = np.iinfo(np.int64).max

#: Bits in which the fingerprints of texts that meet in the covering tables differ at most. It decides who finds a
#: link, never whether it is found.
RADIUS = 4

#: Bits of the map of the documents whose sets are compared.
SLOTS = 1 << 22


def shingle_set(text: str, shingle_words: int) -> np.ndarray:
    """The sorted hashes of the text's shingles; a text of fewer words is one shingle, one without words none."""
    import xxhash

    words = simhash.WORD.findall(text.encode().translate(simhash.LOWER))
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle_words + 1)
    starts, ends = np.concatenate([[0], ends[: n - 1] + 1]).tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n))


def frequent(docs: DataFrame, total: int, *, id_col: str, text_col: str, shingle_words: int) -> np.ndarray:
    """Shingles that several texts of a sample have, sorted: at most ``ORDERED``, the most frequent."""

    def run(batches):
        for batch in batches:
            held = [shingle_set(t.as_py() or "", shingle_words).view(np.int64) for t in batch.column(0)]
            found, counts = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["shingle", "texts"])

    sample = docs.where(F.pmod(F.xxhash64(id_col, F.lit("order")), F.lit(max(1, total // SAMPLE))) == 0).select(text_col)
    counted = sample.mapInArrow(run, "shingle long, texts long").groupBy("shingle").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= FREQUENT)
    top = counted.orderBy(F.desc("texts"), "shingle").limit(ORDERED).collect()
    return np.sort(np.array([r["shingle"] for r in top], dtype=np.int64).view(np.uint64))


def histogram(own: np.ndarray) -> bytes:
    """How many of the sorted hashes fall into each of equal ranges, whose number is the power of two at or above
    a quarter of the hashes, as bytes. Empty if one holds too many for a byte."""
    bits = max(4, (max(1, len(own)) - 1).bit_length() - 2)
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def overlap_bound(a: bytes, b: bytes) -> int | None:
    """What the overlap of two sets is at most, by their histograms; None if one has none."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, dtype=np.uint8).astype(np.int64), np.frombuffer(b, dtype=np.uint8).astype(np.int64)
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(axis=1), y.reshape(size, -1).sum(axis=1)).sum())


def prefixes(docs: DataFrame, last: np.ndarray, similarity: Fraction, *, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """``id_col``, fp (a hash of the whole shingle set), code (its SimHash fingerprint), n (its size), prefix (packed, in
    the order with the shingles of ``last`` at the end) and counts (its histogram) of each text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    top, bottom = similarity.numerator, similarity.denominator

    def run(batches):
        import xxhash

        for batch in batches:
            fps, codes, sizes, packed, counts = [], [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py() or "", shingle_words)
                n = len(own)
                late = np.isin(own, last)
                keep = n - -(-top * n // bottom) + 1 if n else 0
                fps.append(xxhash.xxh64_intdigest(own.tobytes()))
                codes.append(simhash.majority(own))
                sizes.append(n)
                packed.append(np.concatenate([own[~late], own[late]])[:keep].tobytes())
                counts.append(histogram(own))
            hashes = [pa.array(np.array(h, dtype=np.uint64).view(np.int64)) for h in (fps, codes)]
            columns = [batch.column(0), *hashes, pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "fp", "code", "n", "prefix", "counts"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, fp long, code long, n long, prefix binary, counts binary")


def covered_pairs(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src, dst: texts (fp; ``rows`` has one row for each, with code) whose fingerprints differ in at most ``radius`` bits.

    Links of the covering tables, which connect all fingerprints within the radius, as pairs of the fingerprints' smallest
    texts; and each text of a fingerprint with the smallest one."""
    codes = common.cut_lineage(rows.groupBy("code").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("texts")))
    edges = simhash.near_edges(codes.select(F.col("code").alias("fp")), radius).distinct()
    ends = [codes.select(F.col("code").alias(end), F.col("first").alias(f"{end}_fp")).hint("merge") for end in ("src", "dst")]
    between = edges.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_fp").alias("a"), F.col("dst_fp").alias("b"))
    shared = common.attach_group(rows.select("fp", "code"), codes.where("texts > 1"), "code", "texts", rows.count())
    pairs = between.unionByName(shared.where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")))
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose texts lie in different components."""
    for end in ("src", "dst"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    return pairs.where(F.coalesce("src_root", "src") != F.coalesce("dst_root", "dst")).select("src", "dst")


def entries(sets: DataFrame) -> DataFrame:
    """shingle, fp, n and place of the shingle, for each shingle of the prefixes."""

    def run(batches):
        for batch in batches:
            held = [np.frombuffer(p.as_py(), dtype=np.int64) for p in batch.column(2)]
            count = [len(p) for p in held]
            place = np.concatenate([np.arange(c) for c in count]) if count else np.empty(0, np.int64)
            columns = [np.concatenate(held) if held else np.empty(0, np.int64), np.repeat(batch.column(0).to_numpy(), count), np.repeat(batch.column(1).to_numpy(), count), place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "fp", "n", "place"])

    return sets.select("fp", "n", "prefix").mapInArrow(run, "shingle long, fp long, n long, place long")


def meetings(rows: DataFrame, similarity: Fraction) -> DataFrame:
    """src, dst, shingle. Without a shingle: a pair of texts that share one of their prefixes and may be
    similar, all for shingles of at most ``PAIRED`` texts, those with the smallest text for a more crowded
    one. With one: a text (src and dst) of a more crowded one.

    At the first shingle that a similar pair shares, what is left of both sets has to suffice for the
    overlap; a pair for which it doesn't is either not similar or found at an earlier shingle.
    """
    top, bottom, most, room = similarity.numerator, similarity.denominator, PAIRED, 16 * BLOCK

    def found(rows: np.ndarray):
        new = np.ones(len(rows), dtype=bool)
        new[1:] = rows[1:, 0] != rows[:-1, 0]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rows)))
        left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
            at = starts[sizes == size]
            a, b = np.triu_indices(size, 1)
            left.append((at[:, None] + a).ravel())
            right.append((at[:, None] + b).ravel())
        for start, size in zip(starts[sizes > most].tolist(), sizes[sizes > most].tolist(), strict=True):
            left.append(np.full(size, start + int(rows[start : start + size, 1].argmin())))
            right.append(np.arange(start, start + size))
        a, b = rows[np.concatenate(left)], rows[np.concatenate(right)]
        rest = np.minimum(a[:, 2] - a[:, 3], b[:, 2] - b[:, 3])
        may = (rest * (top + bottom) >= top * (a[:, 2] + b[:, 2])) & (a[:, 1] != b[:, 1])
        a, b = a[may, 1], b[may, 1]
        crowd = rows[np.repeat(sizes > most, sizes)]
        src, dst = np.concatenate([np.minimum(a, b), crowd[:, 1]]), np.concatenate([np.maximum(a, b), crowd[:, 1]])
        shingle = pa.array(np.concatenate([a, crowd[:, 0]]), mask=np.arange(len(src)) < len(a))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), shingle], ["src", "dst", "shingle"])

    def run(batches):
        rows, held = np.empty((0, 4), dtype=np.int64), []

        def joined():
            return np.concatenate([rows, *(np.stack([c.to_numpy() for c in b.columns], axis=1) for b in held)])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < room:
                continue
            rows, held = joined(), []
            differ = rows[:, 0] != rows[-1, 0]  # the last shingle may go on
            if end := int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0:
                yield found(rows[:end])
                rows = rows[end:]
        rows = joined()
        if len(rows):
            yield found(rows)

    parted = rows.repartition("shingle").sortWithinPartitions("shingle")
    return parted.mapInArrow(run, "src long, dst long, shingle long")


def wanted_sets(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """fp and shingles (the set, packed) of the documents whose id is in ``wanted`` and of few others.

    The ids go out as a bitmap of their hashes (``SLOTS`` bits): no text is shuffled, and an id that
    isn't asked for but shares a slot only gives a set too many."""
    slot = F.pmod(F.xxhash64(F.col(id_col), F.lit("wanted")), F.lit(SLOTS))
    words = wanted.select(slot.alias("s")).select((F.col("s") / 32).cast("long").alias("w"), F.expr("shiftleft(1L, cast(s % 32 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bitmap = np.zeros(SLOTS // 32, dtype=np.int64)
    for w, b in words:
        bitmap[w] = b
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.astype(np.uint32))

    def run(batches):
        import xxhash

        for batch in batches:
            at = batch.column(0).to_numpy()
            asked = np.flatnonzero(sent.value[at // 32] >> (at % 32).astype(np.uint32) & 1)
            packed = [shingle_set(batch.column(1)[k].as_py() or "", shingle_words).tobytes() for k in asked.tolist()]
            fps = np.array([xxhash.xxh64_intdigest(p) for p in packed], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(packed, pa.binary())], ["fp", "shingles"])

    return docs.select(slot.alias("slot"), F.col(text_col)).mapInArrow(run, "fp long, shingles binary").where(F.length("shingles") > 0)


def overlaps(one: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many members of ``one`` each of the sets has that follow each other in ``flat``."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def ends_of(pairs: DataFrame, end: str, rows: DataFrame) -> DataFrame:
    """``rows`` (fp and others) of the texts at one ``end`` of the pairs, and maybe others: up to ``SENT_KEYS`` ends
    are counted and go to every task, so that no other row is shuffled for the join that follows."""
    keys = pairs.select(F.col(end).alias("fp")).distinct()
    return rows.join(F.broadcast(keys), "fp", "left_semi") if keys.count() <= common.SENT_KEYS else rows


def possible(pairs: DataFrame, counts: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs that may be similar by their histograms."""
    top, bottom = similarity.numerator, similarity.denominator
    a = ends_of(pairs, "src", counts).select(F.col("fp").alias("src"), F.col("n").alias("m"), F.col("counts").alias("a"))
    b = ends_of(pairs, "dst", counts).select(F.col("fp").alias("dst"), "n", F.col("counts").alias("b"))

    def run(batches):
        for batch in batches:
            sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            bounds = [overlap_bound(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            may = [bound is None or bound * (top + bottom) >= top * size for bound, size in zip(bounds, sizes, strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(may, pa.bool_()))

    joined = pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
    return joined.select("src", "dst", "m", "n", "a", "b").mapInArrow(run, "src long, dst long")


def first_partners(pairs: DataFrame) -> DataFrame:
    """Of the pairs, each text's with the smallest of its partners."""
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("dst"))
    return least.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def mixed(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """shingle, fp and root of the crowds whose texts aren't all of one component; one of those with the
    same texts."""
    rooted = crowds.join(roots, crowds.fp == roots.node, "left").select("shingle", "fp", F.coalesce("root", "fp").alias("root"))
    members = F.sum(F.xxhash64("fp").cast("decimal(38,0)"))
    seen = rooted.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), members.alias("h"), (F.min("root") < F.max("root")).alias("mixed"))
    one = seen.where("mixed").groupBy("m", "h").agg(F.min("shingle").alias("shingle"))
    return rooted.join(one.select("shingle"), "shingle", "left_semi")


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """shingle, _lo, _hi, _b, fp and ``columns``: each crowd (shingle) in blocks (_b) of about ``BLOCK`` texts,
    and each row once for each pair of blocks (_lo, _hi) that its own is in."""
    crowds = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"))
    cut = rows.join(crowds, "shingle").withColumn("_n", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int"))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int"))
    cut = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return cut.select("shingle", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi"), "_b", "fp", *columns)


def partners(fps: np.ndarray, sizes: np.ndarray, counts: list[bytes], groups: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Of the sets of other groups that may be similar to each set by their histograms, the smallest fp; ``NONE``
    without any."""
    top, bottom = similarity.numerator, similarity.denominator
    found = np.full(len(sizes), NONE)
    order = np.argsort(sizes, kind="stable")
    lengths = np.array([len(c) for c in counts])
    # For each length, the histograms of that length and of the double, which is the next one that a partner can have.
    tables = {}
    for length in set(lengths.tolist()) - {0}:
        table = np.zeros((len(sizes), length), dtype=np.uint16)
        for k in np.flatnonzero((lengths == length) | (lengths == 2 * length)).tolist():
            table[k] = np.frombuffer(counts[k], dtype=np.uint8).reshape(length, -1).sum(axis=1)
        tables[length] = table[order]
    ordered, parts, known = sizes[order], groups[order], lengths[order]
    for i, k in enumerate(order.tolist()):
        end = int(np.searchsorted(ordered, ordered[i] * bottom // top, side="right"))
        at = np.flatnonzero(parts[i + 1 : end] != parts[i]) + i + 1
        if not len(at):
            continue
        near = np.ones(len(at), dtype=bool)
        if known[i]:
            bound = np.minimum(tables[known[i]][at], tables[known[i]][i]).sum(axis=1, dtype=np.int64)
            near = (bound * (top + bottom) >= top * (ordered[i] + ordered[at])) | (known[at] == 0) | (known[at] > 2 * known[i])
        others = order[at[near]]
        if len(others):
            found[others] = np.minimum(found[others], fps[k])
            found[k] = min(found[k], fps[others].min())
    return found


def worth_comparing(crowds: DataFrame, counts: DataFrame, similarity: Fraction) -> DataFrame:
    """shingle, fp of the texts that may be similar to a text of another component in their crowd, with the
    smallest such text as partner."""
    rows = dealt(crowds, "root").join(counts.hint("merge"), "fp").select("shingle", "_lo", "_hi", "_b", "fp", "root", "n", "counts")

    def find(table: pa.Table) -> pa.Table:
        found = partners(table.column("fp").to_numpy(), table.column("n").to_numpy(), table.column("counts").to_pylist(), table.column("root").to_numpy(), similarity)
        return table.select(["shingle", "fp"]).append_column("partner", pa.array(found)).filter(pa.array(found != NONE))

    found = rows.groupBy("shingle", "_lo", "_hi").applyInArrow(find, "shingle long, fp long, partner long")
    return found.groupBy("shingle", "fp").agg(F.min("partner").alias("partner"))


def checked(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs that are similar. Sets travel for the ends of the pairs alone; of first partners, one end is few texts."""
    top, bottom = similarity.numerator, similarity.denominator
    a = ends_of(pairs, "src", sets).select(F.col("fp").alias("src"), F.col("shingles").alias("a"))
    b = ends_of(pairs, "dst", sets).select(F.col("fp").alias("dst"), F.col("shingles").alias("b"))

    def run(batches):
        for batch in batches:
            similar = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (x, y))
                shared = int(overlaps(x, y, np.zeros(1, dtype=np.int64))[0])
                similar.append(shared * (top + bottom) >= top * (len(x) + len(y)))
            yield batch.select(["src", "dst"]).filter(pa.array(similar, pa.bool_()))

    joined = pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
    return joined.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def spanning(fps: list[int], sets: list[np.ndarray], side: np.ndarray | None, similarity: Fraction) -> Iterator[tuple[int, int]]:
    """Links that connect whatever all similar pairs (of different sides, if given) would connect."""
    top, bottom = similarity.numerator, similarity.denominator
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, sets = sizes[order], [sets[k] for k in order]
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    forest, left = simhash.Forest(len(sets)), len(sets) - 1
    for i in range(len(sets)):
        # Of sets that are larger, those up to 1 / similarity the size.
        end = int(np.searchsorted(sizes, sizes[i] * bottom // top, side="right"))
        if end <= i + 1 or not left:
            continue
        shared = overlaps(sets[i], flat[starts[i + 1] : starts[end]], starts[i + 1 : end] - starts[i + 1])
        near = shared * (top + bottom) >= top * (sizes[i] + sizes[i + 1 : end])
        if side is not None:
            near &= side[order[i + 1 : end]] != side[order[i]]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if forest.link(i, j):
                left -= 1
                yield fps[order[i]], fps[order[j]]


def crowded_edges(rows: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """src, dst: links among the texts (fp) of each crowded shingle, enough to connect all similar ones.
    Above ``BLOCK`` texts, each pair of blocks is compared in a task of its own."""
    held = dealt(rows).join(sets.select("fp", "shingles").hint("merge"), "fp")

    def compare(table: pa.Table) -> pa.Table:
        fps, block = table.column("fp").to_pylist(), table.column("_b").to_numpy()
        own = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
        same = table.column("_lo")[0].as_py() == table.column("_hi")[0].as_py()
        pairs = np.array(list(spanning(fps, own, None if same else block, similarity)), dtype=np.int64).reshape(-1, 2)
        return pa.table({"src": pairs[:, 0].copy(), "dst": pairs[:, 1].copy()})

    return held.groupBy("shingle", "_lo", "_hi").applyInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """``id_col`` and component_id for each document.

    Documents link when the Jaccard index of their shingle sets is at least ``similarity``; component_id
    is the smallest id that links lead to, the document's own included. Documents with the same set are
    one node of the search.

    Null and empty text, and text without words: one component. A null id never is a component_id
    unless all ids of the component are null. A text of any length is read whole, as one row of its task. No rows:
    none out. Other columns are not read.
    """
    own = {"id_col": id_col, "text_col": text_col, "shingle_words": shingle_words}
    total = docs.count()
    marks = common.cut_lineage(prefixes(docs, frequent(docs, total, **own), similarity, **own))
    nodes = common.cut_lineage(marks.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")))
    # One row for each set: that of its first document.
    firsts = nodes.select(F.struct(F.col("first_id").alias("id"), "fp").alias("first"))
    rows = marks.select("fp", "code", "n", "prefix", "counts", F.struct(F.col(id_col).alias("id"), "fp").alias("own"))
    rows = rows.join(firsts.hint("merge"), F.col("own") == F.col("first"), "left_semi")
    light = common.cut_lineage(rows.select("fp", "code", "n", "counts"))
    counts = light.select("fp", "n", "counts")  # read by five steps
    covered = common.cut_lineage(possible(covered_pairs(light.select("fp", "code")), counts, similarity))
    met = common.cut_lineage(meetings(entries(rows), similarity))
    crowds = met.where("shingle is not null").select("shingle", F.col("src").alias("fp"))
    met_pairs = common.cut_lineage(met.where("shingle is null").select("src", "dst").distinct())
    pairs = common.cut_lineage(possible(met_pairs, counts, similarity))
    ends = [rows.select(F.col(end).alias("fp")) for rows in (covered, pairs) for end in ("src", "dst")]
    asked = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).unionByName(crowds.select("fp")).distinct()
    wanted = nodes.join(asked, "fp", "left_semi").select(F.col("first_id").alias(id_col))
    sets = common.cut_lineage(wanted_sets(docs, wanted, **own))
    links = common.cut_lineage(checked(covered, sets, similarity))
    pairs = common.cut_lineage(apart(pairs, simhash.components(nodes, links)))
    first = common.cut_lineage(first_partners(pairs))
    links = common.cut_lineage(links.unionByName(checked(first, sets, similarity)))
    roots = simhash.components(nodes, links)
    rest = apart(pairs.join(first, ["src", "dst"], "left_anti"), roots)
    # Crowds whose texts lie in several components: again each text with its first partner before the rest.
    worth = common.cut_lineage(worth_comparing(mixed(crowds, roots), counts, similarity))
    second = worth.select(F.least("fp", "partner").alias("src"), F.greatest("fp", "partner").alias("dst")).unionByName(rest).distinct().join(first, ["src", "dst"], "left_anti")
    second = common.cut_lineage(second)
    links = common.cut_lineage(links.unionByName(checked(second, sets, similarity)))
    roots = simhash.components(nodes, links)
    left = common.cut_lineage(worth_comparing(mixed(worth.select("shingle", "fp"), roots), counts, similarity))
    roots = simhash.components(nodes, links.unionByName(crowded_edges(left.select("shingle", "fp"), sets, similarity)))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("fp", "copies", "component_id")
    return common.attach_group(marks.select(id_col, "fp"), named, "fp", "copies", total).select(id_col, "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The documents whose id is the smallest of their component, with all their columns. Rows that
    repeat that id are the same document and all stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, similarity=similarity)
    kept = F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("kept")
    gone = found.groupBy(id_col).agg(kept).where("not kept").select(F.struct(F.col(id_col).alias("id")).alias("gone"))
    return common.without(docs, F.struct(F.col(id_col).alias("id")), gone)
