"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (of all lengths in ``LENGTHS``) that both
have, over the geometric mean of how many each has: a blended-spectrum presence kernel. N-grams are
hashed into ``DIMS`` slots. A Nyström approximation over landmark texts gives features, on which one
ridge regression per language is solved. All of that is linear in a text's presence vector, so the
model folds into one matrix (slots x languages), and texts are scored by products of batches of
presence vectors with it.

Only presence vectors of a bounded sample reach the driver (``DIMS / 8`` bytes each); scoring reads
every whole text in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMS = 1 << 16
LENGTHS = (1, 2, 3, 4)
LETTER, NO_LETTERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")

#: The fit takes at most so many texts in all (or one of each language, if that is more), and of each
#: language; so many landmarks (or one of each language).
SAMPLE, SAMPLE_PER_LANGUAGE, LANDMARKS = 1024, 256, 256

#: With more labels than this the fit raises an error: the model has a column for each.
MOST_LANGUAGES = 4096
RIDGE = 1e-3

#: A text of a learned language has at least this value of its language, out of 1: on sf0.1 held-out labelled
#: texts had 0.30 or more, texts of unlearned languages and random letters 0.21 at most. Where more than
#: the share ``LOST`` of the labelled sample had less, the bound is lowered to what they have.
LEAST_VALUE, LOST = 0.25, 0.01


def presence(text: str, out: np.ndarray) -> bool:
    """Set the slots of the text's n-grams in ``out``. False if it has no letters (Unicode category L).

    Case is folded, and whatever is neither letter nor mark counts as one blank."""
    if not LETTER.search(text):
        return False
    letters = NO_LETTERS.sub(" ", text.lower()).strip()
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype="<u4")
    hashed = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        hashed = hashed[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in LENGTHS:
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            out[mixed >> np.uint32(16)] = 1
    return True


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMS x languages
    least: float = 0.0  # the best value that a text has to reach

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its share of the positive scores for presence vectors; 0 below ``least``."""
        values = rows @ self.weights / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        positive = np.maximum(values, 0)
        best = values.argmax(axis=1)
        total = positive.sum(axis=1)
        top = positive[np.arange(len(best)), best]
        return best, np.where((total > 0) & (top >= self.least), top / np.where(total > 0, total, 1), 0.0)


def unpacked(bits: list[bytes]) -> np.ndarray:
    """Presence vectors of unit length, one row for each packed vector."""
    rows = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8)).reshape(len(bits), DIMS).astype(np.float32)
    rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    return rows


def fit_model(bits: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Nyström kernel ridge regression, one against the rest, on packed presence vectors. None without
    texts. Only the landmarks are unpacked as a whole; the others pass by in blocks."""
    if not bits:
        return None
    languages = sorted(set(labels))
    # Landmarks: as many of each language, in the order of the sample.
    each, taken, chosen = max(1, landmarks // len(languages)), dict.fromkeys(languages, 0), []
    for row, label in zip(bits, labels, strict=True):
        if taken[label] < each:
            taken[label] += 1
            chosen.append(row)
    marks = unpacked(chosen)
    kernel = np.concatenate([unpacked(bits[k : k + 64]) @ marks.T for k in range(0, len(bits), 64)]).astype(np.float64)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    goal = np.array([[label == language for language in languages] for label in labels], dtype=np.float64)
    weight = (goal / goal.sum(axis=0)).sum(axis=1)  # languages with few texts count as much as those with many
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (goal * weight[:, None]))
    return Model(languages, marks.T @ (root @ beta).astype(np.float32))


def least_value(bits: list[bytes], labels: list[str]) -> float:
    """The bound of the best value: every fourth text is scored by a model of the others."""
    model = fit_model([b for k, b in enumerate(bits) if k % 4], [x for k, x in enumerate(labels) if k % 4])
    if model is None:
        return 0.0
    asked = bits[::4]
    values = np.concatenate([(unpacked(asked[k : k + 64]) @ model.weights).max(axis=1) for k in range(0, len(asked), 64)])
    return float(max(0.0, min(LEAST_VALUE, np.quantile(values, LOST))))


def presence_rows(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and bits (the packed presence vector) of each text with letters."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            bits = []
            for text in batch.column(len(keep)):
                row = np.zeros(DIMS, dtype=np.uint8)
                bits.append(np.packbits(row).tobytes() if presence(text.as_py() or "", row) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(bits, pa.binary())], [*keep, "bits"])

    return docs.select(*keep, text_col).mapInArrow(run, f"{fields}, bits binary").where("bits is not null")


def fit(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", bounded: bool = False) -> Model | None:
    """A model of the rows for which ``train`` holds and that have a label and an id.

    The fit is on a bounded sample: of each language the documents with the smallest hash of their id,
    ``SAMPLE_PER_LANGUAGE`` or ``SAMPLE`` over the number of languages, one at least, so that every label
    can be predicted. Rows that repeat an id and label count once: the one whose presence vector is the
    smallest as bytes, so that the same rows always give the same model. None if there is no such row.
    ``bounded``: the model has a bound of the best value (``least_value``).
    """
    rows = docs.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    counted = rows.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(MOST_LANGUAGES + 1).collect()
    if not counted:
        return None
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in {label_col}")
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // len(counted)))
    # Each language's share of ids below a bound on their hash: a few times as many as are taken, however
    # many there are, so that the ranking meets few rows.
    share = F.create_map(*(F.lit(x) for r in counted for x in (r[0], min(1.0, (4 * each + 64) / r["count"]))))
    place = F.shiftrightunsigned(F.xxhash64(id_col), 33)
    few = rows.where(place < F.element_at(share, F.col(label_col)) * float(1 << 31)).select(id_col, label_col, place.alias("_place"))
    order = F.dense_rank().over(Window.partitionBy(label_col).orderBy("_place", id_col))
    picked = few.withColumn("_n", order).where(F.col("_n") <= each).select(id_col, label_col).distinct().collect()
    # At most as many as the sample has texts.
    wanted = docs.sparkSession.createDataFrame(picked, rows.select(id_col, label_col).schema)
    sample = presence_rows(rows.join(F.broadcast(wanted), [id_col, label_col], "left_semi"), text_col, [id_col, label_col])
    found = sample.groupBy(id_col, label_col).agg(F.min("bits").alias("bits")).orderBy(place, id_col, label_col).collect()
    bits, labels = [bytes(r["bits"]) for r in found], [r[label_col] for r in found]
    model = fit_model(bits, labels)
    if bounded and model is not None:
        model.least = least_value(bits, labels)
    return model


def judge(texts: pa.Array, model: Model | None, rows: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``rows`` is the room for as many presence vectors as are scored
    at once."""
    best, score = [], []
    for start in range(0, len(texts), len(rows)):
        part = texts.slice(start, len(rows))
        rows[:] = 0
        letters = [presence(t.as_py() or "", rows[i]) for i, t in enumerate(part)]
        if model is None:
            best += ["und"] * len(part)
            score += [0.0] * len(part)
            continue
        which, share = model.score(rows[: len(part)])
        best += [model.languages[w] if ok else "und" for w, ok in zip(which.tolist(), letters, strict=True)]
        score += [float(s) if ok else 0.0 for s, ok in zip(share.tolist(), letters, strict=True)]
    return best, score


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", batch_rows: int = 64) -> DataFrame:
    """All columns of ``docs`` but the text, and lang_pred and score (0 to 1) of each whole text.

    ``und`` with score 0: null text, text without letters, or no model. Rows may repeat; no rows: none
    out. Columns named lang_pred or score are replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        rows = np.zeros((batch_rows, DIMS), dtype=np.float32)
        for batch in batches:
            best, score = judge(batch.column(len(keep)), model, rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, text_col).mapInArrow(run, f"{fields}lang_pred string, score double")


def held_out(id_column: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_score: float = 0.0) -> DataFrame:
    """The documents whose language is recognised, with all their columns: the prediction is not
    ``und``, the best language's value reaches the model's bound (which texts of unlearned languages and
    random letters don't), and it holds more than ``min_score`` of the positive scores. Without any
    labelled row there is no model, and nothing to reject by but missing letters."""
    model = fit(docs, ~held_out(F.col(id_col)), id_col=id_col, text_col=text_col, label_col=label_col, bounded=True)
    if model is None:
        return docs.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))

    # A predicate: the text goes to Python, and only a flag comes back.
    @F.arrow_udf("boolean")
    def recognised(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = np.zeros((64, DIMS), dtype=np.float32)
        for texts in batches:
            best, score = judge(texts, model, rows)
            yield pa.array([b != "und" and s > min_score for b, s in zip(best, score, strict=True)], pa.bool_())

    return docs.where(recognised(F.col(text_col)))
