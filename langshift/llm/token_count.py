"""Token counts of texts of any length, by overlap resynchronisation.

A text longer than a chunk is encoded by the library in overlapping chunks with offsets. In the overlap of
two chunks lies an edge at which the tokenizer's words part whatever stands around it; if both encodings
have the end of a token exactly there, the left one counts up to it and the right one from it on, which
is what the library counts over the whole text. If there is no such edge in the overlap, or the encodings
don't agree on it, the left chunk is encoded again with a wider overlap.

That an edge is stable is proven for tokenizers whose parts are known (see ``parts_known``). Texts of any
other tokenizer go to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Word patterns of which no match holds a character other than white space and, right after
#: it, white space.
WORD_PATTERNS = [
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
]

#: Texts that the library encodes at once.
TOGETHER = 16


def state(part) -> dict | None:
    return None if part is None else json.loads(part.__getstate__())


def parts_known(library) -> bool:
    """Whether ``common.BLANK_EDGE`` parts the words of this tokenizer wherever it matches: normalisers that
    leave white space white space and don't compose across it, words by a pattern of ``WORD_PATTERNS``, and
    no added token with white space inside."""

    def normaliser(s: dict | None) -> bool:
        if s is None or s["type"] in ("NFC", "NFD", "Lowercase"):
            return True
        if s["type"] == "Sequence":
            return all(map(normaliser, s["normalizers"]))
        return s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "

    def words(s: dict | None) -> bool:
        if s is None:
            return False
        if s["type"] == "Sequence":
            return words(s["pretokenizers"][0])
        if s["type"] == "Split":
            return s["pattern"].get("Regex") in WORD_PATTERNS
        return s["type"] == "ByteLevel" and s["use_regex"]

    added = (token.content for token in library.get_added_tokens_decoder().values())
    return normaliser(state(library.normalizer)) and words(state(library.pre_tokenizer)) and not any(c.isspace() for content in added for c in content)


class Counter:
    """Counts the tokens of texts with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.stable = parts_known(self.library)

    def ends(self, chunk: str) -> np.ndarray:
        """Where each token ends, in characters."""
        return np.array([end for _, end in self.library.encode(chunk, add_special_tokens=False).offsets], dtype=np.int64)

    def counts(self, texts: list[str], size: int, overlap: int) -> list[int]:
        found = [0] * len(texts)
        short = [k for k, text in enumerate(texts) if len(text) <= size or not self.stable]
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            for k, encoded in zip(some, self.library.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                found[k] = len(encoded)
        for k in set(range(len(texts))).difference(short):
            found[k] = self.long(texts[k], size, overlap)
        return found

    def long(self, text: str, size: int, overlap: int) -> int:
        total, start, stop, counted = 0, 0, size, 0
        left = self.ends(text[:size])
        while stop < len(text):
            wide, following = overlap, max(start, stop - overlap)
            next_stop = min(len(text), following + size)
            right = self.ends(text[following:next_stop])
            while (edge := self.splice(text, start, left, stop, following, right)) is None:
                # Widen: the left chunk reaches further, until the whole rest belongs to it.
                stop = min(len(text), stop + wide)
                left = self.ends(text[start:stop])
                if stop == len(text):
                    return total + len(left) - counted
                wide *= 2
                if stop >= next_stop:
                    next_stop = min(len(text), stop + size)
                    right = self.ends(text[following:next_stop])
            total += int(np.searchsorted(left, edge - start, side="right")) - counted
            counted = int(np.searchsorted(right, edge - following, side="right"))
            left, start, stop = right, following, next_stop
        return total + len(left) - counted

    @staticmethod
    def splice(text: str, start: int, left: np.ndarray, stop: int, following: int, right: np.ndarray) -> int | None:
        """The first edge in the overlap at which both chunks end a token."""
        for found in common.BLANK_EDGE.finditer(text, following + 1, stop):
            edge = found.start()
            if all(at < len(ends) and ends[at] == wanted for ends, wanted in ((left, edge - start), (right, edge - following)) for at in [int(np.searchsorted(ends, wanted))]):
                return edge
        return None


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    chunk_chars: int = 8192,
    overlap_chars: int = 256,
) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) for each whole text.

    Null and empty text: 0, 0 and false. Null and repeated ids are carried along; no rows: none out. A text
    of any length is encoded in chunks of ``chunk_chars`` characters (more where nothing parts its words).
    Other columns are not read. There is no shuffle; a task holds one batch of texts and one chunk's tokens.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = counter(tokenizer_path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = own.counts(texts, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
