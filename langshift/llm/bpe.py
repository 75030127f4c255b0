"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are short, the parts are encoded, and neighbours are joined on the
way up. A join encodes a window around the seam again and widens it until the tokens outside can no
longer change:

* between texts, both ends of the window are edges at which every scan with the word pattern has a
  boundary, whatever follows or precedes. Words on either side of such an edge are encoded apart, so
  tokens outside the window are those of the whole text;
* inside one long word, the tokens next to both ends of the window form pairs that encode to
  themselves. A row of BPE tokens is the encoding of its bytes exactly if this holds for each pair
  of neighbours, and all other pairs are unchanged.

Decoding concatenates the bytes up the same kind of tree.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of the pattern: a letter before an ASCII non-letter, a digit before an ASCII non-digit and
#: a visible character before a blank are never inside one match.
EDGE = re.compile(r"(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])|(?<=[!-~¡-ᙿ、-퟿])(?=[ \n\r\t])")


class TreeCodec:
    def __init__(self, encoding, pattern: str, leaf: int = 2048):
        self.encoding, self.pattern, self.leaf = encoding, pattern, leaf
        self.piece = encoding._encode_single_piece
        self.bytes_of = encoding.token_byte_values()
        self.lengths = np.zeros(encoding.max_token_value + 1, dtype=np.int64)
        for token in self.bytes_of:
            self.lengths[encoding.encode_single_token(token)] = len(token)

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return np.array(self.encoding.encode_ordinary(text[lo:hi]), dtype="<u4")
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of ``text[lo:hi]`` from those of its halves."""
        width = 16
        while True:
            begin, end = max(lo, mid - width), min(hi, mid + width)
            before = [m.start() for m in EDGE.finditer(text, begin, mid + 1) if m.start() > lo]
            after = EDGE.search(text, mid, end)
            if (before or begin == lo) and (after or end == hi):
                break
            width *= 2
        begin, end = before[-1] if before else lo, after.start() if after else hi
        window = self.window(text[begin:end])
        keep = self.split(left[::-1], len(text[begin:mid].encode()))
        skip = self.split(right, len(text[mid:end].encode()))
        return np.concatenate([left[: len(left) - keep], window, right[skip:]])

    def split(self, tokens: np.ndarray, n_bytes: int) -> int:
        """How many of the first tokens make up ``n_bytes``."""
        take = min(len(tokens), n_bytes)
        at = int(np.searchsorted(np.cumsum(self.lengths[tokens[:take]]), n_bytes, side="left")) + 1 if n_bytes else 0
        assert int(self.lengths[tokens[:at]].sum()) == n_bytes, "an edge lies inside a token"
        return at

    def window(self, text: str) -> np.ndarray:
        if len(text) <= 2 * self.leaf:
            return np.array(self.encoding.encode_ordinary(text), dtype="<u4")
        import regex

        return np.concatenate([self.word(m[0].encode()) for m in regex.finditer(self.pattern, text)])

    def word(self, data: bytes) -> np.ndarray:
        """The tokens of one match of the pattern, however long."""
        if len(data) <= self.leaf:
            return np.array(self.piece(data), dtype="<u4")
        mid = len(data) // 2
        left, right, k = self.word(data[:mid]), self.word(data[mid:]), 4
        while True:
            a, b = left[max(0, len(left) - k) :], right[:k]
            window = self.piece(b"".join(map(self.encoding.decode_single_token_bytes, [*a.tolist(), *b.tolist()])))
            if (k >= len(left) or self.stable(left[-k - 1], window[0])) and (k >= len(right) or self.stable(window[-1], right[k])):
                return np.concatenate([left[: max(0, len(left) - k)], np.array(window, dtype="<u4"), right[k:]])
            k *= 2

    def stable(self, a: int, b: int) -> bool:
        token = self.encoding.decode_single_token_bytes
        return self.piece(token(int(a)) + token(int(b))) == [a, b]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


#: What ``encode_decode`` can give out, with Spark's types.
OUTPUTS = {"ids": "array<long>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_decode(
    docs: DataFrame,
    *,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "n_tokens"),
    leaf: int = 2048,
) -> DataFrame:
    """Encode each whole text, and decode its ids where an output asks for it: ``id_col`` and ``outputs``.

    ``outputs``: of ``OUTPUTS``. ids_sha256 is over little-endian unsigned 32-bit ids, decoded_sha256
    over the decoded bytes; both in lower-case hex. Special strings are ordinary text.

    Null and empty text: no ids, the digests of nothing. Null and repeated ids are carried along. No
    rows: none out. Other columns are not read. There is no shuffle; a task holds one text at a time.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = {"ids": pa.list_(pa.int64()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}

    def run(batches):
        codec = TreeCodec(common.rank_encoding(ranks_path, pattern), pattern, leaf)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                row = {"ids": ids, "n_tokens": len(ids)}
                if "ids_sha256" in outputs:
                    row["ids_sha256"] = hashlib.sha256(ids.tobytes()).hexdigest()
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    row["decoded"] = codec.decode(ids)
                    row["decoded_sha256"] = hashlib.sha256(row["decoded"]).hexdigest()
                rows.append(tuple(row[k] for k in outputs))
            columns = zip(*rows, strict=True) if rows else [[] for _ in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), kinds[k]) for k, c in zip(outputs, columns, strict=True))], [id_col, *outputs])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))


def decode(encoded: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", leaf: int = 2048) -> DataFrame:
    """``id_col`` and ``text``: the text of each row of ids. Null ids count as none; bytes that are no
    UTF-8 become the replacement character."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = TreeCodec(common.rank_encoding(ranks_path, pattern), pattern, leaf)
        for batch in batches:
            texts = [codec.decode(np.array(ids.as_py() or [], dtype="<u4")).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {id_type}, text string")
