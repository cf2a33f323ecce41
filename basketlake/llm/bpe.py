"""Byte-level BPE by a tree of joins: texts are encoded in halves, neighbours joined.

**Across matches of the pattern.** No match holds a non-blank followed by a blank, and
the pattern looks at nothing before its match. So a place between a non-blank and a
space or line feed is a boundary whatever stands around it: a text is cut at such
places near its middle, recursively, and the halves' ids are simply concatenated.

**Inside one long match** halves are encoded alone and joined: a window of ids round the
seam is encoded anew, and the window doubles on each side until what lies outside is
proven stable. The proof: merges run by rank, leftmost first; until a merge crosses the
border of two ids of a sequence, the bytes of each id develop as they would alone. Hence
a sequence of ids is the encoding of its bytes if and only if each neighbouring pair,
encoded alone, gives back that pair. Pairs within a half or within the window hold by
construction, so the two pairs at the window's edges decide.

Decoding concatenates the ids' bytes up the same kind of tree. The leaves (at most
``LEAF`` characters) are encoded by the tiktoken library with the given ranks.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 4096       # characters of a leaf of the tree
WINDOW = 16       # ids on each side of a seam that are encoded anew at first
OUT_BYTES = 1 << 22  # about so many bytes of results are held before they leave a task

#: A non-blank before a space or line feed; Python's blanks include all of the pattern's.
_SURE = re.compile(r"\S[ \n]")


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.plain = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = dict(map(reversed, self.ranks.items()))
        self.pair_stands = lru_cache(maxsize=1 << 16)(self._pair_stands)

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint32) of a whole text."""
        parts: list[np.ndarray] = []
        self._halves(text, 0, len(text), parts)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode_ordinary(text), dtype=np.uint32)

    def _halves(self, text: str, start: int, end: int, parts: list[np.ndarray]) -> None:
        if end - start <= LEAF:
            parts.append(self._leaf(text[start:end]))
            return
        cut = _sure_cut(text, start, end)
        if cut is not None:
            self._halves(text, start, cut, parts)
            self._halves(text, cut, end, parts)
            return
        for match in self.pattern.finditer(text[start:end]):
            piece = match.group()
            parts.append(self._leaf(piece) if len(piece) <= LEAF else self._match(piece))

    def _match(self, piece: str) -> np.ndarray:
        """Ids of one long match; any part of it is one match as well."""
        if len(piece) <= LEAF:
            return self._leaf(piece)
        middle = len(piece) // 2
        return self.join(self._match(piece[:middle]), self._match(piece[middle:]))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Encoding of the concatenated bytes of two encodings within one match."""
        before = after = WINDOW
        while True:
            start, end = max(0, len(left) - before), min(len(right), after)
            while start > 0 and self._inside(left[start]):
                start -= 1
            while end < len(right) and self._inside(right[end]):
                end += 1
            middle = self._leaf((self.decode(left[start:]) + self.decode(right[:end])).decode())
            left_stands = start == 0 or self.pair_stands(int(left[start - 1]), int(middle[0]))
            right_stands = end == len(right) or self.pair_stands(int(middle[-1]), int(right[end]))
            if left_stands and right_stands:
                return np.concatenate((left[:start], middle, right[end:]))
            before *= 1 if left_stands else 2
            after *= 1 if right_stands else 2

    def _inside(self, token: int) -> bool:
        """The id begins within a character."""
        return 0x80 <= self.bytes_of[int(token)][0] < 0xC0

    def _pair_stands(self, first: int, second: int) -> bool:
        a, b = self.bytes_of[first], self.bytes_of[second]
        parts = [bytes([value]) for value in a + b]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(x + y, len(self.ranks) + (1 << 32)), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts == [a, b]


def _sure_cut(text: str, start: int, end: int) -> int | None:
    """A sure boundary inside, looked for from the middle outwards in doubling steps."""
    middle, step = (start + end) // 2, 64
    while True:
        low, high = max(start, middle - step), min(end, middle + step)
        match = _SURE.search(text, low, high)
        if match:
            return match.start() + 1
        if (low, high) == (start, end):
            return None
        step *= 4


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """The codec of a rank file, once per Python worker."""
    return Codec(ranks_path, pattern)


def _per_row(name: str, convert):
    """Batches (doc_id, value) to batches (doc_id, ``name`` binary) of bounded size."""
    def run(batches):
        for batch in batches:
            ids, out, held, first = batch.column(0), [], 0, 0
            for i, value in enumerate(batch.column(1)):
                out.append(convert(value.as_py()))
                held += len(out[-1])
                if held >= OUT_BYTES or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(out)), pa.array(out, pa.binary())], ["doc_id", name])
                    out, held, first = [], 0, i + 1
    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each row: ids of the whole text as packed little-endian uint32.

    The same ids as the tiktoken library gives for the rank file without special tokens.
    A null or empty text has no ids (an empty value). Repeated rows and null ids each
    give a row of their own; further columns are not read. A task holds one document and
    about ``OUT_BYTES`` of results.
    """
    def convert(text):
        return codec(ranks_path, pattern).encode(text or "").astype("<u4").tobytes()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_per_row("ids", convert), "doc_id long, ids binary")


def decoded(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of each row of ``tokens(doc_id, ids)``: the bytes of the ids.

    Null ids decode to no bytes; an id that the rank file lacks is an error.
    """
    def convert(ids):
        return codec(ranks_path, pattern).decode(np.frombuffer(ids or b"", dtype="<u4"))
    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_per_row("decoded", convert), "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row: encoded, and decoded again from the ids."""
    def both(batches):
        use = codec(ranks_path, pattern)
        for batch in _per_row("ids", lambda text: use.encode(text or "").astype("<u4").tobytes())(batches):
            back = [use.decode(np.frombuffer(ids.as_py(), dtype="<u4")) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(both, "doc_id long, ids binary, decoded binary")


def token_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``."""
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
