"""Language by rank-order profiles.

A profile is the list of the most frequent n-grams (one to three bytes of letters,
words bounded by a blank). A text's own most frequent n-grams are compared with
each language profile by the out-of-place distance: the sum over its n-grams of
the difference in rank, ``TOP`` where the profile lacks the n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlake.llm import bytetext
from basketlake.llm.common import in_fold

TOP = 300
UNKNOWN = "und"

_LETTER = np.array([0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80 for b in range(256)])
_FOLD = np.where(_LETTER, bytetext.LOWER, 0x20).astype(np.uint64)
_CODE_BITS, _COUNT_BITS = 26, 20


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every n-gram; a text is bounded by blanks."""
    lengths = np.diff(offsets)
    n = len(lengths)
    wide = np.full(len(data) + n + 1, 0x20, dtype=np.uint64)
    row = np.repeat(np.arange(n), lengths)
    wide[np.arange(len(data)) + row + 1] = _FOLD[data]
    owner = np.concatenate(([0], np.repeat(np.arange(n), lengths + 1)))
    full = wide != 0x20
    one = np.flatnonzero(full)
    two = np.flatnonzero(full[:-1] | full[1:])
    three = np.flatnonzero(full[1:-1] & (full[:-2] | full[2:]))
    pair = (wide[:-1] << np.uint64(8)) | wide[1:]
    triple = (pair[:-1] << np.uint64(8)) | wide[2:]
    rows = np.concatenate((owner[one], np.where(full[two], owner[two], owner[two + 1]), owner[three + 1]))
    codes = np.concatenate((wide[one], pair[two] | np.uint64(1 << 24), triple[three] | np.uint64(2 << 24)))
    return rows.astype(np.uint64), codes


def gram_counts(data, offsets):
    """(row, code, count), sorted by row and code."""
    rows, codes = gram_codes(data, offsets)
    keys = np.sort((rows << np.uint64(_CODE_BITS)) | codes)
    if not len(keys):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    lead = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(lead, len(keys)))
    keys = keys[lead]
    return (keys >> np.uint64(_CODE_BITS)).astype(np.int64), (keys & np.uint64((1 << _CODE_BITS) - 1)).astype(np.int64), counts


def _language_counts(batches):
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        languages, index = names.dictionary, names.indices.to_numpy(zero_copy_only=False)
        found = []
        for row0, data, offsets in bytetext.blocks(batch.column(1)):
            rows, codes, counts = gram_counts(data, offsets)
            keys = (index[row0 + rows].astype(np.int64) << _CODE_BITS) | codes
            keys, at = np.unique(keys, return_inverse=True)
            found.append((keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)))
        if found:
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                languages.take(pa.array(keys >> _CODE_BITS)), pa.array(keys & ((1 << _CODE_BITS) - 1)), pa.array(total)],
                names=["lang", "code", "n"])


def profiles(texts: DataFrame) -> DataFrame:
    """(lang, code, place): the TOP n-grams of each language of ``texts(lang, text)``, all rows counted."""
    counts = (texts.where("lang is not null and text is not null").select("lang", "text")
              .mapInArrow(_language_counts, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < TOP).select("lang", "code", "place")


class Profiles:
    """Rank table: one row per known n-gram, one column per language."""

    def __init__(self, rows):
        self.languages = sorted({r["lang"] for r in rows})
        at = {name: i for i, name in enumerate(self.languages)}
        self.codes = np.unique(np.array([r["code"] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), TOP, dtype=np.int32)
        for r in rows:
            self.ranks[np.searchsorted(self.codes, r["code"]), at[r["lang"]]] = r["place"]
        self.known = len(self.ranks) - 1

    def distances(self, data, offsets):
        """(distance to each language, n-grams compared) per row."""
        n = len(offsets) - 1
        rows, codes, counts = gram_counts(data, offsets)
        rows, codes = by_count(rows, codes, counts)
        first = np.searchsorted(rows, np.arange(n))
        place = np.arange(len(rows)) - first[rows]
        top = place < TOP
        rows, codes, place = rows[top], codes[top], place[top]
        near = np.minimum(np.searchsorted(self.codes, codes), max(0, self.known - 1))
        near = np.where(self.codes[near] == codes, near, self.known) if self.known else near
        apart = np.where(near[:, None] == self.known, TOP, np.abs(self.ranks[near] - place[:, None]))
        out = np.stack([np.bincount(rows, weights=np.minimum(apart[:, j], TOP), minlength=n) for j in range(len(self.languages))], axis=1)
        return out, np.bincount(rows, minlength=n)


def by_count(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes by row, then commonest first, then code."""
    top = (1 << _COUNT_BITS) - 1
    if counts.max(initial=0) > top:  # a count that does not fit beside row and code in one number
        order = np.lexsort((codes, -counts, rows))
        return rows[order], codes[order]
    keys = np.sort((((rows << _COUNT_BITS) | (top - counts)) << _CODE_BITS) | codes)
    return keys >> (_COUNT_BITS + _CODE_BITS), keys & ((1 << _CODE_BITS) - 1)


def _has_letter(raw: bytes) -> bool:
    if any(0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A for b in raw[:64]):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            labels, scores = [], []
            for _, data, offsets in bytetext.blocks(batch.column(2)):
                n = len(offsets) - 1
                if not model.languages:
                    labels += [UNKNOWN] * n
                    scores += [0.0] * n
                    continue
                apart, compared = model.distances(data, offsets)
                best = np.argmin(apart, axis=1)
                score = 1.0 - apart[np.arange(n), best] / (TOP * np.maximum(compared, 1))
                for i in range(n):
                    lettered = compared[i] > 0 and _has_letter(data[offsets[i]: offsets[i + 1]].tobytes())
                    labels.append(model.languages[best[i]] if lettered else UNKNOWN)
                    scores.append(float(score[i]) if lettered else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``documents(doc_id, text, lang)``.

    Profiles are learned from all rows outside the held-out fold with text and lang;
    rows without doc_id belong to neither side. ``score`` is one minus the distance
    over the largest possible one. Null, empty and letterless texts are ``und`` with
    score 0, as is everything when nothing could be learned; equal distances give the
    first language by name. Rows that repeat repeat their result; other columns are ignored.
    """
    docs = documents.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"),
                            F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learned = profiles(docs.where("not held_out and doc_id is not null"))
    shared = documents.sparkSession.sparkContext.broadcast(Profiles(learned.collect()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
