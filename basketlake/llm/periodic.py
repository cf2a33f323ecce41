"""Runs of repeated words: minimizers at several scales seed exact extensions.

A run of period q is a stretch of at least ``max(6, 4 q)`` words in which words q
apart are identical, q is the smallest such distance, and neither neighbour can join.

Periods up to ``LAGS`` are found by comparing the words with themselves at each lag.
Longer ones go by scales k = 16, 32, ...: scale k finds the periods in (k/2, k]. Each
place gets a hash of the k words from it on; a place is kept where its hash is the
least of some window of k/2 places. In a run of such a period, windows q apart hold the
same hashes, the first window lies whole within one period, and k words >= one period
repeat at no shorter distance (else q were not the smallest). So two neighbouring
equal minimizers stand exactly q apart, and no run is missed. Every such pair is only a
seed: it is extended word by word in both directions, and the result is held against
the definition. Random text yields hardly any seeds; all work but the extensions is a
few vector operations per scale over a block of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm.bytetext import mix

LAGS = 8                 # periods up to here are scanned lag by lag; a power of two
LEAST = 6                # words of the shortest run
TIMES = 4                # periods of the shortest run
BLOCK_WORDS = 1 << 17    # documents are joined to blocks of about so many words

_SALT = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """No divisor of ``period`` is a period too; the stretch holds two periods at least."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            p = period // factor
            if (words[start: start + period] == words[start + p: start + p + period]).all():
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _long_enough(matches: int, period: int) -> bool:
    return matches + period >= max(LEAST, TIMES * period)


def _by_lag(words: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    """(start, matches) of the stretches of one period."""
    same = np.zeros(len(words) - period + 2, dtype=np.int8)
    same[1:-1] = words[period:] == words[:-period]
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[::2], edges[1::2]
    for i in np.flatnonzero(ends - starts + period >= max(LEAST, TIMES * period)):
        yield int(starts[i]), int(ends[i] - starts[i])


def _sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """Least or greatest of each window of ``width`` (a power of two) values."""
    step = 1
    while step < width:
        values = op(values[:-step], values[step:])
        step *= 2
    return values


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some window of ``width`` places."""
    least = _sliding(np.minimum, hashes, width)
    edge = np.zeros(width - 1, dtype=hashes.dtype)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, least, edge)), width) == hashes)


def _reach(words: np.ndarray, at: int, lag: int, way: int) -> int:
    """The farthest place from ``at`` on up to which words ``lag`` apart are identical."""
    step, top = 64, len(words) - lag
    while True:
        if way > 0:
            end = min(top, at + step)
            wrong = np.flatnonzero(words[at:end] != words[at + lag: end + lag])
            if len(wrong):
                return at + int(wrong[0])
        else:
            end = max(0, at - step)
            wrong = np.flatnonzero(words[end:at] != words[end + lag: at + lag])
            if len(wrong):
                return end + int(wrong[-1]) + 1
        if end in (0, top):
            return end
        at, step = end, step * 2


def runs_of(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start and period, of word codes (uint64).

    ``longest`` is the length of the longest document where ``words`` joins several.
    """
    n = len(words)
    most = (n if longest is None else longest) // TIMES
    found = []
    for period in range(1, min(LAGS, most, n - 1) + 1):
        found += [(s, m, period) for s, m in _by_lag(words, period)]
    hashes, size, k = mix(words + _SALT), 1, 2 * LAGS
    while k // 2 < most:
        while size < k:
            if len(hashes) <= size:
                return _checked(words, found)
            hashes = mix(hashes[:-size] + mix(hashes[size:] ^ _SALT))
            size *= 2
        if len(hashes) < k // 2:
            break
        places = _minimizers(hashes, k // 2)
        order = np.lexsort((places, hashes[places]))
        places = places[order]
        lag = np.diff(places)
        seeds = np.flatnonzero((np.diff(hashes[places]) == 0) & (lag > k // 2) & (lag <= min(k, most)))
        seeds = seeds[np.lexsort((places[seeds], lag[seeds]))]
        last, end = 0, 0
        for place, period in zip(places[seeds].tolist(), lag[seeds].tolist()):
            if period == last and place < end:
                continue
            last, end = period, _reach(words, place, period, 1)
            start = _reach(words, place, period, -1)
            if _long_enough(end - start, period):
                found.append((start, end - start, period))
        k *= 2
    return _checked(words, found)


def _checked(words: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = [(s, m + q, q) for s, m, q in found if _smallest(words, s, q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


def _true_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> bool:
    """The words themselves repeat, not only their 64-bit codes."""
    return all(words[s: s + n - q] == words[s + q: s + n] for s, n, q in runs)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    return b" ".join(map(words.__getitem__, kept.tolist()))


def _block_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each document of a block; a code of its own ends each document."""
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    codes = np.empty(starts[-1], dtype=np.uint64)
    for i, words in enumerate(texts):
        codes[starts[i]: starts[i + 1] - 1] = _codes(words)
    codes[starts[1:] - 1] = mix(np.arange(len(texts), dtype=np.uint64) + _SALT)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = runs_of(codes, int(lengths.max(initial=0)))
    docs = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
    for (start, length, period), doc in zip(found, docs.tolist()):
        out[doc].append((start - int(starts[doc]), length, period))
    for doc in set(docs.tolist()):
        if not _true_runs(texts[doc], out[doc]):  # two words of one code: number the words instead
            numbers: dict[bytes, int] = {}
            exact = [numbers.setdefault(w, len(numbers)) for w in texts[doc]]
            out[doc] = runs_of(mix(np.array(exact, dtype=np.uint64)))
    return out


def repeated_part(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's variant of a document: every tenth one repeats a part of itself.

    With h = crc32 of the id, documents with h % 10 = 0 repeat, from word a on, their
    next p words up to the end. A document without an id stays as it is.
    """
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a: a + p] * ((n - a) // p + 1))[: n - a]


def _scan(variant: Callable | None):
    schema = pa.schema([("doc_id", pa.int64()), ("runs", _ARROW_RUNS), ("collapsed", pa.string())])

    def flush(ids, texts):
        runs = _block_runs(texts)
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        kept = pa.array([_collapsed(w, r) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, _ARROW_RUNS), kept], schema=schema)

    def scan(batches):
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), column):
                raw = text.as_py()
                words = raw.split() if raw else []
                ids.append(doc_id)
                texts.append(variant(doc_id, words) if variant else words)
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield flush(ids, texts)
    return scan


def periodic_runs(docs: DataFrame, variant: Callable | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of each row: its runs and its text with repeats cut.

    Words are stretches without blank and the bytes 09-0D. ``runs`` lists (start,
    length, period) in words by start, then period. ``collapsed`` joins by one space the
    words that no run holds after its own first period. ``variant(doc_id, words)`` may
    change the words first. A null, empty or blank text has no runs and collapses to
    ''. Repeated rows and null ids each give a row of their own; further columns are not
    read. A task holds one block of words or the one longer document.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scan(variant), f"doc_id long, runs {RUNS}, collapsed string")


def run_digest(found: DataFrame) -> DataFrame:
    """One row per document of :func:`periodic_runs`: count, longest run and digests.

    The longest run is the one of the greatest length, then smallest start, then
    smallest period; without runs its four columns are null.
    """
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as start, r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-best.l * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
