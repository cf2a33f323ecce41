"""Benchmark decontamination by word windows.

Every run of ``WINDOW`` consecutive words of a benchmark item (a shorter item as a
whole) is a window. Windows are hashed; a document window whose hash is known is
compared word by word before it counts. The window table is broadcast in blocks of
at most ``MAX_WINDOWS`` rows, each block scanned against all documents, so what is
broadcast never grows with the benchmark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm import bytetext
from basketlake.llm.common import changed_rows, quoted, stored, text_slices

WINDOW = 10
MAX_WINDOWS = 100_000  #: rows of one broadcast block, about 10 MB of text
_FILTER_BITS = 22


def _phrase(data: np.ndarray, starts, ends, first: int, size: int) -> bytes:
    """The words first..first+size-1, lower-cased and blank-separated."""
    return b" ".join(bytetext.LOWER[data[starts[i]: ends[i]]].tobytes() for i in range(first, first + size))


def _benchmark_windows(batches):
    for batch in batches:
        out = {"hash": [], "size": [], "phrase": [], "item": []}
        for row0, data, offsets in bytetext.blocks(batch.column(1)):
            starts, ends, rows, counts = bytetext.word_spans(data, offsets, bytetext.ALNUM_WORD)
            words = bytetext.word_hashes(data, starts, ends)
            first = np.concatenate(([0], np.cumsum(counts)))
            for i, count in enumerate(counts):
                if not count:
                    continue
                size = int(min(count, WINDOW))
                part = words[first[i]: first[i + 1]]
                hashes, at = bytetext.window_hashes(part, np.zeros(count), size)
                for h, p in zip(hashes.view(np.int64).tolist(), at.tolist()):
                    out["hash"].append(h)
                    out["size"].append(size)
                    out["phrase"].append(_phrase(data, starts, ends, int(first[i]) + p, size))
                    out["item"].append(batch.column(0)[row0 + i].as_py())
        yield pa.RecordBatch.from_arrays([
            pa.array(out["hash"], pa.int64()), pa.array(out["size"], pa.int32()),
            pa.array(out["phrase"], pa.binary()), pa.array(out["item"], pa.string())],
            names=["hash", "size", "phrase", "item"])


class WindowTable:
    """Windows of one block, by size: a bit filter, then hash to (phrase, items)."""

    def __init__(self, rows):
        self.sizes: dict[int, tuple[np.ndarray, dict[int, dict[bytes, set]]]] = {}
        for row in rows:
            known = self.sizes.setdefault(row["size"], (np.zeros(1 << _FILTER_BITS, dtype=bool), {}))
            h = row["hash"] & 0xFFFFFFFFFFFFFFFF
            known[0][h >> (64 - _FILTER_BITS)] = True
            items = known[1].setdefault(h, {}).setdefault(bytes(row["phrase"]), set())
            if row["item"] is not None:
                items.add(row["item"])

    def hits(self, data, starts, ends, words, rows):
        """(first word, size, items) of each confirmed window."""
        for size, (bits, known) in self.sizes.items():
            hashes, at = bytetext.window_hashes(words, rows, size)
            maybe = np.flatnonzero(bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            for h, p in zip(hashes[maybe].tolist(), at[maybe].tolist()):
                phrases = known.get(h)
                if phrases is not None:
                    items = phrases.get(_phrase(data, starts, ends, p, size))
                    if items is not None:
                        yield p, size, items


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SCAN = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _found(windows: WindowTable, text: pa.Array):
    """(words, hit runs, items, bytes without the runs or None) of each text."""
    for _, data, offsets in bytetext.blocks(text):
        starts, ends, rows, counts = bytetext.word_spans(data, offsets, bytetext.ALNUM_WORD)
        words = bytetext.word_hashes(data, starts, ends)
        cover = np.zeros(len(words) + 1, dtype=np.int32)
        items: dict[int, set] = {}
        for p, size, names_of in windows.hits(data, starts, ends, words, rows):
            cover[p] += 1
            cover[p + size] -= 1
            items.setdefault(int(rows[p]), set()).update(names_of)
        hit = np.cumsum(cover[:-1]) > 0
        first = np.concatenate(([0], np.cumsum(counts)))
        for i, count in enumerate(counts):
            if i not in items:
                yield int(count), [], [], None
                continue
            own = np.concatenate(([False], hit[first[i]: first[i + 1]], [False]))
            runs = [(int(a), int(b)) for a, b in np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)]
            keep = np.ones(offsets[i + 1] - offsets[i], bool)
            for a, b in runs:
                keep[starts[first[i] + a] - offsets[i]: ends[first[i] + b - 1] - offsets[i]] = False
            yield int(count), runs, sorted(items[i]), data[offsets[i]: offsets[i + 1]][keep]


def _scan(shared):
    """Batches whose column ``text`` gives way to what is found in it."""
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for part in text_slices(batch, names.index("text")):
                n_words, spans, found = [], [], []
                for count, runs, items, _ in _found(shared.value, part.column(names.index("text"))):
                    n_words.append(count)
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    found.append(items)
                columns = [c for n, c in zip(names, part.columns) if n != "text"]
                columns += [pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[n for n in names if n != "text"] + ["n_words", "spans", "items"])
    return run


def _removed(shared, spans: bool):
    """Keeps the texts without a hit, or cuts the hit runs out of all."""
    def change(texts):
        found = list(_found(shared.value, texts))
        if not spans:
            return [not runs for _, runs, _, _ in found], None
        cut = [None if left is None else left.tobytes().decode("utf-8", "replace") for _, _, _, left in found]
        return None, pa.compute.coalesce(pa.array(cut, pa.string()), texts)
    return change


def _window_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The distinct windows, as tables of at most about MAX_WINDOWS rows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    windows = stored(
        items.mapInArrow(_benchmark_windows, "hash long, size int, phrase binary, item string").distinct(), "windows")
    n = windows.count()
    parts = -(-n // MAX_WINDOWS) or 1
    if parts == 1:
        return [windows]
    return [windows.where(F.pmod(F.xxhash64("hash", "phrase", "item"), F.lit(parts)) == i) for i in range(parts)]


def _hits(keyed: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(k, spans, items) of the texts of ``keyed(doc_id, text, k)`` that a block hits, once per block."""
    spark = keyed.sparkSession
    kind = keyed.schema["doc_id"].dataType.simpleString()
    hits = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(WindowTable(block.collect()))
        one = stored(keyed.mapInArrow(_scan(shared), f"doc_id {kind}, k string, {_SCAN}")
                     .where("size(spans) > 0").select("k", "spans", "items").dropDuplicates(["k"]), "hits")
        shared.unpersist()
        hits = one if hits is None else hits.union(one)
    return hits


def _cut(batches):
    """The text of each row without the words of ``raw``, spans that may overlap."""
    for batch in batches:
        text, raw, cleaned = batch.column(0), batch.column(2).to_pylist(), []
        row0 = 0
        for _, data, offsets in bytetext.blocks(text):
            starts, ends, _, counts = bytetext.word_spans(data, offsets, bytetext.ALNUM_WORD)
            first = np.concatenate(([0], np.cumsum(counts)))
            for i, count in enumerate(counts):
                spans = raw[row0 + i]
                if not spans:
                    cleaned.append(None)
                    continue
                cover = np.zeros(count + 1, dtype=np.int64)
                for span in spans:
                    cover[span["start"]] += 1
                    cover[span["end"]] -= 1
                own = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
                keep = np.ones(offsets[i + 1] - offsets[i], bool)
                for a, b in np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2):
                    keep[starts[first[i] + a] - offsets[i]: ends[first[i] + b - 1] - offsets[i]] = False
                cleaned.append(data[offsets[i]: offsets[i + 1]][keep].tobytes().decode("utf-8", "replace"))
            row0 += len(counts)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(cleaned, pa.string())], names=["row", "cleaned"])


def _without_spans(documents: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """Spans of all blocks, found on the texts as they are, cut out at once."""
    names = documents.columns
    keyed = documents.select(F.col("text").cast("string").alias("text"), F.struct(*quoted(names)).alias("row")).withColumn(
        "k", F.sha2(F.coalesce("text", F.lit("")), 256))
    hits = _hits(keyed.select(F.lit(0).alias("doc_id"), "text", "k"), blocks)
    merged = hits.groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("raw"))
    kind = keyed.schema["row"].dataType.simpleString()
    cut = keyed.join(merged, "k", "left").select("text", "row", "raw").mapInArrow(_cut, f"row {kind}, cleaned string")
    return cut.select(*[
        F.coalesce("cleaned", "row.text").alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in names])


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) per row of ``documents(doc_id, text)``.

    ``spans`` are the hit runs of words (start, end exclusive, from 0), ``items`` the
    sorted ids, as strings, of items with a window in the text. Null and empty texts
    have no words. Benchmark rows without id still hit but name no item; repeated
    rows and ids count once; an empty benchmark hits nothing. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = _window_blocks(benchmark)
    if len(blocks) == 1:
        shared = spark.sparkContext.broadcast(WindowTable(blocks[0].collect()))
        return docs.mapInArrow(_scan(shared), f"doc_id {kind}, {_SCAN}")
    # a large benchmark: one scan per block; rows are matched by id and content
    keyed = docs.withColumn("k", F.sha2(F.coalesce("text", F.lit("")), 256))
    merged = _hits(keyed, blocks).groupBy("k").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = spark.sparkContext.broadcast(WindowTable([]))
    base = keyed.mapInArrow(_scan(none), f"doc_id {kind}, k string, {_SCAN}").select("doc_id", "k", "n_words")
    empty = "cast(array() as array<struct<start:int,end:int>>)"
    spans = F.expr(f"""coalesce(aggregate(raw, {empty}, (acc, x) ->
        CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= x.start
          THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start,
               'end', greatest(element_at(acc, -1).end, x.end))))
          ELSE concat(acc, array(x)) END), {empty})""")
    return base.join(merged, "k", "left").select(
        "doc_id", "n_words", spans.alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def contamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with counts and a digest in place of spans and ids."""
    found = contamination(documents, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``documents`` without contaminated rows, or (``remove="spans"``) without the hit spans.

    All columns stay. A benchmark of more than MAX_WINDOWS distinct windows is passed
    over the documents block by block; spans are cut only after all passes.
    """
    spark = documents.sparkSession
    out = documents
    blocks = _window_blocks(benchmark)
    if remove == "spans" and len(blocks) > 1:
        return _without_spans(documents, blocks)
    for block in blocks:
        shared = spark.sparkContext.broadcast(WindowTable(block.collect()))
        out = changed_rows(out, _removed(shared, remove == "spans"))
    return out


def items_digest(items: list[str]) -> str:
    """The digest of a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
