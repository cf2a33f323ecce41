"""MinHash near-duplicates by one-permutation hashing.

A document's set holds its distinct five-word shingles (all words as one shingle
when there are fewer). One hash of each shingle gives bin and value; empty bins
borrow from a random filled one (optimal densification); five bins make a band.

1. Documents with equal sets form a class; only one set per class goes on.
2. Shingles that no other class of any bucket holds bound what a class can share:
   with u of n of its own, at most n - u. Pairs that cannot reach the threshold by
   this bound are never formed; no link is lost.
3. In each band bucket the class with the smallest share of own shingles is the
   centre of a star: every other class makes one edge with it, so a bucket of g
   classes makes g - 1 pairs. Star pairs are confirmed on full sets and joined to
   components.
4. In a bucket whose classes are still in different components, what is left across
   components is confirmed too, so that no link hangs on the choice of the centre:
   as pairs that pass the bound in a small bucket, and in a large one by exact
   intersection counts of tile against tile, which return nothing but links.

A pair at the threshold is missed with probability (1 - t^5)^36: 7e-10 at 0.85,
6e-7 at 0.8. Confirmed links are exact (64-bit shingle hashes).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm import bytetext
from basketlake.llm.common import components, quoted, stored

SHINGLE = 5
BANDS, ROWS = 36, 5
BINS = BANDS * ROWS
SMALL = 64  #: open buckets up to this size form their pairs as rows, larger ones in tiles
TILE = 256  #: classes of a tile; one task holds the sets of two tiles
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; whole texts, null and blank are empty."""
    for _, data, offsets in bytetext.blocks(column):
        starts, ends, rows, counts = bytetext.word_spans(data, offsets, bytetext.BLANK_WORD)
        words = bytetext.word_hashes(data, starts, ends)
        shingles, at = bytetext.window_hashes(words, rows, SHINGLE)
        cut = np.concatenate(([0], np.cumsum(np.maximum(counts - SHINGLE + 1, 0))))
        first = np.concatenate(([0], np.cumsum(counts)))
        for i, count in enumerate(counts):
            if count >= SHINGLE:
                own = np.sort(shingles[cut[i]: cut[i + 1]])
                keep = np.ones(len(own), dtype=bool)
                keep[1:] = own[1:] != own[:-1]
                yield own[keep]
            elif count:
                yield bytetext.window_hashes(words[first[i]: first[i + 1]], np.zeros(count), int(count))[0]
            else:
                yield np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def _probes(rounds: int = 96) -> np.ndarray:
    """For each bin, the bins it tries to borrow from, in order."""
    numbers = bytetext.mix(np.arange(rounds * BINS, dtype=np.uint64) + np.uint64(0xA5A5))
    return (numbers % np.uint64(BINS)).astype(np.int64).reshape(rounds, BINS)


def densified(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values per set; every set must hold something."""
    low = np.full((len(sets), BINS), EMPTY, dtype=np.uint64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bin_ = (((flat >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    place = row * BINS + bin_
    lead = np.ones(len(place), dtype=bool)
    lead[1:] = place[1:] != place[:-1]  # sorted sets: the first of a bin is its minimum
    low.reshape(-1)[place[lead]] = flat[lead]
    own = low != EMPTY
    done, out = own.copy(), low.copy()
    for probe in _probes():
        take = ~done & own[:, probe]
        if take.any():
            out[take] = low[:, probe][take]
            done |= take
        if done.all():
            return out
    for step in range(1, BINS):  # what random probes left over: the next filled bin
        rolled = np.roll(own, -step, axis=1)
        take = ~done & rolled
        out[take] = np.roll(low, -step, axis=1)[take]
        done |= take
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    weights = bytetext.constants(ROWS, 501)
    grouped = values.reshape(len(values), BANDS, ROWS)
    total = np.zeros(grouped.shape[:2], dtype=np.uint64)
    for j, w in enumerate(weights):
        total += grouped[:, :, j] * w
    return bytetext.mix(total + bytetext.constants(BANDS, 502)[None, :]).view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    second = bytetext.mix(shingles ^ np.uint64(0x5DEECE66D))
    return shingles.sum(dtype=np.uint64).tobytes() + second.sum(dtype=np.uint64).tobytes()


def _parts(batches, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that what a worker builds stays small."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def _tags(names: list) -> pa.Array:
    return pa.array([None if n is None else int.from_bytes(n[:8], "little", signed=True) for n in names], pa.int64())


SKETCH = "doc_id long, n_shingles long, cls binary, tag long, bands array<long>"


def _sketches(batches):
    for batch in _parts(batches):
        ids, text = batch.column(0), batch.column(1)
        held, sizes, names, bands = [], [], [], []

        def flush():
            if held:
                bands.extend(band_keys(densified(held)).tolist())
                held.clear()

        for s in shingle_sets(text):
            sizes.append(len(s))
            names.append(set_digest(s) if len(s) else None)
            if len(s):
                held.append(s)
                if len(held) == 512:
                    flush()
        flush()
        found = iter(bands)
        yield pa.RecordBatch.from_arrays([
            ids, pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), _tags(names),
            pa.array([next(found) if n else None for n in sizes], pa.list_(pa.int64())),
        ], names=["doc_id", "n_shingles", "cls", "tag", "bands"])


def _full_sets(batches):
    for batch in _parts(batches):
        names, sets = [], []
        for s in shingle_sets(batch.column(0)):
            names.append(set_digest(s))
            sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), _tags(names), pa.array(sets, pa.binary())], names=["cls", "tag", "shingles"])


def _exploded(batches):
    for part in _parts(batches, 256):
        held = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
        tags = np.repeat(part.column(0).to_numpy(), [len(x) for x in held])
        yield pa.RecordBatch.from_arrays([pa.array(tags), pa.array(np.concatenate(held))], names=["tag", "shingle"])


def _confirmed(percent: int):
    def run(batches):
        for batch in _parts(batches):
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                a = np.frombuffer(left.as_buffer(), np.uint64)
                b = np.frombuffer(right.as_buffer(), np.uint64)
                joint = np.sort(np.concatenate((a, b)))
                shared = int((joint[1:] == joint[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
    return run


def _tile_links(percent: int):
    """Links across components among the sets of one tile pair, by exact intersection counts."""
    def run(table):
        names, roots = table.column("cls").to_pylist(), table.column("root").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        sizes = np.array([len(x) for x in sets])
        _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        place = np.where(shared, np.cumsum(shared) - 1, -1)[ids]
        row = np.repeat(np.arange(len(sets)), sizes)[place >= 0]
        place = place[place >= 0]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float64)
        for low in range(0, int(shared.sum()), 4096):
            cut = slice(*np.searchsorted(place, [low, low + 4096]))
            ones = np.zeros((len(sets), 4096), dtype=np.float32)
            ones[row[cut], place[cut] - low] = 1
            common += ones @ ones.T
        _, root = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        left, right = np.nonzero(np.triu(linked & (root[:, None] != root[None, :]), 1))
        pairs = sorted({(min(names[x], names[y]), max(names[x], names[y])) for x, y in zip(left, right)})
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets reach the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(_confirmed(percent), "a binary, b binary")


def _classes(batches):
    """The class of each row, null for an empty set."""
    for batch in _parts(batches):
        names = [set_digest(s) if len(s) else None for s in shingle_sets(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.binary())], names=["row", "cls"])


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``documents(doc_id, text)``.

    Linked are documents with 100 * |A and B| >= percent * |A or B|. Null, empty and
    blank texts have an empty set and are linked with nothing; rows without doc_id
    take no part in linking (component_id null, kept). Rows that repeat share their
    component. Other columns are ignored.
    """
    return _linked(documents, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _linked(documents: DataFrame, percent: int) -> DataFrame:
    """``near_duplicates`` with the class of each row; ``stays`` marks one class per component.

    That is the class of the smallest doc_id, of several the one with the smallest
    digest. Rows of the class with another doc_id do not stay; empty sets do.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stored(docs.mapInArrow(_sketches, SKETCH), "sketches")
    linked = sketch.where("cls is not null and doc_id is not null")
    classes = stored(linked.groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("tag").alias("tag"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands")), "classes")

    # buckets of several classes; one long names a class until its row is fetched
    flat = classes.select("tag", F.explode("bands").alias("key"))
    several = stored(flat.groupBy("key").count().where("count > 1").select("key"), "buckets")
    members = stored(flat.join(several, "key"), "members")
    met = stored(classes.join(members.select("tag").distinct(), "tag", "left_semi").select("cls", "tag", "rep", "n"), "met")
    wanted = met.select("rep").distinct()
    sets = stored(docs.join(wanted, docs.doc_id == wanted.rep, "left_semi").select("text")
                  .mapInArrow(_full_sets, "cls binary, tag long, shingles binary")
                  .join(met.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    # u: shingles that no other class in a bucket holds; they can be in no intersection
    alone = (sets.select("tag", "shingles").mapInArrow(_exploded, "tag long, shingle long")
             .groupBy("shingle").agg(F.count("*").alias("c"), F.min("tag").alias("tag")).where("c = 1")
             .groupBy("tag").agg(F.count("*").alias("u")))
    able = stored(met.join(alone, "tag", "left").select("cls", "tag", "n", F.coalesce("u", F.lit(0)).alias("u"))
                  .where((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent), "able")
    members = stored(members.join(able, "tag").select("key", "cls", "n", "u"), "members")

    def can_link(n1: Column, u1: Column, n2: Column, u2: Column) -> Column:
        most = F.least(n1 - u1, n2 - u2)
        return most * (100 + percent) >= (n1 + n2) * percent

    centre = members.groupBy("key").agg(
        F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "cls", "n", "u")).alias("m"), F.count("*").alias("c")).where("c > 1")
    star = stored(
        members.join(centre.select("key", "m"), "key")
        .where((F.col("cls") != F.col("m.cls")) & can_link(F.col("n"), F.col("u"), F.col("m.n"), F.col("m.u")))
        .select(F.least("m.cls", "cls").alias("a"), F.greatest("m.cls", "cls").alias("b")).distinct(), "stars")
    links = stored(_verified(star, sets, percent), "links")
    roots = components(links)

    # buckets still in several components: the pairs across components that can link
    spread = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "cls", "n", "u", F.coalesce("root", "cls").alias("root"))
    unmet = spread.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = stored(spread.join(unmet, "key"), "open")
    count = left.groupBy("key").agg(F.count("*").alias("c"))
    small = left.join(count.where(F.col("c") <= SMALL).select("key"), "key")
    l, r = small.alias("l"), small.alias("r")
    across = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.cls") < F.col("r.cls"))
                    & (F.col("l.root") != F.col("r.root"))
                    & can_link(F.col("l.n"), F.col("l.u"), F.col("r.n"), F.col("r.u")))
    rest = (across.select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).distinct()
            .join(star, ["a", "b"], "left_anti"))
    tiles = F.ceil(F.col("c") / TILE).cast("int")
    large = stored(left.join(count.where(F.col("c") > SMALL), "key").select(
        "key", "cls", "root", tiles.alias("tiles"), F.pmod(F.xxhash64("cls"), tiles).cast("int").alias("own")), "large")
    tiled = (large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "root")
             .join(sets.select("cls", "shingles"), "cls"))
    inside = tiled.groupBy("key", "i", "j").applyInArrow(_tile_links(percent), "a binary, b binary")
    more = stored(_verified(rest, sets, percent).union(inside).distinct(), "links")
    if not more.isEmpty():
        roots = components(links.union(more))

    least = stored(classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
                   .select("cls", "rep", F.coalesce("root", "cls").alias("root")), "roots")
    head = least.groupBy("root").agg(F.min(F.struct("rep", "cls")).alias("head"))
    named = least.join(head, "root").select(
        "cls", F.col("head.rep").alias("component"), (F.col("cls") == F.col("head.cls")).alias("first"))
    out = sketch.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "cls", component.alias("component_id"), "first").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).withColumn(
        "stays", F.col("kept") & F.coalesce("first", F.lit(True))).drop("first")


def deduplicated(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that stay: one of each group, with its smallest doc_id.

    Rows without doc_id stay, all columns stay. Rows are told apart by doc_id and
    class, so rows of other groups stay although a doc_id clashes. Of rows with one
    doc_id and equal sets (empty ones too) the one whose JSON form has the smallest
    digest is kept.
    """
    found = _linked(documents, percent).where("doc_id is not null")
    pairs = stored(found.groupBy("doc_id", "cls").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "pairs")
    ids = stored(pairs.groupBy("doc_id").agg(F.max("stays").alias("stays"), F.sum("n").alias("n"))
                 .where("not stays or n > 1"), "ids")
    # the same plan at every size: the dropped ids grow with the corpus, so they are never broadcast
    gone = ids.select(F.col("doc_id").alias("gone")).hint("merge")
    left = documents.join(gone, documents["doc_id"] == F.col("gone"), "left_anti")
    again = stored(ids.where("stays and n > 1").select(F.col("doc_id").alias("again")), "repeated")
    if again.isEmpty():
        return left
    names = documents.columns
    several = documents.join(again, documents["doc_id"] == F.col("again"), "left_semi").select(
        F.col("text").cast("string").alias("text"), F.struct(*quoted(names)).alias("row"))
    kind = several.schema["row"].dataType.simpleString()
    told = several.mapInArrow(_classes, f"row {kind}, cls binary").withColumn("id", F.col("row.doc_id").cast("long"))
    staying = pairs.where("stays").select(F.col("doc_id").alias("again"), F.col("cls").alias("own"))
    one = (told.join(staying, (F.col("id") == F.col("again")) & F.col("cls").eqNullSafe(F.col("own")), "left_semi")
           .groupBy("id", "cls").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")))
    return left.unionByName(one.select(*[F.col("row").getField(n).alias(n) for n in names]))
