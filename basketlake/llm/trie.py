"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

**Nodes.** A node is a distinct sequence of first turns. Its key is a 128-bit running
sum of digests of (place, role, text), so keys of one very long conversation come from
running totals over range chunks, never from a loop in one task. Equal keys are counted.

**Edges.** Nodes below one another with the same members form one edge; a node's members
are known by the smallest one and their number, since member sets along a conversation
only shrink. A conversation with k edges shares turns with k - 1 others that leave it at
different depths, so k is below the square root of twice the number of turns, however
long the conversation. Equal conversations count once.

**Shards.** Conversations are range-sorted by their edges' keys, which puts each subtree
together, and cut into shards (one Arrow batch). A shard writes its edges as balanced
parentheses. Blocks of the excess and a tree of their minima answer *findclose*, which
delimits each subtree; a rank over leaf pairs counts its leaves, a cumulative array sums
its savings. Edges on the first or last path of a shard (its spines) may go on in other
shards: only their partial figures are shuffled and added.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm.common import chunk_totals, running_totals, stored
from basketlake.operators.skew import heavy_keys, spread_join

EXCESS_BLOCK = 64      # parentheses of a block
PIECE = 1 << 16        # ids joined to one piece of an end list
HEAVY_ROWS = 500       # keys with fewer rows are never cut
KEY = 32               # hexadecimal digits of a node key
NO_ENDS = hashlib.sha256(b"").hexdigest()

_LIMBS = ["l0", "l1", "l2", "l3"]  # four sums of 32-bit parts, exact below 2**31 turns


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes): turns of each conversation, places from 1.

    Order: turn (null first), then role and text; null role or text is empty. Rows
    without a conv_id belong to no conversation.
    """
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    cut = stored(
        turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
            "conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
            F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("_chunk")), "turns")
    return chunk_totals(cut, ["conv_id"], ["at"], {"before": "one"}).select(
        "conv_id", (F.col("before") + 1).alias("place"), "digest", "bytes")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's variant of :func:`ordered_turns`, and the ids of all conversations.

    Conversation c begins with the first h turns of conversation c - c % 5 (all if it has
    fewer, none if it is absent), h = crc32 of the id % 9, then its own turns after its
    first h, if any. % keeps the sign of c.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = counts.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    convs = stored(convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
                   .select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "conversations")
    heads = turns.where((F.col("conv_id") % 5 == 0) & (F.col("place") <= 8)).withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "h").join(heads, "base").where("place <= h")
    own = turns.where(F.col("place") > h)
    own = spread_join(own, convs.select("conv_id", "taken"), ["conv_id"], "inner", ["place"], heavy_keys(own, ["conv_id"], HEAVY_ROWS))
    own = own.withColumn("place", F.col("place") - h + F.col("taken"))
    names = ["conv_id", "place", "digest", "bytes"]
    return heads.select(*names).unionByName(own.select(*names)), convs.select("conv_id")


def _keyed(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, key, bytes, total): one row per conversation and node on its path, root included."""
    part = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), "digest"))
    limbs = {n: F.conv(F.substring(part, 1 + 8 * i, 8), 16, 10).cast("long") for i, n in enumerate(_LIMBS)}
    rows = turns.select(F.col("conv_id").alias("c"), F.col("place").alias("depth"), "bytes", *[v.alias(n) for n, v in limbs.items()])
    sums = running_totals(rows, ["c"], ["depth"], {**{f"s_{n}": n for n in _LIMBS}, "before": "bytes"})
    whole = F.concat(*[F.lpad(F.hex((F.col(f"s_{n}") + F.col(n)) % (1 << 32)), 8, "0") for n in _LIMBS])
    cells = sums.select("c", "depth", whole.alias("key"), "bytes", (F.col("before") + F.col("bytes")).alias("total"))
    zero = F.lit(0).cast("long")
    root = convs.select(F.col("conv_id").alias("c"), zero.alias("depth"), F.lit("0" * KEY).alias("key"), zero.alias("bytes"), zero.alias("total"))
    return cells.unionByName(root)


def _pieces(batches):
    """Batches (key, c) sorted by both to (key, first, n, list): ids joined piece by piece."""
    schema = pa.schema([("key", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("list", pa.string())])
    for batch in batches:
        keys, ids = batch.column(0), batch.column(1).to_numpy()
        if not len(ids):
            continue
        codes = keys.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(np.diff(codes)) + 1
        bounds = [0, *cuts.tolist(), len(ids)]
        starts = [p for a, b in zip(bounds, bounds[1:]) for p in range(a, b, PIECE)]
        ends = [*starts[1:], len(ids)]
        yield pa.RecordBatch.from_arrays([
            keys.take(pa.array(starts)), pa.array(ids[starts]), pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
            pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends)])], schema=schema)


def _hashed(batches):
    """Sorted pieces to (conv_id, ends, ends_sha256) per key; only the digest's state is held."""
    key, first, count, digest = None, None, 0, None

    def closed():
        return pa.RecordBatch.from_arrays(
            [pa.array([first], pa.int64()), pa.array([count], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "ends", "ends_sha256"])
    for batch in batches:
        done = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != key:
                if key is not None:
                    done.append(closed())
                key, first, count, digest = row[0], row[1], 0, hashlib.sha256()
            else:
                digest.update(b",")
            count += row[2]
            digest.update(row[3].encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if key is not None:
        yield closed()


def _ends(cells: DataFrame) -> DataFrame:
    """(conv_id, ends, ends_sha256) per node at which conversations end; conv_id is the smallest.

    The ids are sorted and joined over all tasks; a digest has to see them in order, so
    the joined pieces of one node stream through one task, which keeps 32 bytes of them.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = stored(cells.groupBy("c").agg(F.max_by("key", "depth").alias("key")), "ends")
    pieces = last.select("key", "c").repartitionByRange(n, "key", "c").sortWithinPartitions("key", "c").mapInArrow(
        _pieces, "key string, first long, n long, list string")
    return pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(
        _hashed, "conv_id long, ends long, ends_sha256 string")


def find_close(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The closing place of each opening one: the first later place with one less excess.

    The own block is scanned, then the tree of block minima leads to the first block
    that falls to the wanted excess, which is scanned as well.
    """
    n, size = len(excess), EXCESS_BLOCK
    n_blocks = -(-n // size)
    leaves = 1 << max(0, (n_blocks - 1).bit_length())
    padded = np.full(leaves * size, np.iinfo(np.int64).max)
    padded[:n] = excess
    least = np.empty(2 * leaves, dtype=np.int64)
    least[leaves:] = padded.reshape(leaves, size).min(axis=1)
    for node in range(leaves.bit_length() - 2, -1, -1):
        low = 1 << node
        least[low: 2 * low] = least[2 * low: 4 * low].reshape(low, 2).min(axis=1)
    wanted = excess[opens] - 1
    out = np.full(len(opens), -1, dtype=np.int64)

    def scan(todo: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Look through the rest of the block of ``at``; what finds nothing comes back with its next block."""
        missed = []
        while len(todo):
            found = padded[at] == wanted[todo]
            out[todo[found]] = at[found]
            todo, at = todo[~found], at[~found] + 1
            over = at % size == 0
            missed.append((todo[over], at[over] // size))
            todo, at = todo[~over], at[~over]
        return tuple(np.concatenate(x) for x in zip(*missed)) if missed else (todo, at)

    start = opens + 1
    over = start % size == 0
    todo, block = scan(np.flatnonzero(~over), start[~over])
    todo, node = np.concatenate((todo, np.flatnonzero(over))), np.concatenate((block, start[over] // size)) + leaves
    while True:
        high = least[node] > wanted[todo]
        if not high.any():
            break
        node[high] += 1
        node[high & (node % 2 == 0)] //= 2
    while True:
        inner = node < leaves
        if not inner.any():
            break
        left = 2 * node[inner]
        node[inner] = np.where(least[left] <= wanted[todo[inner]], left, left + 1)
    scan(todo, (node - leaves) * size)
    return out


def _shard(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Figures of each edge within one shard of sorted paths."""
    c, leaf, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
    lists = batch.column(3)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    keys = np.array(lists.flatten().to_pylist(), dtype=f"S{KEY}")
    conv, members, weight, top, bottom, total = (batch.column(i).flatten().to_numpy() for i in range(4, 10))
    n, lengths = len(keys), np.diff(offsets)
    path = np.repeat(np.arange(len(c)), lengths)
    level = np.arange(n) - offsets[path]
    above = np.maximum(path - 1, 0)
    before = np.where((path > 0) & (level < lengths[above]), offsets[above] + level, -1)
    shared = (before >= 0) & (keys == keys[before])

    opened = np.flatnonzero(~shared)             # cells that open a parenthesis, in order
    common = np.bincount(path[shared], minlength=len(c))
    closes = np.cumsum(np.concatenate(([0], lengths[:-1] - common[1:])))
    at = closes[path[opened]] + np.arange(len(opened))
    signs = np.full(2 * len(opened), -1, dtype=np.int64)
    signs[at] = 1
    excess = np.cumsum(signs)
    close = find_close(excess, at)
    after = np.arange(len(opened)) + (close - at + 1) // 2   # edges of a subtree are neighbours

    by_level = np.argsort(level[opened] * n + opened)
    sorted_code = (level[opened] * n + opened)[by_level]
    edge = by_level[np.searchsorted(sorted_code, level * n + np.arange(n), side="right") - 1]
    owned = np.zeros(len(opened), dtype=np.int64)
    owned[edge[conv == c[path]]] = 1             # each edge counts once: with the path of its smallest member
    ending = offsets[1:] - 1
    pairs = np.zeros(len(opened), dtype=np.int64)
    pairs[edge[ending[leaf]]] = 1
    pairs &= signs[np.minimum(at + 1, len(signs) - 1)] < 0
    rank = np.concatenate(([0], np.cumsum(pairs)))
    saved = np.concatenate(([0], np.cumsum(weight[opened] * owned)))
    parent = np.where(level[opened] > 0, edge[np.maximum(opened - 1, 0)], -1)
    children = np.bincount(parent[parent >= 0], weights=owned[parent >= 0], minlength=len(opened)).astype(np.int64)
    spine = np.zeros(len(opened), dtype=bool)
    spine[: lengths[0]] = True
    spine[edge[offsets[-2]:]] = True
    ends = np.full(len(opened), -1, dtype=np.int64)
    ends[edge[ending]] = np.arange(len(c))
    up = conv[opened[np.maximum(parent, 0)]]
    return pa.RecordBatch.from_arrays([
        pa.array(conv[opened]), pa.array(members[opened]), pa.array(up, mask=parent < 0),
        pa.array(rank[after] - rank[:-1]), pa.array(saved[after] - saved[:-1]), pa.array(children),
        pa.array(weight[opened]), pa.array(top[opened]), pa.array(bottom[opened]), pa.array(total[opened]),
        digest.take(pa.array(ends, mask=ends < 0)), pa.array(spine)], schema=schema)


_EDGE = "conv_id long, n_convs long, parent_conv_id long, n_leaves long, saved long, n_children long, weight long, top long, bottom long, total long, ends_sha256 string, spine boolean"


def _shards(batches):
    names = [part.split() for part in _EDGE.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in names])
    for batch in batches:
        if batch.num_rows:
            yield _shard(batch, schema)


def _edges(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per edge with its subtree's figures and the place of its ends."""
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = stored(_ends(cells), "ends")
    mine = spread_join(cells, reps.select(F.col("conv_id").alias("c")), ["c"], "inner", ["depth"], heavy_keys(cells, ["c"], HEAVY_ROWS))
    heavy = heavy_keys(cells, ["key"], HEAVY_ROWS)
    walked = spread_join(mine, nodes.select("key", "conv_id", "n_convs"), ["key"], "inner", ["c"], heavy)
    parts = walked.groupBy("c", "conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by("key", "depth").alias("key"),
        F.max("total").alias("total"), (F.col("n_convs") - 1).alias("others"), F.min(F.col("total") - F.col("bytes")).alias("start"))
    cell = F.struct("top", "bottom", "key", "conv_id", "n_convs", "total", (F.col("others") * (F.col("total") - F.col("start"))).alias("weight"))
    paths = parts.groupBy("c").agg(F.sort_array(F.collect_list(cell)).alias("path"))
    paths = stored(paths.join(reps.withColumnRenamed("conv_id", "c"), "c").select(
        "c", "path", "ends_sha256", (F.col("ends") == F.expr("element_at(path, -1).n_convs")).alias("leaf"),
        F.array_join("path.key", "").alias("way")), "paths")
    found = stored(paths.repartitionByRange(n, "way").sortWithinPartitions("way").select(
        "c", "leaf", "ends_sha256", *[F.col(f"path.{f}").alias(f) for f in ("key", "conv_id", "n_convs", "weight", "top", "bottom", "total")]
    ).mapInArrow(_shards, _EDGE), "shards")
    merged = found.where("spine").groupBy("conv_id", "n_convs").agg(
        *[F.min(c).alias(c) for c in ("parent_conv_id", "weight", "top", "bottom", "total")],
        *[F.sum(c).alias(c) for c in ("n_leaves", "saved", "n_children")], F.max("ends_sha256").alias("ends_sha256"))
    return found.where("NOT spine").drop("spine").unionByName(merged)


def trie_nodes(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per node of the trie of ``turns(conv_id, place, digest, bytes)``.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256. ``convs(conv_id)`` names
    all conversations, also those without a turn; absent, those that have turns. Without
    conversations there is no node, not even the root.
    """
    if convs is None:
        convs = turns.select("conv_id").distinct()
    cells = stored(_keyed(turns, convs), "cells")
    nodes = stored(cells.groupBy("key").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"),
        F.min("bytes").alias("bytes"), F.min("total").alias("through")), "nodes")
    edges = _edges(cells, nodes)
    both = ["conv_id", "n_convs"]
    rows = spread_join(nodes, edges, both, "inner", ["key"], heavy_keys(nodes, both, HEAVY_ROWS))
    at_end = F.col("depth") == F.col("bottom")
    below = (F.col("n_convs") - 1) * (F.col("total") - F.col("through") + F.col("bytes"))
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(at_end, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - F.col("weight") + below).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """:func:`trie_nodes` of ``conversations(conv_id, turn, role, text)`` as they are.

    Null turns come first, null role or text is empty, rows without conv_id are left out,
    repeated rows are turns of their own, further columns are not read.
    """
    return trie_nodes(ordered_turns(conversations))


def shared_head_trie(conversations: DataFrame) -> DataFrame:
    """:func:`trie_nodes` of the variant of :func:`with_shared_heads`."""
    turns, convs = with_shared_heads(stored(ordered_turns(conversations), "ordered"))
    return trie_nodes(turns, convs)
