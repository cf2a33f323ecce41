"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected (``CURVES`` random projections to ``DIMS`` dimensions, each
with its own shift) and ordered along a Hilbert curve. A query takes as candidates
the rows within a window around its own place on each curve; candidates of all
curves are merged and ranked on the original vectors in double precision.

For the largest inner product, vectors are lifted by one coordinate to equal length
first, which turns it into nearness. The half window is fitted: for ``FIT`` queries
the true neighbours are found by brute force over all rows, and the window is the
``COVER`` quantile of the smallest distance, in places over all curves, at which they
lie. Clustered vectors get narrow windows; vectors without structure, whose
neighbours lie anywhere, get wide ones, as any index needs for them.

Places are cut into blocks of ``BLOCK`` rows, queries into chunks, so one task sees
a bounded number of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm.common import running_totals, stored

CURVES, DIMS, BITS = 16, 8, 7
FIT, COVER = 64, 0.97
PILOT = 10_000  #: rows, about, that scale the projections
BLOCK = 4096
CHUNK = 2048
NEAREST = 20
EVERY = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (n x dims integers) along the Hilbert curve.

    Axes are turned to the transposed index by undoing the excess rotations from the
    highest bit down and Gray-decoding; the bits then interleave.
    """
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        turn ^= np.where((x[dims - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections, shifts and scales; keys of lifted rows and of queries."""

    def __init__(self, pilot: np.ndarray, longest: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.longest = longest
        lifted = self.lift(pilot)
        width = lifted.shape[1]
        dims = min(DIMS, width)
        self.axes = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(CURVES)]
        self.low, self.span, self.shift = [], [], []
        for axes in self.axes:
            seen = lifted @ axes
            mean, spread = seen.mean(0), np.maximum(seen.std(0), 1e-12)
            self.low.append(mean - 3.5 * spread)
            self.span.append(7 * spread)
            self.shift.append(rng.random(dims) * 0.2)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(1), 0))])

    def aim(self, x: np.ndarray) -> np.ndarray:
        """Queries at the lifted rows' length, without the extra coordinate."""
        return np.column_stack([x * (self.longest / np.sqrt((x * x).sum(1)))[:, None], np.zeros(len(x))])

    def keys(self, points: np.ndarray) -> np.ndarray:
        out = []
        for axes, low, span, shift in zip(self.axes, self.low, self.span, self.shift):
            unit = (points @ axes - low) / span * 0.8 + shift
            cells = np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            out.append(hilbert_keys(cells, BITS))
        return np.stack(out)


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1).astype(float)


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component to the last."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += left[:, j] * right[:, j]
    return total


def top_of_block(queries, query_ids, rows, row_ids, k):
    """(ids, scores) of the k best rows of each query, its own id left out."""
    out = []
    for first in range(0, len(queries), 256):
        part, names = queries[first: first + 256], query_ids[first: first + 256]
        rough = part @ rows.T
        rough[names[:, None] == row_ids[None, :]] = -np.inf
        if rough.shape[1] > k:
            edge = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        else:
            edge = np.full(len(part), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(edge), edge, 0)))
        q, r = np.nonzero((rough >= (edge - slack)[:, None]) & np.isfinite(rough))
        score = exact_products(part[q], rows[r])
        order = np.lexsort((row_ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        cuts = np.searchsorted(q, np.arange(len(part) + 1))
        for i in range(len(part)):
            own = slice(cuts[i], min(cuts[i + 1], cuts[i] + k))
            out.append((row_ids[r[own]].tolist(), score[own].tolist()))
    return out


_FOUND = "query_id long, near array<struct<vec_id:long,score:double>>"
_NEAR = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))


def _found(query_ids, best):
    near = [[{"vec_id": i, "score": s} for i, s in zip(*b)] for b in best]
    return [pa.array(query_ids, pa.int64()), pa.array(near, _NEAR)]


def _brute(shared, k: int):
    def run(batches):
        names, queries = shared.value
        for batch in batches:
            if len(batch):
                best = top_of_block(queries, names, matrix(batch.column(1)), batch.column(0).to_numpy(), k)
                yield pa.RecordBatch.from_arrays(_found(names, best), names=["query_id", "near"])
    return run


def _keyed(shared, query: bool):
    def run(batches):
        curves = shared.value
        for batch in batches:
            if not len(batch):
                continue
            points = matrix(batch.column(1))
            keys = curves.keys(curves.aim(points) if query else curves.lift(points))
            n = len(batch)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(batch.column(0).to_numpy(), CURVES)), pa.array(np.repeat(np.arange(CURVES, dtype=np.int32), n)),
                pa.array(keys.reshape(-1)), pa.array(np.full(CURVES * n, 0 if query else 1, dtype=np.int64))],
                names=["vec_id", "curve", "key", "row"])
    return run


def _reranked(k: int):
    def run(rows, queries):
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "near": pa.array([], _NEAR)})
        names = queries.column("q_vec_id").to_numpy()
        best = top_of_block(matrix(queries.column("q_v")), names, matrix(rows.column("v")), rows.column("vec_id").to_numpy(), k)
        return pa.table(dict(zip(["query_id", "near"], _found(names, best))))
    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all lists found; each list holds at most k."""
    both = F.array_distinct(F.flatten(F.collect_list("near")))
    ranked = F.slice(F.array_sort(F.transform(both, lambda x: F.struct((-x["score"]).alias("far"), x["vec_id"].alias("vec_id")))), 1, k)
    return found.groupBy("query_id").agg(ranked.alias("near"))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of the commonest length without null, NaN or infinity, not all zero.

    Rows without id take no part; an id that repeats counts once (its smallest vector).
    """
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    sound = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sound = sound.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                        & F.exists("v", lambda x: x != 0.0))
    width = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return sound
    return sound.where(F.size("v") == width["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(embeddings: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its k nearest found.

    Nearest first, ties to the smaller vec_id; all candidates if there are fewer.
    An empty or unusable table gives an empty result. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    context = spark.sparkContext
    data = stored(usable(embeddings), "vectors")
    queries = data.where(F.col("vec_id") % every == 0)
    schema = "query_id long, rank int, vec_id long, score double"
    n, n_queries = data.count(), queries.count()
    if not n_queries or n < 2:
        return spark.createDataFrame([], schema)
    longest = float(np.sqrt(data.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]))

    def drawn(df: DataFrame, rows: int, total: int, salt: str) -> list:
        part = max(1, int(min(1.0, 1.2 * rows / total) * (1 << 30)))
        mark = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 30))
        return df.where(mark < part).orderBy(mark).limit(rows).collect()

    pilot = np.array([r["v"] for r in drawn(data, PILOT, n, "pilot")] or [data.first()["v"]])
    curves = context.broadcast(Curves(pilot, longest))
    keys = (data.mapInArrow(_keyed(curves, False), "vec_id long, curve int, key long, row long")
            .union(queries.mapInArrow(_keyed(curves, True), "vec_id long, curve int, key long, row long")))
    places = stored(running_totals(keys, ["curve"], ["key", "row", "vec_id"], {"place": "row"}), "places")

    # the window: true neighbours of a few queries, and how near they lie on their best curve
    few = drawn(queries, FIT, n_queries, "fit") or queries.limit(FIT).collect()
    shared = context.broadcast((np.array([r["vec_id"] for r in few]), np.array([r["v"] for r in few])))
    truth = merged(data.mapInArrow(_brute(shared, k), _FOUND), k).select("query_id", F.explode("near.vec_id").alias("vec_id"))
    truth = F.broadcast(stored(truth, "truth"))  # FIT x k rows
    at = places.where("row = 1").join(truth, "vec_id").select("query_id", "vec_id", "curve", F.col("place").alias("p"))
    own = places.where("row = 0").select(F.col("vec_id").alias("query_id"), "curve", F.col("place").alias("o"))
    apart = [r["d"] for r in F.broadcast(stored(at, "fit")).join(own, ["query_id", "curve"])
             .groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("p") - F.col("o"))).alias("d")).collect()]
    half = int(np.quantile(apart, COVER)) + 1 if apart else n

    chunks = max(1, -(-n_queries * (2 * half + BLOCK) // (n * CHUNK)))
    block = F.floor(F.col("place") / BLOCK).cast("long")
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    last = (n - 1) // BLOCK
    base = data.toDF("vec_id", "v")
    rows = (places.where("row = 1").select("vec_id", "curve", block.alias("block"))
            .join(base, "vec_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    low = F.floor(F.greatest(F.lit(0), F.col("place") - half) / BLOCK).cast("long")
    high = F.least(F.floor((F.col("place") + half) / BLOCK).cast("long"), F.lit(last))
    asked = (places.where("row = 0").select("vec_id", "curve", F.explode(F.sequence(F.least(low, F.lit(last)), high)).alias("block"))
             .join(queries, "vec_id").withColumn("chunk", chunk))
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    grouped = ["curve", "block", "chunk"]
    found = rows.groupBy(*grouped).cogroup(asked.groupBy(*[f"q_{c}" for c in grouped])).applyInArrow(_reranked(k), _FOUND)
    best = merged(found, k).select("query_id", F.posexplode("near").alias("p", "x"))
    return best.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
