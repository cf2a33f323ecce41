"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the first 4, 5 and 6 bytes of longer words, each
hashed to 64 bits. The machine adds to linear weights of terms an inner product of
factors for each pair present, so that an insult beside a group mention can weigh more
than both apart. It is fitted twice. A wide, sparse machine first sees *all* terms of the
sample, hashed to ``BUCKETS``; a term that tells nothing alone still gets factors there if
its pairs tell. Its ``PAIRED`` strongest buckets and the ``TERMS`` most telling terms (by
the log-odds of toxic against other labelled texts, less one standard error) are then the
inputs of the machine that scores.

Training reads at most about ``SAMPLE`` labelled rows, drawn by a digest of the id;
term counts and the fit see those rows whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm import bytetext
from basketlake.llm.common import in_fold, stored

SAMPLE = 20_000
TERMS = 512
PAIRED = 96
BUCKETS = 1 << 18
WIDE_STEPS, WIDE_ROWS = 160, 256  # minibatches of the wide machine
LEAST_TEXTS = 3  # a term of fewer sampled texts is no input
FACTORS = 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3


def term_hashes(data, offsets):
    """(row, hash) of each distinct term of each text."""
    starts, ends, rows, _ = bytetext.word_spans(data, offsets, bytetext.ALNUM_WORD)
    hashes, owners = [bytetext.word_hashes(data, starts, ends)], [rows]
    for n in PREFIXES:
        longer = ends - starts > n
        hashes.append(bytetext.mix(bytetext.word_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n)))
        owners.append(rows[longer])
    return np.concatenate(owners), np.concatenate(hashes)


def _terms(batches):
    for batch in batches:
        out = []
        for _, data, offsets in bytetext.blocks(batch.column(1)):
            rows, hashes = term_hashes(data, offsets)
            order = np.argsort(rows, kind="stable")
            parts = np.split(hashes[order], np.searchsorted(rows[order], np.arange(1, len(offsets) - 1)))
            out += [np.unique(p).view(np.int64) for p in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["toxic", "terms"])


def fit_machine(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, n_terms: int, steps: int = 240, seed: int = 5):
    """Weights (bias, linear, factors) by Adam on the log loss; rows/terms name the ones."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(labels), n_terms), dtype=np.float32)
    x[rows, terms] = 1.0
    y = labels.astype(np.float32)
    prior = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    weights = [np.array([np.log(prior / (1 - prior))], np.float32), np.zeros(n_terms, np.float32),
               rng.normal(0, 0.01, (n_terms, FACTORS)).astype(np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        bias, linear, factors = weights
        sums = x @ factors
        score = bias[0] + x @ linear + 0.5 * ((sums ** 2).sum(1) - x @ (factors ** 2).sum(1))
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / max(1, len(y))
        mass = x.T @ error
        gradients = [np.array([error.sum()], np.float32), mass + 1e-5 * linear,
                     x.T @ (sums * error[:, None]) - factors * mass[:, None] + 1e-4 * factors]
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - 0.05 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return float(weights[0][0]), weights[1], weights[2]


def term_bucket(terms: np.ndarray) -> np.ndarray:
    return (terms.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int32)


def wide_factors(ends: np.ndarray, buckets: np.ndarray, labels: np.ndarray, seed: int = 5) -> np.ndarray:
    """Factors (buckets x FACTORS) of a machine over all buckets, by sparse minibatches.

    Row i has the buckets ``buckets[ends[i-1]:ends[i]]``. Steps adapt to each parameter's
    past gradients and a threshold shrinks what pairs do not confirm to zero.
    """
    rng = np.random.default_rng(seed)
    starts = np.concatenate(([0], ends[:-1]))
    prior = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
    bias, linear, factors = np.log(prior / (1 - prior)), np.zeros(BUCKETS), rng.normal(0, 0.02, (BUCKETS, FACTORS))
    past, past_factors = np.full(BUCKETS, 1e-3), np.full((BUCKETS, FACTORS), 1e-3)
    order = rng.permutation(len(labels))
    for step in range(WIDE_STEPS):
        rows = np.take(order, np.arange(step * WIDE_ROWS, (step + 1) * WIDE_ROWS), mode="wrap")
        ones = np.concatenate([buckets[a:b] for a, b in zip(starts[rows], ends[rows])])
        if not len(ones):
            continue
        row = np.repeat(np.arange(WIDE_ROWS), ends[rows] - starts[rows])
        own = factors[ones]
        sums = np.stack([np.bincount(row, weights=own[:, f], minlength=WIDE_ROWS) for f in range(FACTORS)], axis=1)
        score = (bias + np.bincount(row, weights=linear[ones], minlength=WIDE_ROWS)
                 + 0.5 * ((sums ** 2).sum(1) - np.bincount(row, weights=(own ** 2).sum(1), minlength=WIDE_ROWS)))
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[rows]) / WIDE_ROWS
        active, place = np.unique(ones, return_inverse=True)
        slope = np.bincount(place, weights=error[row])
        slopes = np.stack([np.bincount(place, weights=error[row] * (sums[row, f] - own[:, f])) for f in range(FACTORS)], axis=1)
        past[active] += slope ** 2
        past_factors[active] += slopes ** 2
        rate, rates = 0.1 / np.sqrt(past[active]), 0.1 / np.sqrt(past_factors[active])
        linear[active] -= rate * slope
        moved = factors[active] - rates * slopes
        factors[active] = np.sign(moved) * np.maximum(np.abs(moved) - 2e-4 * rates, 0)
        bias -= 0.1 * error.sum()
    return factors


def _paired(batches):
    """The buckets with the most factor mass over the texts that hold them."""
    sizes, buckets, labels = [], [], []
    for batch in batches:
        labels.append(batch.column(0).to_numpy())
        sizes.append(np.diff(batch.column(1).offsets.to_numpy()))
        buckets.append(batch.column(1).flatten().to_numpy())
    if labels:
        ends, ones, marks = np.cumsum(np.concatenate(sizes)), np.concatenate(buckets), np.concatenate(labels)
        texts = np.bincount(ones, minlength=BUCKETS)
        spread = np.sqrt(texts * np.maximum(len(marks) - texts, 0.0))
        mass = np.where(texts >= LEAST_TEXTS, (wide_factors(ends, ones, marks.astype(float)) ** 2).sum(1) * spread, 0.0)
        best = np.lexsort((np.arange(BUCKETS), -mass))[:PAIRED]
        yield pa.RecordBatch.from_arrays([pa.array(best[mass[best] > 0].astype(np.int32))], names=["bucket"])


def _bucketed(batches):
    for batch in batches:
        terms = batch.column(1)
        flat = pa.array(term_bucket(terms.flatten().to_numpy()))
        starts = terms.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), flat)], names=["toxic", "buckets"])


def _known(vocabulary: list[int]):
    """Drops terms that are no input, before they travel to the fitting task."""
    def run(batches):
        for batch in batches:
            rows = [v.values.to_numpy() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[np.isin(r, vocabulary)] for r in rows], pa.list_(pa.int64()))], names=["toxic", "terms"])
    return run


def _fit(vocabulary: list[int]):
    def run(batches):
        known = np.array(sorted(vocabulary), dtype=np.int64)
        rows, terms, labels = [], [], []
        for batch in batches:
            for label, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = own.values.to_numpy()
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                at = at[known[at] == values]
                rows.append(np.full(len(at), len(labels)))
                terms.append(at)
                labels.append(label)
        if labels:
            bias, linear, factors = fit_machine(np.concatenate(rows), np.concatenate(terms), np.array(labels), len(known))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(known, 0)), pa.array(np.append(linear, bias).astype(float)),
                pa.array([*factors.astype(float).tolist(), []], pa.list_(pa.float64())),
                pa.array([False] * len(known) + [True])], names=["term", "weight", "factors", "bias"])
    return run


class Machine:
    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: (r["bias"], r["term"]))
        terms = [r for r in rows if not r["bias"]]
        self.bias = next((r["weight"] for r in rows if r["bias"]), -3.0)
        self.terms = np.array([r["term"] for r in terms], dtype=np.int64)
        self.weight = np.array([r["weight"] for r in terms])
        self.factors = np.array([r["factors"] for r in terms]).reshape(len(terms), FACTORS)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.terms.view(np.uint64) >> np.uint64(44)] = True

    def scores(self, data, offsets):
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        if len(self.terms):
            rows, hashes = term_hashes(data, offsets)
            maybe = self.bits[hashes >> np.uint64(44)]
            rows, hashes = rows[maybe], hashes[maybe].view(np.int64)
            at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
            same = self.terms[at] == hashes
            pairs = np.unique(rows[same] * len(self.terms) + at[same])
            rows, at = pairs // len(self.terms), pairs % len(self.terms)
            total += np.bincount(rows, weights=self.weight[at], minlength=n)
            for f in range(FACTORS):
                v = self.factors[at, f]
                total += 0.5 * (np.bincount(rows, weights=v, minlength=n) ** 2 - np.bincount(rows, weights=v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _score(shared):
    def run(batches):
        machine = shared.value
        for batch in batches:
            scores = [machine.scores(data, offsets) for _, data, offsets in bytetext.blocks(batch.column(2))]
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(flat), pa.array((flat >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])
    return run


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, terms) of about SAMPLE labelled rows outside the held-out fold."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~in_fold(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marked.count()
    if n > SAMPLE:
        part = int(SAMPLE / n * (1 << 30))
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < part)
    rows = F.broadcast(stored(marked, "labels"))  # about SAMPLE rows of 12 bytes
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).join(rows, "doc_id").select("toxic", "text")


def train(documents: DataFrame, labels: DataFrame) -> Machine:
    sample = stored(training_rows(documents, labels).mapInArrow(_terms, "toxic int, terms array<long>"), "terms")
    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, rest = totals[0], totals[1] - totals[0]
    if not toxic or not rest:
        return Machine([])
    counts = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("p"), F.count("*").alias("c")).where(F.col("c") >= LEAST_TEXTS)
    q = F.col("c") - F.col("p")
    odds = F.log((F.col("p") + 0.5) / (toxic + 1.0)) - F.log((q + 0.5) / (rest + 1.0))
    telling = F.abs(odds) - F.sqrt(1 / (F.col("p") + 0.5) + 1 / (q + 0.5))
    best = [r["term"] for r in counts.select("term", telling.alias("z")).orderBy(F.desc("z"), "term").limit(TERMS).collect()]
    # the term as an unsigned number modulo the (power of two) number of buckets
    bucket = F.col("term").bitwiseAND(F.lit(BUCKETS - 1))
    paired = [r["bucket"] for r in sample.mapInArrow(_bucketed, "toxic int, buckets array<int>").repartition(1)
              .sortWithinPartitions("toxic", "buckets").mapInArrow(_paired, "bucket int").collect()]
    best += [r["term"] for r in counts.where(bucket.isin(paired)).select("term").collect()] if paired else []
    best = sorted(set(best))
    weights = sample.mapInArrow(_known(best), "toxic int, terms array<long>").repartition(1).mapInArrow(_fit(best), "term long, weight double, factors array<double>, bias boolean")
    return Machine(weights.collect())


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents(doc_id, text)``.

    Labels outside the held-out fold are learned from; a doc_id labelled twice counts
    as toxic if any label says so, null labels and ids are passed over. Null and empty
    texts get the score of a text without known terms. Without both kinds of labels
    every score is that of the bias alone. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    docs = documents.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
