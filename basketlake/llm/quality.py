"""Quality by weak labels: overlapping heuristics, accuracies by EM, a hashed linear scorer.

Heuristics vote good, bad or nothing on a whole text. Expectation-maximisation over
the counts of vote patterns of all documents estimates how each heuristic votes on
good texts and on each kind of bad ones, and with it the probability that a pattern is
a good text. Priors are a few pseudo-rows; the counts decide.
These posteriors are the soft labels of a logistic scorer over hashed word shapes,
fitted on about ``SAMPLE`` documents drawn by a digest. The scorer decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm import bytetext
from basketlake.llm.common import changed_rows, stored, text_slices

SAMPLE = 20_000
BUCKETS = 1 << 11
THRESHOLD = 0.5
NONE, BAD, GOOD = 0, 1, 2

#: Heuristics: feature, bad beyond, good below. Signs are turned where less is worse.
HEURISTICS = [
    ("repeated", 0.10, 0.04),  # share of words equal to the one before
    ("capitals", 0.30, 0.05),  # share of letters that are capitals
    ("symbols", 0.25, 0.05),  # symbols a word, without . , ; : ' " - ( ) ! ?
    ("shouts", 0.30, 0.05),  # ! and ? a word
    ("sameness", 0.75, 0.50),  # 1 - distinct words / words, texts of 20 words and more
    ("odd_length", 9.0, 4.0),  # distance of the mean word length from 6 bytes
    ("fringed", 0.25, 0.05),  # share of words that begin or end with a symbol
]
SHORT = 20  #: below so many words (or letters) shares say nothing: no vote

#: Assumed before counting, (mean, rows): bad votes on good texts, on a kind of bad ones, and
#: on a kind that one heuristic sees alone (its own votes, those of others).
GOOD_PRIOR, BAD_PRIOR = (0.05, 20.0), (0.5, 4.0)
LONE_OWN, LONE_OTHER = (0.99, 1e12), (0.001, 1e12)
UNSEEN = 0.002  #: share of a kind of bad texts that no heuristic sees
ROUNDS, KINDS, SEEDS = 500, 8, 3  #: of the estimate: rounds, kinds of bad texts, starts for each further kind

_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_PLAIN = set(b".,;:'\"-()!?")
_SYMBOL = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() and b not in _PLAIN for b in range(256)])
_SHOUT = np.array([b in b"!?" for b in range(256)])


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_features(data, offsets):
    """Heuristic features (rows x heuristics), words per row, and hashed shapes (row, bucket, share)."""
    starts, ends, rows, counts = bytetext.word_spans(data, offsets, bytetext.BLANK_WORD)
    n = len(counts)
    hashes = bytetext.word_hashes(data, starts, ends)
    words = np.maximum(counts, 1)
    again = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((hashes, rows))
    first = np.ones(len(order), dtype=bool)
    if len(order):
        h, r = hashes[order], rows[order]
        first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(rows[order][first], minlength=n)
    letters = _per_row(_LETTER[data], offsets)
    fringe = _SYMBOL[data[starts]] | _SYMBOL[data[ends - 1]] if len(starts) else np.zeros(0, bool)
    features = np.stack([
        np.where(counts >= SHORT, np.bincount(rows, weights=again, minlength=n) / words, 0.06),
        np.where(letters >= SHORT, _per_row(_UPPER[data], offsets) / np.maximum(letters, 1), 0.1),
        _per_row(_SYMBOL[data], offsets) / words,
        _per_row(_SHOUT[data], offsets) / words,
        np.where(counts >= SHORT, 1 - distinct / words, 0.6),
        np.abs(np.bincount(rows, weights=ends - starts, minlength=n) / words - 6),
        np.bincount(rows, weights=fringe, minlength=n) / words,
    ], axis=1)
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    inner = capitals[ends] - capitals[starts]
    shape = (np.minimum(ends - starts, 15) | (np.minimum(inner, 3) << 4) | (again.astype(np.int64) << 6)
             | (np.where(_LETTER[data[ends - 1]], 0, data[ends - 1]).astype(np.int64) << 7)
             | (np.where(_LETTER[data[starts]], 0, data[starts]).astype(np.int64) << 15)) if len(starts) else np.zeros(0, np.int64)
    bucket = (bytetext.mix(shape.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    keys, total = np.unique(rows * BUCKETS + bucket, return_counts=True)
    where = keys // BUCKETS
    return features, counts, (where, keys % BUCKETS, total / words[where])


def votes(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Vote of each heuristic; texts without words get bad from all."""
    out = np.full(features.shape, NONE)
    for j, (_, bad, good) in enumerate(HEURISTICS):
        out[features[:, j] > bad, j] = BAD
        out[features[:, j] < good, j] = GOOD
    out[counts == 0] = BAD
    return out


def _chances(patterns: np.ndarray, prior: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Log of P(class and pattern), patterns x classes; class 0 is good, the others are seen but for UNSEEN."""
    bad, voted = (patterns == BAD).astype(float), (patterns != NONE).astype(float)
    silent = voted @ np.log1p(-rates).T
    log = np.log(prior) + bad @ (np.log(rates) - np.log1p(-rates)).T + silent
    given = np.log1p(-UNSEEN) - np.log(-np.expm1(np.minimum(silent, -1e-9)))
    seen = bad.any(1)[:, None]
    log[:, 1:] = np.where(seen, log + given, np.log(prior) + np.log(UNSEEN))[:, 1:]
    return log


def estimate(patterns: np.ndarray, weights: np.ndarray, share: np.ndarray, lone: tuple[int, ...] = ()):
    """EM from the class shares ``share`` (k x classes, class 0 good) of each pattern.

    Within a class heuristics vote independently; a missing vote says nothing. The last
    classes are kinds that the heuristics ``lone`` see alone: their rates are given.
    Returns (shares, P(class), P(bad vote | class, a vote), better, log likelihood);
    ``better``: the good class has most texts without a bad vote, and on it no heuristic
    is worse than chance.
    """
    bad_votes, voted = (patterns == BAD).astype(float), (patterns != NONE).astype(float)
    classes, width = share.shape[1], patterns.shape[1]
    before = np.repeat(np.array([GOOD_PRIOR] + [BAD_PRIOR] * (classes - 1))[:, None], width, axis=1)
    for at, own in enumerate(lone, classes - len(lone)):
        before[at] = np.where(np.arange(width)[:, None] == own, LONE_OWN, LONE_OTHER)
    wrong, strength = before[..., 0] * before[..., 1], before[..., 1]
    for _ in range(ROUNDS):
        held = (share * weights[:, None]).T
        prior = (held.sum(1) + 1) / (weights.sum() + classes)
        rates = (held @ bad_votes + wrong) / (held @ voted + strength)
        log = _chances(patterns, prior, rates)
        top = log.max(1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(log - top).sum(1))
        after = np.exp(log - each[:, None])
        moved = np.abs(after - share).max(initial=0)
        share = after
        if moved < 1e-9:
            break
    unseen = weights * ~bad_votes.any(1)
    better = bool(2 * (unseen @ share[:, 0]) >= unseen.sum() and (rates[0] <= 0.5).all())
    return share, prior, rates, better, float(weights @ each)


def pattern_posteriors(patterns: np.ndarray, weights: np.ndarray):
    """P(good | pattern) and P(bad vote | class, a vote), class 0 bad and 1 good, by EM.

    Junk comes in kinds that different heuristics see, so votes on bad texts need not be
    independent: the model is one good class and one or more kinds of bad ones. Symmetry
    is broken by "heuristics are better than chance" alone: one kind is fitted from "bad
    if anything votes bad" and from the majority vote, the likelier fit stays. Then kinds
    are added, each begun at the bad-voted pattern that the fit so far explains worst, as
    long as the Bayesian information criterion rises or a heuristic is still worse than chance on
    good texts. Last, texts with one bad vote (all, or those that still count as noise of good
    texts) are tried as kinds that one heuristic sees alone, all at once, beside the other kinds
    or in their place: they are, if they meet each other so much less often than independent
    noise would that the criterion rises with one parameter a kind. Rates of the bad class are
    those of all its kinds together.
    """
    width = patterns.shape[1]
    if not len(patterns) or not weights.sum():
        return np.ones(len(patterns)), np.full((2, width), 0.5)
    each = np.log(weights.sum()) / 2  # cost of one more parameter
    cost = (width + 1) * each
    bad_votes, good_votes = (patterns == BAD).sum(1), (patterns == GOOD).sum(1)
    starts = [np.where(bad, 0.05, 0.95) for bad in (bad_votes > 0, bad_votes > good_votes)]
    best = max((estimate(patterns, weights, np.stack([g, 1 - g], axis=1)) for g in starts), key=lambda fit: fit[3:])
    _, group = np.unique((patterns != NONE) @ (2 ** np.arange(width)), return_inverse=True)
    group = group.ravel()  # patterns compete where the same heuristics vote
    while best[0].shape[1] <= KINDS:
        share = best[0]
        expected = np.exp(_chances(patterns, *best[1:3])).sum(1) * np.bincount(group, weights=weights)[group]
        misfit = np.where(bad_votes > 0, weights * np.log(weights / expected), 0.0)
        tries = []
        for seed in np.argsort(-misfit, kind="stable")[:SEEDS]:
            if misfit[seed] > 0:
                begun = np.append(share, np.zeros((len(share), 1)), axis=1)
                begun[seed] = np.arange(begun.shape[1]) == share.shape[1]
                tries.append(estimate(patterns, weights, begun))
        found = max(tries, key=lambda fit: fit[3:], default=None)
        if found is None or (found[3], found[4] - cost) <= best[3:]:
            break
        best = found
    share, level = best[0], (best[3], best[4] - (best[0].shape[1] - 1) * cost)
    single, alone = bad_votes == 1, np.ones((len(patterns), 1))
    for seen, base in ((single, alone), (single, share), (single & (share[:, 0] > 0.5), share)):
        lone = tuple(j for j in range(width) if (seen & (patterns[:, j] == BAD)).any())
        begun = np.append(base, np.zeros((len(patterns), len(lone))), axis=1)
        for at, j in enumerate(lone, base.shape[1]):
            begun[seen & (patterns[:, j] == BAD)] = np.arange(begun.shape[1]) == at
        found = estimate(patterns, weights, begun, lone)
        if lone and (found[3], found[4] - (base.shape[1] - 1) * cost - len(lone) * each) > level:
            best = found
            break
    share, _, rates, _, _ = best
    mass = weights @ share[:, 1:]
    return share[:, 0], np.stack([mass @ rates[1:] / max(mass.sum(), 1e-300), rates[0]])


_POWERS = 3 ** np.arange(len(HEURISTICS))


def _voted(batches):
    for batch in batches:
        chosen = batch.column(1).to_numpy(zero_copy_only=False)
        patterns, buckets, shares = [], [], []
        for row0, data, offsets in bytetext.blocks(batch.column(0)):
            features, counts, (where, bucket, share) = text_features(data, offsets)
            patterns.append(votes(features, counts) @ _POWERS)
            cut = np.searchsorted(where, np.arange(len(counts) + 1))
            for i in range(len(counts)):
                own = slice(cut[i], cut[i + 1])
                pick = bool(chosen[row0 + i])
                buckets.append(bucket[own] if pick else None)
                shares.append(share[own] if pick else None)
        flat = np.concatenate(patterns) if patterns else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat, pa.int32()), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))],
            names=["pattern", "buckets", "shares"])


def fit_linear(rows, buckets, shares, targets, steps: int = 300):
    """Logistic weights on soft targets by Adam, bias last."""
    n = len(targets)
    x = np.zeros((n, BUCKETS), dtype=np.float32)
    np.add.at(x, (rows, buckets), np.sqrt(shares))
    y = targets.astype(np.float32)
    w, b = np.zeros(BUCKETS, np.float32), 0.0
    m1, m2 = np.zeros(BUCKETS + 1, np.float32), np.zeros(BUCKETS + 1, np.float32)
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / n
        g = np.append(x.T @ error + 1e-5 * w, error.sum()).astype(np.float32)
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return np.append(w, b)


def _fit(posterior: dict[int, float]):
    def run(batches):
        rows, buckets, shares, targets = [], [], [], []
        for batch in batches:
            for pattern, own, share in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                rows.append(np.full(len(own.values), len(targets)))
                buckets.append(own.values.to_numpy())
                shares.append(share.values.to_numpy())
                targets.append(posterior[pattern])
        if targets:
            fitted = fit_linear(np.concatenate(rows), np.concatenate(buckets), np.concatenate(shares), np.array(targets))
            yield pa.RecordBatch.from_arrays([pa.array([fitted.astype(float).tolist()], pa.list_(pa.float64()))], names=["weights"])
    return run


def _scores(text: pa.Array, weights: np.ndarray, posterior: dict[int, float]):
    """(words, posterior, score) of each text."""
    sizes, likely, scores = [np.zeros(0, np.int64)], [], [np.zeros(0)]
    for _, data, offsets in bytetext.blocks(text):
        features, counts, (where, bucket, share) = text_features(data, offsets)
        raw = np.bincount(where, weights=np.sqrt(share) * weights[bucket], minlength=len(counts)) + weights[-1]
        scores.append(np.where(counts == 0, 0.0, 1 / (1 + np.exp(-np.clip(raw, -30, 30)))))
        sizes.append(counts)
        likely += [posterior.get(int(p), 0.5) for p in votes(features, counts) @ _POWERS]
    return np.concatenate(sizes), likely, np.concatenate(scores)


def _scored(shared):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                sizes, likely, scores = _scores(part.column(1), *shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(likely, pa.float64()), pa.array(scores), pa.array(scores >= THRESHOLD)],
                    names=["doc_id", "n_words", "posterior", "score", "kept"])
    return run


def train(documents: DataFrame) -> tuple[np.ndarray, dict[int, float]]:
    """(weights, posterior by pattern); votes of all documents are counted."""
    text = F.col("text").cast("string")
    n = documents.count()
    part = 1 << 30 if n <= SAMPLE else int(SAMPLE / n * (1 << 30))
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.length("text"), F.lit("quality")), F.lit(1 << 30)) < part
    voted = stored(documents.select(text.alias("text"), "doc_id").select("text", chosen.alias("chosen"))
                   .mapInArrow(_voted, "pattern int, buckets array<int>, shares array<double>"), "votes")
    counts = voted.groupBy("pattern").count().collect()  # at most 3^7 rows
    codes = np.array([r["pattern"] for r in counts], dtype=np.int64)
    patterns = (codes[:, None] // _POWERS) % 3
    good, _ = pattern_posteriors(patterns, np.array([r["count"] for r in counts], dtype=float))
    posterior = dict(zip(codes.tolist(), good.tolist()))
    fitted = voted.where("buckets is not null").repartition(1).mapInArrow(_fit(posterior), "weights array<double>").first()
    return (np.array(fitted["weights"]) if fitted else np.zeros(BUCKETS + 1)), posterior


def quality(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, posterior, score, kept) per row of ``documents(doc_id, text)``.

    Null, empty and blank texts score 0 and are not kept. Rows that repeat repeat
    their result; doc_id is only carried (and, with the length, draws the training
    sample). Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents))
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_scored(shared), f"doc_id {kind}, n_words long, posterior double, score double, kept boolean")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the scorer keeps, all columns."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents))
    return changed_rows(documents, lambda texts: (_scores(texts, *shared.value)[2] >= THRESHOLD, None))
