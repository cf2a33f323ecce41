"""Secrets: fixed patterns, and a linear-chain conditional random field for the rest.

Tokens are runs of letters, digits, / _ - and bytes beyond ASCII. Each is tagged
outside, begin or inside from its shape, the words around it, what separates it
from the one before, and features of the whole text. The field learns from the
pattern matches of a bounded sample of texts and is decoded by Viterbi. A token
whose margin for "outside" beats anything its neighbours' tags can add is outside
on every best path, so only the stretches between such tokens are decoded.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.llm import bytetext
from basketlake.llm.common import changed_rows, stored, text_slices

SAMPLE = 12_000  #: texts, about, whose windows train the field
WINDOWS = 24_000  #: distinct training windows, about; a bound of the fit only
STEP_WINDOWS = 2048  #: windows of one step of the fit
REACH = 8  #: tokens on each side of a training window's middle

# Patterns of the base kinds, the shortest that counts, their order
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "crf"]

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_TOKEN = np.array([chr(b).isascii() and (chr(b).isalnum() or chr(b) in "/_-") or b >= 0x80 for b in range(256)])
_HEXES = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_FLAGS = {
    "digit": np.array([0x30 <= b <= 0x39 for b in range(256)]),
    "upper": np.array([0x41 <= b <= 0x5A for b in range(256)]),
    "lower": np.array([0x61 <= b <= 0x7A for b in range(256)]),
    "hex": _HEXES,
}
_SPLIT = np.array([1 if b in b":=" else 2 if b in b"\"'" else 0 for b in range(256)])
_WORDS = 1 << 12
#: Feature groups: own shape, length and mixture alone, word before, word after, separator before, whole text.
SIZES = [8 * 4 * 4 * 2, 8 * 2, _WORDS, _WORDS, 4, 16]
#: Ridge by group: a token's own shape should carry the tag where it can.
RIDGE = [1e-5, 1e-5, 3e-3, 3e-3, 3e-3, 3e-3]


def base_spans(raw: bytes, has_hex: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind."""
    found = []
    if b":" in raw or b"=" in raw:
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(raw) if len(m.group(2)) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(raw) if len(m.group()) >= LEAST["access"]]
    if has_hex:
        found += [(2, m.start(), m.end()) for m in HEX.finditer(raw) if len(m.group()) >= LEAST["hex"]]
    return found


def _secret_parts(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of the secret values the patterns find."""
    values = [m.span(2) for m in ASSIGN.finditer(raw) if len(m.group(2)) >= LEAST["assign"]]
    return values + [(a, b) for kind, a, b in base_spans(raw) if kind]


def token_features(data, offsets):
    """Token starts, ends, rows, counts, and one feature number per group and token."""
    starts, ends, rows, counts = bytetext.word_spans(data, offsets, _TOKEN)
    n = len(starts)
    length = ends - starts
    sums = {}
    for name, table in _FLAGS.items():
        total = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(table[data], out=total[1:])
        sums[name] = total[ends] - total[starts]
        if name == "digit":
            density = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    size = np.searchsorted([4, 8, 12, 16, 20, 24, 36], length, side="right")
    digits = np.where(sums["digit"] == 0, 0, np.searchsorted([0.25, 0.6], sums["digit"] / np.maximum(length, 1), side="right") + 1)
    # a capital first letter alone is ordinary writing
    inner = sums["upper"] - (_FLAGS["upper"][data[starts]] if n else 0)
    case = (inner > 0) * 2 + (sums["lower"] > 0)
    shape = ((size * 4 + digits) * 4 + case) * 2 + (sums["hex"] == length)
    coarse = size * 2 + ((sums["digit"] > 0) & (sums["digit"] < length))
    words = (bytetext.word_hashes(data, starts, ends) % np.uint64(_WORDS - 1)).astype(np.int64) + 1
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n > 1:
        same = rows[1:] == rows[:-1]
        before[1:] = np.where(same, words[:-1], 0)
        after[:-1] = np.where(same, words[1:], 0)
    marks = [np.concatenate(([0], np.cumsum(_SPLIT[data] == k))) for k in (1, 2)]
    left = np.where(before > 0, np.concatenate(([0], ends[:-1])) if n else starts, offsets[rows] if n else starts)
    split = (marks[0][starts] > marks[0][left]) + 2 * (marks[1][starts] > marks[1][left])
    signs = (marks[0][offsets[1:]] - marks[0][offsets[:-1]]) / np.maximum(counts, 1)
    file = np.searchsorted([0.002, 0.01, 0.05], density) * 4 + np.searchsorted([0.0, 0.01, 0.1], signs)
    return starts, ends, rows, counts, np.stack([shape, coarse, before, after, split, file[rows] if n else rows], axis=1)


def _windows(batches):
    """Training windows (features and tags) of the sampled texts."""
    span = 2 * REACH + 1
    for batch in batches:
        features, tags = [], []
        for _, data, offsets in bytetext.blocks(batch.column(0)):
            starts, ends, rows, counts, found = token_features(data, offsets)
            first = np.concatenate(([0], np.cumsum(counts)))
            for i, count in enumerate(counts):
                if count < span:
                    continue
                own = np.zeros(count, dtype=np.int64)
                a0, b0 = starts[first[i]: first[i + 1]] - offsets[i], ends[first[i]: first[i + 1]] - offsets[i]
                middles = [REACH + (int(offsets[i + 1] - offsets[i]) * 7919 + int(count)) % (count - span + 1)]
                for a, b in _secret_parts(data[offsets[i]: offsets[i + 1]].tobytes()):
                    inside = np.flatnonzero((a0 < b) & (b0 > a))
                    own[inside] = INSIDE
                    own[inside[:1]] = BEGIN
                    middles += inside[:1].tolist()
                for middle in middles:
                    low = min(max(0, middle - REACH), count - span)
                    features.append(found[first[i] + low: first[i] + low + span].reshape(-1))
                    tags.append(own[low: low + span])
        yield pa.RecordBatch.from_arrays([
            pa.array([f.tolist() for f in features], pa.list_(pa.int32())), pa.array([t.tolist() for t in tags], pa.list_(pa.int32()))],
            names=["features", "tags"])


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(features: np.ndarray, tags: np.ndarray, counts: np.ndarray | None = None, steps: int = 240):
    """(weights per group, transitions) by Adam on the negative log-likelihood.

    features: windows x tokens x groups; tags: windows x tokens; counts: how often each
    window occurs. A step sees ``STEP_WINDOWS`` windows, in a fixed shuffled order, and
    the last third of the steps shrinks, so that their noise averages out.
    """
    total, length, groups = features.shape
    share = np.ones(total) if counts is None else counts / counts.mean()
    order = np.random.default_rng(0).permutation(total)
    size = min(total, STEP_WINDOWS)
    weights = [np.zeros((s, 3)) for s in SIZES]
    moves = np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = -4.0
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in [*weights, moves]]
    for step in range(1, steps + 1):
        chosen = np.take(order, np.arange((step - 1) * size, step * size), mode="wrap")
        x, w = features[chosen], share[chosen][:, None, None] / size
        gold = np.eye(3)[tags[chosen]]
        emit = sum(weights[g][x[:, :, g]] for g in range(groups))
        ahead, back = np.zeros((size, length, 3)), np.zeros((size, length, 3))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, length):
            ahead[:, t] = emit[:, t] + _log_sum(ahead[:, t - 1][:, :, None] + moves, 1)
        for t in range(length - 2, -1, -1):
            back[:, t] = _log_sum(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        whole = _log_sum(ahead[:, -1], 1)
        error = (np.exp(ahead + back - whole[:, None, None]) - gold) * w
        joint = np.exp(ahead[:, :-1, :, None] + moves + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        gradients = []
        for g in range(groups):
            flat = x[:, :, g].reshape(-1)
            slope = np.stack([np.bincount(flat, weights=error[:, :, c].reshape(-1), minlength=len(weights[g])) for c in range(3)], axis=1)
            gradients.append(slope + RIDGE[g] * weights[g])
        pairs = np.einsum("nta,ntb,n->ab", gold[:, :-1], gold[:, 1:], w[:, 0, 0])
        gradients.append(np.einsum("ntab,n->ab", joint, w[:, 0, 0]) - pairs + 2e-4 * moves)
        rate = 0.1 * min(1.0, 3 * (1 - (step - 1) / steps))
        for i, slope in enumerate(gradients):
            first, second = state[i]
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope * slope
            state[i] = first, second
            change = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            if i < groups:
                weights[i] = weights[i] - change
            else:
                moves = moves - change
    return weights, moves


def _fit(batches):
    windows, tags, counts = [], [], []
    for batch in batches:
        windows.append(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, 2 * REACH + 1, len(SIZES)))
        tags.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, 2 * REACH + 1))
        counts.append(batch.column(2).to_numpy())
    if counts:
        weights, moves = fit_field(np.concatenate(windows), np.concatenate(tags), np.concatenate(counts))
        flat = np.concatenate([w.reshape(-1) for w in weights] + [moves.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["flat"])


def viterbi(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of one stretch; equal scores take the lower tag."""
    best, back = emit[0], []
    for scores in emit[1:]:
        paths = best[:, None] + moves
        back.append(paths.argmax(0))
        best = paths.max(0) + scores
    tags = [int(best.argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return np.array(tags[::-1])


class Field:
    def __init__(self, flat: np.ndarray | None):
        self.weights = None
        if flat is not None:
            cuts = np.cumsum([s * 3 for s in SIZES])
            parts = np.split(flat, cuts)
            self.weights = [p.reshape(-1, 3) for p in parts[:-1]]
            self.moves = parts[-1].reshape(3, 3)
            # the most that leaving "outside" can gain from its two neighbours
            self.gain = [0.0] + [max(max(0.0, (self.moves[a, x] - self.moves[a, 0]) + (self.moves[x, b] - self.moves[0, b]),
                                         self.moves[a, x] - self.moves[a, 0], self.moves[x, b] - self.moves[0, b])
                                     for a in range(3) for b in range(3)) for x in (1, 2)]

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(w[features[:, g]] for g, w in enumerate(self.weights))

    def tags(self, emit: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Viterbi tags of all tokens; only stretches that may leave "outside" are decoded."""
        out = np.zeros(len(emit), dtype=np.int64)
        open_ = np.flatnonzero((emit[:, 1] + self.gain[1] >= emit[:, 0]) | (emit[:, 2] + self.gain[2] >= emit[:, 0]))
        if not len(open_):
            return out
        breaks = np.flatnonzero((np.diff(open_) > 1) | (rows[open_[1:]] != rows[open_[:-1]])) + 1
        for part in np.split(open_, breaks):
            low, high = part[0], part[-1] + 1
            if low and rows[low - 1] == rows[low]:
                low -= 1  # the neighbours are outside for certain and carry their transitions
            if high < len(rows) and rows[high] == rows[high - 1]:
                high += 1
            out[low:high] = viterbi(emit[low:high], self.moves)
        return out

    def spans(self, data, offsets) -> dict[int, list[tuple[int, int]]]:
        """Byte spans (within the text) by row."""
        if self.weights is None:
            return {}
        starts, ends, rows, _, features = token_features(data, offsets)
        found: dict[int, list[tuple[int, int]]] = {}
        if not len(starts):
            return found
        tags = self.tags(self.emissions(features), rows)
        for i in np.flatnonzero(tags):
            row = int(rows[i])
            own = found.setdefault(row, [])
            a, b = int(starts[i] - offsets[row]), int(ends[i] - offsets[row])
            if tags[i] == INSIDE and own and i and tags[i - 1] and rows[i - 1] == row:
                own[-1] = (own[-1][0], b)
            else:
                own.append((a, b))
        return found


def _drawn(rows: DataFrame, keep: int, *by) -> DataFrame:
    """About ``keep`` of the rows, drawn by a digest of ``by`` alone."""
    n = rows.count()
    part = 1 << 30 if n <= keep else int(keep / n * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(*by, F.lit("secrets")), F.lit(1 << 30)) < part)


def train(documents: DataFrame) -> Field:
    """Fit on about WINDOWS distinct windows of about SAMPLE texts.

    Both draws go by digests of content, so they do not depend on where rows lie. Equal
    windows are counted and weigh so much: neither a text full of secrets nor a hot
    group of copies brings more rows to the one task that fits.
    """
    sample = _drawn(documents, SAMPLE, F.col("doc_id").cast("string"), F.col("text").cast("string"))
    windows = stored(sample.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text"))
                     .mapInArrow(_windows, "features array<int>, tags array<int>")
                     .groupBy("features", "tags").agg(F.count(F.lit(1)).cast("double").alias("n")), "windows")
    fitted = _drawn(windows, WINDOWS, "features", "tags").repartition(1).sortWithinPartitions("features", "tags").mapInArrow(
        _fit, "flat array<double>").first()
    return Field(np.array(fitted["flat"]) if fitted else None)


def all_spans(data, offsets, field: Field):
    """Per row: (kind, start, end) of base spans, and of those plus the field's, sorted; in bytes."""
    sizes = np.diff(offsets)
    starts, ends, rows, _ = bytetext.word_spans(data, offsets, _HEXES)
    hexed = set(rows[ends - starts >= LEAST["hex"]].tolist())
    more = field.spans(data, offsets)
    out = []
    for i in range(len(sizes)):
        raw = data[offsets[i]: offsets[i + 1]].tobytes()
        base = sorted(base_spans(raw, i in hexed), key=lambda s: (s[1], s[0]))
        added = [(3, a, b) for a, b in more.get(i, ()) if not any(a < e and s < b for _, s, e in base)]
        out.append((raw, base, sorted(base + added, key=lambda s: (s[1], s[0]))))
    return out


def _in_code_points(raw: bytes, spans):
    if raw.isascii() or not spans:
        return spans
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(k, int(lead[a]), int(lead[b])) for k, a, b in spans]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(shared):
    def run(batches):
        field = shared.value
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            counts, digests, spans = ([], [], []), [], []
            for _, data, offsets in bytetext.blocks(batch.column(1)):
                for raw, base, every in all_spans(data, offsets, field):
                    for kind in range(3):
                        counts[kind].append(sum(k == kind for k, _, _ in base))
                    digests.append(hashlib.sha256(_joined(_in_code_points(raw, base)).encode()).hexdigest())
                    spans.append(_joined(_in_code_points(raw, every)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def secret_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of ``documents(doc_id, text)``.

    Spans are ``kind:start:end`` in code points, end exclusive; the field's (``crf``)
    join those of the patterns where they touch none of them. Null and empty texts
    have no spans. Without a text long enough to learn from, the patterns stand alone.
    Rows that repeat repeat their result; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents))
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_scan(shared), f"doc_id {kind}, {_FOUND}")


MASK = b"[SECRET]"


def _masked(shared):
    def change(texts):
        out = []
        for _, data, offsets in bytetext.blocks(texts):
            for raw, _, every in all_spans(data, offsets, shared.value):
                parts, last = [], 0
                for _, a, b in sorted(every, key=lambda s: s[1]):
                    if a >= last:
                        parts += [raw[last:a], MASK]
                    last = max(last, b)
                out.append(b"".join([*parts, raw[last:]]).decode("utf-8", "replace") if every else None)
        return None, pa.compute.coalesce(pa.array(out, pa.string()), texts)
    return change


def masked(documents: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by a mark; all other columns as they are."""
    return changed_rows(documents, _masked(documents.sparkSession.sparkContext.broadcast(train(documents))))
