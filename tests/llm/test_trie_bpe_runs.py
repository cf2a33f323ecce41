"""Prefix trie, byte-level BPE and periodic runs against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from basketlake.llm import bpe, periodic, queries, trie
from llm_fixtures import CLASHING, make_docs, messy, nothing, shipped  # noqa: F401

RANKS = public_tokenizers.path(queries.RANKS)
CONVERSATIONS = "conv_id long, turn int, role string, text string"


def plain_trie(rows, shared_heads):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [r[1:] for r in sorted(turns)] for c, turns in own.items()}
    full = dict(own)
    if shared_heads:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 9
            full[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members, children, out = {}, {}, []
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        cost = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below[node] = (sum(below[k][0] for k in kids) or 1, cost + sum(below[k][1] for k in kids))
        ends = ",".join(map(str, sorted(c for c in members[node] if len(full[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids),
                    *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    """Few distinct turns, null turns, roles and texts, copies, two very long ones, turnless ones."""
    rng = random.Random(seed)
    rows = [(c, rng.choice([None, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "y", "é", None]))
            for c in range(60) for t in range(rng.choice([0, 1, 2, 3, 5, 12, 30]))]
    rows += [(61, i, "u", "z") for i in range(200)] + [(66, i, "u", "z") for i in range(150)] + [(None, 1, "u", "q")]
    return rows + [(70 + 5 * i, 0, "u", "k") for i in range(30)] + rows[:3] + [(-3, 0, "u", "x")]


@pytest.mark.parametrize("batch, piece", [(10_000, 1 << 16), (3, 4), (1, 1)])
def test_trie_equals_a_plain_one(spark, monkeypatch, batch, piece):
    """Whole shards, and shards of a few or single paths, whose spines merge."""
    if piece != 1 << 16:
        monkeypatch.setattr(trie, "HEAVY_ROWS", 20)
    rows = conversations(batch)
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("x") for c in ("c", "key", "depth", "way", "at")}).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == plain_trie(rows, False)
        if batch == 3:
            assert sorted(map(tuple, trie.shared_head_trie(df).collect()), key=str) == plain_trie(rows, True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_without_conversations(spark):
    rows = [(None, 1, "u", "x"), (None, None, None, None)]
    assert trie.shared_head_trie(spark.createDataFrame(rows, CONVERSATIONS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_end_lists_are_joined_in_pieces():
    """Pieces of one key stream through one digest, in any batching."""
    import pyarrow as pa

    ids = list(range(2, 1000, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 100 + ["b"] * (len(ids) - 100)), pa.array(ids)], ["key", "c"])
    old = trie.PIECE
    try:
        trie.PIECE = 7
        pieces = [p for part in (batch.slice(0, 150), batch.slice(150)) for p in trie._pieces([part])]
    finally:
        trie.PIECE = old
    got = [tuple(r.values()) for b in trie._hashed(pieces) for r in b.to_pylist()]
    want = [(part[0], len(part), hashlib.sha256(",".join(map(str, part)).encode()).hexdigest()) for part in (ids[:100], ids[100:])]
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 5000])
def test_find_close_equals_a_stack(n):
    rng = random.Random(n)
    signs, depth = [], 0
    while len(signs) < 2 * n:
        up = depth == 0 or (2 * n - len(signs) > depth and rng.random() < (0.5 if n < 1000 else 0.7))
        signs.append(1 if up else -1)
        depth += signs[-1]
    stack, close = [], {}
    for i, s in enumerate(signs):
        if s > 0:
            stack.append(i)
        else:
            close[stack.pop()] = i
    opens = np.flatnonzero(np.array(signs) > 0)
    assert trie.find_close(np.cumsum(signs), opens).tolist() == [close[i] for i in opens.tolist()]


ALPHABET = ["a", "b", "x", "é", "日", "本", "ü", "'", "!", "-", " ", "\n", "\t", "1", "２", "🎉", " ", "s", "t", "ll", " the", "ing", "\x1c", "<|endoftext|>"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        kind = i % 4
        if kind == 0:
            yield "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(600)))
        elif kind == 1:
            yield "".join(rng.choice(ALPHABET[:7]) for _ in range(rng.randrange(900)))
        elif kind == 2:
            yield rng.choice(ALPHABET) * rng.randrange(1500) + rng.choice(ALPHABET) * rng.randrange(500)
        else:
            yield "".join(rng.choice(ALPHABET) * rng.randrange(120) for _ in range(10))


@pytest.mark.parametrize("leaf, window", [(4096, 16), (40, 2), (64, 1), (37, 4)])
def test_ids_equal_the_library(monkeypatch, leaf, window):
    """Trees of small leaves give the ids of the library for each match, and the bytes come back."""
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "WINDOW", window)
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for text in odd_texts(leaf, 200):
        ids = codec.encode(text)
        assert ids.tolist() == codec.plain.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_join_of_halves_moves_a_whole_side():
    """A seam inside a run of equal letters shifts every later id: the window grows to the end."""
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    left, right = codec.plain.encode_ordinary("x" * 1025), codec.plain.encode_ordinary("x" * 4000)
    joined = codec.join(np.array(left, np.uint32), np.array(right, np.uint32))
    assert joined.tolist() == codec.plain.encode_ordinary("x" * 5025)


def test_long_matches(spark, make_docs):
    texts = ["x" * 300_001, " " * 50_001 + "a", "日本" * 30_000 + " é", "ab" * 100_000]
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for row in bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(row["ids"], "<u4").tolist() == codec.plain.encode_ordinary(texts[row["doc_id"]])


def test_bpe_rows(spark, messy, nothing, monkeypatch):
    """Every row comes back; null and empty texts have no ids; decoding is a step of its own as well."""
    use = (RANKS, public_tokenizers.PATTERN)
    codec = bpe.codec(*use)

    def sha(data):
        return hashlib.sha256(data).hexdigest()
    want = sorted((str(r["doc_id"]), len(i), sha(np.array(i, "<u4").tobytes()), sha((r["text"] or "").encode()))
                  for r in messy.select("doc_id", "text").collect() for i in [codec.plain.encode_ordinary(r["text"] or "")])
    got = bpe.token_digest(messy, *use).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    back = bpe.decoded(bpe.encoded(messy, *use), *use).select("doc_id", F.decode("decoded", "UTF-8").alias("text")).collect()
    assert sorted(map(str, back)) == sorted(map(str, messy.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert bpe.token_digest(nothing, *use).count() == 0


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q) and not any(words[start: start + length - p] == words[start + p: start + length] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    k, words = rng.choice([1, 2, 3, 50, 1000]), []
    size = rng.choice([0, 5, 50, 400, 900])
    while len(words) < size:
        part = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 12, 15, 16, 17, 18, 31, 32, 33, 40, 64, 65, 70]))]
        if rng.random() < 0.4:
            words += (part * rng.randrange(2, 9))[: len(part) * 8 - rng.randrange(len(part))]
        else:
            words += part[: rng.randrange(20)]
    return [str(w).encode() for w in words]


@pytest.mark.parametrize("lags", [8, 4, 2])
def test_runs_equal_brute_force(monkeypatch, lags):
    """Nested, touching and overlapping runs of all scales, several documents a block."""
    monkeypatch.setattr(periodic, "LAGS", lags)
    rng = random.Random(lags)
    for _ in range(60):
        docs = [repetitive(rng) for _ in range(3)]
        assert periodic._block_runs(docs) == [plain_runs(d) for d in docs]


def test_words_of_one_code_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic, "_codes", lambda words: np.array([len(w) for w in words], dtype=np.uint64))
    docs = [b"a b a a b a b b a b".split(), b"a b a b a b a b a b".split()]
    assert periodic._block_runs(docs) == [plain_runs(d) for d in docs]


def plain_digest(doc_id, text, variant=True):
    words = [w for w in (text or "").encode().split()]
    if variant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    found = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *found, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_query_equals_brute_force(spark, make_docs, nothing):
    rng = random.Random(9)
    rows = [(i, b" ".join(repetitive(rng)).decode(), "en", "s") for i in range(120)]
    rows += [(None, "a b " * 30, "en", "s"), (3, None, None, None), (3, "", "en", "s"), (4, " \t\n", "en", "s"), (5, "é é " * 50, "en", "s"), rows[0]]
    docs = make_docs(rows)
    got = periodic.run_digest(periodic.periodic_runs(docs, periodic.repeated_part)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_digest(r[0], r[1]) for r in rows), key=str)
    assert sum(r["n_runs"] > 0 for r in got) > 30
    collapsed = {r["doc_id"]: r["collapsed"] for r in periodic.periodic_runs(docs).collect()}
    assert collapsed[None] == "a b" and collapsed[4] == ""
    assert periodic.periodic_runs(nothing).count() == 0


def test_one_long_document(spark, make_docs):
    """A period of thousands of words, beyond all short scales."""
    rng = random.Random(1)
    part = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    text = " ".join(["x"] * 3 + part * 5 + part[:77] + ["y"])
    row = periodic.periodic_runs(make_docs([(1, text, "en", "s")])).first()
    assert [tuple(r) for r in row["runs"]] == [(3, 25_077, 5000)]
    assert row["collapsed"] == " ".join(["x"] * 3 + part + ["y"])
    assert set(CLASHING)  # extra columns of make_docs are ignored
