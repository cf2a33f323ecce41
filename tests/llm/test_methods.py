"""The methods against plain versions."""

import hashlib
import math
import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlake.llm import ann, bytetext, decontam, langid, licenses, mixing, neardup, quality, secret_scan, toxicity, warc
from llm_fixtures import make_docs, prose, shipped  # noqa: F401


def words_of(text, pattern):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, low)


def test_word_spans_and_hashes():
    import pyarrow as pa

    texts = ["Ab cd", None, "", " x\ty ", "é É ab", "AB"]
    seen = []
    for _, data, offsets in bytetext.blocks(pa.array(texts)):
        starts, ends, rows, counts = bytetext.word_spans(data, offsets, bytetext.BLANK_WORD)
        hashes = bytetext.word_hashes(data, starts, ends)
        assert counts.tolist() == [2, 0, 0, 2, 3, 1]
        seen = [(int(r), data[a:b].tobytes().decode()) for r, a, b in zip(rows, starts, ends)]
        assert hashes[0] == hashes[6] == hashes[7] and len(set(hashes.tolist())) == 6
    assert seen == [(0, "Ab"), (0, "cd"), (3, "x"), (3, "y"), (4, "é"), (4, "É"), (4, "ab"), (5, "AB")]


def mutated(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        if rng.random() < 0.5:
            out[at] = f"w{rng.randrange(10**6)}"
        else:
            del out[at]
    return out


def brute_components(docs, percent):
    sets = {}
    for i, text in docs:
        w = words_of(text, r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[j: j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(parent)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            inter = len(sets[a] & sets[b])
            if sets[a] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter) and inter:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small, tile", [(64, 256), (2, 3)])
def test_near_duplicates_equal_brute_force(spark, make_docs, monkeypatch, small, tile):
    """Graded copies around the threshold; also with every open bucket cut into small tiles."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(3)
    docs = []
    for group in range(5):
        base = [f"g{group}w{rng.randrange(300)}" for _ in range(120)]
        for copy in range(16):
            docs.append((len(docs), " ".join(mutated(rng, base, copy // 3))))
    docs += [(len(docs), "one two"), (len(docs) + 1, "One  TWO"), (len(docs) + 2, "one two three")]
    truth = brute_components(docs, 85)
    out = neardup.near_duplicates(make_docs([(i, t, "en", "s") for i, t in docs]), 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == truth
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_clashing_ids_lose_no_other_text(spark, make_docs):
    """Rows of one doc_id fall only with rows of their own component."""
    copy = prose(1, 80)
    near = copy + " more"
    other, third = prose(2, 80), prose(3, 80)
    rows = [(3, copy, "en", "a"), (7, other, "en", "a"), (7, near, "en", "a"), (9, other, "en", "a"), (9, third, "en", "b"),
            (9, third, "en", "a"), (11, "", "en", "a"), (11, prose(5, 80), "en", "a"), (None, copy, "en", "a"),
            (1, prose(6, 80), "en", "a"), (1, prose(6, 80) + " end", "en", "a")]
    docs = make_docs(rows)
    want = [(3, copy), (7, other), (9, third), (11, ""), (11, prose(5, 80)), (None, copy)]
    outs = [sorted(map(tuple, neardup.deduplicated(d).select("doc_id", "text", "source").collect()), key=str)
            for d in (docs, docs.repartition(5), docs.orderBy(F.desc("source"), F.desc("text")))]
    assert outs[0] == outs[1] == outs[2]
    assert sorted([r[:2] for r in outs[0] if r[0] != 1], key=str) == sorted(want, key=str)
    assert len(outs[0]) == len(want) + 1 and neardup.deduplicated(docs).columns == docs.columns


def test_densification_fills_alike():
    rng = np.random.default_rng(0)
    few = np.sort(rng.integers(0, 1 << 63, 9, dtype=np.uint64))
    values = neardup.densified([few, few[:1]])
    assert (values != neardup.EMPTY).all() and set(values[0]) <= set(few) and set(values[1]) == set(few[:1])
    many = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    other = np.sort(np.concatenate((many[:380], rng.integers(0, 1 << 63, 20, dtype=np.uint64))))
    a, b = neardup.densified([many, other])
    assert abs((a == b).mean() - 380 / 420) < 0.08


@pytest.mark.parametrize("limit", [100_000, 7])
def test_contamination_equals_brute_force(spark, make_docs, monkeypatch, limit):
    """One broadcast block, and many (a benchmark beyond the bound)."""
    monkeypatch.setattr(decontam, "MAX_WINDOWS", limit)
    rng = random.Random(1)
    items = [(i, " ".join(f"b{rng.randrange(40)}" for _ in range(n))) for i, n in enumerate([14, 10, 3, 1, 25, 0])]
    items.append((10, items[0][1]))
    docs = []
    for i in range(40):
        words = [f"b{rng.randrange(40)}" for _ in range(30)]
        if i % 2:
            words[5:5] = items[rng.choice([0, 1, 4])][1].upper().split()[: rng.choice([9, 10, 12])]
        docs.append((i, "; ".join(words)))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    expected = {}
    for i, text in docs:
        w, hit, found = words_of(text, word), set(), set()
        for item, body in items:
            b = words_of(body, word)
            k = min(10, len(b))
            grams = {tuple(b[j: j + k]) for j in range(len(b) - k + 1)} if b else set()
            for j in range(len(w) - k + 1):
                if k and tuple(w[j: j + k]) in grams:
                    hit.update(range(j, j + k))
                    found.add(str(item))
        expected[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    df = make_docs([(i, t, "en", "s") for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contamination_digest(df, bench).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == expected
    kept = {r["doc_id"] for r in decontam.decontaminated(df, bench).collect()}
    assert kept == {i for i, e in expected.items() if not e[4]}
    cleaned = decontam.decontaminated(df, bench, remove="spans")
    assert cleaned.count() == len(docs)


def test_spans_of_many_blocks_are_cut_at_once(spark, make_docs, monkeypatch):
    rng = random.Random(11)
    item = [f"b{i}" for i in range(60)]
    rows = [(None, None, "en", "s"), (0, "", "en", "s")]
    for i in range(1, 30):
        words = [f"É{rng.randrange(50)}" for _ in range(40)]
        a = rng.randrange(45)
        words[9:9] = item[a: a + rng.randrange(8, 16)]
        rows += [(i, "; ".join(words), "en", "s")] * (1 + i % 2)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "é1 é2")], "item_id long, text string")
    cleaned = []
    for limit in (100_000, 7):
        monkeypatch.setattr(decontam, "MAX_WINDOWS", limit)
        out = decontam.decontaminated(make_docs(rows), bench, remove="spans")
        assert out.columns == make_docs(rows).columns
        cleaned.append(sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str))
    assert cleaned[0] == cleaned[1] and len(cleaned[0]) == len(rows)


def test_mix_meets_targets(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), "en", f"s{i % 7 if i % 3 else 0}" if i % 11 else None) for i in range(400)]
    out = mixing.mixed(make_docs(rows)).collect()
    again = mixing.mixed(make_docs(rows).repartition(3)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    carried = mixing.mixed_rows(make_docs(rows))
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, carried.select(
        "row.doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    source = {r[0]: r[3] for r in rows}
    groups = {}
    for r in out:
        groups.setdefault(source[r["doc_id"]], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    order = sorted([s for s in groups if s is not None]) + [None]
    sizes = {s: sum(r["size"] for r in groups[s]) for s in order}
    weights = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
    target.update({s: level * weights[s] for s in open_})
    for s in order:
        assert math.isclose(groups[s][0]["target"], target[s]) and groups[s][0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in groups[s]) - target[s]) < 1.001


def test_repeated_rows_share_the_cut(make_docs):
    rows = [(1, "a b c d", "en", "s")] * 5 + [(2, "w " * 7, "en", "t")]
    out = mixing.mixed_rows(make_docs(rows)).collect()
    taken = [r["taken"] for r in out if r["row"]["doc_id"] == 1]
    target = next(r["target"] for r in out if r["row"]["doc_id"] == 1)
    assert len(out) == 6 and len(set(taken)) == 1 and target - 5 < sum(taken) <= target


def test_cuts_are_not_written_by_one_task(make_docs, monkeypatch):
    plans, write = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().logical().toString()), write(df, name))[1])
    mixing.mixed_rows(make_docs([(i, "w " * i, "en", f"s{i}") for i in range(20)]))
    assert len(plans) >= 3 and not any("Repartition 1," in p for p in plans)


def test_languages_on_planted_alphabets(make_docs):
    rng = random.Random(4)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oi", "é"]}
    rows = []
    for i in range(240):
        lang = sorted(syllables)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randrange(3, 40))), lang, "s"))
    out = langid.identify(make_docs(rows)).collect()
    assert any(r["held_out"] for r in out) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in out)


def test_grams_of_a_text():
    import pyarrow as pa

    for _, data, offsets in bytetext.blocks(pa.array(["Ab a", ""])):
        rows, codes, counts = langid.gram_counts(data, offsets)
    grams = {}
    for c, n in zip(codes.tolist(), counts.tolist()):
        size = (c >> 24) + 1
        grams[(c & 0xFFFFFF).to_bytes(3, "big")[3 - size:].decode()] = n
    assert set(rows.tolist()) == {0}
    assert grams == {"a": 2, "b": 1, " a": 2, "ab": 1, "b ": 1, "a ": 1, " ab": 1, "ab ": 1}


def secret_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", m) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(((m.start(), order.index(k), m.end()) for k, m in found))


def test_secrets_keep_base_and_find_more(make_docs):
    rng = random.Random(5)
    vocabulary = "the quick brown fox jumps over lazy dogs while éclairs und straße wait here for more of it".split()

    def value(n=28):
        return "".join(rng.choices("abcdef0123456789", k=n))
    rows = []
    for i in range(400):
        words = rng.choices(vocabulary, k=60)
        if i % 2 == 0:
            words.insert(rng.randrange(5, 50), rng.choice([f'token = "{value()}"', f"password={value(18)}", "AKIA" + value(18).upper(), f"Secret: {value()}"]))
        rows.append((i, " ".join(words), "en", "s"))
    # not in any base pattern: a password introduced by a word that the patterns do not join
    planted = {}
    for i in range(1000, 1006):
        words = rng.choices(vocabulary, k=40)
        head = " ".join(words[:20]) + " password is "
        planted[i] = f"crf:{len(head)}:{len(head) + 18}"
        rows.append((i, head + value(18) + " " + " ".join(words[20:]), "en", "s"))
    rows.append((2000, "toKen=abcde, toſen=abcdefgh passwd : \"abc.def=ghi\" AKIA0000 " + "f" * 24, "en", "s"))
    out = {r["doc_id"]: r for r in secret_scan.secret_spans(make_docs(rows)).collect()}
    for i, text, _, _ in rows:
        base = secret_base(text)
        names = ["assign", "access", "hex"]
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert out[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert {f"{names[k]}:{a}:{b}" for a, k, b in base} <= set(out[i]["spans"].split(",") if out[i]["spans"] else [])
        assert [out[i]["n_assign"], out[i]["n_access"], out[i]["n_hex"]] == [sum(k == j for _, k, _ in base) for j in range(3)]
    assert sum(out[i]["spans"] == span for i, span in planted.items()) >= 2
    assert sum("crf" in out[i]["spans"] for i in range(1, 400, 2)) <= 4


def test_pruned_viterbi_is_exact():
    rng = np.random.default_rng(8)
    field = secret_scan.Field(None)
    field.weights = []
    for _ in range(30):
        flat = np.concatenate([np.zeros(3 * sum(secret_scan.SIZES)), rng.normal(0, 1.5, 9)])
        field = secret_scan.Field(flat)
        emit = rng.normal(0, 2, (40, 3)) + np.array([2.5, 0, 0])
        rows = np.repeat([0, 1, 2], [15, 1, 24])
        plain = np.concatenate([secret_scan.viterbi(emit[rows == r], field.moves) for r in range(3)])
        assert field.tags(emit, rows).tolist() == plain.tolist()


def test_field_learns_a_chain():
    rng = np.random.default_rng(1)
    features = rng.integers(1, 4, (200, 17, 6))
    features[:, :, 5] = 0
    tags = np.zeros((200, 17), dtype=int)
    for n in range(200):
        at = rng.integers(2, 14)
        features[n, at, 0], features[n, at + 1, 0] = 7, 8
        tags[n, at], tags[n, at + 1] = 1, 2
    weights, moves = secret_scan.fit_field(features, tags)
    field = secret_scan.Field(np.concatenate([w.reshape(-1) for w in weights] + [moves.reshape(-1)]))
    assert np.array_equal(field.tags(field.emissions(features[0]), np.zeros(17, int)), tags[0])


def test_weak_labels_find_the_rare_kind():
    rng = np.random.default_rng(0)
    n = 4000
    bad = rng.random(n) < 0.12
    kind = rng.integers(0, 3, n)
    patterns = np.full((n, 4), quality.GOOD)
    for j in range(3):
        patterns[bad & (kind == j) & (rng.random(n) < 0.95), j] = quality.BAD
    patterns[rng.random(n) < 0.3, 3] = quality.NONE
    patterns[~bad & (rng.random(n) < 0.001), 0] = quality.BAD
    distinct, counts = np.unique(patterns, axis=0, return_counts=True)
    good, _ = quality.pattern_posteriors(distinct, counts.astype(float))
    for row, p in zip(distinct, good):
        assert (p < 0.5) == bool((row == quality.BAD).any())


def plain_em(rows, start):
    """One good and one bad class, row by row in loops over the distinct rows."""
    counts = collections.Counter(map(tuple, rows))
    good = {p: start(p) for p in counts}
    total = sum(counts.values())
    for _ in range(quality.ROUNDS):
        rates, shares = [], []
        for share, (mean, strength) in ((lambda p: good[p], quality.GOOD_PRIOR), (lambda p: 1 - good[p], quality.BAD_PRIOR)):
            shares.append((sum(share(p) * c for p, c in counts.items()) + 1) / (total + 2))
            rates.append([
                (sum(share(p) * c for p, c in counts.items() if p[j] == quality.BAD) + mean * strength)
                / (sum(share(p) * c for p, c in counts.items() if p[j] != quality.NONE) + strength) for j in range(len(rows[0]))])
        for p in counts:
            odds, silent = list(shares), 1.0
            for vote, r_good, r_bad in zip(p, *rates):
                odds[0] *= r_good if vote == quality.BAD else 1 - r_good if vote == quality.GOOD else 1
                odds[1] *= r_bad if vote == quality.BAD else 1 - r_bad if vote == quality.GOOD else 1
                silent *= 1 - r_bad if vote != quality.NONE else 1
            # a bad text is seen by some heuristic, but for a given share
            odds[1] = odds[1] * (1 - quality.UNSEEN) / (1 - silent) if quality.BAD in p else shares[1] * quality.UNSEEN
            good[p] = odds[0] / (odds[0] + odds[1])
    return good, rates


@pytest.mark.parametrize("seed", range(3))
def test_weak_label_rates_of_erring_heuristics_are_estimated(seed):
    rng = np.random.default_rng(seed)
    n = 20_000
    alarms, hits = np.array([0.20, 0.10, 0.30, 0.05, 0.15]), np.array([0.8, 0.7, 0.9, 0.6, 0.75])
    bad = rng.random(n) < 0.3
    votes = np.where(rng.random((n, 5)) < np.where(bad[:, None], hits, alarms), quality.BAD, quality.GOOD)
    votes[rng.random((n, 5)) < 0.1] = quality.NONE
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, rates = quality.pattern_posteriors(patterns, counts.astype(float))
    assert np.abs(rates[0] - hits).max() < 0.03 and np.abs(rates[1] - alarms).max() < 0.03
    right = ((good[where.ravel()] < 0.5) == bad).mean()
    majority = ((votes == quality.BAD).sum(1) > (votes == quality.GOOD).sum(1)) == bad
    assert right >= majority.mean()
    plain, plain_rates = plain_em(votes.tolist(), lambda p: 0.05 if p.count(quality.BAD) > p.count(quality.GOOD) else 0.95)
    assert max(abs(plain[tuple(p)] - g) for p, g in zip(patterns.tolist(), good)) < 1e-6
    assert np.abs(np.array(plain_rates)[::-1] - rates).max() < 1e-6


def test_weak_labels_know_a_kind_from_the_noise_of_good_texts():
    # heuristics 0 and 1 see one kind, 2 and 3 another; heuristic 4 errs on its own, 30 % of the time
    rng = np.random.default_rng(5)
    n = 10_000
    kind = rng.choice(3, n, p=[0.9, 0.05, 0.05])
    votes = np.full((n, 5), quality.GOOD)
    votes[kind == 1, 0:2] = votes[kind == 2, 2:4] = quality.BAD
    votes[rng.random(n) < 0.3, 4] = quality.BAD
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, rates = quality.pattern_posteriors(patterns, counts.astype(float))
    assert ((good[where.ravel()] > 0.5) == (kind == 0)).all()
    assert abs(rates[1][4] - 0.3) < 0.03


def test_weak_labels_of_nothing_and_of_one_pattern():
    good, rates = quality.pattern_posteriors(np.zeros((0, 5), int), np.zeros(0))
    assert not len(good) and rates.shape == (2, 5)
    good, _ = quality.pattern_posteriors(np.full((1, 5), quality.GOOD), np.array([50.0]))
    assert good[0] > 0.5


def test_quality_keeps_prose_and_drops_junk(make_docs):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mir", "the", "on") for b in ("n", "der", "t", "ing", "a")]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, k=50)
        if i % 6 == 1:
            words = [w for w in words[:5] for _ in range(12)]
        if i % 6 == 3:
            words = [w.upper() + "!!" for w in words]
        if i % 6 == 5:
            words = [w + rng.choice(["%%%", "###"]) for w in words]
        rows.append((i, " ".join(words), "en", "s"))
    out = {r["doc_id"]: r["kept"] for r in quality.quality(make_docs(rows)).collect()}
    wrong = [i for i in out if out[i] != (i % 2 == 0)]
    assert len(wrong) <= 3


def test_factorization_machine_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 6)) < 0.4
    y = (x[:, 0] & x[:, 1]).astype(int)
    rows, terms = np.nonzero(x)
    bias, linear, factors = toxicity.fit_machine(rows, terms, y, 6, steps=800)
    score = bias + x @ linear + 0.5 * (((x @ factors) ** 2).sum(1) - x @ (factors ** 2).sum(1))
    assert ((score > 0) == (y == 1)).mean() > 0.99 and factors[0] @ factors[1] > 0.5


def test_toxic_words_on_held_out_rows(spark, make_docs):
    rng = random.Random(7)
    clean = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(1200):
        words = rng.choices(clean, k=rng.randrange(5, 60))
        toxic = i % 8 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilesort", "grimoaf", "badstem" + rng.choice("abcdef")]))
        rows.append((i, " ".join(words), "en", "s"))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = [r for r in toxicity.toxicity(make_docs(rows), labels).collect() if r["held_out"]]
    assert len(out) > 100 and all(r["predicted"] == (r["score"] >= 0.3) for r in out)
    wrong = [r for r in out if r["predicted"] != (r["doc_id"] % 8 == 0)]
    assert len(wrong) <= len(out) * 0.02


def test_licenses_base_and_templates(make_docs):
    rows = [
        (0, "Released UNDER the\nMIT license. Under the mit license!", "en", "s"),
        (1, "text\nThis work is licensed under the GNU General Public License, version 3.\nmore", "en", "s"),
        (2, "CC-BY-NC by cc by nc", "en", "s"),
        (3, "This work is licensed under something else", "en", "s"),
        (4, "Apache License, Version 2.0 and Apache License Version 22", "en", "s"),
    ]
    out = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_scan(make_docs(rows)).collect()}
    assert out[0] == (9, 2, 1, 5, "mit", "mit", 1.0)
    assert out[1][:6] == (14, 0, None, None, "", "gpl-3") and out[1][6] == 1.0
    assert out[2][1:4] == (2, 0, 4)
    assert out[3][4:] == ("", "", 0.0)
    assert out[4][1:4] == (1, 0, 0)


def test_licenses_of_wrapped_notices(make_docs):
    """Canonical texts wrapped over lines, at any place of a long text; scattered words are none."""
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\n"
           "in the Software without restriction")
    bsd = ("Redistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions\nare met:")
    gpl = ("This program is free software: you can redistribute it and/or modify\n"
           "it under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.")
    work = "This work is licensed under the GNU\n * General Public License,\n * version 3."
    words = [f"w{i}" for i in range(100)]
    rows = [(0, mit, "en", "s"), (1, bsd, "en", "s"), (2, gpl, "en", "s"), (3, work, "en", "s"),
            (4, mit.replace(" ", "\n"), "en", "s")]
    rows += [(100 + n, "\n".join(words[:n]) + "\n" + bsd + "\n" + "\n".join(words), "en", "s") for n in range(0, 100, 7)]
    rows.append((5, "\n".join(f"{w} {prose(n, 12)}" for n, w in enumerate(bsd.split())), "en", "s"))
    out = {r["doc_id"]: r for r in licenses.license_scan(make_docs(rows)).collect()}
    assert [out[i]["labels"] for i in range(6)] == ["mit", "bsd", "gpl-3", "gpl-3", "mit", ""]
    assert [out[i]["score"] for i in (0, 1, 2, 3, 5)] == [1.0, 1.0, 1.0, 1.0, 0.0]
    assert all(out[100 + n]["labels"] == "bsd" and out[100 + n]["score"] == 1.0 for n in range(0, 100, 7))


@pytest.fixture
def small_splits(spark):
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_archives_reject_magic_in_payloads(spark, tmp_path, small_splits):
    """Whole records, headers and bare magic inside payloads; files cut into many blocks."""
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rng = random.Random(9)
    rows = []
    for i in range(150):
        body = "".join(rng.choices("abc é<p>\r\n", k=rng.randrange(0, 300)))
        if i % 5 == 0:
            body = body + fake * rng.randrange(1, 40) + body + "WARC/1." * 3
        rows.append((i, f"http://h/{i}", body))
    rows += [(200, None, None), (201, "u\r\nX: y", ""), (202, "u", rows[5][2]), (None, "u", rows[5][2]), (203, "u", rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(found) == len(rows)
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(html or "", i)
    by_id = {r["page_id"]: r for r in found}
    for i, url, html in rows:
        r = by_id[None if i is None else str(i)]
        raw = (html or "").encode()
        import base64
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if first[html or ""] == i:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == raw
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == str(first[html or ""]) and r["payload"] is None


def test_small_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), min_bytes=5)
    assert {r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {"response"}


def test_chain_intervals():
    chunks = [(0, 3, 10), (10, 3, 20), (15, 2, 20), (20, 3, 40), (30, 1, None)]
    rows = warc.chain_rows(chunks)
    assert [r[0] for r in rows] == [40, 40, 40, 40, None]

    def meets(e, c):
        return rows[c][1] <= rows[e][1] < rows[c][2]
    assert meets(0, 1) and meets(0, 3) and not meets(0, 2) and meets(2, 3) and not meets(2, 1) and not meets(3, 0)


def test_recall_against_brute_force(spark):
    """Vectors without structure: the fitted window still reaches 0.9."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:40] *= 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = ann.nearest(df).collect()
    full = x.astype(float)
    hits, truth = 0, 0
    found = {}
    for r in out:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert math.isclose(r["score"], float(full[r["query_id"]] @ full[r["vec_id"]]), rel_tol=1e-12, abs_tol=1e-12)
    for q in range(0, 3000, 20):
        scores = full @ full[q]
        scores[q] = -np.inf
        best = set(np.argsort(-scores, kind="stable")[:20].tolist())
        hits, truth = hits + len(best & found[q]), truth + 20
    assert hits / truth >= 0.9


def test_hilbert_curve_is_a_path():
    cells = np.array([(a, b, c) for a in range(4) for b in range(4) for c in range(4)])
    order = cells[np.argsort(ann.hilbert_keys(cells, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_toxicity_of_pairs_that_tell_nothing_apart(spark, make_docs):
    """Toxic if both words stand there or neither; each alone has no log-odds, in a vocabulary of thousands."""
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(4000):
        words = [f"word{rng.randrange(3000)}" for _ in range(25)]
        first, second = rng.random() < 0.5, rng.random() < 0.5
        words[3:3] = ["insultish"] * first
        words[9:9] = ["groupname"] * second
        rows.append((i, " ".join(words), "en", "s"))
        marks.append((i, 1, int(first == second)))
    out = toxicity.toxicity(make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).where("held_out").collect()
    right = sum((r["score"] >= 0.5) == bool(marks[r["doc_id"]][2]) for r in out)
    assert len(out) > 900 and right >= 0.9 * len(out)


@pytest.mark.parametrize("most", [50, 1 << 22])
def test_ranks_by_count_at_any_size(most):
    """Counts beyond the packed form rank like all others."""
    rng = np.random.default_rng(most)
    rows, codes = np.sort(rng.integers(0, 5, 400)), rng.integers(0, 1 << 20, 400)
    counts = rng.integers(1, most, 400)
    got = list(zip(*[x.tolist() for x in langid.by_count(rows, codes, counts)]))
    assert got == [(r, c) for r, _, c in sorted(zip(rows.tolist(), (-counts).tolist(), codes.tolist()))]


def test_licenses_lower_case_a_to_z_only(spark, make_docs):
    kelvin = "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License wor\u212a"
    docs = make_docs([(1, kelvin, "en", "s"), (2, kelvin.upper(), "en", "s"), (3, "UNDER THE MIT LICENSE", "en", "s"), (4, "under the m\u0130t license", "en", "s")])
    rows = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert rows[3]["base_labels"] == "mit" and rows[4]["base_labels"] == ""
    assert rows[1]["labels"] == rows[2]["labels"]
