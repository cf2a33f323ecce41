"""License notices: exact containment join between text blocks and notice templates.

A block is a line of a text, or a run of words anywhere in it, whatever the line
breaks: at most ``SPREAD`` times as many words as the template. A block meets a
template when it holds at least ``CONTAINMENT`` of the template's distinct words.
Runs are looked for in overlapping stretches of the text, of which one holds any
run whole; where a stretch qualifies, each run in it is counted.

Words are ordered by their frequency over all lines, rarest first: a block (line or
stretch) that meets a template of n words
shares one of its first n - ceil(t n) + 1 words (prefix filter), holds at least
ceil(t n) template words (length filter), and what can follow their first shared
word suffices (positional filter). What passes is verified on the sets. All
built-in functions.
"""

from __future__ import annotations

import math
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm.common import stored

# Phrases with their labels, notices with their labels, word pattern
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.9
SPREAD = 2  #: words of a run for each word of the template
REACH = SPREAD * max(len(notice.split()) for _, notice in TEMPLATES)  #: the longest run


def template_sets() -> list[tuple[str, list[str], int]]:
    """(label, distinct words, least number of shared words) of each template."""
    out = []
    for label, notice in TEMPLATES:
        words = sorted(set(notice.split()))
        out.append((label, words, math.ceil(CONTAINMENT * len(words) - 1e-9)))
    return out


def _places(words: str, phrase: str) -> Column:
    """Starts of the phrase among the words."""
    parts = phrase.split()
    return F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: reduce(lambda a, b: a & b, [F.get(F.col(words), i + j) == p for j, p in enumerate(parts)]))


def _base(words: str, low: str) -> list[Column]:
    likely = (F.col(low).contains("license") | F.col(low).contains("cc")) & (F.size(words) > 0)
    none = F.expr("cast(array() as array<int>)")
    return [F.when(likely, _places(words, phrase)).otherwise(none).alias(f"at_{i}") for i, phrase in enumerate(PHRASES.values())]


def license_scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    Base columns tell where the words of a phrase stand in a row, across lines too;
    ``labels`` adds those of templates that a line or a run of words meets. ``score`` is 1 with a base
    place, else the largest containment met, else 0. Null and empty texts have no
    words and no labels. Rows that repeat repeat their result; other columns are ignored.
    """
    spark = documents.sparkSession
    sets = template_sets()
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    fewest = min(least for _, _, least in sets)
    known = F.array(*[F.lit(w) for w in vocabulary])
    # A-Z alone: other letters with an ASCII small form stay as they are
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    low = documents.select("doc_id", text.alias("low"))
    lines = low.withColumn("lines", F.transform(
        F.split("low", "\n", -1), lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0))))
    counted = lines.select(
        "doc_id", "low", F.flatten("lines").alias("words"),
        F.transform("lines", lambda line: F.array_intersect(line, known)).alias("blocks"))
    # stretches of 2 * REACH words, one from every REACH-th word on; words of no template are null
    marked = counted.withColumn("marked", F.transform("words", lambda w: F.when(w.isin(vocabulary), w)))
    stretches = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("marked") - 1, F.lit(0)), F.lit(REACH)),
        lambda i: F.slice("marked", i + 1, 2 * REACH))
    scanned = marked.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), *_base("words", "low"),
        F.filter("blocks", lambda b: F.size(b) > 0).alias("blocks"),
        F.filter(stretches, lambda b: F.size(F.array_compact(b)) >= fewest).alias("stretches"))
    rows = stored(scanned.withColumn("rid", F.monotonically_increasing_id()), "blocks")

    # global order: rarest first; at most one row per template word reaches the driver
    counts = {r["w"]: r["n"] for r in rows.select(F.explode("blocks").alias("b")).select(F.explode("b").alias("w"))
              .groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefixes = []
    for t, (_, words, least) in enumerate(sets):
        ranked = sorted(words, key=order.__getitem__)
        for p, w in enumerate(ranked[: len(ranked) - least + 1]):
            prefixes.append((w, t, p, len(ranked), least))
    prefix = spark.createDataFrame(prefixes, "w string, t int, p int, n int, least int")
    whole = rows.select("rid", F.posexplode("blocks").alias("line", "block"), F.expr("cast(null as array<string>)").alias("stretch"))
    parts = (rows.select("rid", F.posexplode("stretches").alias("line", "stretch"))
             .select("rid", -1 - F.col("line"), F.array_distinct(F.array_compact("stretch")), "stretch"))
    place = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    blocks = (whole.union(parts).where(F.size("block") >= fewest)
              .select("rid", "line", "stretch", F.array_sort(F.transform("block", lambda w: F.struct(place[w].alias("o"), w.alias("w")))).alias("block")))
    tokens = blocks.select("rid", "line", "stretch", "block", F.posexplode("block").alias("q", "token"))
    met = tokens.select("rid", "line", "stretch", "block", "q", F.col("token.w").alias("w")).join(F.broadcast(prefix), "w")
    size = F.size("block")
    possible = 1 + F.least(F.col("n") - F.col("p") - 1, size - F.col("q") - 1)
    candidates = (met.where((size >= F.col("least")) & (possible >= F.col("least")))
                  .select("rid", "line", "t", "n", "least", "stretch", F.col("block.w").alias("block")).dropDuplicates(["rid", "line", "t"]))
    wanted = F.array(*[F.array(*[F.lit(w) for w in words]) for _, words, _ in sets])
    names = F.array(*[F.lit(label) for label, _, _ in sets])
    longest = F.array(*[F.lit(SPREAD * len(notice.split())) for _, notice in TEMPLATES])
    own, reach = F.get(wanted, F.col("t")), F.get(longest, F.col("t"))
    starts = F.filter(F.sequence(F.lit(1), F.size("stretch")), lambda i: F.array_contains(own, F.get("stretch", i - 1)))
    runs = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("stretch", i, reach), own)))
    # a line counts as a whole; of a stretch the fullest run
    shared = F.when(F.col("stretch").isNull(), F.size(F.array_intersect("block", own))).otherwise(F.array_max(runs))
    verified = candidates.withColumn("shared", shared).where("shared >= least")
    found = verified.groupBy("rid").agg(
        F.collect_set(F.get(names, F.col("t"))).alias("more"), F.max(F.col("shared") / F.col("n")).alias("best"))

    places = F.concat(*[F.col(f"at_{i}") for i in range(len(PHRASES))])
    base = F.filter(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES)]), lambda x: x.isNotNull())
    joined = rows.join(found, "rid", "left").select("*", places.alias("places"), F.array_sort(base).alias("base"))
    none = F.expr("cast(array() as array<string>)")
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
