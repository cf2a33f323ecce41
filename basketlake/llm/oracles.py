"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from basketlake.llm import licenses, mixing

#: Lower-cases A-Z alone.
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicate_sql(docs: str, percent: int) -> str:
    """Rows (doc_id, n_shingles, component_id, kept) for ``docs(doc_id, text)``."""
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+'), []) AS w FROM {docs}
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM worded
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN least ON a = doc_id"""


def decontamination_sql(docs: str) -> str:
    """Rows of the contamination digest for ``docs(doc_id, text)``."""
    words = rf"coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM {docs}
), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark
), bw AS (SELECT item, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w FROM b WHERE len(w) > 0
), bench AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM bw
), sizes AS (SELECT DISTINCT k FROM bench
), dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, sizes WHERE len(w) >= k
), dg AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM dw
), hits AS (SELECT doc_id, p, k, item FROM dg JOIN bench USING (k, g)
), words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
    SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id
), items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p
), m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d
), b AS (SELECT *, [CAST('0x' || h[5 * i + 1:5 * i + 5] AS BIGINT) FOR i IN range(8)] AS v FROM m)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v[i // 4 + 1] // [32768, 1024, 32, 1][i % 4 + 1]) % 32 + 1, 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b"""


def mixing_sql(docs: str, seed: int = 17) -> str:
    """Rows of the mix for ``docs(doc_id, text, source)``."""
    weights = str(mixing.SOURCE_WEIGHTS)
    return rf"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM {docs}
), keyed AS (
  SELECT *, -ln(u) / CASE WHEN size > 0 AND length(text) / size BETWEEN 3.0::DOUBLE AND 12.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS key FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM keyed GROUP BY source
), weighed AS (SELECT *, 2 * source_size AS cap, {weights}[place % {len(mixing.SOURCE_WEIGHTS)} + 1] AS w FROM sources
), filled AS (
  SELECT *, sum(cap) OVER o - cap AS caps, sum(w) OVER o - w AS passed, cap / w AS ratio FROM weighed
  WINDOW o AS (ORDER BY cap / w, place)
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - caps::DOUBLE) / ((SELECT sum(w) FROM weighed) - passed)::DOUBLE AS level FROM filled
), chosen AS (SELECT level FROM levels WHERE level * w < cap ORDER BY ratio, place LIMIT 1
), targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM chosen) * w, cap::DOUBLE)) AS target FROM filled
), summed AS (
  SELECT k.*, t.source_size, t.target, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
), epoched AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM summed)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM epoched"""


def license_sql(docs: str) -> str:
    """Rows of the license scan for ``docs(doc_id, text)``."""
    def places(phrase):
        parts = phrase.split()
        test = " AND ".join(f"w[i + {j}] = '{p}'" for j, p in enumerate(parts))
        return f"[i FOR i IN range(1, len(w) + 1) IF {test}]"

    sets = licenses.template_sets()
    quoted = ["[" + ", ".join(f"'{x}'" for x in words) + "]" for _, words, _ in sets]
    rows = ", ".join(f"('{label}', {q}, {least})" for (label, _, least), q in zip(sets, quoted))
    base = ", ".join(f"{places(p)} AS p{i}" for i, p in enumerate(licenses.PHRASES.values()))
    labels = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(licenses.PHRASES))
    every = " || ".join(f"p{i}" for i in range(len(licenses.PHRASES)))
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH worded AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce({_LOW}, '') AS low, coalesce(regexp_extract_all({_LOW}, {word}), []) AS w FROM {docs}
), base AS (SELECT rid, doc_id, len(w) AS n_words, {base} FROM worded
), templates(label, words, least) AS (VALUES {rows}
), lines AS (SELECT rid, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), {word})) AS b FROM worded
), met AS (
  SELECT rid, label, len(list_intersect(b, words)) AS shared, len(words) AS n, least FROM lines, templates
), found AS (
  SELECT rid, list(DISTINCT label) AS more, max(shared / n) AS best FROM met WHERE shared >= least GROUP BY rid
), joined AS (
  SELECT *, {every} AS places, [x FOR x IN [{labels}] IF x IS NOT NULL] AS own FROM base LEFT JOIN found USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(own), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(own || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM joined"""


_NEIGHBOURS = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    list_reduce([q.e[i] * d.e[i] FOR i IN range(1, len(q.e) + 1)], lambda a, b: a + b) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""


#: CRC-32 of the ASCII text ``x``: bit by bit, the reflected polynomial 0xEDB88320.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(x) + 1), lambda i: ord(x[i])::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))),
    4294967295)"""

_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), counts AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS x FROM turns GROUP BY conv_id
), heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CAST(({_CRC32}) % 9 AS BIGINT) AS h FROM counts
), taken AS (SELECT a.*, least(h, coalesce(n, 0)) AS m FROM heads a LEFT JOIN counts b ON b.conv_id = a.base
), rebuilt AS (
  SELECT a.conv_id, t.i AS d, role, text FROM taken a JOIN turns t ON t.conv_id = a.base AND t.i <= h
  UNION ALL SELECT a.conv_id, t.i - h + m, role, text FROM taken a JOIN turns t ON t.conv_id = a.conv_id AND t.i > h
), cells AS (
  SELECT conv_id, d, octet_length(encode(text)) AS bytes,
    md5(string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads
), nodes AS (
  SELECT key, d, min(conv_id) AS c, count(*) AS n, min(bytes) AS bytes FROM cells GROUP BY key, d
), linked AS (
  SELECT n.*, u.key AS up, p.c AS up_c FROM nodes n LEFT JOIN cells u ON u.conv_id = n.c AND u.d = n.d - 1 LEFT JOIN nodes p ON p.key = u.key
), kids AS (SELECT up AS key, count(*) AS k FROM linked WHERE up IS NOT NULL GROUP BY up
), under AS (
  SELECT a.key, sum((b.n - 1) * b.bytes) AS saved, count(*) FILTER (WHERE k.k IS NULL) AS leaves
  FROM nodes b JOIN cells a ON a.conv_id = b.c AND a.d <= b.d LEFT JOIN kids k ON k.key = b.key GROUP BY a.key
), lasts AS (SELECT conv_id, arg_max(key, d) AS key FROM cells GROUP BY conv_id
), ends AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS s FROM lasts GROUP BY key
)
SELECT c AS conv_id, CAST(d AS BIGINT) AS depth, up_c AS parent_conv_id, n AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
FROM linked LEFT JOIN kids USING (key) JOIN under USING (key) LEFT JOIN ends USING (key)"""


SQL = {
    "op11_prefix_trie": _TRIE,
    "op2_neighbours": _NEIGHBOURS,
    "op1_mixing": mixing_sql("documents"),
    "op8_licenses": license_sql("documents"),
    "op4_decontamination": decontamination_sql("documents"),
    "op10_warc": _WARC,
    "op6_near_duplicates": near_duplicate_sql("documents", 85),
}
