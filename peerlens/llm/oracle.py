"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_SPACE, _WORD = r"[ \t\x0B\f\r]", r"[^ \t\x0B\f\r]"


def _found(c: str) -> str:
    """Nodes of the leaves by section and paragraph."""
    return (
        f"list_transform(string_split({c}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(CASE WHEN length(p) <= 64 "
        f"THEN regexp_extract_all(p, '{_SPACE}*{_WORD}{{1,16}}{_SPACE}*|{_SPACE}+') ELSE regexp_extract_all(p, '{_SPACE}*(?:{_WORD}{{1,16}}{_SPACE}*){{1,4}}|{_SPACE}+') END, lambda r: sha256(r))))"
    )


def _root(c: str) -> str:
    return f"sha256(array_to_string(list_transform({c}, lambda s: sha256(array_to_string(list_transform(s, lambda q: sha256(coalesce(array_to_string(q, ''), ''))), ''))), ''))"


def _marks(c: str) -> str:
    return f"list_transform(flatten(flatten({c})), lambda h: h[1:8])"


def _like(a: str, ra: str, b: str, rb: str) -> str:
    n = f"(len(list_distinct({a})) + len(list_distinct({b})))"
    return f"CASE WHEN {ra} = {rb} THEN 1.0 WHEN {n} = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / {n} END::DOUBLE"


OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
following AS (
  SELECT doc_id, t, length(t) AS n_chars,
    coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx
  FROM d),
edited AS (SELECT doc_id, n_chars, t, nx, left(t, n_chars - n_chars // 4) || left(nx, n_chars // 4) AS e FROM following),
found AS (SELECT doc_id, n_chars, e, {_found("t")} AS tf, {_found("e")} AS ef, {_found("nx")} AS nf FROM edited),
pieces AS (SELECT doc_id, n_chars, e, {_root("tf")} AS tr, {_root("ef")} AS er, {_root("nf")} AS nr, {_marks("tf")} AS tl, {_marks("ef")} AS el, {_marks("nf")} AS nl FROM found)
SELECT doc_id, n_chars, sha256(e) AS edited_sha256,
  tr || ':' || coalesce(array_to_string(tl, ''), '') AS fingerprint, er || ':' || coalesce(array_to_string(el, ''), '') AS edited_fingerprint,
  {_like("tl", "tr", "el", "er")} AS near_edited, {_like("tl", "tr", "nl", "nr")} AS near_next
FROM pieces
"""

OP5 = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS k, coalesce(contains(url, '://'), false) AS ok
  FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u JOIN r ON ok AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (k)
"""

OP7 = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes)),
met AS (SELECT k, i, d.n, item_id FROM dwin d JOIN win USING (win, n)),
hits AS (SELECT k, count(DISTINCT word) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS word FROM met) GROUP BY k),
ids AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM met) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (k) LEFT JOIN ids USING (k)
"""

OP2 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, md5_number(array_to_string(w[i:i + 4], ' ')) AS x FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
common AS (SELECT a.r AS ra, b.r AS rb, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT p.doc_id AS a, q.doc_id AS b FROM common c JOIN n p ON p.r = ra JOIN n q ON q.r = rb WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN low ON low.a = d.doc_id
"""

OP4 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, md5_number(substring(h, 2 * p + 1, 200)) AS x FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
f AS (SELECT x, min((doc_id, p)) AS place FROM w GROUP BY x HAVING count(*) > 1),
g AS (SELECT r, p FROM w JOIN f USING (x) WHERE (doc_id, p) <> place),
m AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 1 ELSE 0 END AS new FROM g),
k AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM m),
span AS (SELECT r, k, min(p) AS a, max(p) + 100 AS b FROM k GROUP BY r, k),
piece AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM piece JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substring(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

OP11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN met USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def _op12(rounds: int) -> str:
    steps = [
        """WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster, v AS c FROM e QUALIFY cluster < 8)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, best.cluster AS cluster, best.d::BIGINT AS distance
  FROM (SELECT vec_id, any_value(v) AS v, min({{'d': list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), 'cluster': cluster}}) AS best FROM e, c{r} GROUP BY vec_id))"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (
  SELECT cluster, list(m ORDER BY i) AS c FROM (
    SELECT cluster, i, floor(sum(x) / count(*)) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"""
            )
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""
    )


OP12 = _op12(10)

OP13 = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
d AS (SELECT *, length(bin(size)) * 256 + (size >> greatest(length(bin(size)) - 8, 0)) AS size_bin FROM t),
s AS (SELECT source, sum(size)::BIGINT AS n, 3 * sum(size)::BIGINT AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(nth - 1) % 3 + 1] AS weight FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, nth) AS k,
    (sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
g AS (SELECT arg_min(level, k) AS water FROM o WHERE level * weight < cap),
p AS (SELECT source, n, least(cap::DOUBLE, water * weight) AS target, ('0x' || substr(md5('13:' || coalesce(source, '')), 1, 8))::BIGINT AS start FROM o, g),
e AS (SELECT *, CASE WHEN n > 0 THEN floor(target * 4294967296 / n)::BIGINT ELSE 0 END AS share FROM p),
c AS (
  SELECT doc_id, size, n, target, share,
    start + coalesce(sum(share) OVER (PARTITION BY d.source ORDER BY size_bin, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, n AS source_size, target, (size * ((place + share) // 4294967296 - place // 4294967296))::BIGINT AS taken,
  ((place + share) // 4294967296 - place // 4294967296)::INTEGER AS copies
FROM c
"""

ORACLES: dict[str, str] = {"op1_document_fingerprints": OP1, "op2_minhash_near_dedup": OP2, "op4_suffix_array_dedup": OP4, "op5_url_filters": OP5, "op7_benchmark_decontamination": OP7, "op11_hard_negatives": OP11, "op12_centroid_clustering": OP12, "op13_source_mixing": OP13}
