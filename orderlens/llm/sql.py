"""DuckDB SQL of the queries that SQL can express, over the raw tables."""

from __future__ import annotations

LLM_SQL: dict[str, str] = {}

LLM_SQL["op3_url_filters"] = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail
  FROM pages),
named AS (
  SELECT page_id,
         translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM parts),
rules(rule, dom, dir, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block'))
SELECT page_id, host, path,
       (SELECT arg_max(rule, length(rule)) FROM rules
        WHERE ('.' || host) LIKE ('%.' || dom) AND starts_with(path, dir)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rule)) FROM rules
        WHERE ('.' || host) LIKE ('%.' || dom) AND starts_with(path, dir)), 'allow') AS verdict
FROM named
"""

LLM_SQL["op1_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents),
tokens AS (
  SELECT doc_id, no, raw, list_filter(string_split_regex(raw, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w FROM lines),
masked AS (SELECT *, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM tokens WHERE len(w) > 0),
counted AS (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) AS digits, len(list_filter(m, lambda x: x <> '<*>')) AS fixed FROM masked),
keyed AS (SELECT doc_id, no, CASE WHEN 100 * digits > 20 * len(w) THEN {'numbers': true, 't': w} ELSE {'numbers': false, 't': m} END AS line, fixed FROM counted),
unlike AS (SELECT line, any_value(fixed) AS fixed, min(doc_id) AS first FROM keyed GROUP BY line),
templates AS (
  SELECT line, first, {'place': p, 't': list_concat(line.t[:p - 1], line.t[p + 1:])} AS template
  FROM (SELECT *, unnest(range(4, len(line.t) + 1)) AS p FROM unlike WHERE NOT line.numbers AND 100 * (fixed - 1) >= 80 * len(line.t))
  WHERE line.t[p] <> '<*>'),
shared AS (SELECT line, min(first) OVER (PARTITION BY template) AS earliest FROM templates),
stays AS (SELECT line, least(any_value(first), min(earliest)) AS stays FROM unlike LEFT JOIN shared USING (line) GROUP BY line),
dropped AS (SELECT doc_id, no FROM keyed JOIN stays USING (line) WHERE doc_id > stays),
rest AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE d.no IS NULL) AS text, count(*) AS n_lines, count(d.no) AS n_dropped
  FROM lines LEFT JOIN dropped d USING (doc_id, no) GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(rest.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN rest USING (doc_id)
"""

LLM_SQL["op2_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

LLM_SQL["op11_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
counts AS (
  SELECT lang, w[i:i + m - 1] AS p, count(*) AS f FROM placed, (VALUES (1), (2), (3)) lengths(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(p) = 1 GROUP BY lang),
found AS (SELECT lang, p, f AS a FROM counts WHERE len(p) > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM found) c
  JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)]),
scored AS (SELECT lang, p, a, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'k': k}) AS cut FROM cuts GROUP BY lang, p, a),
inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer
  FROM (SELECT lang, p, a, unnest(range(1, len(p) + 1)) AS i FROM found), (VALUES (2)) lengths(m) WHERE len(p) > m AND i + m - 1 <= len(p) GROUP BY ALL),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, cut.l AS l, cut.r AS r, cut.score AS score,
         row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM scored LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

LLM_SQL["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

LLM_SQL["op5_ngram_jaccard"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s
  FROM split),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sets
"""


def _merkle_sql(levels: int = 12, group_levels: int = 7) -> str:
    """Trees of up to 3**levels rows per source and 3**group_levels sources, one CTE per level."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars')))} || {field(text)})"
    pad = lambda side: (f"coalesce(string_agg(digest, '') OVER (PARTITION BY g, r // 3 ORDER BY r ROWS BETWEEN "  # noqa: E731
                        f"{'UNBOUNDED PRECEDING AND 1 PRECEDING' if side == 'lo' else '1 FOLLOWING AND UNBOUNDED FOLLOWING'}), '') AS {side}")

    def climb(t: str, w: str, n: int) -> str:
        out = ""
        for k in range(n):
            out += f"""
{t}{k}x AS (SELECT *, {pad('lo')}, {pad('hi')} FROM {t}{k}),
{t}{k + 1} AS (SELECT g, r // 3 AS r, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY r)) ELSE min(digest) END AS digest
  FROM {t}{k} GROUP BY g, r // 3, n),
{w}{k + 1} AS (SELECT doc_id, source_no, g, r // 3 AS r, leaf, CASE WHEN n > 1 THEN sha256(lo || x || hi) ELSE x END AS x, proof || lo || hi AS proof
  FROM {w}{k} JOIN {t}{k}x USING (g, r)),"""
        return out

    return f"""
WITH step AS (  -- CRC-32 by the reflected polynomial 0xEDB88320, of the id's decimal digits
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, bit: xor(c // 2, 3988292384 * (c % 2)))) AS crc
  FROM documents),
even AS (SELECT DISTINCT doc_id AS even_id FROM step WHERE xor(crc, 4294967295) % 2 = 0),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS source_no, {leaf('text')} AS leaf,
         CASE WHEN even_id IS NULL THEN {leaf('text')} ELSE {leaf("replace(text, chr(10), '')")} END AS x
  FROM documents LEFT JOIN even ON doc_id = even_id),
w0 AS (
  SELECT doc_id, source_no, source_no AS g, row_number() OVER (PARTITION BY source_no ORDER BY doc_id, leaf) - 1 AS r, leaf, x, '' AS proof
  FROM leaves),
t0 AS (SELECT g, r, count(*) OVER (PARTITION BY g) AS n, leaf AS digest FROM w0),{climb('t', 'w', levels)}
u0 AS (SELECT 0 AS g, g AS r, count(*) OVER () AS n, digest FROM t{levels}),
v0 AS (SELECT * REPLACE (0 AS g, source_no AS r) FROM w{levels}),{climb('u', 'v', group_levels)}
subroots AS (SELECT g AS source_no, digest AS subroot FROM t{levels})
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = digest AS verified
FROM v{group_levels} JOIN subroots USING (source_no) CROSS JOIN u{group_levels}
"""


LLM_SQL["op13_merkle_manifest"] = _merkle_sql()
