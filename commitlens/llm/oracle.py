"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from commitlens.llm import importance, line_dedup, projection_passes, quality, revisits, secrets

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def key(line: str) -> str:
    return f"translate(trim({line}, {WHITE}), {UPPER}, lower({UPPER}))"


OP1 = f"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
k AS (SELECT doc_id, i, line, {key('line')} AS k FROM l),
r AS (SELECT k, min(doc_id) AS keep FROM k WHERE length(k) >= {line_dedup.MIN_CHARS}
      GROUP BY k HAVING count(DISTINCT doc_id) > {line_dedup.MAX_DOCS})
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (r.k IS NOT NULL AND doc_id <> keep))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.k IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.k = r.k GROUP BY doc_id"""

OP7 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, source, i, string_split(t, chr(10))[i] AS line
  FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i)),
real AS (SELECT *, {key('line')} AS k FROM lines WHERE trim(line, {WHITE}) <> ''),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM real GROUP BY doc_id),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS g
          FROM d, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS u(i)),
often AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM often, range({quality.WINDOW}) AS r(o) GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
freq AS (SELECT source, k, min(doc_id) AS keep, count(DISTINCT doc_id) AS n FROM real GROUP BY source, k),
over_limit AS (SELECT f.* FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
         WHERE n > {quality.MIN_DOCS} AND n > {quality.HOST_SHARE} * docs),
gone AS (SELECT r.doc_id, sum(length(regexp_replace(r.line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS n
         FROM real r JOIN over_limit o ON r.source IS NOT DISTINCT FROM o.source AND r.k = o.k WHERE r.doc_id <> o.keep GROUP BY r.doc_id),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.n, 0)::BIGINT AS removed_chars
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
failed AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND removed_chars <= {1 - quality.MIN_LEFT} * word_chars AS kept FROM failed"""


def _pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _spans(r: secrets.Rule, order: int) -> str:
    # as in the query: matches and the gaps between them come from one pattern
    return f"""SELECT doc_id, '{r.name}' AS rule, {order} AS ord,
      list_sum([length(x) FOR x IN gaps[:i]]) + coalesce(list_sum([length(x) FOR x IN hits[:i - 1]]), 0) AS s, length(hits[i]) AS n
    FROM (SELECT doc_id, string_split_regex(t, {_pattern(r.pattern)}) AS gaps, regexp_extract_all(t, {_pattern(r.pattern)}) AS hits,
            regexp_extract_all(t, {_pattern(r.pattern)}, {r.group}) AS tests FROM d) x, unnest(range(1, len(hits) + 1)) AS u(i)
    WHERE length(tests[i]) >= {r.least}"""


_BASE = ", ".join(f"'{r.name}'" for r in secrets.BASE)
OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans(r, i) for i, r in enumerate(secrets.RULES))}),
g AS (SELECT doc_id, rule, ord, s::BIGINT AS s, rule || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM f)
SELECT d.doc_id, {", ".join(f"(count(*) FILTER (rule = '{r.name}'))::BIGINT AS n_{r.name}" for r in secrets.BASE)},
  sha256(coalesce(string_agg(span, ',' ORDER BY s, ord) FILTER (rule IN ({_BASE})), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, ord), '') AS spans
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id"""

_HOST = "regexp_extract(rest, '^([^/?]*)', 1)"
OP2 = f"""
WITH p AS (SELECT *, md5(coalesce(html, '')) AS digest FROM pages),
t AS (SELECT *, '"' || left(digest, 16) || '"' AS tag FROM p),
rec AS (
  SELECT 2 * page_id AS record_id, page_id, url, 60 * page_id AS ts, 200 AS status, tag AS etag, 't' || page_id AS last_modified, digest, tag,
    strlen(coalesce(html, '')) AS size FROM t
  UNION ALL
  SELECT 2 * page_id + 1, page_id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=revisit#again',
    60 * page_id + 30 + page_id % 7 * 30000, 304, CASE page_id % 5 WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 3 THEN '"stale"' END,
    CASE WHEN page_id % 5 = 2 THEN 't' || page_id END, NULL, CASE WHEN page_id % 5 = 1 THEN 'W/' || tag ELSE tag END, 0 FROM t),
c AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM rec),
k AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace({_HOST}, '^[^@]*@', ''), '\\.?(:80|:443)?$', '')), '^www[0-9]*\\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'),
      lambda a: a <> '' AND NOT regexp_matches(a, '^(?i:{revisits.TRACKING})(=.*)?$'))) AS args FROM c),
u AS (SELECT * EXCLUDE (rest, host, path, args), host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key FROM k),
m AS (
  SELECT v.*, f.record_id AS ref, f.etag AS f_etag, f.last_modified AS f_date, f.digest AS f_digest, f.size AS f_size, f.page_id AS f_page
  FROM (SELECT * FROM u WHERE status = 304) v ASOF LEFT JOIN (SELECT * FROM u WHERE status = 200) f ON v.url_key = f.url_key AND v.ts > f.ts),
x AS (SELECT *, CASE WHEN ref IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = f_etag THEN 'etag' ELSE 'etag_differs' END
    WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = f_date THEN 'last_modified' ELSE 'date_differs' END ELSE 'unchecked' END AS reason FROM m),
y AS (SELECT *, reason IN ('etag', 'last_modified', 'unchecked') AS resolved FROM x)
SELECT record_id, page_id, url_key, ref AS refers_to, resolved, reason, CASE WHEN resolved THEN f_digest END AS digest,
  CASE WHEN resolved THEN 'content-length=' || f_size || ';content-type=text/html;date=r' || page_id || ';etag=' || tag END AS headers
FROM y"""

_TERM = "'[0-9a-z\\x{80}-\\x{10FFFF}]+'"
OP12 = f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {UPPER}, lower({UPPER})), {_TERM})) AS t FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY doc_id, t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {UPPER}, lower({UPPER})), {_TERM})) AS t FROM benchmark),
g AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY t, docs),
c AS (SELECT doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS c
      FROM tf JOIN d USING (doc_id) JOIN g USING (t), s),
r AS (SELECT item_id, doc_id, sum(c)::BIGINT AS score FROM q JOIN c USING (t) GROUP BY item_id, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 50"""

OP11 = f"""
WITH RECURSIVE v AS (  -- every pair of a label, compared in full
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {projection_passes.LIMIT}),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, least(vec_id, coalesce(least, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""

_RUNS = f"regexp_extract_all(translate(text, {UPPER}, lower({UPPER})), {_TERM})"
OP13 = f"""
WITH k AS (  -- the CRC-32 table from its polynomial
  SELECT [list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, {importance.POLYNOMIAL}) ELSE a // 2 END)
          FOR b IN range(256)] AS tab),
d AS (SELECT doc_id, unnest({_RUNS}) AS w FROM documents),
q AS (SELECT unnest({_RUNS}) AS w FROM benchmark),
v AS (SELECT w, [('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(w))] AS bytes FROM (SELECT w FROM d UNION SELECT w FROM q)),
h AS (SELECT w, xor(list_reduce([4294967295] || bytes, lambda r, x: xor(r >> 8, tab[(xor(r, x) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS b FROM v, k),
s AS (SELECT b, count(*) AS n FROM d JOIN h USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM q JOIN h USING (w) GROUP BY b),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::BIGINT AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::BIGINT AS t_all),
g AS (SELECT i AS b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (s_all + {importance.BUCKETS}))::DOUBLE / ((coalesce(s.n, 0) + 1) * (t_all + {importance.BUCKETS}))::DOUBLE))::BIGINT AS gain
      FROM range({importance.BUCKETS}) r(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i, a),
f AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN h USING (w) JOIN g USING (b) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || left(sha256('{importance.SEED}:' || doc_id), 8))::BIGINT AS u FROM documents LEFT JOIN f USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS open FROM z WHERE n_features >= {importance.MIN_WORDS})
SELECT z.*, CASE WHEN rank <= {importance.SHARE_PCT} * open // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (doc_id)"""

SQL: dict[str, str] = {"op12_ranked_search": OP12, "op13_importance_resampling": OP13, "op11_embedding_dedup": OP11, "op2_warc_revisits": OP2, "op1_line_dedup": OP1, "op7_quality_rules": OP7, "op10_secret_ledger": OP10}
