"""The SQL that core queries are held against, for DuckDB over the same tables."""

from __future__ import annotations

from .functions.stability import ATOMIC, SINGLETONS, STATE, UTILITY, VARIANT
from .plans.schema_drift import ROLES
from .model import NOISE_PREFIXES, NOISE_SUFFIX, NOISE_TOKENS, STRUCTURAL_TAGS

_HOST = r"lower(regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"
_TAGS = r"""tags AS (
  SELECT file_id, pos - 1 AS pos, lower(tags[pos]) AS tag
  FROM (SELECT file_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS tags FROM (SELECT DISTINCT file_id, html FROM wcxb_samples)), unnest(range(1, len(tags) + 1)) AS t(pos)
)"""
_SHINGLES = _TAGS + """, shingles AS (
  SELECT DISTINCT file_id, tag || '>' || b || '>' || c AS shingle
  FROM (SELECT file_id, tag, lead(tag, 1) OVER w AS b, lead(tag, 2) OVER w AS c FROM tags WINDOW w AS (PARTITION BY file_id ORDER BY pos)) WHERE c IS NOT NULL
)"""
_SKETCH = _SHINGLES + """, sketch AS (
  SELECT file_id, slot::INTEGER AS slot, min(substr(md5(slot::VARCHAR || '|' || shingle), 1, 8)) AS mark FROM shingles, range(16) AS r(slot) GROUP BY ALL
)"""
_COUNTS = _TAGS + """, counts AS (SELECT file_id, tag, count(*) AS n, min(pos) AS first_pos FROM tags GROUP BY ALL)"""
_HOSTS = "hosts AS (SELECT DISTINCT file_id, lower(host) AS host FROM wcxb_samples WHERE host IS NOT NULL)"
_LINKS = r"""links AS (
  SELECT DISTINCT source, lower(regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href ELSE regexp_extract(source, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) || href END, '#.*$', '')) AS target
  FROM (SELECT lower(regexp_replace(url, '#.*$', '')) AS source, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS href FROM wcxb_samples WHERE url IS NOT NULL)
  WHERE (regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') OR starts_with(href, '/')) AND regexp_matches(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href ELSE source END, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+')
)"""
_WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]+"
_PAIRS = f"""pairs AS (SELECT DISTINCT id, page_type, html, gold, regexp_replace(html, '<[^>]*>', ' ', 'g') AS plain FROM fixtures WHERE gold IS NOT NULL),
p AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(plain), '{_WORD}')) AS word FROM pairs) GROUP BY ALL),
g AS (SELECT id, word, count(*) AS m FROM (SELECT id, unnest(regexp_extract_all(lower(gold), '{_WORD}')) AS word FROM pairs) GROUP BY ALL)"""
_F1 = f"""{_PAIRS},
both_ AS (SELECT id, sum(least(n, m)) AS overlap FROM p JOIN g USING (id, word) GROUP BY id),
sizes AS (SELECT id, page_type, coalesce((SELECT sum(n) FROM p WHERE p.id = pairs.id), 0) AS np, coalesce((SELECT sum(m) FROM g WHERE g.id = pairs.id), 0) AS ng FROM pairs),
scored AS (
  SELECT id, page_type, CASE WHEN np > 0 THEN coalesce(overlap, 0)::DOUBLE / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS precision,
         CASE WHEN ng > 0 THEN coalesce(overlap, 0)::DOUBLE / ng WHEN np = 0 THEN 1.0 ELSE 0.0 END AS recall
  FROM sizes LEFT JOIN both_ USING (id)
),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM scored)"""
_LATEST = """latest AS (
  SELECT store_id, template_id, max(file_seq) AS file_seq FROM templates WHERE template_id IS NOT NULL GROUP BY ALL
)"""


_ROLE = "|".join(sorted(ROLES))
_DRIFT = rf"""WITH RECURSIVE raw AS (
  SELECT 'streaming_templates' AS blob_table, store_id, file_seq, template_id, max(template_blob) AS b FROM streaming_templates WHERE store_id IS NOT NULL AND file_seq IS NOT NULL AND template_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'templates', store_id, file_seq, template_id, max(extractor_blob) FROM templates WHERE store_id IS NOT NULL AND file_seq IS NOT NULL AND template_id IS NOT NULL GROUP BY ALL
),
blobs AS (SELECT *, blob_table || '/' || store_id AS store FROM (SELECT blob_table, store_id, file_seq, template_id, ltrim(try(decode(b)), chr(65279)) AS j FROM raw) WHERE json_valid(j)),
nodes AS (
  SELECT store, file_seq, template_id, t.id, t.fullkey, t.type, t.atom,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(t.fullkey, '^\$\.', ''), '\[[0-9]+\]', '[]', 'g'), '\.(?:{_ROLE})(\.|$)', '{{}}\1', 'g'), '(claims\[\]\.data)\.[^.]+(\.|$)', '\1{{}}\2', 'g') AS path
  FROM blobs, json_tree(j) AS t WHERE t.fullkey <> '$' AND t.type <> 'NULL'
),
fields AS (
  SELECT store, file_seq, template_id, id, fullkey, path, CASE WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'ARRAY' THEN 'array' ELSE 'object' END AS type
  FROM nodes WHERE NOT ends_with(path, ']') AND NOT ends_with(path, '}}')
),
readable AS (SELECT store, file_seq, count(*) AS readable FROM blobs GROUP BY ALL),
present AS (SELECT store, file_seq, path, count(DISTINCT template_id) AS n FROM fields GROUP BY ALL),
typed AS (SELECT store, file_seq, path, arg_min(type, lpad((1000000000 - n)::VARCHAR, 12, '0') || type) AS type FROM (SELECT store, file_seq, path, type, count(*) AS n FROM fields GROUP BY ALL) GROUP BY ALL),
schema_ AS (SELECT p.store, p.file_seq, p.path, t.type, regexp_replace(regexp_replace(p.path, '(^|\.)[^.]*$', ''), '(\[\]|\{{\}})+$', '') AS parent
  FROM present p JOIN readable r USING (store, file_seq) JOIN typed t USING (store, file_seq, path) WHERE p.n >= r.readable * 0.1 - 1e-9),
steps AS (SELECT DISTINCT a.store, a.file_seq FROM schema_ a JOIN schema_ b ON b.store = a.store AND b.file_seq = a.file_seq - 1),
both_ AS (
  SELECT store, file_seq, path, max(parent) AS parent, max(old_type) AS old_type, max(new_type) AS new_type FROM (
    SELECT s.store, s.file_seq, f.path, f.parent, NULL AS old_type, f.type AS new_type FROM steps s JOIN schema_ f USING (store, file_seq)
    UNION ALL SELECT s.store, s.file_seq, f.path, f.parent, f.type, NULL FROM steps s JOIN schema_ f ON f.store = s.store AND f.file_seq = s.file_seq - 1) GROUP BY ALL
),
up AS (
  SELECT store, file_seq, path, parent AS above FROM both_ WHERE parent <> ''
  UNION
  SELECT u.store, u.file_seq, u.path, b.parent FROM up u JOIN both_ b ON b.store = u.store AND b.file_seq = u.file_seq AND b.path = u.above WHERE b.parent <> ''
),
hidden AS (SELECT DISTINCT u.store, u.file_seq, u.path FROM up u LEFT JOIN both_ b ON b.store = u.store AND b.file_seq = u.file_seq AND b.path = u.above WHERE b.old_type IS DISTINCT FROM b.new_type OR b.path IS NULL),
seen AS (SELECT * FROM both_ WHERE (store, file_seq, path) NOT IN (SELECT (store, file_seq, path) FROM hidden) AND old_type IS DISTINCT FROM new_type),
pairs AS (SELECT o.store, o.file_seq, o.path AS old_path, n.path AS new_path FROM seen o JOIN seen n ON n.store = o.store AND n.file_seq = o.file_seq AND n.parent = o.parent AND o.new_type IS NULL AND n.old_type IS NULL AND o.old_type = n.new_type),
wanted AS (SELECT store, file_seq - 1 AS file_seq, old_path AS path FROM pairs UNION SELECT store, file_seq, new_path FROM pairs),
leaves AS (
  SELECT f.store, f.file_seq, f.template_id, f.path, f.id, string_agg(substr(n.fullkey, length(f.fullkey) + 1) || '=' || CASE WHEN n.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'n' || (n.atom::VARCHAR)::DOUBLE::VARCHAR ELSE n.type || coalesce(n.atom::VARCHAR, '') END, ';' ORDER BY n.fullkey) AS v
  FROM fields f JOIN wanted w USING (store, file_seq, path) JOIN nodes n ON n.store = f.store AND n.file_seq = f.file_seq AND n.template_id = f.template_id AND (n.fullkey = f.fullkey OR starts_with(n.fullkey, f.fullkey || '.') OR starts_with(n.fullkey, f.fullkey || '['))
  GROUP BY ALL
),
forms AS (SELECT store, file_seq, template_id, path, string_agg(v, '|' ORDER BY id) AS v FROM leaves GROUP BY ALL),
renamed AS (
  SELECT p.store, p.file_seq, old_path, new_path FROM pairs p JOIN forms a ON a.store = p.store AND a.file_seq = p.file_seq - 1 AND a.path = p.old_path JOIN forms b ON b.store = p.store AND b.file_seq = p.file_seq AND b.path = p.new_path AND b.template_id = a.template_id
  GROUP BY ALL HAVING avg((a.v = b.v)::INTEGER) >= 0.9
),
out_ AS (
  SELECT store, file_seq, 'renamed' AS change, old_path, new_path FROM renamed
  UNION ALL SELECT store, file_seq, 'type_changed', path, path FROM seen WHERE old_type IS NOT NULL AND new_type IS NOT NULL
  UNION ALL SELECT store, file_seq, 'removed', path, '' FROM seen WHERE new_type IS NULL AND (store, file_seq, path) NOT IN (SELECT (store, file_seq, old_path) FROM renamed)
  UNION ALL SELECT store, file_seq, 'added', '', path FROM seen WHERE old_type IS NULL AND (store, file_seq, path) NOT IN (SELECT (store, file_seq, new_path) FROM renamed)
)
SELECT split_part(store, '/', 1) AS blob_table, substr(store, strpos(store, '/') + 1) AS store_id, file_seq, change, old_path, new_path FROM out_"""


def _q(text: str) -> str:
    return text.replace("'", "''")


#: The key of keyed_host_hash, and what HMAC makes of it before the inner and the outer hash.
KEY = b"a key of at least sixteen bytes"
_PAD_IN, _PAD_OUT = (bytes(k ^ x for k in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))

SQL: dict[str, str] = {
    "pages_by_host": f"SELECT {_HOST.format(u='url')} AS host, count(DISTINCT file_id) AS pages, min(crawled_at) AS first_seen FROM wcxb_samples GROUP BY 1",
    "host_hash": "SELECT host, left(sha256(host), 32) AS host_hash FROM (SELECT DISTINCT lower(host) AS host FROM wcxb_samples WHERE host IS NOT NULL)",
    "url_functions": f"""
WITH u AS (SELECT DISTINCT file_id, url FROM wcxb_samples),
h AS (SELECT *, {_HOST.format(u='url')} AS host, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM u)
SELECT file_id, lower(regexp_replace(url, '#.*$', '')) AS canonical,
  length(host) <= 253 AND regexp_matches(host, '^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)*[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?$') AS valid_host,
  regexp_matches(url, '^https?://') AND length(host) > 0 AND NOT regexp_matches(host, '^(?:localhost|.*\\.localhost|127\\..*|10\\..*|192\\.168\\..*|169\\.254\\..*|172\\.(?:1[6-9]|2[0-9]|3[01])\\..*|0\\..*|\\[.*)$') AS public,
  'md:' || sha256(concat_ws('|', 'GET', lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1),
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: length(p) > 0 AND NOT starts_with(p, 'format='))), '&'), 'RagFull')) AS cache_key
FROM h""",
    "accept_quality": """
WITH r AS (
  SELECT DISTINCT response_id, 'text/html, text/*;q=0.' || (block_count % 9 + 1)::VARCHAR || CASE WHEN block_count % 3 = 0 THEN ',text/markdown;q=0.75' ELSE '' END || CASE WHEN block_count % 2 = 0 THEN ', */*;q=0.1' ELSE '' END AS accept
  FROM test_responses WHERE block_count IS NOT NULL
)
SELECT response_id, accept,
  coalesce(nullif(regexp_extract(accept, 'text/markdown;q=([0-9.]+)', 1), ''), regexp_extract(accept, 'text/\\*;q=([0-9.]+)', 1))::DOUBLE AS markdown_q, 1.0::DOUBLE AS html_q
FROM r""",
    "tag_events": f"WITH {_COUNTS} SELECT file_id, tag, n, first_pos::INTEGER AS first_pos FROM counts",
    "structural_tags": f"""
WITH {_COUNTS} SELECT file_id, sum(n) FILTER (tag IN ({", ".join(f"'{x}'" for x in STRUCTURAL_TAGS)}))::BIGINT AS structural,
  round(sum(n) FILTER (tag IN ({", ".join(f"'{x}'" for x in STRUCTURAL_TAGS)}))::DOUBLE / sum(n), 9) AS share FROM counts GROUP BY file_id HAVING structural > 0""",
    "event_sessions": """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS key, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
    "tag_histogram": f"WITH {_TAGS} SELECT tag, count(*) AS n, count(DISTINCT file_id) AS pages FROM tags GROUP BY tag",
    "tag_shingles": f"WITH {_SHINGLES} SELECT shingle, count(*) AS pages FROM shingles GROUP BY shingle",
    "minhash_sql": f"WITH {_SKETCH} SELECT * FROM sketch",
    "band_probe": f"""
WITH {_SKETCH}, {_HOSTS},
bands AS (SELECT file_id, slot // 4 AS band, string_agg(mark, ',' ORDER BY slot) AS key FROM sketch GROUP BY ALL),
b AS (SELECT * FROM bands JOIN hosts USING (file_id)),
first AS (SELECT host, band, key, min(file_id) AS file_a FROM b GROUP BY ALL)
SELECT host, file_a, file_id AS file_b, count(*) AS bands FROM b JOIN first USING (host, band, key) WHERE file_a < file_id GROUP BY ALL""",
    "gram_cosine": f"""
WITH {_COUNTS}, {_HOSTS}, first AS (SELECT host, min(file_id) AS first_id FROM hosts GROUP BY host),
norms AS (SELECT file_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM counts GROUP BY file_id),
dots AS (
  SELECT h.host, a.file_id, f.first_id, sum(a.n * b.n)::DOUBLE AS dot FROM hosts h JOIN first f USING (host) JOIN counts a ON a.file_id = h.file_id JOIN counts b ON b.file_id = f.first_id AND b.tag = a.tag GROUP BY ALL
)
SELECT host, d.file_id, round(dot / (x.norm * y.norm), 9) AS cosine FROM dots d JOIN norms x ON x.file_id = d.file_id JOIN norms y ON y.file_id = d.first_id""",
    "tag_entropy": f"WITH {_COUNTS} SELECT file_id, round(-sum(p * log2(p)), 9) AS entropy FROM (SELECT file_id, n::DOUBLE / sum(n) OVER (PARTITION BY file_id) AS p FROM counts) GROUP BY file_id",
    "page_title": "SELECT DISTINCT file_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM wcxb_samples",
    "class_tokens": f"""
WITH t AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(c, ' ')) AS token FROM (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM wcxb_samples)) WHERE token <> '' GROUP BY token)
SELECT token, n,
  CASE WHEN length(trim(token)) = 0 THEN false WHEN length(token) < 3 THEN true ELSE NOT (
    (starts_with(token, 'css-') AND length(token) >= 8) OR (starts_with(token, 'sc-') AND length(token) >= 7) OR (starts_with(token, '_') AND contains(token, '__'))
    OR (length(token) >= 6 AND (NOT regexp_matches(token, '[aeiouy]') OR (length(token) - length(regexp_replace(token, '[0-9]', '', 'g'))) > length(token) * 0.3))
    OR regexp_matches(token, '{_q(VARIANT)}') OR regexp_matches(token, '{_q(STATE)}') OR regexp_matches(token, '{_q(UTILITY)}') OR regexp_matches(token, '{_q(ATOMIC)}')
    OR token IN ({", ".join(f"'{x}'" for x in SINGLETONS)})) END AS stable,
  CASE WHEN token IN ({", ".join(f"'{x}'" for x in sorted(NOISE_TOKENS))}) OR regexp_matches(token, '^({"|".join(NOISE_PREFIXES)})') THEN '' ELSE regexp_replace(token, '{NOISE_SUFFIX}', '') END AS quiet
FROM t""",
    "word_counts": f"""
SELECT word, sum(n)::BIGINT AS n, count(*) AS documents
FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY word""",
    "word_f1": f"WITH {_F1} SELECT DISTINCT id, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f",
    "f1_rollup": f"WITH {_F1} SELECT page_type, count(*) AS pages, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM f GROUP BY ROLLUP (page_type)",
    "excess_words": f"""
WITH {_PAIRS}, d AS (SELECT word, sum(coalesce(n, 0))::BIGINT AS n, sum(coalesce(m, 0))::BIGINT AS m FROM p FULL JOIN g USING (id, word) GROUP BY word)
(SELECT word, 'extra' AS side, n - m AS excess FROM d WHERE n > m ORDER BY excess DESC, word LIMIT 30) UNION ALL (SELECT word, 'missing' AS side, m - n AS excess FROM d WHERE m > n ORDER BY excess DESC, word LIMIT 30)""",
    "with_without": f"""
WITH {_PAIRS}, w AS (SELECT id, plain, list_filter(string_split(gold, chr(10)), lambda x: length(x) > 0) AS wanted FROM pairs)
SELECT id, round(CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda x: contains(plain, x)))::DOUBLE / len(wanted) END, 9) AS with_recall,
  round(1 - len(list_filter(['cookie', 'http://'], lambda x: contains(plain, x)))::DOUBLE / 2, 9) AS without_reject
FROM w""",
    "value_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, max(value) AS p100 FROM events GROUP BY event_type",
    "events_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL",
    "observation_ring": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY observed_at DESC, loaded_at DESC, similarity_at_match DESC NULLS LAST) AS place FROM (SELECT DISTINCT * FROM template_observations))
SELECT template_id, count(*) AS kept, min(observed_at) AS oldest, max(observed_at) AS newest FROM r WHERE place <= 100 GROUP BY template_id""",
    "drift_average": """
WITH s AS (SELECT DISTINCT template_id, observed_at, loaded_at, similarity_at_match AS x FROM template_observations WHERE similarity_at_match IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY observed_at DESC, loaded_at DESC, x DESC) - 1 AS k FROM s),
n AS (SELECT *, count(*) OVER (PARTITION BY template_id) AS n FROM k)
SELECT template_id, max(n) AS n, round(sum(pow(0.8, k) * CASE WHEN k = n - 1 THEN 1.0 ELSE 0.2 END * (1 - x)), 9) AS ewma FROM n GROUP BY template_id""",
    "longest_drift": """
WITH s AS (SELECT DISTINCT template_id, observed_at, loaded_at, similarity_at_match AS x FROM template_observations WHERE similarity_at_match IS NOT NULL),
b AS (SELECT *, x < 0.85 AS hit, sum(CASE WHEN x < 0.85 THEN 0 ELSE 1 END) OVER (PARTITION BY template_id ORDER BY observed_at, loaded_at, x ROWS UNBOUNDED PRECEDING) AS breaks FROM s)
SELECT template_id, max(run)::BIGINT AS longest FROM (SELECT template_id, breaks, sum(hit::INTEGER) AS run FROM b GROUP BY ALL) GROUP BY template_id""",
    "true_likeness": """
WITH own AS (SELECT DISTINCT template_id, hex(signature_minhash) AS a FROM templates WHERE octet_length(signature_minhash) = 512),
seen AS (SELECT DISTINCT template_id, observed_at, hex(signature_minhash) AS b, similarity_at_match AS logged FROM template_observations WHERE octet_length(signature_minhash) = 512)
SELECT template_id, observed_at, logged, len(list_filter(range(128), lambda i: substr(a, i * 8 + 1, 8) = substr(b, i * 8 + 1, 8))) / 128.0::DOUBLE AS likeness FROM seen JOIN own USING (template_id)""",
    "fence_versions": """
WITH f AS (SELECT DISTINCT lower(host) AS host, version, template_id, created_at FROM streaming_templates WHERE host IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY version DESC NULLS LAST, created_at DESC NULLS LAST, template_id DESC NULLS LAST) AS k FROM f)
SELECT host, (SELECT string_agg(v::VARCHAR, ',' ORDER BY v) FROM (SELECT DISTINCT version AS v FROM f g WHERE g.host = l.host)) AS versions, template_id AS latest FROM l WHERE k = 1""",
    "fence_at_version": """
WITH l AS (SELECT lower(host) AS host, template_id, row_number() OVER (PARTITION BY lower(host) ORDER BY created_at DESC NULLS LAST, template_id DESC) AS k FROM streaming_templates WHERE version = 1 AND host IS NOT NULL)
SELECT host, template_id FROM l WHERE k = 1""",
    "store_history": "SELECT * FROM (SELECT store_id, file_seq, row_number() OVER (PARTITION BY store_id ORDER BY file_seq DESC)::INTEGER AS place FROM (SELECT DISTINCT store_id, file_seq FROM templates)) WHERE place <= 2",
    "store_changes": """
WITH ids AS (SELECT DISTINCT store_id, file_seq, template_id FROM templates WHERE template_id IS NOT NULL), files AS (SELECT DISTINCT store_id, file_seq FROM ids)
SELECT i.store_id, i.file_seq, i.template_id, 'added' AS change FROM ids i JOIN files f ON f.store_id = i.store_id AND f.file_seq = i.file_seq - 1
WHERE NOT EXISTS (SELECT 1 FROM ids b WHERE b.store_id = i.store_id AND b.file_seq = i.file_seq - 1 AND b.template_id = i.template_id)
UNION ALL
SELECT i.store_id, i.file_seq + 1, i.template_id, 'removed' FROM ids i JOIN files f ON f.store_id = i.store_id AND f.file_seq = i.file_seq + 1
WHERE NOT EXISTS (SELECT 1 FROM ids b WHERE b.store_id = i.store_id AND b.file_seq = i.file_seq + 1 AND b.template_id = i.template_id)""",
    "latest_templates": """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY store_id, template_id ORDER BY file_seq DESC, version_number DESC, last_seen DESC NULLS LAST) AS k FROM templates WHERE template_id IS NOT NULL)
SELECT store_id, template_id, file_seq, version_number, observation_count, md5(signature_minhash) AS signature FROM l WHERE k = 1""",
    "aging_score": """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY store_id, template_id ORDER BY file_seq DESC, version_number DESC, last_seen DESC NULLS LAST) AS k FROM templates WHERE template_id IS NOT NULL),
s AS (SELECT hex(host_hash) AS host_hash, template_id, 1.0 + 0.02 * ln(1 + observation_count::DOUBLE) + 0.05 * exp(-((epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(last_seen)) / 86400000000.0) / 30.0) AS score
      FROM l WHERE k = 1 AND last_seen IS NOT NULL AND host_hash IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY host_hash ORDER BY round(score, 9) DESC, template_id) AS r FROM s)
SELECT host_hash, template_id, round(score, 6) AS score FROM b WHERE r = 1""",
    "status_report": """
SELECT status, count(DISTINCT response_id) AS responses, count(DISTINCT host) AS hosts, sum(block_count)::BIGINT AS blocks
FROM (SELECT response_id, coalesce(regexp_replace(lower(trim(status)), '[^a-z]', '', 'g'), 'unknown') AS status, lower(host) AS host, block_count FROM (SELECT DISTINCT * FROM test_responses)) GROUP BY status""",
    "bundle_roundtrip": """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY store_id, template_id ORDER BY file_seq DESC, version_number DESC, last_seen DESC NULLS LAST) AS k FROM templates WHERE template_id IS NOT NULL)
SELECT store_id, template_id, hex(host_hash) AS host_hash, version_number, md5(signature_minhash) AS signature, md5(pq_gram_vector) AS vector, md5(extractor_blob) AS extractor, observation_count FROM l WHERE k = 1""",
    "queue_cooldown": """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, ts FROM events WHERE ts IS NOT NULL),
q AS (
  SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY ALL
  UNION ALL
  SELECT q.user_id, q.event_type, min(e.ts) AS ts FROM q JOIN e ON e.user_id = q.user_id AND e.event_type = q.event_type AND e.ts >= q.ts + INTERVAL 1 HOUR GROUP BY ALL
)
SELECT * FROM q""",
    "bundle_export": """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY store_id, template_id ORDER BY file_seq DESC, version_number DESC, last_seen DESC NULLS LAST) AS k FROM templates WHERE template_id IS NOT NULL)
SELECT '{"schemaVersion":1,"hashAlgorithm":"hmac-sha256","pqGramP":2,"pqGramQ":3,"pqGramTopK":256,"store_id":"' || store_id || '","template_id":"' || template_id || '"' || coalesce(',"hostHash":"' || hex(host_hash) || '"', '')
  || coalesce(',"version":' || version_number::VARCHAR, '') || coalesce(',"signature":"' || base64(signature_minhash) || '"', '') || coalesce(',"pqGramVector":"' || base64(pq_gram_vector) || '"', '')
  || coalesce(',"extractor":"' || base64(extractor_blob) || '"', '') || coalesce(',"observationCount":' || observation_count::VARCHAR, '') || coalesce(',"createdAt":' || epoch_us(created_at)::VARCHAR, '')
  || coalesce(',"lastSeen":' || epoch_us(last_seen)::VARCHAR, '') || '}' AS value
FROM l WHERE k = 1""",
    "site_links": f"WITH {_LINKS} SELECT source, target FROM links",
    "site_map": f"""
WITH RECURSIVE {_LINKS}, own AS (SELECT source, target FROM links WHERE {_HOST.format(u='source')} = {_HOST.format(u='target')}),
seeds AS (SELECT min(lower(regexp_replace(url, '#.*$', ''))) AS url FROM wcxb_samples WHERE url IS NOT NULL AND {_HOST.format(u='url')} <> '' GROUP BY {_HOST.format(u='url')}),
walk AS (SELECT url AS root, url, 0 AS depth FROM seeds UNION SELECT w.root, o.target, w.depth + 1 FROM walk w JOIN own o ON o.source = w.url WHERE w.depth < 3),
reached AS (SELECT root, url, min(depth)::INTEGER AS depth FROM walk GROUP BY ALL)
SELECT root, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, url) AS place FROM reached) WHERE place <= 50""",
    "excerpt_escape": r"""
SELECT doc_id, md5(left(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))), 200)) AS excerpt, md5(regexp_replace(text, '([\\*_`])', '\\\1', 'g')) AS escaped FROM documents WHERE text IS NOT NULL""",
    "p4_found": _DRIFT,
    "band_classes": f"""
WITH {_SKETCH}, {_HOSTS}, m AS (SELECT file_id, host, string_agg(mark, ',' ORDER BY slot) AS marks FROM sketch JOIN hosts USING (file_id) GROUP BY ALL)
SELECT host, file_id, min(file_id) OVER (PARTITION BY host, marks) AS class_id FROM m""",
    "band_pairs": f"""
WITH {_SKETCH}, {_HOSTS}, m AS (SELECT file_id, host, list(mark ORDER BY slot) AS marks FROM sketch JOIN hosts USING (file_id) GROUP BY ALL),
c AS (SELECT host, marks, min(file_id) AS page FROM m GROUP BY ALL)
SELECT a.host, a.page AS file_a, b.page AS file_b, len(list_filter(range(1, 17), lambda i: a.marks[i] = b.marks[i])) / 16.0::DOUBLE AS likeness
FROM c a JOIN c b ON a.host = b.host AND a.page < b.page AND len(list_filter([0, 4, 8, 12], lambda k: a.marks[k + 1 : k + 4] = b.marks[k + 1 : k + 4])) > 0""",
    "keyed_host_hash": f"""
SELECT host, left(sha256(unhex('{_PAD_OUT}') || unhex(sha256(unhex('{_PAD_IN}') || host::BLOB))), 32) AS host_hash FROM (SELECT DISTINCT lower(host) AS host FROM wcxb_samples WHERE host IS NOT NULL)""",
    "class_buckets": """
WITH t AS (SELECT DISTINCT unnest(string_split(c, ' ')) AS token FROM (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM wcxb_samples))
SELECT token, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(lower(token), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fnv FROM t WHERE token <> ''""",
}
