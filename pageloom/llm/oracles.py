"""The SQL that queries of problem 5 are held against, for DuckDB over the same tables: every pair compared."""

from __future__ import annotations

_LE32 = "('0x' || substr(h, {0} + 6, 2) || substr(h, {0} + 4, 2) || substr(h, {0} + 2, 2) || substr(h, {0}, 2))::BIGINT"
_LE64 = "('0x' || " + " || ".join(f"substr(h, off_ + 8 + 2 * size + {k}, 2)" for k in range(14, -2, -2)) + ")::UBIGINT"
_SAME = "len(list_filter(range(128), lambda i: substr({a}, i * 8 + 1, 8) = substr({b}, i * 8 + 1, 8)))"
_PAIRS = f"""signs AS (
  SELECT DISTINCT template_id AS t, hex(signature_minhash) AS h FROM templates WHERE template_id IS NOT NULL AND octet_length(signature_minhash) = 512 AND hex(signature_minhash) <> repeat(substr(hex(signature_minhash), 1, 8), 128)
),
slots AS (SELECT t, h, i, substr(h, i * 8 + 1, 8) AS s FROM signs, range(128) AS r(i)),
sign_pairs AS (SELECT DISTINCT x, y FROM (SELECT a.t AS x, b.t AS y FROM slots a JOIN slots b ON a.i = b.i AND a.s = b.s AND a.t < b.t GROUP BY a.t, a.h, b.t, b.h HAVING count(*) >= 109)),
raw AS (SELECT DISTINCT template_id AS t, hex(pq_gram_vector) AS h FROM templates WHERE template_id IS NOT NULL AND octet_length(pq_gram_vector) > 4),
walk AS (
  SELECT t, h, {_LE32.format('1')} AS n, 0 AS i, 9 AS off_, {_LE32.format('9')} AS size FROM raw
  UNION ALL
  SELECT t, h, n, i + 1, off_ + 8 + 2 * size + 16, CASE WHEN i + 1 < n THEN {_LE32.format('(off_ + 8 + 2 * size + 16)')} END FROM walk WHERE i + 1 < n
),
bits AS (SELECT t, md5(h) AS m, decode(unhex(substr(h, off_ + 8, 2 * size))) AS gram, {_LE64} AS v FROM walk WHERE size IS NOT NULL AND n > 0),
weights AS (SELECT t, m, gram, CASE WHEN v >> 63 = 1 THEN -1.0 ELSE 1.0 END * (1.0::DOUBLE + (v & 4503599627370495)::DOUBLE / 4503599627370496.0) * pow(2.0::DOUBLE, ((v >> 52) & 2047)::INTEGER - 1023) AS w FROM bits),
norms AS (SELECT t, m, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL),
dots AS (SELECT a.t AS x, a.m AS mx, b.t AS y, b.m AS my, sum(a.w * b.w) AS dot FROM weights a JOIN weights b ON a.gram = b.gram AND a.t < b.t GROUP BY ALL),
gram_pairs AS (SELECT DISTINCT x, y FROM dots JOIN norms p ON p.t = x AND p.m = mx JOIN norms q ON q.t = y AND q.m = my WHERE dot / (p.norm * q.norm) >= 0.90),
pairs AS (SELECT * FROM sign_pairs UNION SELECT * FROM gram_pairs)"""

SQL: dict[str, str] = {
    "p5_found": f"WITH RECURSIVE {_PAIRS} SELECT x AS template_id_a, y AS template_id_b FROM pairs",
    "p5_groups": f"""WITH RECURSIVE {_PAIRS},
both_ AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT x AS t, x AS r FROM both_ UNION SELECT reach.t, both_.y FROM reach JOIN both_ ON both_.x = reach.r),
counts AS (SELECT t, count(*) AS links FROM (SELECT x AS t FROM sign_pairs UNION ALL SELECT y FROM sign_pairs UNION ALL SELECT x FROM gram_pairs UNION ALL SELECT y FROM gram_pairs) GROUP BY t)
SELECT t AS template_id, min(r) AS group_id, max(links) AS links FROM reach JOIN counts USING (t) GROUP BY t""",
    "p5_wandering": f"""WITH RECURSIVE {_PAIRS},
own AS (SELECT t, max(h) AS h FROM signs GROUP BY t),
first_ AS (SELECT h, min(t) AS first_t FROM own GROUP BY h),
rivals AS (SELECT DISTINCT p.t, f.h, f.first_t FROM (SELECT x AS t, y AS u FROM pairs UNION SELECT y, x FROM pairs) p JOIN own a ON a.t = p.t JOIN own b ON b.t = p.u JOIN first_ f ON f.h = b.h WHERE b.h <> a.h),
seen AS (
  SELECT DISTINCT template_id AS t, observed_at, hex(signature_minhash) AS h FROM template_observations
  WHERE octet_length(signature_minhash) = 512 AND hex(signature_minhash) <> repeat(substr(hex(signature_minhash), 1, 8), 128)
),
scored AS (
  SELECT s.t, s.observed_at, s.h, {_SAME.format(a='s.h', b='o.h')} AS own_slots, r.first_t, {_SAME.format(a='s.h', b='r.h')} AS near_slots FROM seen s JOIN own o ON o.t = s.t JOIN rivals r ON r.t = s.t
)
SELECT t AS template_id, observed_at, first_t AS nearest_id, own_slots::INTEGER AS own_slots, near_slots::INTEGER AS nearest_slots
FROM (SELECT *, row_number() OVER (PARTITION BY t, observed_at, h ORDER BY near_slots DESC, first_t) AS r FROM scored WHERE near_slots > own_slots) WHERE r = 1""",
}
