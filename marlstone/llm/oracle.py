"""The same results as DuckDB SQL, where SQL can state them."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: A line without white space at its ends.
TRIM = r"regexp_replace(regexp_replace({}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"

WARC = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, MAX(page_id) OVER (PARTITION BY payload) AS newest, sha1(payload) AS h FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(i // 4 AS BIGINT) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM d"""

#: Quantile sketches as the operator keeps them: exact below 512, then 256 buckets to a doubling.
QUALITY = rf"""
WITH t AS (SELECT doc_id, lang, source, COALESCE(text, '') AS x FROM documents),
w AS (SELECT doc_id, lang, source, x, {WORDS.format("x")} AS words, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING COUNT(*) > 1),
cover AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(COALESCE(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
r AS (
  SELECT c.*, t.x, 10000 * n_symbols // greatest(word_chars, 1) AS r0, 10000 * n_dup_lines // greatest(n_lines, 1) AS r1,
         10000 * n_repeat_words // greatest(n_words, 1) AS r2, 100 * word_chars // greatest(n_words, 1) AS r3,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c JOIN t ON c.doc_id = t.doc_id),
o AS (SELECT DISTINCT lang, source, x, r0, r1, r2, r3, word_chars, n_lines, n_words FROM r WHERE NOT base_failed),
v AS (SELECT lang, source, unnest(range(7)) AS k, unnest([r0, r1, r2, r3, word_chars, n_lines, n_words]) AS v FROM o),
s AS (SELECT lang, source, k, (v >> greatest(length(bin(v)) - 9, 0)) << greatest(length(bin(v)) - 9, 0) AS b FROM v),
lv AS (SELECT 0 AS lvl, lang, source, k, b FROM s UNION ALL SELECT 1, lang, NULL, k, b FROM s UNION ALL SELECT 2, NULL, NULL, k, b FROM s),
h AS (SELECT lvl, lang, source, k, b, COUNT(*) AS n FROM lv GROUP BY lvl, lang, source, k, b),
u AS (SELECT *, SUM(n) OVER (PARTITION BY lvl, lang, source, k ORDER BY b) AS upto, SUM(n) OVER (PARTITION BY lvl, lang, source, k) AS total FROM h),
q AS (SELECT lvl, lang, source, k, MAX(total) AS total, MIN(CASE WHEN 100 * upto >= 25 * total THEN b END) AS q25, MIN(CASE WHEN 100 * upto >= 50 * total THEN b END) AS q50,
        MIN(CASE WHEN 100 * upto >= 75 * total THEN b END) AS q75, MIN(CASE WHEN 100 * upto >= 90 * total THEN b END) AS q90 FROM u GROUP BY lvl, lang, source, k),
e AS (SELECT a.lvl, a.lang, a.source, a.k, a.total, a.q25, a.q50, a.q75, a.q90, CASE a.k WHEN 2 THEN 240000 WHEN 3 THEN 4 * a.q50 ELSE 40000 END AS slack, z.q50 AS size
      FROM q a JOIN q z ON a.lvl = z.lvl AND a.lang IS NOT DISTINCT FROM z.lang AND a.source IS NOT DISTINCT FROM z.source AND z.k = CASE a.k WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 6 END WHERE a.k < 4),
g2 AS (SELECT *, greatest(8 * least(q75 - q50, q50 - q25), slack // greatest(size, 1)) AS reach FROM e),
f AS (SELECT *, greatest(q50 + reach, least(q90 + 2 * (q90 - q50), q50 + 2 * reach)) AS high, q50 - reach AS low FROM g2),
p AS (
  SELECT r.*, CASE WHEN a.total >= 100 THEN 0 WHEN b.total >= 100 THEN 1 ELSE 2 END AS lvl
  FROM r LEFT JOIN f a ON a.lvl = 0 AND a.k = 0 AND a.lang IS NOT DISTINCT FROM r.lang AND a.source IS NOT DISTINCT FROM r.source
         LEFT JOIN f b ON b.lvl = 1 AND b.k = 0 AND b.lang IS NOT DISTINCT FROM r.lang),
j AS (
  SELECT p.doc_id, p.x, BOOL_AND(CASE f.k WHEN 0 THEN 10000 * n_symbols <= high * word_chars + slack WHEN 1 THEN 10000 * n_dup_lines <= high * n_lines + slack
           WHEN 2 THEN 10000 * n_repeat_words <= high * n_words + slack ELSE 100 * word_chars <= high * n_words + slack AND 100 * word_chars >= low * n_words - slack END) AS passes
  FROM p JOIN f ON f.lvl = p.lvl AND (p.lvl = 2 OR f.lang IS NOT DISTINCT FROM p.lang) AND (p.lvl > 0 OR f.source IS NOT DISTINCT FROM p.source) GROUP BY p.doc_id, p.x)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND COALESCE(passes, TRUE) AS kept FROM r LEFT JOIN j ON r.doc_id = j.doc_id"""

CLEAN = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""
WITH b AS (SELECT item_id, {CLEAN.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
d AS (SELECT doc_id, {CLEAN.format("COALESCE(text, '')")} AS w FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, i, item FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
hits AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
       sha256(COALESCE(names, '')) AS items_sha256, COALESCE(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""

LINES = f"""
WITH l AS (SELECT doc_id, source, i, ls[i] AS line, {TRIM.format("ls[i]")} AS x
           FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
b AS (SELECT x, MIN(doc_id) AS keeper FROM l WHERE x <> '' GROUP BY x HAVING COUNT(DISTINCT COALESCE(source, chr(1))) >= 10),
k AS (SELECT l.doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> l.doc_id) AS n_removed,
             string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = l.doc_id) AS kept
      FROM l LEFT JOIN b ON l.x = b.x GROUP BY l.doc_id)
SELECT d.doc_id, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""

#: Bytes as pairs of hexadecimal digits; 50 bytes are 100 digits.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, MIN(doc_id) AS keeper FROM w GROUP BY s HAVING COUNT(*) > 1),
m AS (SELECT doc_id, p FROM w JOIN f ON w.s = f.s WHERE keeper < doc_id),
n AS (SELECT doc_id, p, CASE WHEN p - LAG(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM m),
r AS (SELECT doc_id, p, SUM(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n),
spans AS (SELECT doc_id, MIN(p) AS a, MAX(p) + 50 AS b FROM r GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
gaps AS (SELECT doc_id, a, COALESCE(LAG(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM ends),
kept AS (SELECT gaps.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS k FROM gaps JOIN d ON d.doc_id = gaps.doc_id GROUP BY gaps.doc_id),
sums AS (SELECT doc_id, SUM(b - a) AS n_removed, COUNT(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN sums ON d.doc_id = sums.doc_id"""

#: Similar sets share one of their n - ceil(0.8 n) + 1 rarest shingles at least.
COPIES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT g, COUNT(*) AS df FROM s GROUP BY g),
k AS (SELECT s.doc_id, s.g, n, ROW_NUMBER() OVER (PARTITION BY s.doc_id ORDER BY df, s.g) AS k FROM s JOIN df ON s.g = df.g JOIN n ON s.doc_id = n.doc_id),
p AS (SELECT doc_id, g FROM k WHERE k <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
fits AS (SELECT a, b, x.n AS na, y.n AS nb FROM cand JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
i AS (SELECT a, b, na, nb, COUNT(*) AS c FROM fits JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b, na, nb),
e AS (SELECT a, b FROM i WHERE 100 * c >= 80 * (na + nb - c) UNION SELECT b, a FROM i WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, MIN(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

ORACLE_SQL: dict[str, str] = {"op2_minhash_near_dedup": COPIES, "op3_warc": WARC, "op5_quality_rules": QUALITY, "op7_decontaminate": DECONTAMINATE, "op8_suffix_array_dedup": REPEATS, "op9_line_dedup": LINES}
