"""SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"
ITEM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{WORD}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0))),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
 SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""

OP5 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::bigint AS n FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
 SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM p JOIN f USING (h)"""

OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{ITEM_WORD}') AS w FROM documents),
 b AS (SELECT item_id::varchar AS item, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '{ITEM_WORD}') AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
 h AS (SELECT doc_id, item, n, i FROM dw JOIN bw USING (n, g)),
 c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
 SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP9 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS ls FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
 r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
 m AS (SELECT doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
  len(ls)::bigint AS n_lines, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(r.n, 0)::bigint AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, ((n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (4 * n_symbols > n_words)::bigint + 8 * (2 * n_dup_lines > n_lines)::bigint
  + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words))::bigint)::bigint AS fail_bits FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"""

OP10 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
 x AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1)),
 k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN x USING (doc_id, j) GROUP BY doc_id)
 SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(k.n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

ORACLE_SQL = {"op1_ngram_jaccard_join": OP1, "op5_warc": OP5, "op8_decontamination": OP8, "op9_quality_rules": OP9, "op10_substring_dedup": OP10}
