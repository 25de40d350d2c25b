"""DuckDB SQL for the results of the training-data queries that SQL can express, over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
places AS (
  SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
found AS (SELECT r, k, n, item_id FROM places JOIN item_windows USING (n, s)),
hits AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS place FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

_TWENTY_BITS = "CAST('0x' || substr(h, 5 * q + 1, 5) AS BIGINT)"
WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
digests AS (
  SELECT payload, first, array_to_string(list_transform(range(8), lambda q: array_to_string(list_transform(range(4),
    lambda e: substr('{UPPER}234567', CAST(({_TWENTY_BITS} >> (15 - 5 * e)) & 31 AS BIGINT) + 1, 1)), '')), '') AS digest
  FROM (SELECT payload, first, sha1(payload) AS h FROM firsts))
SELECT page_id, octet_length(payload) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM p JOIN digests USING (payload)
"""

#: A UTF-8 character in hexadecimal digits.
_CHARACTER = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(?:E[1-9A-CEF])(?:[89AB].){2}|ED[89].[89AB].|F0[9AB].(?:[89AB].){2}|F[1-3](?:[89AB].){3}|F48.(?:[89AB].){2}"
SUFFIX = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
strings AS (SELECT r, k, sha256(array_slice(b, k, k + 399)) AS s FROM (SELECT r, b, unnest(range(1, CAST(octet_length(b) AS BIGINT) - 398)) AS k FROM d WHERE octet_length(b) >= 400)),
starts AS (SELECT r, k FROM strings JOIN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1) USING (s)),
marked AS (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 400 THEN 0 ELSE 1 END AS fresh FROM starts),
numbered AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS run FROM marked),
runs AS (SELECT r, min(k) AS first, max(k) + 399 AS last FROM numbered GROUP BY r, run),
gaps AS (
  SELECT r, coalesce(lag(last) OVER (PARTITION BY r ORDER BY first), 0) + 1 AS begin, first - 1 AS stop FROM runs
  UNION ALL SELECT r, max(last) + 1, any_value(CAST(octet_length(b) AS BIGINT)) FROM runs JOIN d USING (r) GROUP BY r),
rests AS (SELECT r, string_agg(CASE WHEN begin <= stop THEN hex(array_slice(b, begin, stop)) ELSE '' END, '' ORDER BY begin) AS rest FROM gaps JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, CAST(sum(last - first + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r),
left_over AS (SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(rest, hex(b)) AS rest FROM d LEFT JOIN sums USING (r) LEFT JOIN rests USING (r))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256, decode(unhex(regexp_replace(rest, '({_CHARACTER})|..', '\\1', 'g'))) AS text FROM left_over
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s AS x JOIN s AS y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS c USING (doc_id)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b] ELSE '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] END AS out FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(out) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

COLLOCATIONS = rf"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = first JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[s : s + m - 1], ' ') AS part FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) GROUP BY ALL),
left_over AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND part = phrase WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over) JOIN totals USING (lang) WHERE rank <= 2000
"""

#: Every ``<|``, with backslashes between, gets one more.
_ESCAPED = "regexp_replace({0}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')".format
CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, place, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(place, role)),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(12 + length({_ESCAPED("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + 1 + length({_ESCAPED("text")}) + 11) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

SQL = {
    "op4_decontamination": DECONTAMINATION, "op7_warc_writer": WARC, "op9_suffix_dedup": SUFFIX, "op10_hyperminhash": NEAR_DUPLICATES, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_collocations": COLLOCATIONS,
    "op13_chat_format": CHAT,
}
