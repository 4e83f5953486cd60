"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP4 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3
), keyed AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM windows
), twice AS (
  SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM keyed) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, md5(t) AS c, unnest(l) AS line FROM d
), normal AS (
  SELECT doc_id, source, c, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS line,
         len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
  FROM lines
), hosts AS (
  SELECT source, count(DISTINCT md5(t)) AS n_host FROM d GROUP BY source
), often AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT c) AS n FROM normal GROUP BY source, line)
  JOIN hosts USING (source) WHERE n > 30 AND n > n_host * 0.10
), removed AS (
  SELECT doc_id, sum(n) AS n FROM normal JOIN often USING (source, line) GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept
FROM counted
"""

_ESC = "regexp_replace({}, '<(\\|+)', '<\\1|', 'g')"

OP5 = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length({_ESC.format('role')}) + 1 + length({_ESC.format('text')}) + 11)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

OP6 = f"""
WITH d AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), runs AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), gone AS (
  SELECT doc_id, list(DISTINCT p + k) AS g
  FROM (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM runs) WHERE n > 1), range(35) AS r(k)
  GROUP BY doc_id
), places AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) AS a
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(g) AS i FROM gone) AS b WHERE a.doc_id = b.doc_id AND a.i = b.i)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN places USING (doc_id)
"""

_NORMAL = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

OP7 = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item, len(w[p:p + 9]) AS n, array_to_string(w[p:p + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, p, n, item FROM grams JOIN windows USING (n, g)),
per_doc AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id),
words AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN words USING (doc_id)
"""

OP8 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT h, min(page_id) AS least FROM p GROUP BY h),
n AS (SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', h[i + 1]) - 1), 4, '0')), 'string_agg', '') AS bits FROM p JOIN f USING (h))
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT + 1]),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM n
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 byte by byte: its table is made from the polynomial 0xEDB88320 (3988292384).
OP11 = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce([i] || range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i:
           ((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT),
         lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM (SELECT run, n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs), crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), one AS (
  SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM less AS a JOIN words AS b ON a.rest = b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
), near AS (
  SELECT a, an, b, bn FROM one UNION SELECT b, bn, a, an FROM one
), best AS (
  SELECT a, any_value(an) AS an, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS b, max(bn) AS bn FROM near GROUP BY a
), formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n
  FROM words LEFT JOIN best ON word = a
), up AS (
  SELECT word, word AS root, form AS after FROM formed
  UNION ALL SELECT up.word, formed.word, formed.form FROM up JOIN formed ON up.after = formed.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM up WHERE after IS NULL) USING (word)
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), q AS (
  SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark
), totals AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0
), tfs AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals
), shares AS (
  SELECT r, doc_id, term, weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * docs) // terms))) AS s
  FROM tfs JOIN d USING (r) JOIN weights USING (term), totals
), scores AS (
  SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(s)::BIGINT AS score FROM q JOIN shares USING (term) GROUP BY q, r
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""

OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams AS x JOIN grams AS y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY a, b)
  JOIN sizes AS s ON s.doc_id = a JOIN sizes AS t ON t.doc_id = b WHERE 100 * shared >= 80 * (s.n + t.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""

#: Boosted trees, 64-bit hashes and seeded draws have no SQL here; op1, op2, op3, op9, op10 and the
#: pipeline are tested against brute force, held-out accuracy or round trips in tests/llm.
ORACLE = {"op4_quality": OP4, "op5_chat": OP5, "op6_substrings": OP6, "op7_contamination": OP7, "op8_warc": OP8,
          "op11_spelling": OP11, "op12_search": OP12, "op13_jaccard": OP13}
