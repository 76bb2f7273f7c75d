"""DuckDB SQL that states the same results as the registered queries."""

from __future__ import annotations

from orderly.llm import quality, warc

_PHRASES = " OR ".join(f"contains(lower(line), '{p.decode()}')" for p in quality.BOILERPLATE)

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + {quality.WINDOW - 1}) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {quality.WINDOW})
),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM twice) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
    length(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) AS marks, length(regexp_replace(line, '[^|]', '', 'g')) AS bars
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)
),
judged AS (
  SELECT doc_id, strlen(line) AS b, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k,
    ((bars >= 2 AND n <= 4 * (bars + 1)) OR 2 * marks > n OR {_PHRASES}) AS fails
  FROM lines WHERE n > 0
),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE fails) AS n_failed_lines, count(*) FILTER (WHERE k > 1) AS n_dup_lines,
    sum(b) AS text_bytes, coalesce(sum(b) FILTER (WHERE fails), 0) AS lost_bytes
  FROM judged GROUP BY doc_id
),
j AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
    coalesce(text_bytes, 0) AS text_bytes, coalesce(lost_bytes, 0) AS lost_bytes
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id)
),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed FROM j)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, n_lines::BIGINT AS n_lines,
  n_failed_lines::BIGINT AS n_failed_lines, text_bytes::BIGINT AS text_bytes, lost_bytes::BIGINT AS lost_bytes,
  NOT base_failed AND 100 * lost_bytes <= {quality.MAX_LOST_PCT} * text_bytes AS kept
FROM b
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
l AS (SELECT conv_id, max(CASE WHEN contains(text, '<s>') OR contains(text, '</s>') THEN 1 ELSE 0 END) AS level FROM t GROUP BY conv_id),
e AS (
  SELECT t.*, CASE WHEN level = 0 THEN text ELSE replace(replace(replace(text, '\', '\\'), '</s>', '<\/s>'), '<s>', '<\s>') END AS shown
  FROM t JOIN l USING (conv_id)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(shown) + 10)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP10 = f"""
WITH p AS (
  SELECT page_id, coalesce(floor(page_id / {warc.PER_FILE}.0), -1)::BIGINT AS file,
    'WARC/1.0' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'WARC-Record-ID: <urn:page:' ||
    coalesce(page_id::VARCHAR, '') || '>' || crlf || 'Content-Type: text/html' || crlf || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR ||
    crlf || crlf || coalesce(html, '') || crlf || crlf AS record
  FROM pages, (SELECT chr(13) || chr(10) AS crlf)
),
i AS (
  SELECT page_id, file, record, strlen(record)::BIGINT AS length, sha256(record) AS digest,
    (sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, sha256(record) ROWS UNBOUNDED PRECEDING) - strlen(record))::BIGINT AS "offset"
  FROM p
)
SELECT page_id, file, 0 AS volume, "offset", length, digest,
  CASE WHEN page_id % 64 = 1 THEN sha256(left(record, length(record) - 1) || chr(13)) WHEN page_id % 64 = 2 THEN NULL ELSE digest END AS replica_digest,
  CASE WHEN page_id % 64 = 1 THEN 'changed' WHEN page_id % 64 = 2 THEN 'missing' ELSE 'ok' END AS verdict
FROM i
"""

# A byte-wise crc32 of an ASCII string; the table is the usual one of the reflected polynomial 0xEDB88320.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""


def _crc(text: str) -> str:
    bytes_ = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255::BIGINT) + 1])), 4294967295::BIGINT)"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _edit(cost: str, letter: str, rest: str) -> str:
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a}}"


def _row_ways(state: str, rerole: str, keep: str) -> str:
    """The cheapest edit of a row in a state: s0 start, s1 after system, s2 after user, s3 after assistant."""
    return _least(_edit("3", "D", state), f"CASE WHEN fault < 2 THEN {_edit('2 + fault', 'R', rerole)} END", f"CASE WHEN fault < 2 THEN {keep} END")


def _kept(*ways: str) -> str:
    return "CASE " + " ".join(f"WHEN head = '{h}' THEN {_edit('fault', 'K', s)}" for h, s in (w.split() for w in ways)) + " END"


OP11 = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, tab
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM raw WHERE kind <> 0)
),
rows_ AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last, left(role, 1) AS head
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy FROM damaged)
),
f AS (
  SELECT *, CASE WHEN last = '' THEN 3 WHEN copy > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
    coalesce(lag(head) OVER (PARTITION BY conv_id ORDER BY i) || head NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM rows_
),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (bad) AS illegal
  FROM f GROUP BY conv_id
),
dp AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': 4, 'a': 'II'}} AS s1, {{'c': 2, 'a': 'I'}} AS s2, {{'c': 0, 'a': ''}} AS s3 FROM n
  UNION ALL
  SELECT conv_id, i, {_least("t0", _edit("2", "I", "t2"), _edit("4", "II", "t3"))}, {_least("t1", _edit("2", "I", "t2"), _edit("4", "II", "t3"))},
    {_least("t2", _edit("2", "I", "t3"))}, {_least("t3", _edit("2", "I", "t2"))}
  FROM (
    SELECT dp.conv_id, dp.i - 1 AS i, {_row_ways("s0", "s2", _kept("s s1", "u s2"))} AS t0, {_row_ways("s1", "s2", _kept("u s2"))} AS t1,
      {_row_ways("s2", "s3", _kept("a s3"))} AS t2, {_row_ways("s3", "s2", _kept("u s2"))} AS t3
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i
  )
),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM dp WHERE i = 0),
letters AS (
  SELECT conv_id, p, letter, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS p FROM best WHERE audit <> '')
),
turns AS (
  SELECT l.conv_id, p, letter, f.role, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text,
    row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS nth,
    first_value(letter = 'K' AND f.head = 's') OVER (PARTITION BY l.conv_id ORDER BY p) AS led
  FROM letters l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE letter <> 'D'
),
said AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN letter = 'K' THEN role WHEN (nth - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS digest
  FROM turns GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _assigned(name: str, centroids: str) -> str:
    return f"""{name} AS (
  SELECT rid, min({{'d': list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': m.c}}) AS best
  FROM k, {centroids} m GROUP BY rid
)"""


def _moved(name: str, assigned: str, centroids: str) -> str:
    return f"""{name}_sums AS (
  SELECT best.c AS c, j, sum(x)::BIGINT AS s, count(*) AS n FROM {assigned} JOIN (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM k) USING (rid) GROUP BY ALL
),
{name} AS (
  SELECT m.c, coalesce(w.v, m.v) AS v FROM {centroids} m
  LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM {name}_sums GROUP BY c) w USING (c)
)"""


OP12 = f"""
WITH k AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v,
    sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v FROM k ORDER BY h, v LIMIT 16),
{_assigned("a0", "c0")}, {_moved("c1", "a0", "c0")}, {_assigned("a1", "c1")}, {_moved("c2", "a1", "c1")},
{_assigned("a2", "c2")}, {_moved("c3", "a2", "c2")}, {_assigned("a3", "c3")}
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN k USING (rid) JOIN c3 ON c3.c = best.c
"""

ORACLE_SQL = {
    "op11_structure_repair": OP11,
    "op12_centroid_clustering": OP12,
    "op7_chat_format": OP7,
    "op10_warc_fixity": OP10,
    "op1_quality_rules": OP1,
}
