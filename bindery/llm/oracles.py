"""SQL for those operators that SQL can express over whole tables."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

OP9 = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM docs),
windows AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS later
  FROM (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i : i + 19], ' '))) AS win FROM docs)
),
marked AS (
  SELECT words.doc_id, words.pos, word, coalesce(words.pos - max(CASE WHEN later THEN words.pos END) OVER (PARTITION BY words.doc_id ORDER BY words.pos) <= 19, false) AS gone
  FROM words LEFT JOIN windows ON words.doc_id = windows.doc_id AND words.pos = windows.pos
),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone::INT)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP3 = rf"""
WITH docs AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
sized AS (SELECT *, ('0x' || substr(md5(concat_ws('|', doc_id, size)), 1, 15))::BIGINT AS hash FROM docs),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source),
weighted AS (SELECT source, source_size, [3.0::DOUBLE, 1.0, 2.0][((r - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
ordered AS (
  SELECT *, sum(cap) OVER before AS capped, sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total
  FROM weighted WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levels AS (SELECT first((1.5::DOUBLE * total - coalesce(capped, 0)) / rest ORDER BY cap / weight, source) AS level FROM ordered WHERE (1.5::DOUBLE * total - coalesce(capped, 0)) / rest <= cap / weight),
targets AS (SELECT source, source_size, least(cap, level * weight) AS target FROM weighted, levels),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 2) END::INT AS times FROM targets),
joined AS (SELECT doc_id, size, hash, plan.*, target - times * source_size AS left_over FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY hash) AS upto, sum(size) OVER (PARTITION BY source, hash) AS together FROM joined)
SELECT doc_id, size, source_size, target,
  size * (times + CASE WHEN times >= 2 THEN 0 WHEN upto <= left_over OR (upto - together <= left_over AND 2 * (left_over - (upto - together)) > together) THEN 1 ELSE 0 END) AS taken
FROM summed
"""

OP4 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) < doc_id AS later
  FROM (SELECT doc_id, pos, substr(h, 2 * pos - 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS pos FROM docs))
),
bytes AS (SELECT doc_id, unnest(range(1, n + 1)) AS pos, unnest(regexp_extract_all(h, '..')) AS b FROM docs),
marked AS (
  SELECT bytes.doc_id, bytes.pos, b, coalesce(bytes.pos - max(CASE WHEN later THEN bytes.pos END) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.pos) <= 49, false) AS gone
  FROM bytes LEFT JOIN windows ON bytes.doc_id = windows.doc_id AND bytes.pos = windows.pos
),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked),
kept AS (
  SELECT doc_id, count(*) AS n_bytes, sum(gone::INT)::BIGINT AS n_removed, sum(opens::INT)::BIGINT AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP1 = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice
  FROM (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS pos, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i : i + 7], ' '))) AS win FROM docs)
),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
covered AS (
  SELECT doc_id, sum(hit::INT)::BIGINT AS n_repeat_words FROM (
    SELECT words.doc_id, coalesce(words.pos - max(CASE WHEN twice THEN words.pos END) OVER (PARTITION BY words.doc_id ORDER BY words.pos) <= 7, false) AS hit
    FROM words LEFT JOIN windows ON words.doc_id = windows.doc_id AND words.pos = windows.pos
  ) GROUP BY doc_id
),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text FROM docs),
parts AS (SELECT doc_id, source, text AS line, {_WORDS} AS ws FROM lines),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM parts WHERE len(ws) > 0 GROUP BY doc_id),
norm AS (
  SELECT doc_id, source, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS line, sum(len(ws)) AS n
  FROM parts WHERE len(ws) > 0 GROUP BY ALL
),
hosts AS (SELECT source, count(DISTINCT doc_id) + count(*) - count(doc_id) AS docs FROM documents GROUP BY source),
common AS (
  SELECT norm.source, line FROM norm JOIN hosts ON norm.source IS NOT DISTINCT FROM hosts.source
  GROUP BY norm.source, line, docs HAVING count(DISTINCT doc_id) > least(greatest(20, docs * 0.002), 1000)
),
lost AS (
  SELECT doc_id, sum(n)::BIGINT AS removed_words FROM norm JOIN common ON norm.source IS NOT DISTINCT FROM common.source AND norm.line = common.line GROUP BY doc_id
),
measured AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id)
),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - removed_words < 20 OR n_words - removed_words < 0.5 * n_words AS depleted FROM measured
)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""


def secrets_sql(rules, base: int) -> str:
    """The spans of rules (kind, regex, group, least); the first ``base`` are counted."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    one = """SELECT doc_id, {k} AS k, {kind} AS kind, m, gaps, judged FROM (
      SELECT doc_id, regexp_extract_all(text, {regex}) AS m, string_split_regex(text, {regex}) AS gaps, regexp_extract_all(text, {regex}, {group}) AS judged FROM docs)"""
    found = " UNION ALL ".join(one.format(k=k, kind=quoted(r.kind), regex=quoted(r.regex), group=r.group) for k, r in enumerate(rules))
    least = "CASE k " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules)) + " END"
    counts = ", ".join(f"coalesce(sum((k = {k})::INT), 0)::BIGINT AS n_{r.kind}" for k, r in enumerate(rules[:base]))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, k, kind, length(array_to_string(gaps[1:i], '')) + length(coalesce(array_to_string(m[1:i - 1], ''), '')) AS s, length(m[i]) AS n
  FROM each WHERE length(judged[i]) >= {least}
),
shown AS (SELECT *, kind || ':' || s || ':' || s + n AS span FROM spans)
SELECT documents.doc_id, {counts},
  sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < {base}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans
FROM documents LEFT JOIN shown ON documents.doc_id = shown.doc_id GROUP BY documents.doc_id
"""
