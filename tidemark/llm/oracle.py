"""DuckDB SQL for the text operators' queries."""

from __future__ import annotations

from tidemark.llm import license_scan, quality_rules as quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SPACES = r"[\x20\x09-\x0D]"

# The CRC-32 of a distinct word's UTF-8 bytes, by the usual table of 256 remainders of polynomial EDB88320.
CRC = """
steps AS (
  SELECT range AS i, list_reduce(list_prepend(range, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS r FROM range(256)
),
remainders AS (SELECT list(r ORDER BY i) AS t FROM steps),
codes AS (
  SELECT w, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS code
  FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM occ), remainders
)"""

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
folds AS (SELECT row, coalesce(('0x' || left(md5(doc_id::VARCHAR), 1))::INTEGER, 0) AS fold FROM docs),
occ AS (SELECT row, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS pos FROM docs),
{CRC},
coded AS (SELECT row, pos, w, code, lag(code) OVER (PARTITION BY row ORDER BY pos) AS before FROM occ JOIN codes USING (w)),
grams AS (
  SELECT row, fold, bucket FROM (
    SELECT row, code % {quality.BUCKETS} AS bucket FROM coded
    UNION ALL SELECT row, (before * {quality.PAIR} + code) % {quality.BUCKETS} FROM coded WHERE before IS NOT NULL
  ) JOIN folds USING (row)
),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (
  SELECT fold, bucket, count(*) AS r, count(t.doc_id) AS t
  FROM grams JOIN docs USING (row) LEFT JOIN trusted t ON t.doc_id = docs.doc_id GROUP BY fold, bucket
),
every AS (SELECT f.range AS fold, b.range AS bucket FROM range({quality.FOLDS}) f, range({quality.BUCKETS}) b),
others AS (
  SELECT fold, bucket, (sum(coalesce(t, 0)) OVER w - coalesce(t, 0))::DOUBLE AS t, (sum(coalesce(r, 0)) OVER w - coalesce(r, 0))::DOUBLE AS r
  FROM every LEFT JOIN counts USING (fold, bucket) WINDOW w AS (PARTITION BY bucket)
),
sums AS (SELECT fold, sum(t) AS t, sum(r) AS r FROM others GROUP BY fold),
weights AS (
  SELECT o.fold, o.bucket, round(ln((o.t + {quality.SMOOTH}) / (CASE WHEN s.r > 0 THEN o.r * s.t / s.r ELSE 0 END + {quality.SMOOTH})) * {quality.UNIT})::BIGINT AS weight
  FROM others o JOIN sums s USING (fold)
),
scored AS (SELECT row, sum(weight)::BIGINT AS total, count(*) AS n FROM grams JOIN weights USING (fold, bucket) GROUP BY row),
windows AS (
  SELECT row, pos, count(*) OVER (PARTITION BY row, g) AS n
  FROM (SELECT row, pos, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS g FROM occ WINDOW o AS (PARTITION BY row ORDER BY pos))
  WHERE g[5] IS NOT NULL
),
repeated AS (SELECT row, count(DISTINCT pos + k) AS n FROM windows, range(0, 5) AS t(k) WHERE n > 1 GROUP BY row),
lines AS (
  SELECT row, count(*) - count(DISTINCT line) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(s.n, 0)::BIGINT AS n_grams, s.total
  FROM docs LEFT JOIN lines l USING (row) LEFT JOIN repeated r USING (row) LEFT JOIN scored s USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_grams, round(total / 1e6 / n_grams, 6) AS score,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(total, 0) >= {round(quality.MIN_SCORE * quality.UNIT)} * n_grams AS kept
FROM measured
"""

EXACT = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g')) AS text_sha256,
    row_number() OVER () AS row FROM documents
),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, row)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _templates() -> str:
    rows = []
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        pairs = license_scan.bigrams(text)
        sizes = license_scan.sizes_allowed(len(pairs))
        rows.append(f"({k}, {_quoted(name)}, [{', '.join(map(_quoted, pairs))}], {len(pairs)}, {sizes.start}, {sizes.stop - 1})")
    return "(VALUES " + ", ".join(rows) + ") AS templates(template, license, pairs, m, least_n, most_n)"


LICENSES = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS plain FROM documents),
cut AS (SELECT *, string_split(plain, chr(10)) AS lines, regexp_split_to_array(plain, '\n[ \n]*\n') AS paragraphs FROM docs),
units AS (
  SELECT row, doc_id, 'line' AS unit, unnest(range(0, len(lines))) AS place, unnest(lines) AS t FROM cut
  UNION ALL SELECT * FROM (SELECT row, doc_id, 'paragraph', unnest(range(0, len(paragraphs))), unnest(paragraphs) AS t FROM cut) WHERE contains(t, chr(10))
  UNION ALL SELECT row, doc_id, 'text', 0, plain FROM cut WHERE len(paragraphs) > 1
),
tokens AS (SELECT *, regexp_extract_all(t, '[a-z0-9]+') AS w FROM units),
sized AS (
  SELECT *, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS p FROM tokens WHERE len(w) > 1
),
found AS (
  SELECT *, len(p) AS n, len(list_filter(pairs, lambda x: list_contains(p, x))) AS common
  FROM sized JOIN {_templates()} ON len(p) BETWEEN least_n AND most_n
)
SELECT doc_id, unit, place::INTEGER AS place, license, template::INTEGER AS template, n::BIGINT AS n_pairs, round(common * 2 / (n + m), 6) AS dice
FROM found WHERE common * 2 >= {license_scan.MIN_DICE} * (n + m)
"""

SQL: dict[str, str] = {"op1_quality_rules": QUALITY, "op7_license_scan": LICENSES, "op8_exact_dedup": EXACT}

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY ALL HAVING 7 * count(*) >= 3 * (any_value(x.n) + any_value(y.n))
),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM sets LEFT JOIN lowest ON a = doc_id
"""
SQL["op5_jaccard_join"] = JACCARD

REVISITS = r"""
WITH parts AS (SELECT *, sha256(html) AS sha, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) AS rest FROM pages),
cut AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', '') AS host,
    regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '\?(.*)$', 1) AS query FROM parts
),
named AS (
  SELECT page_id, sha, html, '"' || left(sha, 16) || '"' AS etag, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS url FROM cut
),
found AS (
  SELECT v.page_id * 2 + 1 AS record_id, v.url, r.page_id * 2 AS source_id, r.sha, r.html, v.etag, (v.page_id + 600) * 60 AS time,
    CASE WHEN v.url IS NULL THEN 'no_url' WHEN r.page_id IS NULL THEN 'no_earlier'
      WHEN coalesce(v.etag = r.etag, v.page_id = r.page_id) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM named v LEFT JOIN LATERAL (
    SELECT * FROM named r WHERE r.url = v.url AND r.page_id * 60 <= (v.page_id + 600) * 60 AND (r.page_id * 60 < (v.page_id + 600) * 60 OR r.page_id * 2 < v.page_id * 2 + 1)
    ORDER BY r.page_id DESC LIMIT 1) r ON true
)
SELECT record_id, url, source_id, outcome, CASE WHEN outcome = 'resolved' THEN sha END AS digest,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || coalesce(chr(10) || 'content-length: ' || octet_length(encode(html)), '')
    || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || time || coalesce(chr(10) || 'etag: ' || etag, '') END AS headers
FROM found
"""
SQL["op6_revisits"] = REVISITS


RANKED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
sums AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
norms AS (SELECT doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, sums WHERE len(terms) > 0),
tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sums GROUP BY term, n_docs
),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
SQL["op13_ranked_search"] = RANKED


REPEATS = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT row, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT row, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY g) AS n FROM strings) WHERE n > 1),
islands AS (
  SELECT row, i, sum(new::INT) OVER (PARTITION BY row ORDER BY i) AS island
  FROM (SELECT row, i, i > coalesce(lag(i) OVER (PARTITION BY row ORDER BY i) + 400, -1) AS new FROM repeated)
),
spans AS (SELECT row, min(i) AS a, max(i) + 400 AS b FROM islands GROUP BY row, island),
pieces AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS from_ FROM spans),
cut AS (
  SELECT row, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept
  FROM pieces JOIN d USING (row) GROUP BY row
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.row IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut c USING (row)
"""
SQL["op11_repeat_index"] = REPEATS
