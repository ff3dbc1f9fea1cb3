"""The given tables' derived inputs, as SQL for the checking engine."""

from __future__ import annotations

BASE = """base AS (SELECT event_id, user_id, event_type, date_trunc('milliseconds', ts) AS et,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  CASE WHEN event_type IN ('click','view') THEN 'en' WHEN event_type = 'error' THEN 'pt' ELSE 'de' END AS lang
  FROM events)"""

EDITS = """edits AS (SELECT CAST(event_id AS VARCHAR) AS event_id, et AS event_time,
  et + to_milliseconds(200 + (event_id * 7919) % 1800) AS ingested_at,
  concat(lang, 'wiki') AS wiki, lang, CASE WHEN event_id % 10 = 0 THEN 'new' ELSE 'edit' END AS type,
  CASE WHEN k % 10 < 7 THEN 0 ELSE k % 5 END AS namespace, concat('Article ', CAST(user_id % 50 AS VARCHAR)) AS title,
  (k % 5 = 0) AS is_bot, concat('[{"topic":"eqiad.x","partition":0,"timestamp":', CAST(epoch_ms(et) AS VARCHAR), '}]') AS sse_id,
  event_id AS ingest_seq FROM base)"""

HEAD = "head AS (SELECT max(event_time) AS t FROM edits)"

NOW = "clock AS (SELECT t + INTERVAL 30 SECOND AS now FROM head)"

ROLLUP = """rollup AS (SELECT date_trunc('minute', event_time) AS minute, lang, count(*) AS edits,
  count(*) FILTER (WHERE is_bot) AS bot_edits FROM edits GROUP BY 1, 2)"""

DRIFTED = """drifted AS (SELECT * FROM rollup
  WHERE NOT (lang = 'en' AND (epoch_ms(minute) // 60000) % 97 = 0))"""

PAGES = """pages_pm AS (SELECT DISTINCT date_trunc('minute', event_time) AS minute, lang, namespace, title FROM edits)"""

GAPS = """gaps AS (SELECT et AS detected_at, et - to_milliseconds(k * 1000) AS gap_from,
  et + to_milliseconds((user_id % 60) * 1000) AS gap_to,
  CASE WHEN user_id % 2 = 0 THEN 'retention' ELSE 'outage' END AS reason FROM base WHERE event_type = 'error')"""

RECONNECTS = """reconnects AS (SELECT et AS "at",
  ['idle','eof','network','source_closed'][CAST(user_id % 4 AS INTEGER) + 1] AS reason FROM base WHERE event_type = 'error')"""

SAMPLES = """samples AS (SELECT date_trunc('minute', et) AS minute, et AS sampled_at,
  CASE WHEN user_id % 50 <> 0 THEN k * CAST(0.75 AS DOUBLE) END AS age_s FROM base)"""

_MONTH = """concat('{"Estimated":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END,
  ',"Total":{"UnblendedCost":{"Amount":"', CAST(event_id AS VARCHAR), '.25"',
  CASE WHEN user_id % 9 = 3 THEN '' ELSE ',"Unit":"USD"' END, '}}}')"""

ANSWERS = f"""answers AS (SELECT et AS fetched_at, concat('{{"ResultsByTime":[',
  CASE WHEN user_id % 9 = 0 THEN '' WHEN user_id % 9 = 1 THEN concat({_MONTH}, ',', {_MONTH}) ELSE {_MONTH} END,
  ']}}') AS response FROM base)"""

COSTS = """costs AS (SELECT fetched_at, ok, date_trunc('month', fetched_at)::DATE AS period_start,
  fetched_at::DATE + 1 AS period_end, CASE WHEN ok THEN amount ELSE '' END AS amount,
  CASE WHEN ok THEN currency ELSE '' END AS currency, ok AND estimated AS estimated,
  CASE WHEN ok THEN '' WHEN months = 1 THEN 'amount or unit missing'
       ELSE concat('expected one month of results, got ', CAST(months AS VARCHAR)) END AS error
  FROM (SELECT *, months = 1 AND amount IS NOT NULL AND currency IS NOT NULL AS ok FROM (
    SELECT fetched_at, CAST(json_array_length(response, '$.ResultsByTime') AS BIGINT) AS months,
      json_extract_string(response, '$.ResultsByTime[0].Total.UnblendedCost.Amount') AS amount,
      json_extract_string(response, '$.ResultsByTime[0].Total.UnblendedCost.Unit') AS currency,
      coalesce(CAST(json_extract(response, '$.ResultsByTime[0].Estimated') AS BOOLEAN), false) AS estimated
    FROM answers)))"""

RECORDED = """ledger AS (
  SELECT hour, CAST(n - CASE WHEN h % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rows, hour + INTERVAL 2 HOUR AS written_at FROM held
  UNION ALL SELECT hour, n + 5, hour + INTERVAL 1 HOUR FROM held)"""

HELD = """held AS (SELECT * FROM (SELECT date_trunc('hour', et) AS hour, count(*) AS n,
  epoch_ms(date_trunc('hour', et)) // 3600000 AS h FROM base GROUP BY 1, 3) WHERE h % 13 <> 0)"""

MESSAGES = """once AS (SELECT event_id * 2 AS position,
  concat('[{"topic":"eqiad.x","partition":0,"timestamp":', CAST(epoch_ms(et) AS VARCHAR), '}]') AS sse_id,
  et + to_milliseconds(200 + (event_id * 7919) % 1800) AS received_at,
  CASE c WHEN 0 THEN '{not json' WHEN 1 THEN '[1,2]' ELSE concat(
    '{"meta":{"id":"', uid, '","domain":"', CASE c WHEN 2 THEN 'canary' ELSE concat(lang, '.wikipedia.org') END,
    '","dt":"', CASE c WHEN 9 THEN concat('2099', substring(dt_text, 5)) ELSE dt_text END,
    CASE c WHEN 8 THEN '' ELSE 'Z' END,
    '"},"wiki":"', CASE c WHEN 3 THEN 'frwiki' ELSE concat(lang, 'wiki') END,
    '","type":"', change, '","namespace":',
    CASE c WHEN 5 THEN 'true' WHEN 10 THEN '2147483648' ELSE CAST(ns AS VARCHAR) END,
    ',"title":"', CASE c WHEN 7 THEN '' ELSE title END,
    '","bot":', CASE c WHEN 6 THEN '"false"' WHEN 11 THEN 'null' ELSE bot END, '}') END AS data
  FROM (SELECT event_id, et, event_id % 50 AS c, lang,
    concat('00000000-0000-4000-8000-', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS uid,
    strftime(et, '%Y-%m-%dT%H:%M:%S.%g') AS dt_text,
    CASE WHEN k % 10 < 7 THEN 0 ELSE k % 5 END AS ns,
    concat('Article ', CAST(user_id % 50 AS VARCHAR)) AS title,
    CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END AS bot,
    CASE WHEN event_id % 50 = 4 THEN 'log' WHEN event_id % 10 = 0 THEN 'new' ELSE 'edit' END AS change
    FROM base)),
messages AS (SELECT * FROM once UNION ALL
  SELECT position + 1001, sse_id, received_at, data FROM once WHERE (position // 2) % 20 = 0)"""

CLASSIFIED = """typed AS (SELECT position, sse_id, received_at,
    CASE WHEN json_valid(data) THEN data END AS j FROM messages),
fields AS (SELECT *, json_type(j) AS k_event, json_type(j, '$.meta') AS k_meta,
    json_extract_string(j, '$.meta.domain') AS domain, json_type(j, '$.meta.domain') AS k_domain,
    json_type(j, '$.wiki') AS k_wiki, json_extract_string(j, '$.wiki') AS wiki,
    json_type(j, '$.type') AS k_type, json_extract_string(j, '$.type') AS type,
    json_type(j, '$.meta.id') AS k_id, json_extract_string(j, '$.meta.id') AS raw_id,
    json_type(j, '$.meta.dt') AS k_dt, json_extract_string(j, '$.meta.dt') AS raw_dt,
    json_type(j, '$.title') AS k_title, json_extract_string(j, '$.title') AS title,
    json_type(j, '$.namespace') AS k_ns, TRY_CAST(json_extract_string(j, '$.namespace') AS BIGINT) AS ns,
    json_type(j, '$.bot') AS k_bot, json_extract_string(j, '$.bot') = 'true' AS bot FROM typed),
timed AS (SELECT *, CASE WHEN regexp_full_match(raw_dt, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z')
    THEN TRY_CAST(left(raw_dt, length(raw_dt) - 1) AS TIMESTAMP) END AS instant FROM fields),
classified AS (SELECT *, CASE
    WHEN k_event IS DISTINCT FROM 'OBJECT' OR k_meta IS DISTINCT FROM 'OBJECT' THEN 'malformed'
    WHEN domain = 'canary' THEN 'canary'
    WHEN k_wiki IS DISTINCT FROM 'VARCHAR' THEN 'malformed'
    WHEN wiki NOT IN ('enwiki','ptwiki','dewiki') THEN 'other_wiki'
    WHEN k_type IS DISTINCT FROM 'VARCHAR' THEN 'malformed'
    WHEN type NOT IN ('edit','new') THEN 'other_type'
    WHEN k_id IS DISTINCT FROM 'VARCHAR' OR k_dt IS DISTINCT FROM 'VARCHAR' OR k_title IS DISTINCT FROM 'VARCHAR' THEN 'malformed'
    WHEN k_ns IS NULL OR k_ns NOT IN ('UBIGINT','BIGINT') OR ns NOT BETWEEN -2147483648 AND 2147483647 THEN 'malformed'
    WHEN k_bot IS NOT NULL AND k_bot <> 'BOOLEAN' THEN 'malformed'
    WHEN NOT regexp_full_match(lower(raw_id), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') OR instant IS NULL THEN 'malformed'
    WHEN title = '' OR strlen(title) > 1024 OR year(instant) NOT BETWEEN 1971 AND 2105 THEN 'malformed'
    WHEN instant > received_at + INTERVAL 5 MINUTE THEN 'future'
    WHEN sse_id = '' THEN 'malformed' ELSE 'kept' END AS outcome FROM timed),
firsts AS (SELECT raw_id AS event_id, min(position) AS position FROM classified WHERE outcome = 'kept' GROUP BY 1),
stored AS (SELECT c.raw_id AS event_id, c.instant AS event_time, c.received_at AS ingested_at, c.wiki, replace(c.wiki, 'wiki', '') AS lang,
    c.type, CAST(c.ns AS INTEGER) AS namespace, c.title, coalesce(c.bot, false) AS is_bot, c.sse_id, c.position
    FROM classified c JOIN firsts f ON c.raw_id = f.event_id AND c.position = f.position WHERE c.outcome = 'kept')"""


def with_inputs(*ctes: str) -> str:
    """`WITH base, edits, ... ` in the order given."""
    return "WITH " + ",\n".join(ctes) + "\n"
