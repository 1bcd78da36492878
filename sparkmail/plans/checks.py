"""Check SQL for the registered queries, written for DuckDB.

Answers are worked out another way than in the queries: grouped minima and
self-joins instead of windows, set arithmetic instead of flags.
"""

from __future__ import annotations

from sparkmail.functions.text import UNICODE_WHITESPACE
from sparkmail.plans.views import NOW_UNIX

_SPACES = " || ".join(f"chr({ord(c)})" for c in UNICODE_WHITESPACE)  # most of them cannot be seen in a literal
_WORD = r"[\p{L}\p{M}\p{N}\p{Pc}"
# Addresses as one expression; RE2 needs no care with repeated groups.
_ADDRESS = rf"{_WORD}\-.]+@(?:{_WORD}-]+\.)+{_WORD}-]{{2,4}}"

_BASE = """
mail_base AS (
  SELECT event_id AS seq, user_id,
         'user' || user_id || '@mail' || (user_id % 7) || '.example.com' AS address,
         CASE WHEN event_id % 10 <> 0 THEN 'e' || event_id || '@example.com' END AS rfc
  FROM events),
scan AS (SELECT *, 'g' || seq AS mail_id FROM mail_base WHERE seq % 4 <> 3),
import_all AS (SELECT * FROM mail_base WHERE seq % 2 = 1 OR seq % 10 = 0),
import AS (SELECT *, 'mid:<' || rfc || '>' AS mail_id FROM import_all WHERE rfc IS NOT NULL),
replay AS (SELECT * FROM scan UNION ALL SELECT * FROM scan WHERE seq % 5 = 0)
"""

_AFTER_BOTH = _BASE + """,
counted AS (
  SELECT seq, address FROM scan
  UNION ALL SELECT seq, address FROM import WHERE rfc NOT IN (SELECT rfc FROM scan WHERE rfc IS NOT NULL)),
after_both AS (SELECT address AS sender, count(*) AS mails_sent FROM counted GROUP BY 1)
"""

_HIDDEN = """
hidden AS (SELECT DISTINCT 'user' || user_id || '@mail' || (user_id % 7) || '.example.com' AS sender
           FROM events WHERE user_id % 11 = 0)
"""

_DOCS = """
docs AS (
  SELECT event_id, user_id, 'g' || event_id AS mail_id,
         CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 'second' || user_id || '@example.org'
              WHEN event_id % 13 = 0 THEN ''
              ELSE 'User ' || user_id || ' <user' || user_id || '@mail' || (user_id % 7) || '.example.com>'
         END AS from_value,
         CASE WHEN event_id % 10 <> 0 THEN '<e' || event_id || '@example.com>' END AS message_id
  FROM events),
doc_senders AS (
  SELECT *, CASE WHEN contains(from_value, '<') THEN split_part(split_part(from_value, '<', 2), '>', 1)
                 ELSE from_value END AS sender
  FROM docs)
"""

_HISTORY = _BASE + """,
hist_seen AS (
  SELECT mail_id, CAST(NULL AS VARCHAR) AS rfc_message_id FROM scan
  UNION ALL SELECT mail_id, rfc FROM import),
hist_senders AS (
  SELECT address AS sender,
         CASE WHEN address LIKE '%mail3.example.com' THEN 5 ELSE count(*) END AS mails_sent
  FROM (SELECT address FROM scan UNION ALL SELECT address FROM import) GROUP BY address),
repaired AS (
  SELECT mail_id, coalesce(rfc, '') AS rfc_message_id, address AS sender,
         rfc IS NOT NULL AND rfc IN (SELECT rfc FROM import) AS duplicate
  FROM scan)
"""

_RANKED = """
raw AS (
  SELECT CASE c_custkey % 50 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CAST(c_custkey % 1000 AS VARCHAR)
         ELSE 'C' || (c_custkey // 2) || '@' || lower(c_mktsegment) || '.example' END AS sender,
         CASE WHEN c_custkey % 89 = 0 THEN 0 ELSE c_custkey % 97 END AS mails_sent,
         c_custkey % 89 = 0 AS junk
  FROM customer),
ranked AS (SELECT coalesce(sender, '') AS sender, CAST(sum(mails_sent) AS BIGINT) AS mails_sent FROM raw GROUP BY 1)
"""

_MBOX = """
msgs AS (
  SELECT doc_id, 'd' || (doc_id % 900) || '@example.com' AS rfc, doc_id % 9 = 4 AS idless,
         doc_id % 17 = 3 AS broken, source || '@' || lang || '.example.com' AS sender,
         'From ' || source || '@example.com Thu Jan  1 00:00:00 2020' || chr(10) ||
         'From: ' || lang || ' desk <' || source || '@' || lang || '.example.com>' || chr(10) ||
         CASE WHEN doc_id % 9 = 4 THEN '' ELSE 'Message-ID: <d' || (doc_id % 900) || '@example.com>' || chr(10) END ||
         CASE WHEN doc_id % 17 = 3 THEN 'broken header line' || chr(10) ELSE '' END || chr(10) ||
         regexp_replace(text, '(?m)^(>*From )', '>\\1', 'g') || chr(10) AS value
  FROM documents)
"""

_TURNS = """
turns AS (
  SELECT conv_id, turn, role || '.' || conv_id || '@mail.example.com' AS address, role,
         conv_id % 10 = 7 AND turn = 1 AS bad, conv_id % 3 = 0 AND turn = 0 AS junk,
         CASE WHEN conv_id % 5 = 1 THEN repeat('y', 9000) ELSE '' END AS pad,
         CASE WHEN conv_id % 9 <> 0 THEN '<' || conv_id || '.' || turn || pad || '@example.com>' END AS message_id
  FROM conversations)
"""

_RUNS = """
base_runs AS (
  SELECT o_orderkey AS run_id,
         CASE o_orderkey % 3 WHEN 0 THEN 'gmail_api' WHEN 1 THEN 'mbox' ELSE 'backfill' END AS source,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'cancelled'
           WHEN '3-MEDIUM' THEN 'done' WHEN '4-NOT SPECIFIED' THEN 'abandoned'
           ELSE CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'awaiting_auth' ELSE 'starting' END END AS state,
         CAST(o_custkey % 50 AS BIGINT) AS pid,
         CAST(epoch(o_orderdate) AS BIGINT) AS started_at_unix,
         CAST(epoch(o_orderdate) AS BIGINT) + o_custkey % 400000 AS updated_at_unix,
         o_custkey AS messages_seen, o_custkey // 2 AS messages_new,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + o_orderkey % 1000 END AS total_estimate,
         CAST(floor(o_totalprice) AS BIGINT) AS price
  FROM orders),
runs AS (
  SELECT run_id, source, state, pid, started_at_unix, updated_at_unix,
         CASE WHEN state IN ('done', 'failed', 'cancelled', 'abandoned') THEN updated_at_unix END AS finished_at_unix,
         messages_seen, messages_new, total_estimate,
         CASE WHEN source = 'mbox' THEN price END AS bytes_total,
         CASE WHEN source = 'mbox' THEN price * (run_id % 12) // 10 END AS bytes_done,
         CASE WHEN source = 'mbox' AND run_id % 5 <> 0 THEN '/mail/' || run_id || '.mbox' END AS mbox_path,
         CASE WHEN state = 'failed' THEN ['policy_enforced', 'missing_credentials', 'auth_required', 'io', 'db',
              'rate_limited', 'gmail_api', 'other'][run_id % 8 + 1] END AS error_kind,
         CASE WHEN state = 'failed' THEN 'run ' || run_id || ' failed' END AS error,
         CASE WHEN state = 'awaiting_auth' THEN 'https://accounts.google.com/o?run=' || run_id END AS auth_url
  FROM base_runs)
"""

_SAMPLES = """
samples AS (
  SELECT user_id AS run_id, epoch_us(ts) // 3600 AS t, max(event_id) AS m,
         max(CASE WHEN event_id % 17 <> 0 THEN event_id * 4096 END) AS b,
         CASE WHEN user_id % 2 = 0 THEN 1000000000 END AS total_b,
         CASE WHEN user_id % 5 <> 0 THEN 150000 END AS total_m
  FROM events GROUP BY user_id, epoch_us(ts) // 3600),
starts AS (
  SELECT s.run_id, s.t, coalesce(
           min(CASE WHEN p.t >= s.t - 30000000 THEN p.t END), max(p.t)) AS from_t
  FROM samples s LEFT JOIN samples p ON p.run_id = s.run_id AND p.t < s.t GROUP BY ALL),
rates AS (
  SELECT s.*, CASE WHEN s.t - f.t >= 500000 THEN greatest(s.m - f.m, 0) / ((s.t - f.t) / 1e6) END AS mps,
         CASE WHEN s.t - f.t >= 500000 AND s.b IS NOT NULL AND f.b IS NOT NULL
              THEN greatest(s.b - f.b, 0) / ((s.t - f.t) / 1e6) END AS bps
  FROM samples s JOIN starts USING (run_id, t) LEFT JOIN samples f ON f.run_id = s.run_id AND f.t = from_t)
"""

_POLLS = """
poll_ids AS (
  SELECT 'v' || (user_id % 3) AS viewer, epoch_us(ts) // 100 AS t, max(event_id) AS e
  FROM events GROUP BY 1, 2),
polls AS (
  SELECT viewer, t, e, CASE WHEN e % 13 <> 0 THEN e // 40 END AS run_id,
         coalesce(CASE WHEN e % 9 < 6 THEN (e // 50) || ':' || CASE WHEN e % 20 < 10 THEN 'running' ELSE 'awaiting_auth' END END, '-')
         || '|' || coalesce(CASE WHEN e >= 50 THEN (e // 50 - 1) || ':done' END, '-') AS runs_key,
         row_number() OVER (PARTITION BY viewer ORDER BY t) AS i
  FROM poll_ids)
"""


def _rounded(x: str) -> str:
    """Half-up to a whole number, as text."""
    return f"CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)"


def _duration(s: str) -> str:
    m = f"CAST(floor({s} / 60.0 + 0.5) AS BIGINT)"
    return (
        f"CASE WHEN {s} < 90 THEN greatest({s}, 0) || 's' WHEN {m} < 90 THEN {m} || ' min' "
        f"ELSE ({m} // 60) || ' h ' || ({m} % 60) || ' min' END"
    )


def _ago(d: str) -> str:
    return (
        f"CASE WHEN {d} < 60 THEN 'just now' WHEN {d} < 3600 THEN {_rounded(f'{d} / 60.0')} || ' min ago' "
        f"WHEN {d} < 172800 THEN {_rounded(f'{d} / 3600.0')} || ' h ago' "
        f"ELSE {_rounded(f'{d} / 86400.0')} || ' d ago' END"
    )


def _trim(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def _normalized(raw: str) -> str:
    t = _trim(raw)
    return (
        f"nullif({_trim(f"CASE WHEN {t} LIKE '<%>' THEN substr({t}, 2, length({t}) - 2) ELSE {t} END")}, '')"
    )


_RAW_IDS = """
raw_ids AS (
  SELECT event_id AS seq, CASE event_id % 10
    WHEN 0 THEN '<e' || event_id || '@example.com>' WHEN 1 THEN 'e' || event_id || '@example.com'
    WHEN 2 THEN '  <e' || event_id || '@example.com>' || chr(9) WHEN 3 THEN '<>' WHEN 4 THEN '<'
    WHEN 5 THEN '< e' || event_id || ' >' WHEN 6 THEN '' WHEN 7 THEN chr(160) || '<E' || event_id || '>' || chr(12288)
    WHEN 8 THEN '<e' || event_id END AS raw
  FROM events)
"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources
    sql["scan_sender_counts"] = f"WITH {_DOCS} SELECT sender, count(*) AS n FROM doc_senders GROUP BY 1"
    sql["scan_refetched"] = f"""
        WITH {_DOCS} SELECT CASE WHEN event_id % 4 <> 3 THEN sender ELSE 'late' || (event_id % 5) || '@example.net' END AS sender,
               count(*) AS n FROM doc_senders GROUP BY 1"""
    sql["metadata_fetch"] = """
        SELECT 'g' || event_id AS mail_id,
               CAST(2 + (event_id % 11 <> 0)::INT + (event_id % 10 <> 0)::INT AS BIGINT) AS kept_headers FROM events"""
    sql["mbox_scan"] = f"""
        WITH {_MBOX} SELECT CASE WHEN NOT idless THEN '<' || rfc || '>' END AS message_id, sender,
               strlen(value) AS bytes FROM msgs WHERE NOT broken"""
    sql["mbox_sniff"] = f"""
        WITH {_MBOX} SELECT CASE WHEN NOT idless THEN '<' || rfc || '>' END AS message_id,
               CASE WHEN broken THEN 'malformed' ELSE 'message' END AS status, count(*) AS n FROM msgs GROUP BY 1, 2"""
    sql["mbox_import_summary"] = f"""
        WITH {_MBOX} SELECT count(*) FILTER (NOT broken) AS messages_seen,
               count(*) FILTER (broken OR idless) AS skipped FROM msgs"""
    sql["mbox_fingerprint"] = f"""
        WITH {_MBOX}, placed AS (
          SELECT doc_id // 500 AS bundle, value,
                 coalesce(sum(strlen(value)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
                 lead(doc_id) OVER w IS NULL AS last
          FROM msgs WINDOW w AS (PARTITION BY doc_id // 500 ORDER BY doc_id)),
        records AS (
          SELECT bundle, start, strlen(value) AS bytes,
                 substr(CASE WHEN last THEN value ELSE substr(value, 1, length(value) - 1) END,
                        CASE WHEN start = 0 THEN 1 ELSE 6 END) AS text FROM placed)
        SELECT CAST(sum(bytes) AS BIGINT) AS bytes,
               lower(to_hex(bit_xor(CAST('0x' || substr(md5(start || ':' || md5(text)), 1, 15) AS BIGINT)))) AS hash
        FROM records GROUP BY bundle"""
    counted_streams = f"""WITH {_BASE}, {_DOCS},
      scanned AS (SELECT * FROM doc_senders WHERE event_id % 4 <> 3),
      imported AS (SELECT * FROM import WHERE mail_id NOT IN (SELECT 'mid:' || message_id FROM scanned WHERE message_id IS NOT NULL))
    """
    running_sums = f"""{counted_streams}
      SELECT sender, count(*) AS mails_sent
      FROM (SELECT sender FROM scanned UNION ALL SELECT address FROM imported) GROUP BY sender"""
    sql["mbox_resume"] = sql["live_summary"] = running_sums
    sql["run_rows_after_ingest"] = f"""{counted_streams}
      SELECT 'gmail_api' AS source, 1::BIGINT AS runs, 'done' AS states, (SELECT count(*) FROM scanned) AS messages_seen,
             (SELECT count(*) FROM scanned) AS messages_new, NULL::BOOLEAN AS all_bytes
      UNION ALL
      SELECT 'mbox', 2, 'cancelled,done', (SELECT count(*) FROM import_all), (SELECT count(*) FROM imported), true"""
    sql["mbox_refused"] = f"""WITH {_BASE}
      SELECT 'messages' AS reason, count(*) AS n FROM import
      UNION ALL SELECT 'no separator', least(1, count(*)) FROM benchmark
      UNION ALL SELECT 'compressed', least(1, count(*)) FROM benchmark"""
    sql["stream_ingest"] = f"""
        WITH {_BASE}, {_DOCS},
        counted AS (
          SELECT sender FROM doc_senders WHERE event_id % 4 <> 3
          UNION ALL SELECT address FROM import
          WHERE '<' || rfc || '>' NOT IN (SELECT message_id FROM docs WHERE event_id % 4 <> 3 AND message_id IS NOT NULL))
        SELECT sender, count(*) AS mails_sent FROM counted GROUP BY 1"""

    # expressions
    sql["header_lookup"] = f"""
        WITH {_DOCS} SELECT mail_id, from_value, '<bounce' || user_id || '@example.net>' AS return_path, message_id FROM docs"""
    sql["sender_priority"] = f"WITH {_DOCS} SELECT mail_id, sender FROM doc_senders"
    sql["clean_sender"] = rf"""
        WITH shaped AS (
          SELECT 'event' AS src, event_id AS id, CASE event_id % 12
            WHEN 0 THEN 'User ' || user_id || ' <user' || user_id || '@mail' || (user_id % 7) || '.example.com>'
            WHEN 1 THEN 'user' || user_id || '@mail' || (user_id % 7) || '.example.com'
            WHEN 2 THEN '<deals-' || user_id || '@shop.example>' WHEN 3 THEN 'user' || user_id || '@example.museum'
            WHEN 4 THEN 'Jane <a+' || user_id || '@x.com>' WHEN 5 THEN 'Foo ann' || user_id || '@x.com <a+b@y.com>'
            WHEN 6 THEN 'not an email ' || user_id WHEN 7 THEN 'Box Office <counter ' || user_id || '>'
            WHEN 8 THEN '' WHEN 9 THEN 'Second.Third-' || user_id || '@post-room.example.org'
            WHEN 10 THEN 'Üser <üser' || user_id || '@exämple.org>'
            ELSE '<a' || user_id || '@b.c.d.example.com.x> tail' || chr(10) || 'second line' END AS header
          FROM events
          UNION ALL SELECT 'document', doc_id, text FROM documents),
        cleaned AS (
          SELECT *, coalesce(nullif(CASE WHEN contains(header, '<')
              THEN regexp_extract(header, '^[^<]*<?({_ADDRESS})[^\n]*$', 1)
              ELSE regexp_extract(header, '^({_ADDRESS})$', 1) END, ''), header) AS sender
          FROM shaped)
        SELECT src, id, md5(sender) AS sender_md5, sender <> header AS changed FROM cleaned"""
    sql["normalize_message_id"] = f"WITH {_RAW_IDS} SELECT seq, {_normalized('raw')} AS rfc_message_id FROM raw_ids"
    sql["mbox_headers"] = f"""
        WITH {_TURNS} SELECT conv_id, turn, message_id,
               CASE turn % 4 WHEN 0 THEN '"' || role || pad || '" <' || address || '>'
                 WHEN 1 THEN role || ' of ' || conv_id || ' <' || address || '>' WHEN 3 THEN address END AS from_,
               CASE turn % 4 WHEN 2 THEN '<bounce.' || conv_id || '@example.net>' END AS return_path
        FROM turns WHERE NOT bad"""
    sql["mbox_skipped"] = f"""
        WITH {_TURNS} SELECT count(*) FILTER (NOT bad AND NOT junk) AS messages_seen,
               count(*) FILTER (junk OR bad OR message_id IS NULL) AS skipped FROM turns"""
    sql["mbox_lossy"] = """
        WITH marked AS (SELECT *, repeat(chr(65533), [1, 1, 1, 2, 3, 0][conv_id % 6 + 1]::BIGINT) AS lost FROM conversations)
        SELECT conv_id, turn, false AS bad, '<' || conv_id || lost || '>' AS message_id,
               'é' || role || lost || ' <a' || turn || '@example.com>' AS from_ FROM marked"""
    sql["populate_mid_rows"] = f"""
        WITH {_RAW_IDS}, stored AS (
          SELECT CASE seq % 4 WHEN 0 THEN 'g' || seq WHEN 1 THEN 'MID:' || coalesce(raw, '')
                 ELSE 'mid:' || coalesce(raw, '') END AS mail_id,
                 CASE WHEN seq % 3 = 0 THEN 'kept' || seq END AS known, seq, raw FROM raw_ids)
        SELECT mail_id, CASE WHEN known IS NOT NULL OR seq % 4 = 0 THEN known
               ELSE coalesce({_normalized('raw')}, '') END AS rfc_message_id FROM stored"""
    sql["error_triage"] = """
        WITH t AS (
          SELECT *, event_id % 16 IN (0, 1, 3, 4, 5, 6, 14)
                 OR (event_id % 16 IN (10, 11, 12) AND event_id % 32 < 16)
                 OR (event_id % 16 = 15 AND (event_id % 3 = 0 OR event_id % 32 < 16)) AS transient FROM events)
        SELECT event_id, transient,
               CASE WHEN event_id % 19 = 0 THEN 'policy_enforced'
                    WHEN event_id % 7 IN (4, 5) THEN CASE WHEN transient THEN 'rate_limited' ELSE 'gmail_api' END
                    ELSE ['auth_required', 'missing_credentials', 'io', 'db', '', '', 'other'][event_id % 7 + 1]
               END AS error_kind FROM t"""
    sql["consent_links"] = "SELECT page_id, page_id % 5 = 1 AS linked FROM pages"

    # dedupe, counters, repair
    sql["fetch_worklist"] = f"WITH {_BASE} SELECT DISTINCT mail_id FROM replay WHERE seq % 3 <> 0"
    sql["dedupe_seen"] = f"""
        WITH {_RAW_IDS}, k AS (SELECT min(seq) AS seq FROM raw_ids GROUP BY seq % 700)
        SELECT 'k' || (seq % 700) AS mail_id, seq, raw FROM raw_ids JOIN k USING (seq)"""
    sql["ingest_scan_new"] = f"""
        WITH {_BASE} SELECT seq, mail_id, rfc AS rfc_message_id, address AS sender, TRUE AS counted FROM scan"""
    sql["ingest_import_new"] = f"""
        WITH {_BASE} SELECT i.seq, i.mail_id, i.rfc AS rfc_message_id, i.address AS sender,
               s.rfc IS NULL AS counted FROM import i LEFT JOIN scan s ON s.rfc = i.rfc"""
    sql["import_summary"] = f"""
        WITH {_BASE} SELECT count(*) AS messages_seen,
               count(*) FILTER (rfc IS NOT NULL AND seq % 4 = 3) AS messages_new,
               count(*) FILTER (rfc IS NULL) AS skipped FROM import_all"""
    sql["senders_after_both"] = f"WITH {_AFTER_BOTH} SELECT * FROM after_both"
    sql["run_counters"] = f"""
        WITH {_AFTER_BOTH} SELECT CAST(1 AS BIGINT) AS run_id, (SELECT count(*) FROM replay) AS messages_seen,
               (SELECT count(*) FROM scan) AS messages_new
        UNION ALL SELECT 2, (SELECT count(*) FROM import_all),
               (SELECT count(*) FROM counted) - (SELECT count(*) FROM scan)"""
    sql["backfill_batches"] = f"""
        WITH {_HISTORY}, pending AS (SELECT mail_id FROM hist_seen WHERE rfc_message_id IS NULL)
        SELECT mail_id, (row_number() OVER (ORDER BY mail_id) - 1) // 500 AS batch_no FROM pending"""
    sql["backfill_rows"] = f"WITH {_HISTORY} SELECT * FROM repaired"
    sql["backfill_outcome"] = f"""
        WITH {_HISTORY}, again AS (SELECT count(*) AS n FROM scan WHERE seq % 7 = 0)
        SELECT count(*) + any_value(n) AS examined, count(*) FILTER (rfc_message_id <> '') AS populated,
               count(*) FILTER (rfc_message_id = '') AS missing_id,
               count(*) FILTER (duplicate) AS decremented, any_value(n) AS already_done FROM repaired, again"""
    sql["senders_after_backfill"] = f"""
        WITH {_HISTORY}, taken AS (SELECT sender, count(*) AS n FROM repaired WHERE duplicate GROUP BY 1)
        SELECT sender, greatest(mails_sent - coalesce(n, 0), 0) AS mails_sent
        FROM hist_senders LEFT JOIN taken USING (sender)"""
    sql["seen_after_backfill"] = f"""
        WITH {_HISTORY} SELECT mail_id, rfc_message_id FROM repaired
        UNION ALL SELECT mail_id, rfc FROM import"""

    sql["stream_repair"] = sql["senders_after_backfill"]
    sql["stream_repair_seen"] = f"""
        WITH {_HISTORY} SELECT mail_id, coalesce(rfc_message_id, '') AS rfc_message_id FROM repaired
        UNION ALL SELECT mail_id, rfc FROM import"""
    sql["run_estimates"] = f"""
        WITH {_BASE}, fetched AS (SELECT * FROM scan UNION ALL SELECT * FROM scan WHERE seq % 7 = 0)
        SELECT 1::BIGINT AS run_id, 'backfill' AS source, (SELECT count(*) FROM scan) AS total_estimate,
               (SELECT count(*) FROM fetched WHERE seq % 2 = 0) AS messages_seen
        UNION ALL SELECT 2, 'backfill', (SELECT count(*) FROM scan WHERE seq % 2 = 1), (SELECT count(*) FROM fetched)
        UNION ALL SELECT 3, 'gmail_api', (SELECT count(*) FROM scan), (SELECT count(*) FROM scan)
        UNION ALL SELECT 4, 'gmail_api', NULL, 0"""

    # summary
    sql["summary_read"] = f"""
        WITH {_RANKED} SELECT 'sender' AS kind, sender, mails_sent FROM ranked
        UNION ALL SELECT 'documents', '{NOW_UNIX}', CAST(sum(mails_sent) AS BIGINT) FROM ranked"""
    sql["mixed_sources"] = f"""
        WITH {_HISTORY}, rows AS (
          SELECT 'unrepaired' AS store, mail_id, rfc_message_id FROM hist_seen
          UNION ALL SELECT 'repaired', mail_id, rfc_message_id FROM repaired UNION ALL SELECT 'repaired', mail_id, rfc FROM import
          UNION ALL SELECT 'scanned', mail_id, NULL FROM scan),
        facts AS (
          SELECT s.store, count(*) FILTER (mail_id LIKE 'mid:%') AS imported, count(*) FILTER (mail_id LIKE 'g%') AS bare,
                 count(*) FILTER (mail_id LIKE 'g%' AND rfc_message_id IS NULL) AS n
          FROM (VALUES ('unrepaired'), ('repaired'), ('scanned'), ('empty')) s(store) LEFT JOIN rows USING (store) GROUP BY 1)
        SELECT store, imported > 0 AND bare > 0 AND n > 0 AS mixed_unrepaired,
               CASE WHEN imported > 0 AND bare > 0 THEN n ELSE 0 END AS unrepaired_count FROM facts"""
    sql["readiness"] = f"""
        WITH {_HISTORY}, {_RUNS},
        open AS (SELECT count(*) AS n FROM runs WHERE state NOT IN ('done', 'failed', 'cancelled', 'abandoned')),
        stores AS (SELECT 'unrepaired' AS name, (SELECT count(*) FROM hist_seen) AS n UNION ALL SELECT 'empty', 0),
        times AS (SELECT 'busy' AS name, (SELECT n FROM open) AS open UNION ALL SELECT 'idle', 0 UNION ALL SELECT 'new', 0)
        SELECT s.name || ', ' || t.name AS store, CASE WHEN s.n > 0 THEN 'ready' ELSE 'empty' END AS db,
               s.n = 0 AND t.open = 0 AS onboard FROM stores s, times t"""
    sql["total_messages"] = f"""
        WITH {_BASE} SELECT count(DISTINCT mail_id) AS total_messages
        FROM (SELECT mail_id FROM replay UNION ALL SELECT mail_id FROM import)"""
    sql["summary_senders"] = f"WITH {_RANKED} SELECT * FROM ranked"
    sql["summary_visible"] = f"""
        WITH {_AFTER_BOTH}, {_HIDDEN} SELECT * FROM after_both WHERE sender NOT IN (SELECT sender FROM hidden)"""
    sql["summary_tiles"] = f"""
        WITH {_AFTER_BOTH}, {_HIDDEN},
        shown AS (SELECT * FROM after_both WHERE sender NOT IN (SELECT sender FROM hidden)),
        gone AS (SELECT coalesce(sum(mails_sent), 0) AS n FROM after_both WHERE sender IN (SELECT sender FROM hidden))
        SELECT CAST((SELECT count(*) FROM scan) + (SELECT count(*) FROM import) - (SELECT n FROM gone) AS BIGINT) AS total_messages,
               (SELECT count(*) FROM shown) AS distinct_senders,
               (SELECT sender FROM shown ORDER BY mails_sent DESC, sender LIMIT 1) AS top_sender"""
    sql["summary_document"] = f"""
        WITH {_BASE}, {_RANKED}
        SELECT 0 AS part, CAST(NULL AS VARCHAR) AS sender, CAST(NULL AS BIGINT) AS mails_sent,
               '{{"total_messages":' || count(*) || ',"generated_at_unix":{NOW_UNIX}}}' AS line
        FROM (SELECT mail_id FROM scan UNION SELECT mail_id FROM import)
        UNION ALL SELECT 1, sender, mails_sent,
               '{{"sender":"' || sender || '","mails_sent":' || mails_sent || '}}' FROM ranked"""
    sql["summary_written"] = f"SELECT line FROM ({sql['summary_document']})"
    sql["summary_quality"] = f"""
        WITH {_RANKED}, senders AS (
          SELECT coalesce(sender, '') AS sender, count(*) AS copies, sum(mails_sent) AS n FROM raw GROUP BY 1),
        spec AS (SELECT sum(c_custkey % 97) AS total, count(*) AS senders FROM customer)
        SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(copies) AS BIGINT) AS sender_rows,
               count(*) FILTER (copies > 1) AS duplicated_senders,
               count(*) FILTER (sender NOT LIKE '%@%.example') AS outside_reserved_domains,
               sum(n) = (SELECT total FROM spec) AS total_conserved, sum(n) >= 84000 AS total_large_enough,
               sum(copies) = (SELECT senders FROM spec) AS sender_count_ok
        FROM senders"""
    sql["category_budget"] = """
        SELECT c_mktsegment AS key, count(*) FILTER (c_acctbal <= 9000) AS tail_count,
               CAST(coalesce(sum(c_custkey) FILTER (c_acctbal <= 9000), 0) AS BIGINT) AS tail_budget
        FROM customer GROUP BY 1"""
    sql["spec_read"] = f"""
        {sql["category_budget"]}
        UNION ALL SELECT 'limits', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer"""
    sql["top_senders"] = f"WITH {_RANKED} SELECT * FROM ranked ORDER BY mails_sent DESC, sender LIMIT 20"
    sql["search_senders"] = f"WITH {_RANKED} SELECT * FROM ranked WHERE lower(sender) LIKE '%machinery.ex%'"
    page = """
        numbers AS (SELECT count(*) AS listed, greatest(1, ceil(count(*) / {size}.0))::BIGINT AS pages FROM shown),
        placed AS (SELECT *, (SELECT count(*) FROM shown o WHERE o.mails_sent > s.mails_sent
                     OR (o.mails_sent = s.mails_sent AND o.sender <= s.sender)) AS rank FROM shown s)
        SELECT least({page}, pages)::BIGINT AS page, pages, listed, {hidden}::BIGINT AS hidden, rank, sender, mails_sent
        FROM placed, numbers WHERE (rank - 1) // {size} + 1 = least({page}, pages)"""
    out_of_sight = "regexp_matches(sender, '^C[0-9]*[37]@')"
    sql["sender_page"] = f"""
        WITH {_RANKED}, shown AS (SELECT * FROM ranked WHERE NOT {out_of_sight} AND lower(sender) LIKE '%c1%'),
        {page.format(size=25, page=3, hidden=f"(SELECT count(*) FROM ranked WHERE {out_of_sight})")}"""
    stored = "SELECT '{name}' AS store, * FROM (WITH {ranked}, shown AS (SELECT * FROM ranked), {page})"
    sql["sender_page_stored"] = " UNION ALL ".join(
        stored.format(name=name, ranked=_RANKED, page=page.format(size=size, page=number, hidden=0))
        for name, size, number in (("later", 100, 7), ("last", 25, 1_000_000)))
    sql["sender_list"] = f"""
        WITH {_RANKED} SELECT 'on' AS store, * FROM ranked UNION ALL SELECT 'off', * FROM ranked WHERE NOT {out_of_sight}"""
    sql["sender_last_page"] = f"""
        WITH {_RANKED}, shown AS (SELECT * FROM ranked), {page.format(size=100, page=1000000, hidden=0)}"""

    # runs
    last = lambda value, when: f"arg_max({value}, event_id) FILTER ({when})"
    sql["run_latest_state"] = f"""
        SELECT user_id AS run_id,
          {last("['gmail_api', 'mbox', 'backfill'][event_id % 3 + 1]", "event_type = 'signup'")} AS source,
          {last('''CASE event_type WHEN 'signup' THEN 'running'
             WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'awaiting_auth' ELSE 'running' END
             ELSE CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'cancelled' END END''',
             "event_type IN ('signup', 'purchase', 'error')")} AS state,
          {last("event_id % 100", "event_type = 'signup'")} AS pid,
          {last("event_id + 1000", "event_type = 'signup'")} AS started_at_unix,
          max(event_id) + 1000 AS updated_at_unix,
          max(event_id + 1000) FILTER (event_type = 'error') AS finished_at_unix,
          coalesce(max(event_id) FILTER (event_type IN ('view', 'click')), 0) AS messages_seen,
          coalesce(max(event_id) FILTER (event_type IN ('view', 'click')) // 2, 0) AS messages_new,
          max(event_id * 2) FILTER (event_type = 'click' AND event_id % 3 = 0) AS total_estimate,
          max(event_id * 100) FILTER (event_type = 'signup' AND event_id % 2 = 0) AS bytes_total,
          max(event_id * 10) FILTER (event_type = 'view' AND event_id % 3 <> 0) AS bytes_done,
          CAST(NULL AS VARCHAR) AS mbox_path,
          CASE WHEN max(event_id) FILTER (event_type = 'error') % 3 = 1 THEN 'other' END AS error_kind,
          CASE WHEN max(event_id) FILTER (event_type = 'error') % 3 = 1
               THEN 'error ' || max(event_id) FILTER (event_type = 'error') END AS error,
          CASE WHEN max(event_id) FILTER (event_type = 'purchase') % 2 = 0
               THEN 'https://accounts.google.com/o?e=' || max(event_id) FILTER (event_type = 'purchase') END AS auth_url,
          'token-' || max(event_id) FILTER (event_type = 'view' AND event_id % 5 = 0) AS resume_token,
          CAST(NULL AS VARCHAR) AS mbox_fingerprint
        FROM events GROUP BY 1"""
    terminal = "state IN ('done', 'failed', 'cancelled', 'abandoned')"
    sql["run_active_last"] = f"""
        WITH {_RUNS} SELECT * FROM runs WHERE run_id = (SELECT max(run_id) FROM runs WHERE {terminal})
           OR run_id = (SELECT max(run_id) FROM runs WHERE NOT {terminal})"""
    sql["run_lookup"] = f"WITH {_RUNS} SELECT * FROM runs WHERE run_id = (SELECT max(o_orderkey) FROM orders)"
    sql["history_document"] = f"""
        WITH {_RUNS} SELECT CAST({NOW_UNIX} AS BIGINT) AS now_unix, run_id, source, state, messages_seen FROM runs
        ORDER BY run_id DESC LIMIT 7"""
    sql["run_history"] = f"WITH {_RUNS} SELECT run_id, state, source FROM runs ORDER BY run_id DESC LIMIT 100"
    sql["runs_public_projection"] = f"WITH {_RUNS} SELECT * FROM runs"
    sql["runs_abandoned"] = f"""
        WITH {_RUNS} SELECT run_id, CASE WHEN {terminal} THEN state ELSE 'abandoned' END AS state,
               coalesce(finished_at_unix, {NOW_UNIX}) AS finished_at_unix,
               CASE WHEN {terminal} THEN updated_at_unix ELSE {NOW_UNIX} END AS updated_at_unix FROM runs"""
    sql["process_newest_run"] = f"WITH {_RUNS} SELECT pid, max(run_id) AS run_id FROM runs WHERE run_id > 1000 GROUP BY 1"
    sql["run_progress_fraction"] = f"""
        WITH {_RUNS} SELECT run_id,
               round(CASE WHEN bytes_total > 0 THEN least(1.0, bytes_done / bytes_total::DOUBLE)
                          WHEN total_estimate > 0 THEN least(1.0, messages_seen / total_estimate::DOUBLE) END, 6) AS fraction,
               CASE WHEN bytes_done IS NULL THEN NULL WHEN bytes_total > 0
                    THEN least(bytes_done, bytes_total) * 100 // bytes_total ELSE 100 END AS percent
        FROM runs"""
    sql["run_display"] = f"""
        WITH {_RUNS} SELECT run_id,
               CASE source WHEN 'mbox' THEN 'Takeout import' WHEN 'gmail_api' THEN 'Gmail scan'
                    ELSE 'Message-ID backfill' END AS source_label,
               CASE state WHEN 'awaiting_auth' THEN 'awaiting authorization' ELSE state END AS state_label,
               {_duration('(updated_at_unix - started_at_unix)')} AS took, {_duration('messages_seen')} AS short_took,
               {_ago(f'({NOW_UNIX} - updated_at_unix)')} AS ago,
               {_ago('(updated_at_unix - started_at_unix)')} AS started_before,
               run_id % 40 > 15 AS stalled FROM runs"""
    sql["run_actions"] = f"""
        WITH {_RUNS} SELECT run_id, CASE WHEN state NOT IN ('failed', 'cancelled', 'abandoned') THEN '' ELSE
               concat_ws('|',
                 CASE WHEN source = 'mbox' AND mbox_path IS NOT NULL
                      THEN CASE WHEN bytes_done > 0 THEN 'Resume import' ELSE 'Retry' END END,
                 CASE WHEN source = 'gmail_api' AND state <> 'cancelled' THEN 'Retry' END,
                 CASE WHEN source = 'gmail_api' AND messages_seen > 0 THEN 'Resume — may restart from the beginning'
                      WHEN source = 'gmail_api' AND state = 'cancelled' THEN 'Start again' END,
                 CASE WHEN error_kind = 'policy_enforced' THEN 'Use Takeout instead →' END) END AS actions FROM runs"""
    sql["run_rate"] = f"""
        WITH {_SAMPLES} SELECT run_id, t AS t_us, round(mps, 4) AS messages_per_sec, round(bps, 3) AS bytes_per_sec FROM rates"""
    sql["run_eta"] = f"""
        WITH {_SAMPLES} SELECT run_id, t AS t_us, CAST(CASE
               WHEN bps > 0 AND total_b IS NOT NULL THEN ceil(greatest(total_b - b, 0) / bps)
               WHEN mps > 0 AND total_m IS NOT NULL THEN ceil(greatest(total_m - m, 0) / mps) END AS BIGINT) AS eta_s FROM rates"""
    sql["observed_rate"] = f"""
        WITH {_POLLS},
        -- Polls between two changes of the run share a window.
        islands AS (SELECT viewer, t, i, run_id, e, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY viewer ORDER BY i) AS island
                    FROM (SELECT *, i > 1 AND run_id IS NOT DISTINCT FROM lag(run_id) OVER (PARTITION BY viewer ORDER BY i) AS same FROM polls)),
        starts AS (SELECT b.viewer, b.i, coalesce(min(CASE WHEN q.t >= b.t - 30000000 THEN q.t END), max(q.t)) AS from_t
                   FROM islands b LEFT JOIN islands q ON q.viewer = b.viewer AND q.island = b.island AND q.i < b.i
                   WHERE b.run_id IS NOT NULL GROUP BY b.viewer, b.i)
        SELECT p.viewer, p.t AS t_us, p.run_id,
               round(CASE WHEN p.t - f.t >= 500000 THEN greatest(p.e - f.e, 0) / ((p.t - f.t) / 1e6) END, 4) AS messages_per_sec
        FROM polls p JOIN starts s USING (viewer, i) LEFT JOIN polls f ON f.viewer = p.viewer AND f.t = s.from_t"""
    sql["history_refreshes"] = f"""
        WITH {_POLLS} SELECT p.viewer, p.t AS t_us, p.runs_key FROM polls p
        LEFT JOIN polls b ON b.viewer = p.viewer AND b.i = p.i - 1 WHERE p.runs_key IS DISTINCT FROM b.runs_key"""
    sql["status_document"] = f"""
        WITH {_BASE}, {_SAMPLES}, latest AS ({sql["run_latest_state"]}),
        active AS (SELECT * FROM latest WHERE NOT {terminal} ORDER BY run_id DESC LIMIT 1),
        pace AS (SELECT a.*, r.mps, r.bps FROM active a LEFT JOIN rates r ON r.run_id = a.run_id
                 AND r.t = (SELECT max(t) FROM rates WHERE run_id = a.run_id))
        SELECT 'ready' AS db, CAST({NOW_UNIX} AS BIGINT) AS now_unix, count(*) > 0 AS mixed_unrepaired,
               count(*) AS unrepaired_count, (SELECT run_id FROM active) AS active_run,
               (SELECT max(run_id) FROM latest WHERE {terminal}) AS last_run,
               (SELECT round(mps, 1) FROM pace) AS rate_per_sec,
               (SELECT CAST(CASE WHEN bps > 0 AND bytes_total IS NOT NULL AND bytes_done IS NOT NULL
                                 THEN ceil(greatest(bytes_total - bytes_done, 0) / bps)
                                 WHEN mps > 0 AND total_estimate IS NOT NULL
                                 THEN ceil(greatest(total_estimate - messages_seen, 0) / mps) END AS BIGINT) FROM pace) AS eta_seconds
        FROM scan"""
    sql["retry_schedule"] = """
        WITH a AS (SELECT event_id // 1000 AS run_id, event_id % 1000 + 1 AS attempt_no, event_type FROM events),
        l AS (SELECT a.run_id, a.attempt_no, a.event_type, max(p.attempt_no) AS last_progress
              FROM a LEFT JOIN a p ON p.run_id = a.run_id AND p.attempt_no <= a.attempt_no AND p.event_type = 'view'
              GROUP BY a.run_id, a.attempt_no, a.event_type),
        r AS (SELECT *, attempt_no - coalesce(last_progress, 1) + 1 AS retries FROM l)
        SELECT run_id, attempt_no, retries, CAST(power(2, least(retries - 1, 5)) AS BIGINT) AS wait_s,
               event_type = 'error' OR retries > 3 AS gives_up FROM r"""
    kept = """
        lines AS (SELECT doc_id % 3 AS run_id, doc_id AS line_no, text AS line,
                         row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id DESC) AS rn FROM documents)"""
    sql["run_log"] = f"""
        WITH {kept} SELECT run_id, line_no, CAST(strlen(line) AS BIGINT) AS bytes, md5(line) AS line_md5 FROM lines WHERE rn <= 200"""
    sql["run_log_tail"] = f"""
        WITH {kept} SELECT run_id, md5(string_agg(line, ' | ' ORDER BY line_no)) AS tail_md5 FROM lines WHERE rn <= 5 GROUP BY 1"""
    return sql
