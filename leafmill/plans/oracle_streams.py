"""SQL twins of the streaming queries."""

from __future__ import annotations

from .oracle import BOOK_PAGES, V_USAGE
from .oracle_records import RECORDS_SQL

BOUNDS = "tag_id, sequence, start_position::INT AS start_position, start_offset::INT AS start_offset, end_position::INT AS end_position, end_offset::INT AS end_offset, next_position::INT AS next_position, next_offset::INT AS next_offset, boundary_kind"

FEEDS = """
    f AS (SELECT user_id::VARCHAR AS feed, ts, event_type = 'signup' AS is_start, ts + CASE WHEN event_type = 'signup' THEN INTERVAL 21600 SECONDS ELSE INTERVAL 86400 SECONDS END AS until FROM events),
    g AS (SELECT *, max(until) OVER (PARTITION BY feed ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY feed ORDER BY ts, event_id) AS rn FROM (SELECT f.*, 0 AS event_id FROM f)),
    h AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY rn) AS session FROM g),
    s AS (SELECT feed, max(ts) AS since, max(until) AS reported_at, count(*) FILTER (NOT is_start) AS n_frames, CASE WHEN count(*) FILTER (NOT is_start) = 0 THEN 'no frames' ELSE 'stalled' END AS reason FROM h GROUP BY feed, session)"""

STREAM_SQL: dict[str, str] = {
    "stream_sections_resumed": f"WITH RECURSIVE {BOOK_PAGES}, m AS (SELECT *, max(sequence) OVER (PARTITION BY tag_id) AS last FROM bounds) SELECT {BOUNDS} FROM m WHERE sequence > last // 2",
    "stream_book_deleted": f"WITH RECURSIVE {BOOK_PAGES}, n AS (SELECT tag_id, count(*) AS n FROM facts2 GROUP BY tag_id) SELECT {BOUNDS} FROM bounds UNION ALL SELECT {BOUNDS} FROM bounds JOIN n USING (tag_id) WHERE end_position < n // 2",
    "silent_feeds": f"WITH {FEEDS} SELECT * FROM s",
    "stream_silent_feeds": f"WITH {FEEDS} SELECT * FROM s WHERE reported_at <= (SELECT max(ts) FROM events)",
    "stream_closed_days": f"""WITH {V_USAGE},
        u AS (SELECT *, CASE WHEN page_key = '42' THEN ts + INTERVAL 3 DAYS ELSE ts END AS seen, (ts - INTERVAL 4 HOURS)::DATE AS period_key FROM v_usage WHERE kind IS NOT NULL),
        o AS (SELECT *, seen >= period_key + INTERVAL 28 HOURS AS late, period_key + INTERVAL 28 HOURS <= (SELECT max(seen) FROM u) AS over FROM u),
        c AS (SELECT period_key, tag_id, count(DISTINCT CASE WHEN kind = 'scan' AND trim(page_key) <> '' THEN page_key END) AS pages_scanned, round(coalesce(sum(seconds) FILTER (kind = 'audio' AND seconds > 0), 0), 3) AS audio_seconds,
            count(*) FILTER (kind = 'chapter_summary') AS chapter_summary_uses, count(*) FILTER (kind = 'book_summary') AS book_summary_uses FROM o WHERE NOT late AND over GROUP BY ALL),
        d AS (SELECT * FROM c WHERE pages_scanned + audio_seconds + chapter_summary_uses + book_summary_uses > 0),
        e AS (SELECT unnest(generate_series(min(period_key)::TIMESTAMP, max(period_key)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS period_key FROM d)
        SELECT 'closed' AS status, * FROM d UNION ALL SELECT 'empty', period_key, NULL, 0, 0.0, 0, 0 FROM e WHERE period_key NOT IN (SELECT period_key FROM d)
        UNION ALL SELECT 'late', period_key, tag_id, count(*), NULL, NULL, NULL FROM o WHERE late GROUP BY period_key, tag_id""",
    "stream_report_ingest": RECORDS_SQL["report_ingest"],
    "stream_report_redelivery": RECORDS_SQL["report_redelivery"],
    "stream_mail": "SELECT o_orderkey % 3 AS uid_validity, o_orderkey AS uid FROM orders UNION ALL SELECT o_orderkey % 3 + 3, o_orderkey FROM orders WHERE o_orderkey % 8 = 0",
    "stream_batch_status": """WITH n AS (SELECT count(*) AS orders, count(*) FILTER (o_orderkey % 4 = 0) AS again, count(*) FILTER (o_orderkey % 8 = 0) AS reset FROM orders)
        SELECT 'callback' AS source, 'done' AS status, orders + reset AS n_rows FROM n UNION ALL SELECT 'listener', 'progress', orders + again + reset FROM n UNION ALL SELECT 'listener', 'started', NULL FROM n UNION ALL SELECT 'listener', 'ended', NULL FROM n""",
}
