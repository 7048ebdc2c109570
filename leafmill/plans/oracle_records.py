"""SQL twins of the queries in records.py. They share no code with the queries."""

from __future__ import annotations

from .oracle import END, V_LINES, V_PAGES, V_TURNS, V_USAGE, artifact, fragment, has, norm, norm_ends, words
from .oracle_text import MARKERS, german

SUMMARIES = "s AS (SELECT conv_id::VARCHAR AS tag_id, turn, printf('chapter_%04d', turn + 1) AS chapter_id, text FROM conversations WHERE role <> 'system')"
PAGE_ID = "CASE WHEN page_number IS NOT NULL THEN printf('page_%04d', page_number) ELSE report_page_id END"
RANGE = """CASE WHEN en THEN CASE WHEN {a} = {b} THEN 'page ' || {a} ELSE 'pages ' || {a} || '-' || {b} END ELSE CASE WHEN {a} = {b} THEN 'Seite ' || {a} ELSE 'Seiten ' || {a} || '-' || {b} END END"""


def asked(kind: str, german_words: str, english_words: str) -> str:
    return f"CASE WHEN en THEN printf('{english_words}', label, pages, n_words, text) ELSE printf('{german_words}', label, pages, n_words, text) END AS {kind}"


RECORDS_SQL: dict[str, str] = {
    "library_pages": f"""WITH {V_TURNS}, p AS (SELECT *, {PAGE_ID} AS page_id FROM v_turns)
        SELECT tag_id, scan_id, side, page_id, page_number::INT AS page_number, clean_text, (row_number() OVER (PARTITION BY tag_id ORDER BY page_number NULLS LAST, page_id, scan_id, side) - 1)::INT AS position FROM p""",
    "library_chapters": f"""WITH {SUMMARIES}, c AS (SELECT tag_id, chapter_id, CASE WHEN (turn + 1) % 3 <> 0 THEN 19 - turn END AS start_page FROM s)
        SELECT tag_id, chapter_id, start_page::INT AS start_page, (row_number() OVER (PARTITION BY tag_id ORDER BY start_page NULLS LAST, chapter_id) - 1)::INT AS position FROM c""",
    "page_lookup": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'page_' || o_orderkey ELSE printf('%04d', o_orderkey % 12000) END AS stored_key FROM orders",
    "book_aliases": """WITH k AS (SELECT DISTINCT 'N' || s_nationkey AS tag_id, 'U' || (s_suppkey % 40) AS alias FROM supplier), b AS (SELECT DISTINCT tag_id FROM k), w AS (SELECT DISTINCT tag_id FROM k WHERE alias IN ('U7', 'U11')),
        m AS (SELECT * FROM k UNION SELECT tag_id, 'U7' FROM b UNION SELECT tag_id, 'X' || tag_id FROM b) SELECT tag_id, alias, tag_id IN (SELECT tag_id FROM w) AS wanted FROM m""",
    "report_lines": f"""WITH {V_LINES}, p AS (SELECT tag_id, scan_id, side, page_number, count(*) AS n, arg_min({norm("text")}, line_index) AS head FROM v_lines GROUP BY ALL)
        SELECT tag_id, scan_id, CASE WHEN page_number % 9 = 8 THEN 'middle' ELSE side END AS side, (CASE page_number % 9 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 8 THEN -1 ELSE n END)::INT AS n_lines,
            CASE page_number % 9 WHEN 0 THEN 'F' WHEN 1 THEN 'F' WHEN 2 THEN 'P' WHEN 3 THEN NULL WHEN 8 THEN NULL ELSE head END AS head FROM p""",
    "library_versions": f"""WITH {V_TURNS} SELECT tag_id, created_at AS key, CASE WHEN side = 'right' THEN 2 ELSE 1 END AS version, clean_text || CASE WHEN side = 'right' THEN ' (2)' ELSE '' END AS document FROM v_turns""",
    "recognised_by_name": """WITH l AS (SELECT doc_id::VARCHAR AS page_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, trim(unnest(string_split(text, chr(10)))) AS t FROM documents)
        SELECT page_id, i::INT AS line_index, length(t) AS n_chars, sha1(t) AS digest FROM l WHERE t <> ''""",
    "report_ingest": f"""WITH {MARKERS}, f AS (SELECT tag_id, true_number, arg_min({{'n': chapter_number, 'h': chapter_heading}}, line_index) AS x FROM markers GROUP BY ALL),
        t AS (SELECT tag_id, true_number, {norm_ends("string_agg(text, chr(10) ORDER BY i)")} AS clean_text FROM cl WHERE text <> '' GROUP BY ALL),
        p AS (SELECT c4.tag_id, c4.scan_id, c4.side, c4.true_number, coalesce(c4.num, CASE WHEN c4.inferred THEN CASE WHEN c4.side = 'left' THEN o - 1 ELSE o + 1 END END) AS page_number, CASE WHEN c4.side = 'left' THEN 'page_1' ELSE 'page_2' END AS report_page_id FROM c4),
        q AS (SELECT p.*, {PAGE_ID} AS page_id FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY tag_id, page_id ORDER BY scan_id DESC) AS v FROM q)
        SELECT r.tag_id, r.scan_id, r.side, r.page_id, r.page_number::INT AS page_number, f.x.n AS chapter_number, f.x.h AS chapter_heading, coalesce(t.clean_text, '') AS clean_text
        FROM r LEFT JOIN f ON f.tag_id = r.tag_id AND f.true_number = r.true_number LEFT JOIN t ON t.tag_id = r.tag_id AND t.true_number = r.true_number WHERE v = 1""",
    "report_redelivery": f"""WITH {V_PAGES}, n AS (SELECT tag_id, scan_id, count(*) AS n, bool_or(side = 'left') AS l FROM v_pages GROUP BY ALL)
        SELECT tag_id, scan_id, 1 AS delivery, 'left' AS side, TRUE AS read, n::INT AS n_stored FROM n WHERE l
        UNION ALL SELECT p.tag_id, p.scan_id, CASE WHEN n.l THEN 2 ELSE 1 END, p.side, p.side = 'right', n.n::INT FROM v_pages p JOIN n ON n.tag_id = p.tag_id AND n.scan_id = p.scan_id""",
    "run_report": f"""WITH {V_TURNS} SELECT tag_id, count(*)::INT AS n_pages, (count(*) FILTER (side = 'left'))::INT AS n_blocks, count(*)::INT AS n_chunks, sha256(string_agg(clean_text, chr(10) ORDER BY created_at, clean_text)) AS digest FROM v_turns GROUP BY tag_id""",
    "capture_report": f"""WITH {V_LINES}, l AS (SELECT tag_id, page_number, count(*) AS n, avg(confidence) AS c FROM v_lines WHERE page_number % 11 <> 0 GROUP BY ALL), p AS (SELECT p.*, 0.5::DOUBLE + p.page_number * 0.25::DOUBLE AS s FROM v_pages p)
        SELECT p.tag_id, p.scan_id, round(sum(s) OVER (PARTITION BY p.tag_id, p.scan_id), 6) AS total_seconds, CASE WHEN side = 'left' THEN 'page_1' ELSE 'page_2' END AS page_id, coalesce(l.n, 0) AS ocr_line_count, round(coalesce(l.c, 0.0), 9) AS avg_confidence
        FROM p LEFT JOIN l ON l.tag_id = p.tag_id AND l.page_number = p.page_number""",
    "enhancement_manifest": f"""WITH {V_TURNS}, d AS (SELECT DISTINCT tag_id, scan_id, side FROM v_turns) SELECT tag_id, scan_id, 'gray' AS ocr_input_mode, FALSE AS denoise_enabled, string_agg(tag_id || '/' || scan_id || '/' || side, ',' ORDER BY side) AS sources FROM d GROUP BY tag_id, scan_id""",
    "usage_archive": f"WITH {V_USAGE} SELECT period_key, tag_id, period_key = DATE '2024-01-10' AS archived FROM daily",
    "latest_scan": f"WITH {V_TURNS} SELECT tag_id, arg_max(scan_id, created_at) AS scan_id, max(created_at) AS created_at FROM v_turns GROUP BY tag_id",
    "book_deletion": f"""WITH {V_TURNS}, {SUMMARIES} SELECT tag_id, count(*) AS n, 'pages' AS what FROM v_turns WHERE tag_id <> '3' GROUP BY tag_id UNION ALL SELECT tag_id, count(*), 'chapters' FROM s WHERE tag_id <> '3' GROUP BY tag_id""",
    "cleanup_plan": f"WITH {V_TURNS}, d AS (SELECT DISTINCT tag_id, scan_id FROM v_turns) SELECT tag_id, scan_id, unnest(['raw', 'rectified', 'case', 'ocr', 'debug', 'ocr_output']) AS kind FROM d",
    "recognised_lines": f"""WITH {V_LINES} SELECT tag_id || '|' || page_number AS page_id, line_index::INT AS line_index, text, CASE page_number % 4 WHEN 0 THEN len({words("text")}) / 8.0::DOUBLE WHEN 1 THEN 0.25 WHEN 2 THEN 0.75 ELSE 0 END AS confidence, CASE WHEN page_number % 4 = 3 THEN 0 ELSE 4 END AS n_points FROM v_lines""",
    "line_order": f"""WITH {V_LINES}, w AS (SELECT tag_id, page_number, line_index, top, unnest(string_split(text, ' ')) AS t FROM v_lines), d AS (SELECT DISTINCT tag_id, page_number, line_index FROM w WHERE length(t) % 9 <> 8 AND t <> '')
        SELECT tag_id, page_number, (line_index // 4)::INT AS block_num, 1 AS par_num, line_index AS line_num, (row_number() OVER (PARTITION BY tag_id, page_number ORDER BY line_index) - 1)::INT AS position FROM d""",
    "image_pairs": """WITH p AS (SELECT c_custkey // 4 AS d, c_custkey % 4 AS i, c_custkey // 4 % 3 AS k FROM customer), q AS (SELECT *, CASE k WHEN 0 THEN ['links', 'rechts', 'a', 'b'] WHEN 1 THEN ['img_1', 'img_2', 'img_3', 'img_4'] ELSE ['left', 'x', 'seite_rechts', 'right'] END[i + 1] AS name FROM p),
        r AS (SELECT *, CASE WHEN name IN ('left', 'links') THEN 'left' WHEN name IN ('right', 'rechts') THEN 'right' WHEN name = 'seite_rechts' THEN 'right2' END AS s FROM q),
        g AS (SELECT d, bool_or(s = 'left') AND bool_or(s IN ('right', 'right2')) AS pair, bool_or(s = 'right') AS plain FROM r GROUP BY d), x AS (SELECT r.*, g.pair, g.plain, row_number() OVER (PARTITION BY r.d ORDER BY name) AS n FROM r JOIN g ON g.d = r.d)
        SELECT '/case/' || d AS directory, CASE WHEN pair THEN CASE WHEN s = 'left' THEN 'left' ELSE 'right' END WHEN n = 1 THEN 'left' ELSE 'right' END AS slot, '/case/' || d || '/' || name || '.png' AS path
        FROM x WHERE CASE WHEN pair THEN s = 'left' OR s = CASE WHEN plain THEN 'right' ELSE 'right2' END ELSE n <= 2 END""",
    "ini_values": "SELECT 'nation ' || n_nationkey AS section, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT 'nation ' || n_nationkey, 'key', n_nationkey || '=x' FROM nation",
    "pin_levels": "SELECT (o_orderkey % 40)::INT AS pin, o_orderkey % 2 = 0 AS level, count(*) AS n FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY ALL",
    "box_measures": f"""WITH {V_LINES} SELECT tag_id, page_number, line_index::INT AS i, top::DOUBLE AS top, bottom::DOUBLE AS bottom, "left"::DOUBLE AS "left", "right"::DOUBLE AS "right", (bottom - top)::DOUBLE AS height, ("right" - "left")::DOUBLE AS width, (top + bottom) / 2.0::DOUBLE AS center,
        greatest(0, coalesce(lead(top) OVER (PARTITION BY tag_id, page_number ORDER BY line_index), 0) - bottom)::DOUBLE AS gap FROM v_lines""",
    "mail_gate": "SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 2 AND o_orderkey % 7 > 2 AS accepted FROM orders",
    "mail_unprocessed": "SELECT o_orderkey % 3 AS uid_validity, o_orderkey AS uid FROM orders WHERE o_orderkey % 4 >= 2 OR o_orderkey % 8 = 0",
    "language_profiles": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'en' ELSE 'de' END AS code, CASE WHEN o_orderkey % 3 = 1 THEN 'en-US' ELSE 'de-DE' END AS speech_code, CASE WHEN o_orderkey % 3 = 1 THEN 'Chapter' ELSE 'Kapitel' END AS chapter_label, CASE WHEN o_orderkey % 3 = 1 THEN 'English' ELSE 'German' END AS summary_language FROM orders",
    "page_kinds": f"""WITH {MARKERS}, t0 AS (SELECT tag_id, true_number, {norm_ends("string_agg(text, chr(10) ORDER BY i)")} AS t, count(*) AS n FROM cl WHERE text <> '' GROUP BY ALL), k AS (SELECT tag_id, true_number, count(*) AS n, any_value(chapter_number) AS no, any_value(chapter_heading) AS h, any_value(line_index) AS li, any_value(consumed_line_count) AS c, any_value(detection_kind) AS d FROM markers GROUP BY ALL),
        x AS (SELECT p.tag_id, p.true_number, coalesce(t0.t, '') AS t, t0.n AS lines, k.* EXCLUDE (tag_id, true_number) FROM c4 p LEFT JOIN t0 ON t0.tag_id = p.tag_id AND t0.true_number = p.true_number LEFT JOIN k ON k.tag_id = p.tag_id AND k.true_number = p.true_number),
        y AS (SELECT *, coalesce(n = 1 AND h IS NOT NULL AND no IS NULL AND {norm("t")} = {norm("h")}, FALSE) AS heading_only, coalesce(n = 1 AND li = 0 AND lines > 0 AND lines <= c AND d IN ('explicit_label', 'explicit_inline_heading', 'explicit_following_heading', 'heading_only_page'), FALSE) AS marker_block, {fragment("t")} AS f FROM x),
        z AS (SELECT *, CASE WHEN t = '' THEN 'empty_clean_text' WHEN heading_only THEN 'heading_only_text' WHEN marker_block THEN 'chapter_marker_block_only' WHEN {has("right(t, 4) || chr(32)", END)} THEN 'ends_with_sentence_terminator' WHEN {has("t || chr(32)", END)} THEN 'fragment_after_last_sentence_terminator' WHEN {artifact("t")} THEN 'ocr_tail_artifact' ELSE 'no_sentence_terminator_found' END AS reason FROM y)
        SELECT tag_id, true_number, heading_only, marker_block, reason, CASE WHEN reason IN ('fragment_after_last_sentence_terminator', 'no_sentence_terminator_found') AND NOT {artifact("f")} THEN f END AS fragment FROM z""",
    "marker_union": """WITH c AS (SELECT DISTINCT conv_id AS k FROM conversations), m AS (SELECT k, 1 AS o, k % 5 AS li, k % 3 AS no, 'first' AS d FROM c UNION ALL SELECT k, 2, k % 4, k % 3, 'second' FROM c UNION ALL SELECT k, 3, k % 5, k % 2, 'third' FROM c),
        u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k, li, no ORDER BY o DESC) = 1) SELECT k AS conv_id, (row_number() OVER (PARTITION BY k ORDER BY li, o) - 1)::INT AS position, li::INT AS line_index, no::INT AS chapter_number, d AS detection_kind FROM u""",
    "line_remap": f"""WITH {V_LINES}, k AS (SELECT tag_id, page_number, line_index FROM v_lines WHERE line_index % 3 <> 1) SELECT tag_id, page_number, (row_number() OVER w - 1)::INT AS i, (row_number() OVER w - 1)::INT AS place FROM k WINDOW w AS (PARTITION BY tag_id, page_number ORDER BY line_index)""",
    "quoted_dialogue": f"""WITH {V_LINES}, q AS (SELECT *, CASE page_number % 4 WHEN 0 THEN '„' || text || '.“' WHEN 1 THEN '»' || text || '!«' WHEN 2 THEN '"' || text || '"' ELSE text END AS s FROM v_lines)
        SELECT tag_id, page_number, line_index, regexp_matches(s, '^(?:"[^"\\n]+"|„[^“\\n]+“|»[^«\\n]+«)$') AND regexp_matches(s, '[.!?…]["“«]$') AS dialogue FROM q""",
    "spoken_german": f"SELECT doc_id, {german("'Dr. ' || text || ' Notre-Dame, Dr.'")} AS text FROM documents",
    "blank_lines": f"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, chr(10), ' ' || chr(10) || ' ' || chr(10) || chr(10) || '  '), chr(10)), lambda x: {norm_ends("x")}) AS ls FROM documents)
        SELECT doc_id, {norm_ends("regexp_replace(array_to_string(ls, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM l""",
    "page_labels": f"""WITH {V_TURNS} SELECT tag_id, scan_id, side, created_at, side || ':' || coalesce(page_number::VARCHAR, report_page_id) AS label, CASE WHEN page_number IS NOT NULL THEN printf('page_%04d', page_number) WHEN side = 'left' THEN report_page_id ELSE scan_id || '_' || side END AS page_id,
        CASE WHEN length(clean_text) > 96 THEN left(clean_text, 95) || '…' ELSE clean_text END AS short, 'kapitel-zusammenfassung:' || coalesce(page_number || '-' || (page_number + 2), scan_id) AS recap, 'kapitel-zusammenfassung-temporaer' || coalesce(':' || page_number || '-' || (page_number + 1), '') AS progress FROM v_turns""",
    "time_formats": """SELECT event_id, 'scan_' || strftime(ts, '%Y%m%d_%H%M%S') AS scan_name, CASE event_id % 3 WHEN 0 THEN floor(value) / 1000 WHEN 1 THEN floor(value) + 0.5 END::DOUBLE AS seconds,
        CASE WHEN event_id % 4 <> 0 THEN try_cast(strftime(ts, '%Y-%m-') || printf('%02d', event_id % 40) AS DATE) END AS day FROM events""",
    "number_formats": """SELECT event_id, least(32767, greatest(-32768, round_even((event_id * 37 % 65536 - 32768) * 1.5, 0)))::BIGINT || ',' || round_even((event_id % 11 - 5) * 1.5, 0)::BIGINT AS samples, round_even(1.0::DOUBLE / greatest(event_id % 40 / 10, 0.1), 3) AS length_scale,
        greatest(80, floor(175 * greatest((event_id % 40 / 10)::DOUBLE, 0.1::DOUBLE)))::INT AS wpm, greatest(0, value - 3.0::DOUBLE - 1.5::DOUBLE) AS wait, CASE WHEN event_id % 5 > 0 THEN round(event_id::DOUBLE / (event_id % 5 * 8000), 9) END AS wav,
        round(greatest(0, least(255, (event_id % 256 - 40) * 255.0::DOUBLE / 160)), 9) AS grey FROM events""",
    "grid_corners": "SELECT p_partkey, i::INT AS i, round(i % 4 * 2.5::DOUBLE * p_retailprice, 6) AS x, round(i // 4 * 2.5::DOUBLE * p_retailprice, 6) AS y FROM part, range(12) t(i)",
    "paths_inside": "SELECT c_custkey, c_custkey % 4 = 0 AS inside FROM customer",
    "device_order": """WITH s AS (SELECT s_nationkey, s_suppkey::VARCHAR AS x, CASE s_suppkey WHEN 77 THEN 1 WHEN 20 THEN 2 WHEN 3 THEN 3 ELSE 9 END AS p FROM supplier) SELECT s_nationkey, string_agg(x, ',' ORDER BY p, x) AS names FROM s GROUP BY s_nationkey""",
    "orientation_best": f"""WITH {V_LINES}, c AS (SELECT tag_id, page_number, line_index * 90 AS r, (length(text) % 6)::DOUBLE / 10 AS s FROM v_lines WHERE line_index < 4) SELECT tag_id, page_number, arg_max(r, (s, -r)) AS rotation_deg, max(s) AS score FROM c GROUP BY ALL""",
    "orientation_swap": f"""WITH {V_TURNS}, p AS (SELECT tag_id, scan_id, max(clean_text) FILTER (side = 'left') AS l, max(clean_text) FILTER (side = 'right') AS r FROM v_turns GROUP BY ALL)
        SELECT tag_id, scan_id, CASE WHEN tag_id::BIGINT % 2 = 0 THEN r ELSE l END AS left_text, CASE WHEN tag_id::BIGINT % 2 = 0 THEN l ELSE r END AS right_text FROM p""",
    "page_rotation": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 90 WHEN 1 THEN 270 WHEN 4 THEN 270 ELSE CASE c_custkey % 3 WHEN 1 THEN 90 WHEN 2 THEN 270 ELSE 0 END END AS rotation FROM customer",
    "timings_total": "SELECT user_id, round(sum(round(value, 3)), 6) AS seconds FROM events GROUP BY user_id",
    "source_version": """WITH f AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'preferred' ELSE 'fallback' END AS source, bool_and(event_id % 97 <> 0) AS available, max(event_id) AS version FROM events GROUP BY ALL)
        SELECT user_id, version, available, source FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY available DESC, source = 'preferred' DESC) = 1""",
    "speech_counters": "SELECT conv_id, count(*) AS blocks, sum(length(text))::BIGINT AS chars, arg_min((turn + length(text) / 8.0::DOUBLE) - turn, turn) AS first_latency FROM conversations WHERE role <> 'system' GROUP BY conv_id",
    "fps_mean": """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT user_id, round(sum(value * (CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END) * pow(0.8::DOUBLE, n - i)), 6) AS fps FROM e GROUP BY user_id""",
    "latest_summarised": f"WITH {SUMMARIES} SELECT tag_id, max(chapter_id) AS chapter_id FROM s WHERE right(chapter_id, 1) IN ('2', '4') GROUP BY tag_id",
    "summary_pairs": f"WITH {SUMMARIES} SELECT tag_id, chapter_id, text AS chapter_text, CASE WHEN right(chapter_id, 1) IN ('1', '3', '5') THEN 'Kurz: ' || left(text, 20) END AS summary FROM s",
    "prompts": f"""WITH c AS (SELECT conv_id, turn, text, conv_id % 2 = 0 AS en, turn + 1 AS n FROM conversations WHERE role <> 'system'),
        d AS (SELECT *, {RANGE.format(a="n", b="(n + 1)")} AS label, regexp_replace(printf('%.1f', greatest(0.1, n / 2)::DOUBLE), '\\.0$', '') AS pages, greatest(25, round_even(n / 2 * 250, 0))::INT AS n_words FROM c)
        SELECT conv_id, turn, {asked("chapter", "Fasse den folgenden Abschnitt (%s, %s Seiten) in etwa %d Woertern zusammen.' || chr(10) || chr(10) || '%s", "Summarise the following section (%s, %s pages) in about %d words.' || chr(10) || chr(10) || '%s")},
            {asked("book", "Fasse das Buch anhand seiner Abschnitte (%s, %s Seiten) in etwa %d Woertern zusammen.' || chr(10) || chr(10) || '%s", "Summarise the book from its sections (%s, %s pages) in about %d words.' || chr(10) || chr(10) || '%s")},
            {asked("progress", "Fasse zusammen, was bisher gelesen wurde (%s, %s Seiten), in etwa %d Woertern.' || chr(10) || chr(10) || '%s", "Summarise what has been read so far (%s, %s pages) in about %d words.' || chr(10) || chr(10) || '%s")},
            {asked("shortening", "Kuerze die folgende Zusammenfassung (%s, %s Seiten) auf hoechstens %d Woerter.' || chr(10) || chr(10) || '%s", "Shorten the following summary (%s, %s pages) to at most %d words.' || chr(10) || chr(10) || '%s")} FROM d""",
    "generator_answers": f"""SELECT conv_id, turn, role, CASE WHEN turn <> 6 THEN {norm_ends("text")} || chr(10) || chr(10) || role END AS text, turn <> 6 AND turn % 2 = 1 AS complete, turn <> 6 AND turn % 4 = 0 AS truncated, turn = 6 OR (turn % 5 <> 0 AND turn % 4 <> 2) AS retry FROM conversations""",
    "metadata_merge": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS a, c_custkey::VARCHAR AS b, 'new' AS c FROM customer",
    "debounced_buttons": """WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS button, event_id * 0.001::DOUBLE AS t, value > 40 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
        d(button, rn, raw, stable, since, t, out) AS (SELECT button, rn, p, p, t, t, NULL::VARCHAR FROM r WHERE rn = 1 UNION ALL
            SELECT r.button, r.rn, r.p, CASE WHEN r.p = d.raw AND r.p <> d.stable AND r.t - d.since >= 0.025::DOUBLE THEN r.p ELSE d.stable END, CASE WHEN r.p <> d.raw THEN r.t ELSE d.since END, r.t, CASE WHEN r.p = d.raw AND r.p <> d.stable AND r.t - d.since >= 0.025::DOUBLE THEN CASE WHEN r.p THEN 'down' ELSE 'up' END END
            FROM d JOIN r ON r.button = d.button AND r.rn = d.rn + 1) SELECT button, t, out AS event_type FROM d WHERE out IS NOT NULL""",
    "quadrature_steps": """WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS encoder, event_id::DOUBLE AS t, floor(value)::INT % 4 AS ph, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
        d(encoder, rn, ph, quarter, t, delta) AS (SELECT encoder, rn, ph, 0, t, 0 FROM r WHERE rn = 1 UNION ALL
            SELECT encoder, rn, ph, CASE WHEN abs(q) >= 4 THEN q - 4 * sign(q) ELSE q END::INT, t, CASE WHEN abs(q) >= 4 THEN sign(q) ELSE 0 END::INT FROM (SELECT r.encoder, r.rn, r.ph, r.t, d.quarter + CASE (r.ph - d.ph + 4) % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS q FROM d JOIN r ON r.encoder = d.encoder AND r.rn = d.rn + 1))
        SELECT encoder, t, delta FROM d WHERE delta <> 0""",
}
