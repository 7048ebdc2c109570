"""SQL twins of the registered queries, for an engine other than Spark. They share no code with the queries.

Where a twin can't be stated (look-around expressions, stateful folds) none is given; tests compare these with plain Python.
"""

from __future__ import annotations

from ..functions import numbers as _N

# --- fragments


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def capitals(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g'))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


CLOSERS = "[\"''»”)\\]]*"
#: An end followed by white space or the end of the text, which a blank put behind the text stands for.
END = f"[.!?…]{CLOSERS}\\s"


def fragment(x: str) -> str:
    t = norm_ends(x)
    return (
        f"CASE WHEN {t} = '' OR {has(f'right({t}, 4) || chr(32)', END)} THEN NULL "
        f"ELSE nullif({norm_ends(f'''regexp_replace({t} || chr(32), '(?s)^.*{END}', '')''')}, '') END"
    )


def norm_ends(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def artifact(x: str) -> str:
    return f"coalesce({has(x, '^[\\[(][^\\])]{1,14}[\\])]$')} AND {has(x, '[0-9]')}, FALSE)"


def prefixed(f: str, t: str) -> str:
    a, b = norm_ends(f"coalesce({f}, '')"), norm_ends(t)
    return f"CASE WHEN {a} = '' OR {artifact(a)} THEN {b} WHEN {b} = '' THEN {a} WHEN right({a}, 1) = '-' AND {has(b, '^\\p{Ll}')} THEN left({a}, -1) || {b} ELSE {a} || ' ' || {b} END"


def without_suffix(t: str, s: str) -> str:
    u = norm_ends(t)
    return f"CASE WHEN {s} IS NULL OR {s} = '' THEN {t} WHEN ends_with({u}, {s}) THEN regexp_replace(left({u}, length({u}) - length({s})), '\\s+$', '') ELSE {u} END"


def heading_line(x: str) -> str:
    return f"({norm(x)} <> '' AND length({norm(x)}) <= 80 AND lower({norm(x)}) NOT IN ('inhalt', 'inhaltsverzeichnis', 'prolog', 'epilog') AND NOT {has(norm(x), '[.!?…:;]$')} AND len({words(x)}) <= 8)"


def heading_shape(x: str) -> str:
    return f"({letters(x)} > 0 AND ({capitals(x)} * 10 >= {letters(x)} * 8 OR (len({words(x)}) <= 5 AND len(list_filter({words(x)}, lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0)))"


def layout_heading(x: str) -> str:
    return f"(length({x}) <= 80 AND NOT {has(x, '[.!?,;:]$')} AND len(list_filter({words(x)}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) * 10 >= greatest(len({words(x)}), 1) * 6)"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(r[1:1]) || lower(r[2:])), '')"


def upper_heading(x: str) -> str:
    return f"({has(x, '\\p{L}')} AND NOT {has(x, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]')} AND len({words(x)}) BETWEEN 2 AND 10 AND length({norm_ends(x)}) <= 80)"


def chapter_number(x: str) -> str:
    value = "list_transform(string_split(upper(trim(" + x + ")), ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END)"
    signed = f"list_sum(list_transform(range(1, len({value}) + 1), lambda i: CASE WHEN {value}[i] < coalesce(list_max({value}[i + 1:]), 0) THEN -{value}[i] ELSE {value}[i] END))"
    return f"CASE WHEN regexp_matches(trim({x}), '^[0-9]+$') THEN try_cast(trim({x}) AS INT) WHEN regexp_matches(upper(trim({x})), '^[IVXLCDM]+$') THEN nullif({signed}, 0)::INT END"


def half_even(x: str) -> str:
    return f"round_even({x}, 0)"


def duration(x: str) -> str:
    s = f"greatest(0, {half_even(x)}::BIGINT)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60)"


# --- views

V_PAGES = """
    cut AS (SELECT doc_id, lang, upper(lang) || '-' || (doc_id // 64) AS tag_id, unnest(range(greatest(((length(text) + 599) // 600), 1))) AS slice, text AS whole FROM documents),
    v_pages AS (SELECT *, printf('scan_%06d', (page_number + 1) // 2) AS scan_id, CASE WHEN page_number % 2 = 1 THEN 'left' ELSE 'right' END AS side, CASE WHEN lang = 'de' THEN 'de' ELSE 'en' END AS language
        FROM (SELECT tag_id, lang, substr(whole, slice * 600 + 1, 600) AS text, row_number() OVER (PARTITION BY tag_id ORDER BY doc_id, slice) AS page_number FROM cut))"""
V_LINES = (
    V_PAGES
    + """,
    flat AS (SELECT * EXCLUDE (text), trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM v_pages),
    piece AS (SELECT * EXCLUDE (text), text AS t, unnest(range((length(text) + 59) // 60)) AS j FROM flat),
    l0 AS (
        SELECT tag_id, scan_id, side, page_number, language, j, trim(CASE WHEN regexp_matches(substr(t, j * 60 + 1, 60), '\\p{L}$') AND regexp_matches(substr(t, j * 60 + 61, 1), '\\p{L}') THEN substr(t, j * 60 + 1, 60) || '-' ELSE substr(t, j * 60 + 1, 60) END) AS text FROM piece
        UNION ALL SELECT tag_id, scan_id, side, page_number, language, -1, CASE WHEN page_number % 50 = 20 THEN '' WHEN language = 'de' THEN 'Kapitel ' ELSE 'Chapter ' END || (page_number // 10) FROM v_pages WHERE page_number % 50 IN (13, 20, 45)
        UNION ALL SELECT tag_id, scan_id, side, page_number, language, 1000, CASE WHEN page_number % 7 = 3 THEN 'I2' ELSE page_number::VARCHAR END FROM v_pages),
    l1 AS (SELECT *, row_number() OVER w AS pos, coalesce(sum(CASE WHEN ends_with(text, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY tag_id, page_number ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gaps FROM l0 WHERE text <> '' WINDOW w AS (PARTITION BY tag_id, page_number ORDER BY j)),
    v_lines AS (SELECT tag_id, scan_id, side, page_number, language, pos - 1 AS line_index, text, 10 AS "left", (40 * pos + 80 * gaps)::INT AS top, 10 + 10 * length(text) AS "right", (40 * pos + 80 * gaps)::INT + 30 AS bottom, 0.5 + (length(text) % 50)::DOUBLE / 100 AS confidence FROM l1)"""
)
V_USAGE = """
    v_usage AS (SELECT user_id::VARCHAR AS tag_id, ts, CASE event_type WHEN 'view' THEN 'scan' WHEN 'click' THEN 'audio' WHEN 'signup' THEN 'chapter_summary' WHEN 'purchase' THEN 'book_summary' END AS kind, json_extract_string(props, '$.k') AS page_key, value AS seconds FROM events),
    daily AS (SELECT (ts - INTERVAL 4 HOURS)::DATE AS period_key, tag_id, count(DISTINCT CASE WHEN kind = 'scan' THEN page_key END) AS pages_scanned,
        round(coalesce(sum(seconds) FILTER (kind = 'audio' AND seconds > 0), 0), 3) AS audio_seconds, count(*) FILTER (kind = 'chapter_summary') AS chapter_summary_uses, count(*) FILTER (kind = 'book_summary') AS book_summary_uses
        FROM v_usage WHERE (kind = 'scan' AND page_key <> '') OR (kind = 'audio' AND seconds > 0) OR kind IN ('chapter_summary', 'book_summary') GROUP BY ALL),
    books AS (SELECT c_custkey::VARCHAR AS tag_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title FROM customer)"""
V_TURNS = """
    v_turns AS (SELECT conv_id::VARCHAR AS tag_id, printf('scan_%04d', turn // 2) AS scan_id, CASE WHEN role = 'user' THEN 'left' ELSE 'right' END AS side, CASE WHEN turn % 3 <> 2 THEN turn + 1 END AS page_number,
        'page_' || (turn % 2 + 1) AS report_page_id, printf('2026-01-01T00:%02d:00Z', turn) AS created_at, CASE WHEN turn % 4 = 1 THEN left(text, length(text) - 1) ELSE text END AS clean_text FROM conversations WHERE role <> 'system')"""
SPOKEN = (
    V_TURNS
    + f""",
    t0 AS (SELECT *, {fragment("clean_text")} AS f FROM v_turns),
    t1 AS (SELECT * EXCLUDE (f), CASE WHEN {artifact("f")} THEN NULL ELSE f END AS tail_fragment FROM t0),
    spoken AS (SELECT *, {without_suffix(norm_ends("clean_text"), "tail_fragment")} AS speak_text FROM t1)"""
)
BOOK_PAGES = (
    V_PAGES
    + f""",
    bp AS (SELECT *, page_number % 50 IN (13, 20, 45) AS marked, (CASE WHEN page_number % 50 IN (13, 20, 45) THEN CASE WHEN language = 'de' THEN 'Kapitel ' ELSE 'Chapter ' END || (page_number // 10) || chr(10) ELSE '' END) || trim(text) AS clean_text, printf('page_%04d', page_number) AS page_id, page_number - 1 AS position FROM v_pages),
    facts AS (SELECT *, CASE WHEN {norm_ends("clean_text")} = '' THEN length(clean_text)
        WHEN regexp_matches(clean_text, '(?s)^(.*[.!?…]{CLOSERS})\\s*\\n\\s*\\n') THEN length(regexp_extract(clean_text, '(?s)^(.*[.!?…]{CLOSERS})\\s*\\n\\s*\\n', 1))
        WHEN regexp_matches(clean_text, '[.!?…]') THEN length(regexp_extract(clean_text, '(?s)^(.*[.!?…]{CLOSERS})', 1)) ELSE length(clean_text) END AS fallback, count(*) OVER (PARTITION BY tag_id) AS n_pages FROM bp),
    facts2 AS (SELECT *, fallback + length(regexp_extract(substr(clean_text, fallback + 1), '^\\s*')) AS resume FROM facts),
    step(tag_id, sequence, sp, so, ep, eo, np, no, kind) AS (
        SELECT tag_id, 0, 0, 0, 0, 0, 0, 0, '' FROM facts2 WHERE position = 0
        UNION ALL
        SELECT s.tag_id, s.sequence + 1, s.np, s.no, e.position, e.off, e.position, e.nxt, e.kind
        FROM step s, LATERAL (
            SELECT f.position, CASE WHEN f.marked AND f.position > s.np THEN 0 ELSE f.fallback END AS off, CASE WHEN f.marked AND f.position > s.np THEN 0 ELSE f.resume END AS nxt,
                CASE WHEN f.marked AND f.position > s.np THEN 'chapter_marker' ELSE 'fallback_last_complete_paragraph' END AS kind
            FROM facts2 f WHERE f.tag_id = s.tag_id AND f.position BETWEEN s.np + 9 AND s.np + 19 AND (f.marked OR f.position = s.np + 19) ORDER BY f.position LIMIT 1) e),
    bounds AS (SELECT tag_id, sequence, sp AS start_position, so AS start_offset, ep AS end_position, eo AS end_offset, np AS next_position, no AS next_offset, kind AS boundary_kind FROM step WHERE sequence > 0)"""
)


def slices(spans: str) -> str:
    return f"""
    sl AS (SELECT s.*, p.position, p.page_id, p.page_number, {norm_ends("substr(p.clean_text, (CASE WHEN p.position = s.start_position THEN s.start_offset ELSE 0 END) + 1, greatest((CASE WHEN p.position = s.end_position THEN least(s.end_offset, length(p.clean_text)) ELSE length(p.clean_text) END) - (CASE WHEN p.position = s.start_position THEN s.start_offset ELSE 0 END), 0))")} AS slice
        FROM {spans} s JOIN bp p ON p.tag_id = s.tag_id AND p.position BETWEEN s.start_position AND s.end_position)"""


CARDINAL_DE = f"""CASE WHEN n < 100 THEN b[n + 1] ELSE (CASE WHEN n // 100 = 1 THEN 'ein' ELSE b[n // 100 + 1] END) || 'hundert' || (CASE WHEN n % 100 = 0 THEN '' ELSE b[n % 100 + 1] END) END
    FROM (SELECT list_transform(range(100), lambda i: CASE WHEN i < 20 THEN u[i + 1] WHEN i % 10 = 0 THEN t[i // 10 - 1] ELSE (CASE WHEN i % 10 = 1 THEN 'ein' ELSE u[i % 10 + 1] END) || 'und' || t[i // 10 - 1] END) AS b
    FROM (SELECT {_N.GERMAN_UNITS!r} AS u, {_N.GERMAN_TENS!r} AS t))"""
CARDINAL_EN = f"""CASE WHEN n < 100 THEN b[n + 1] ELSE b[n // 100 + 1] || ' hundred' || (CASE WHEN n % 100 = 0 THEN '' ELSE ' ' || b[n % 100 + 1] END) END
    FROM (SELECT list_transform(range(100), lambda i: CASE WHEN i < 20 THEN u[i + 1] WHEN i % 10 = 0 THEN t[i // 10 - 1] ELSE t[i // 10 - 1] || '-' || u[i % 10 + 1] END) AS b
    FROM (SELECT {_N.ENGLISH_UNITS!r} AS u, {_N.ENGLISH_TENS!r} AS t))"""

LEVEL = "(SELECT list_transform(range(n), lambda i: round_even(5 + 85 * i / (n - 1), 0)::INT))"

SQL: dict[str, str] = {
    "usage_daily": f"WITH {V_USAGE} SELECT * FROM daily",
    "usage_totals_rollup": f"""WITH {V_USAGE} SELECT period_key, tag_id, sum(pages_scanned)::BIGINT AS pages_scanned, round(sum(audio_seconds), 3) AS audio_seconds, sum(chapter_summary_uses)::BIGINT AS chapter_summary_uses, sum(book_summary_uses)::BIGINT AS book_summary_uses
        FROM daily GROUP BY GROUPING SETS ((period_key, tag_id), (period_key))""",
    "usage_label_join": f"WITH {V_USAGE} SELECT period_key, d.tag_id, coalesce(title || ' (' || d.tag_id || ')', d.tag_id) AS label FROM daily d LEFT JOIN books b ON b.tag_id = d.tag_id",
    "usage_closed_periods": f"""WITH {V_USAGE} SELECT d AS period_key, d || 'T04:00:00' AS starts_at, (d + 1) || 'T04:00:00' AS ends_at FROM (SELECT unnest(range(DATE '2024-01-06', DATE '2024-01-25', INTERVAL 1 DAY))::DATE AS d)""",
    "usage_gap_fill": f"""WITH {V_USAGE}, p AS (SELECT unnest(range(DATE '2024-01-06', DATE '2024-01-25', INTERVAL 1 DAY))::DATE AS period_key)
        SELECT p.period_key, p.period_key || 'T04:00:00' AS starts_at, (p.period_key + 1) || 'T04:00:00' AS ends_at, d.tag_id, coalesce(pages_scanned, 0) AS pages_scanned, coalesce(audio_seconds, 0) AS audio_seconds, coalesce(chapter_summary_uses, 0) AS chapter_summary_uses, coalesce(book_summary_uses, 0) AS book_summary_uses
        FROM p LEFT JOIN daily d ON d.period_key = p.period_key""",
    "usage_report": f"""WITH {V_USAGE}, t AS (SELECT period_key, tag_id, sum(pages_scanned)::BIGINT AS pages_scanned, round(sum(audio_seconds), 3) AS a, sum(chapter_summary_uses)::BIGINT AS chapter_summary_uses, sum(book_summary_uses)::BIGINT AS book_summary_uses FROM daily GROUP BY GROUPING SETS ((period_key, tag_id), (period_key)))
        SELECT period_key, row_number() OVER (PARTITION BY period_key ORDER BY t.tag_id NULLS LAST) AS position, t.tag_id, CASE WHEN t.tag_id IS NULL THEN 'Gesamt' ELSE coalesce(title || ' (' || t.tag_id || ')', t.tag_id) END AS label, pages_scanned, {duration("a")} AS audio, chapter_summary_uses, book_summary_uses FROM t LEFT JOIN books b ON b.tag_id = t.tag_id""",
    "usage_duration_fmt": f"SELECT event_id, {duration('value * 1000 - 500')} AS duration FROM events",
    "norm_ws": f"SELECT doc_id, {norm('text')} AS text FROM documents",
    "word_count": "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+(?:[-’''][\\p{L}\\p{M}\\p{N}_]+)*'))::BIGINT AS n_words FROM documents",
    "sentences": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all({norm("text")}, '[^.!?]*[.!?]["''»«”“)]*|[^.!?]+$'), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)
        SELECT doc_id, (generate_subscripts(a, 1) - 1)::INT AS position, unnest(a) AS sentence FROM s""",
    "sentence_complete": f"""WITH {V_LINES} SELECT tag_id, page_number, line_index, regexp_matches(text, '[.!?][\\s"''»«”“)]*$') AS complete FROM v_lines""",
    "isolated_letters": f"SELECT doc_id, array_to_string(list_filter({words('text')}, lambda w: NOT regexp_matches(w, '^\\p{{L}}$')), ' ') AS text FROM documents",
    "consonant_fragments": f"SELECT doc_id, array_to_string(list_filter({words('text')}, lambda w: NOT (regexp_matches(w, '^\\p{{L}}{{2}}$') AND NOT regexp_matches(w, '[\\p{{Lu}}\\p{{Lt}}]') AND regexp_matches(w, '\\p{{Ll}}') AND NOT regexp_matches(w, '[aeiouäöüAEIOUÄÖÜ]'))), ' ') AS text FROM documents",
    "orphan_percent": f"""WITH s AS (SELECT doc_id, string_split({norm("text")}, '%') AS a FROM documents)
        SELECT doc_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || CASE WHEN i < len(a) AND regexp_matches(rtrim(a[i]), '[0-9]$') THEN '%' ELSE '' END), '') AS text FROM s""",
    "upper_heading_title": f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS line FROM documents),
        s AS (SELECT doc_id, position::INT AS position, {norm("CASE WHEN (doc_id + position) % 2 = 0 THEN upper(replace(line, 'ß', 'SS')) ELSE line END")} AS x FROM l) SELECT doc_id, position, CASE WHEN {upper_heading("x")} THEN {title_case("x")} ELSE x END AS text FROM s""",
    "heading_predicates": f"""WITH {V_LINES} SELECT tag_id, page_number, line_index, {heading_line("text")} AS heading_line, {heading_shape("text")} AS heading_shape, {layout_heading("text")} AS layout_heading,
        (length(text) <= 80 AND len({words("text")}) <= 10 AND NOT regexp_matches(text, '[.!?…]["''«»”)\\]]?$')) AS speech_heading,
        (len(list_filter({words("text")}, lambda w: regexp_matches(w, '\\p{{L}}'))) >= 2 AND len(list_filter({words("text")}, lambda w: regexp_matches(w, '\\p{{L}}') AND NOT regexp_matches(w, '^[^\\p{{L}}]*\\p{{Lu}}'))) = 0) AS title_cased, {upper_heading("text")} AS upper_heading FROM v_lines""",
    "tag_normalize": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(replace(c_name, '#', '-')) END AS tag_id, upper(replace(c_name, '#', '')) AS uid FROM customer""",
    "paragraph_islands": f"""WITH {V_LINES},
        a AS (SELECT *, lag(bottom) OVER w AS pb, lag(bottom - top) OVER w AS ph, lag({layout_heading("text")}) OVER w AS hd, avg(bottom - top) OVER (PARTITION BY tag_id, page_number) AS m FROM v_lines WINDOW w AS (PARTITION BY tag_id, page_number ORDER BY top, "left", line_index)),
        b AS (SELECT *, 1 + sum(CASE WHEN top - pb > CASE WHEN hd THEN greatest(1, ph) * 1.2::DOUBLE ELSE m * 1.4::DOUBLE END THEN 1 ELSE 0 END) OVER (PARTITION BY tag_id, page_number ORDER BY top, "left", line_index) AS paragraph FROM a)
        SELECT tag_id, page_number, paragraph::INT AS paragraph, count(*) AS n_lines, min(line_index) AS first_line, max(line_index) AS last_line FROM b GROUP BY ALL""",
    "change_point_groups": f"""WITH {V_LINES}, a AS (SELECT *, line_index // 3 % 2 AS k, lag(line_index // 3 % 2) OVER (PARTITION BY tag_id, page_number ORDER BY top, "left", line_index) AS pk FROM v_lines),
        b AS (SELECT *, 1 + sum(CASE WHEN pk <> k THEN 1 ELSE 0 END) OVER (PARTITION BY tag_id, page_number ORDER BY top, "left", line_index) AS paragraph FROM a)
        SELECT tag_id, page_number, paragraph::INT AS paragraph, count(*) AS n_lines, min(line_index) AS first_line FROM b GROUP BY ALL""",
    "page_number_line": f"""WITH {V_LINES}, a AS (SELECT *, row_number() OVER (PARTITION BY tag_id, page_number ORDER BY line_index) AS r, count(*) OVER (PARTITION BY tag_id, page_number) AS n, regexp_matches(trim(text), '^[0-9]{{1,4}}$') AS d FROM v_lines)
        SELECT tag_id, page_number, line_index, text FROM a WHERE d AND (r = 1 OR r = n) QUALIFY row_number() OVER (PARTITION BY tag_id, page_number ORDER BY r) = 1""",
    "page_number_pick": f"""WITH {V_LINES}, a AS (SELECT *, max(bottom) OVER (PARTITION BY tag_id, page_number) AS m, try_cast(nullif(regexp_extract(text, '^[\\[(]?\\s*([0-9]{{1,4}})\\s*[\\])]?$', 1), '') AS INT) AS num FROM v_lines),
        b AS (SELECT tag_id, page_number, arg_max({{'p': line_index, 'd': num}}, ((top + bottom) / 2.0 / greatest(1, m), num, -line_index)) FILTER (num IS NOT NULL) AS x FROM a GROUP BY ALL) SELECT tag_id, page_number, x.p AS position, x.d AS detected FROM b""",
    "footer_artifact": f"""WITH {V_LINES}, a AS (SELECT *, max(bottom) OVER (PARTITION BY tag_id, page_number) AS m FROM v_lines)
        SELECT tag_id, page_number, max(line_index) FILTER (regexp_matches(text, '^[0-9IiLlOoSsZzBbGgQq]{{1,4}}$') AND bottom / greatest(1, m) >= 0.93) AS position FROM a GROUP BY ALL""",
    "spread_number_infer": f"""WITH {V_TURNS}, a AS (SELECT *, count(*) OVER w AS n, count(page_number) OVER w AS k, max(page_number) OVER w AS o, max(CASE WHEN page_number IS NOT NULL THEN side END) OVER w AS os FROM v_turns WINDOW w AS (PARTITION BY tag_id, scan_id)),
        b AS (SELECT *, CASE WHEN n = 2 AND k = 1 AND page_number IS NULL THEN CASE WHEN side = 'left' AND os = 'right' AND o > 1 THEN o - 1 WHEN side = 'right' AND os = 'left' THEN o + 1 END END AS g FROM a)
        SELECT tag_id, scan_id, side, coalesce(page_number, g)::INT AS page_number, g IS NOT NULL AS inferred FROM b""",
    "roman_parse": f"""WITH a AS (SELECT doc_id, {words("text")} AS w FROM documents), u AS (SELECT doc_id, (generate_subscripts(w, 1) - 1)::INT AS position, unnest(w) AS word FROM a)
        SELECT doc_id, position, word, {chapter_number("word")} AS number FROM u WHERE {chapter_number("word")} IS NOT NULL""",
    "cardinals": f"SELECT n, CASE WHEN n > 999 THEN n::VARCHAR ELSE (SELECT {CARDINAL_DE}) END AS german, CASE WHEN n > 999 THEN n::VARCHAR ELSE (SELECT {CARDINAL_EN}) END AS english FROM (SELECT c_custkey AS n FROM customer)",
    "word_to_line": f"""WITH {V_LINES}, w AS (SELECT tag_id, page_number, line_index, top, string_split(text, ' ') AS a FROM v_lines), x AS (SELECT * EXCLUDE (a), generate_subscripts(a, 1) - 1 AS k, unnest(a) AS t FROM w),
        y AS (SELECT *, CASE WHEN length(t) % 9 = 8 THEN -1.0 ELSE (length(t) * 7 % 100) END AS conf FROM x)
        SELECT tag_id, page_number, (line_index // 4)::INT AS block_num, line_index AS line_num, string_agg(t, ' ' ORDER BY k) AS text, min(10 + 70 * k) AS "left", min(top) AS top, max(10 + 70 * k + 10 * length(t)) AS "right", max(top + 30) AS bottom, round(avg(conf)::DOUBLE / 100, 9) AS confidence, count(*) AS n_words
        FROM y WHERE conf >= 0 AND t <> '' GROUP BY tag_id, page_number, line_index""",
    "reading_order": f"""WITH {V_TURNS}, a AS (SELECT *, scan_id || '_' || side AS page_id, bool_and(page_number IS NOT NULL) OVER (PARTITION BY tag_id) AND count(*) OVER (PARTITION BY tag_id) > 1 AS every FROM v_turns)
        SELECT tag_id, page_id, row_number() OVER (PARTITION BY tag_id ORDER BY CASE WHEN every THEN page_number WHEN side = 'left' THEN 0 ELSE 1 END, CASE WHEN every THEN '' ELSE page_id END) AS position FROM a""",
    "tail_fragment": f"""WITH {V_PAGES}, a AS (SELECT tag_id, page_number, {norm_ends("text")} AS t, {fragment("text")} AS f FROM v_pages),
        b AS (SELECT *, CASE WHEN t = '' THEN 'empty_clean_text' WHEN {has("right(t, 4) || chr(32)", END)} THEN 'ends_with_sentence_terminator' WHEN {has("t || chr(32)", END)} THEN 'fragment_after_last_sentence_terminator' WHEN {artifact("t")} THEN 'ocr_tail_artifact' ELSE 'no_sentence_terminator_found' END AS reason FROM a)
        SELECT tag_id, page_number, reason, CASE WHEN reason IN ('fragment_after_last_sentence_terminator', 'no_sentence_terminator_found') AND NOT {artifact("f")} THEN f END AS fragment FROM b""",
    "tail_carry_spread": f"""WITH {SPOKEN}, p AS (SELECT l.tag_id, l.scan_id, l.speak_text AS ls, r.speak_text AS rs, CASE WHEN {norm_ends("r.speak_text")} = '' THEN NULL ELSE nullif(coalesce({fragment("l.speak_text")}, l.tail_fragment), '') END AS fragment FROM spoken l JOIN spoken r ON l.tag_id = r.tag_id AND l.scan_id = r.scan_id AND l.side = 'left' AND r.side = 'right'),
        q AS (SELECT *, {norm_ends(f"CASE WHEN fragment IS NULL THEN ls ELSE {without_suffix('ls', 'fragment')} END")} AS a, {norm_ends(f"CASE WHEN fragment IS NULL THEN rs ELSE {prefixed('fragment', 'rs')} END")} AS b FROM p),
        h AS (SELECT *, regexp_extract(a, '([^\\s-]+-)\\s*$', 1) AS w FROM q)
        SELECT tag_id, scan_id, fragment, CASE WHEN w <> '' AND regexp_matches(b, '^\\p{{Ll}}') THEN regexp_replace(left(a, length(a) - length(w)), '\\s+$', '') ELSE a END AS left_speak, CASE WHEN w <> '' AND regexp_matches(b, '^\\p{{Ll}}') THEN left(w, -1) || b ELSE b END AS right_speak FROM h""",
    "tail_carry_next": f"""WITH {SPOKEN}, a AS (SELECT *, row_number() OVER (PARTITION BY tag_id, scan_id ORDER BY page_number IS NULL, side <> 'left', page_number) = 1 AS target FROM spoken),
        b AS (SELECT a.*, p.tail_fragment AS pt, coalesce(a.target AND a.page_number > 1 AND coalesce(p.tail_fragment, '') <> '', FALSE) AS carried FROM a LEFT JOIN spoken p ON p.tag_id = a.tag_id AND p.page_number = a.page_number - 1 AND p.side = 'right')
        SELECT tag_id, scan_id, side, page_number, carried, CASE WHEN carried THEN {prefixed("pt", "speak_text")} ELSE speak_text END AS speak_text FROM b""",
    "pending_tail_locf": f"""WITH {SPOKEN} SELECT tag_id, scan_id, side, (SELECT nullif(trim(p.tail_fragment), '') FROM spoken p WHERE p.tag_id = s.tag_id AND p.side = 'right' AND (p.created_at, p.scan_id, p.side) < (s.created_at, s.scan_id, s.side) ORDER BY p.created_at DESC, p.scan_id DESC LIMIT 1) AS pending FROM spoken s""",
    "hyphen_bridge": f"""WITH {V_LINES}, a AS (SELECT *, lead(text) OVER (PARTITION BY tag_id, page_number ORDER BY line_index) AS r FROM v_lines), b AS (SELECT *, regexp_extract(text, '([^\\s-]+-)\\s*$', 1) AS w FROM a WHERE r IS NOT NULL), c AS (SELECT *, w <> '' AND regexp_matches(r, '^\\p{{Ll}}') AS m FROM b)
        SELECT tag_id, page_number, line_index, CASE WHEN m THEN regexp_replace(left(text, length(text) - length(w)), '\\s+$', '') ELSE text END AS "left", CASE WHEN m THEN left(w, -1) || r ELSE r END AS "right" FROM c""",
    "placeholder_antijoin": f"""WITH {V_TURNS}, l AS (SELECT * REPLACE (900 + length(scan_id) AS page_number) FROM v_turns WHERE page_number IS NULL AND tag_id::BIGINT % 2 = 0), a AS (SELECT * FROM v_turns UNION ALL SELECT * FROM l)
        SELECT tag_id, scan_id, side, report_page_id, page_number::INT AS page_number FROM a WHERE page_number IS NOT NULL OR NOT EXISTS (SELECT 1 FROM a b WHERE b.page_number IS NOT NULL AND b.tag_id = a.tag_id AND b.scan_id = a.scan_id AND b.side = a.side AND b.report_page_id = a.report_page_id)""",
    "latest_page_version": "SELECT user_id, json_extract_string(props, '$.k') AS page_key, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "assembly_order": f"""WITH {V_TURNS} SELECT tag_id, scan_id || '_' || side AS page_id, row_number() OVER (PARTITION BY tag_id ORDER BY created_at, scan_id, CASE side WHEN 'left' THEN 0 ELSE 1 END, page_number IS NULL, coalesce(page_number, 0), scan_id || '_' || side) - 1 AS position FROM v_turns""",
    "marker_offsets": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_index, unnest(a) AS line FROM s)
        SELECT doc_id, line_index::INT AS line_index, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS "offset" FROM l""",
    "fallback_offsets": f"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS clean_text FROM documents) SELECT doc_id, (CASE WHEN {norm_ends("clean_text")} = '' THEN length(clean_text)
        WHEN regexp_matches(clean_text, '(?s)^(.*[.!?…]{CLOSERS})\\s*\\n\\s*\\n') THEN length(regexp_extract(clean_text, '(?s)^(.*[.!?…]{CLOSERS})\\s*\\n\\s*\\n', 1))
        WHEN regexp_matches(clean_text, '[.!?…]') THEN length(regexp_extract(clean_text, '(?s)^(.*[.!?…]{CLOSERS})', 1)) ELSE length(clean_text) END)::INT AS "offset" FROM d""",
    "section_bounds": f"WITH RECURSIVE {BOOK_PAGES} SELECT tag_id, sequence, start_position::INT AS start_position, start_offset::INT AS start_offset, end_position::INT AS end_position, end_offset::INT AS end_offset, next_position::INT AS next_position, next_offset::INT AS next_offset, boundary_kind FROM bounds",
    "section_text": f"""WITH RECURSIVE {BOOK_PAGES}, {slices("bounds")} SELECT tag_id, sequence, start_position::INT AS start_position, end_position::INT AS end_position, boundary_kind, printf('chapter_%04d', sequence) AS chapter_id, {norm_ends("string_agg(slice, chr(10) || chr(10) ORDER BY position)")} AS text,
        string_agg(page_id, ',' ORDER BY position) AS page_ids, string_agg(page_number::VARCHAR, ',' ORDER BY position) AS page_numbers, min(page_number)::INT AS start_page, max(page_number)::INT AS end_page, (end_position - start_position + 1)::INT AS page_span, count(*)::INT AS content_page_count FROM sl WHERE slice <> '' GROUP BY tag_id, sequence, start_position, end_position, boundary_kind""",
    "pending_content": f"""WITH RECURSIVE {BOOK_PAGES}, o AS (SELECT e.tag_id, coalesce(b.next_position, 0) AS start_position, coalesce(b.next_offset, 0) AS start_offset, e.p AS end_position, e.n AS end_offset FROM (SELECT tag_id, max(position) AS p, arg_max(length(clean_text), position) AS n FROM bp GROUP BY tag_id) e LEFT JOIN (SELECT tag_id, arg_max(next_position, sequence) AS next_position, arg_max(next_offset, sequence) AS next_offset FROM bounds GROUP BY tag_id) b ON b.tag_id = e.tag_id), {slices("o")}
        SELECT tag_id, {norm_ends("string_agg(slice, chr(10) || chr(10) ORDER BY position)")} AS text, string_agg(page_id, ',' ORDER BY position) AS page_ids, string_agg(page_number::VARCHAR, ',' ORDER BY position) AS page_numbers FROM sl WHERE slice <> '' GROUP BY tag_id""",
    "boundary_resolve": f"WITH RECURSIVE {BOOK_PAGES} SELECT tag_id, page_id, position::INT AS resolved_position FROM bp",
    "chapter_sequence": """WITH a AS (SELECT o_custkey::VARCHAR AS tag_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 END AS n FROM orders) SELECT tag_id, (CASE WHEN coalesce(max(n), 0) > 0 THEN max(n) ELSE count(*) END + 1)::INT AS next_sequence FROM a GROUP BY tag_id""",
    "summary_fingerprint": """SELECT conv_id::VARCHAR AS tag_id, count(*) AS n, sha256(string_agg(printf('chapter_%04d', turn + 1) || chr(0) || '2026-02-03T04:05:06Z' || chr(0) || text || chr(0), '' ORDER BY turn, text)) AS fingerprint FROM conversations WHERE role <> 'system' GROUP BY conv_id""",
    "summary_cache_valid": "SELECT conv_id, turn, (conv_id % 3 = 0 OR conv_id % 2 = 0) AND turn % 5 <> 0 AND turn % 4 <> 0 AS valid FROM conversations",
    "latest_chapter": """WITH a AS (SELECT conv_id::VARCHAR AS tag_id, CASE WHEN turn = 2 THEN 'loose' ELSE printf('chapter_%04d', turn + 1) END AS chapter_id, turn FROM conversations WHERE role <> 'system') SELECT tag_id, arg_max(chapter_id, CASE WHEN chapter_id = 'loose' THEN 1000 ELSE turn END) AS chapter_id FROM a GROUP BY tag_id""",
    "page_range_label": f"""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 30 END AS s, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 30 END AS e, o_orderkey % 2 = 0 AS en, greatest(0.1, o_orderkey % 50 / 10) AS p FROM orders)
        SELECT o_orderkey, CASE WHEN s IS NULL AND e IS NULL THEN CASE WHEN en THEN 'without page number' ELSE 'ohne Seitenzahl' END WHEN s IS NULL THEN CASE WHEN en THEN 'through page ' ELSE 'bis Seite ' END || e WHEN e IS NULL THEN CASE WHEN en THEN 'from page ' ELSE 'ab Seite ' END || s
            WHEN s = e THEN CASE WHEN en THEN 'page ' ELSE 'Seite ' END || s ELSE CASE WHEN en THEN 'pages ' ELSE 'Seiten ' END || s || '-' || e END AS label, regexp_replace(printf('%.1f', p::DOUBLE), '\\.0$', '') AS pages, greatest(25, {half_even("p * 250")})::INT AS words FROM a""",
    "reading_stream": f"""WITH {V_PAGES}, p AS (SELECT tag_id, page_number, {norm("text")} AS t FROM v_pages), q AS (SELECT *, length(t) + 1 AS n FROM p WHERE t <> ''), r AS (SELECT *, 1 + coalesce(sum(n) OVER (PARTITION BY tag_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM q),
        b AS (SELECT tag_id, regexp_extract_all(string_agg(t, ' ' ORDER BY page_number), '[^.!?]*[.!?]["''»«”“)]*|[^.!?]+$') AS s FROM q GROUP BY tag_id),
        c AS (SELECT tag_id, generate_subscripts(s, 1) AS i, unnest(s) AS raw FROM b), d AS (SELECT *, 1 + coalesce(sum(length(raw)) OVER (PARTITION BY tag_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM c),
        e AS (SELECT *, pos + length(raw) - length(ltrim(raw)) AS f, pos + length(rtrim(raw)) AS g FROM d WHERE trim(raw) <> '')
        SELECT e.tag_id, row_number() OVER (PARTITION BY e.tag_id ORDER BY i) AS position, trim(raw) AS text, regexp_matches(trim(raw), '[.!?][\\s"''»«”“)]*$') AS complete, string_agg(printf('page_%04d', r.page_number), ',' ORDER BY r.page_number) AS source_pages
        FROM e JOIN r ON r.tag_id = e.tag_id AND r.a < e.g AND r.a + r.n > e.f GROUP BY e.tag_id, i, raw""",
    "alias_resolution": """WITH t AS (SELECT DISTINCT o_custkey AS scan, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS tech, o_orderkey % 97 AS u FROM orders),
        r AS (SELECT *, CASE WHEN tech = 1 THEN 1 WHEN u % 5 = 0 THEN 2 WHEN u % 3 = 0 THEN 3 ELSE 4 END AS rule FROM t), b AS (SELECT scan, min(rule) AS rule, arg_min(CASE WHEN rule = 2 THEN 'BOOK' || u ELSE 'U' || u END, (rule, 'U' || u)) AS tag_id, count(DISTINCT u) AS n FROM r GROUP BY scan)
        SELECT scan, CASE WHEN rule < 4 OR n = 1 THEN tag_id END AS tag_id, CASE WHEN rule < 4 OR n = 1 THEN rule END AS rule FROM b""",
    "language_consistency": """WITH p AS (SELECT source AS tag_id, lang AS pl, CASE WHEN ends_with(source, '1') THEN 'en' ELSE 'de' END AS language FROM documents) SELECT tag_id, language, count(*) AS n_pages FROM p WHERE pl <> language GROUP BY ALL""",
    "book_upsert": """WITH s AS (SELECT user_id, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS a, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS z, CASE WHEN user_id % 2 = 0 THEN 'de' ELSE 'en' END AS lang FROM events GROUP BY user_id),
        b AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' END AS language FROM customer), j AS (SELECT coalesce(k, user_id) AS id, k IS NOT NULL AS old, b.language, s.*, k IS NOT NULL AND lang IS NOT NULL AND coalesce(b.language, 'de') <> lang AS clash FROM b FULL JOIN s ON k = user_id)
        SELECT id::VARCHAR AS tag_id, CASE WHEN old THEN '2023-05-06T00:00:00' ELSE a END AS created_at, CASE WHEN clash OR a IS NULL THEN '2023-06-07T00:00:00' ELSE z END AS last_seen_at, CASE WHEN NOT old THEN lang WHEN language IS NULL AND lang = 'de' THEN 'de' ELSE language END AS language FROM j""",
    "nfc_parse": """WITH k AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0) SELECT k AS line_id, 'iso14443a' AS technology, 'AA' || lpad((k % 100)::VARCHAR, 2, '0') AS uid, (k % 3)::INT AS reader_id, 0 AS position FROM k WHERE k % 2 = 1
        UNION ALL SELECT k, 'iso15693', 'E0' || lpad((k % 50)::VARCHAR, 2, '0'), (k % 3)::INT, 1 FROM k""",
    "nmcli_parse": "SELECT 'net:' || c_custkey AS name, 'uuid-' || c_custkey AS uuid, '802-11-wireless' AS kind, 'wlan0' AS device FROM customer WHERE c_custkey % 2 = 0",
    "orientation_vote": f"""WITH {V_LINES}, c AS (SELECT tag_id, page_number, CASE WHEN length(text) % 4 = 0 THEN 180 ELSE 0 END AS l, 0.4::DOUBLE + (length(text) % 7) / 10.0::DOUBLE AS c FROM v_lines WHERE line_index < 3),
        v AS (SELECT tag_id, page_number, count(*) AS n, count(*) FILTER (c >= 0.55) AS accepted, coalesce(sum(c) FILTER (c >= 0.55 AND l = 0), 0) - coalesce(sum(c) FILTER (c >= 0.55 AND l = 180), 0) AS d FROM c GROUP BY ALL)
        SELECT tag_id, page_number, n, accepted, CASE WHEN n >= 3 AND accepted >= 2 THEN CASE WHEN d > 0.35 THEN 0 WHEN d < -0.35 THEN 180 END END AS rotation_deg FROM v""",
    "orientation_locf": f"""WITH {V_PAGES}, s AS (SELECT tag_id, scan_id, CASE length(text) % 5 WHEN 0 THEN 'reader1' WHEN 1 THEN 'reader2' END AS vote FROM v_pages WHERE side = 'left')
        SELECT tag_id, scan_id, coalesce(last_value(vote IGNORE NULLS) OVER (PARTITION BY tag_id ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'reader2') AS orientation FROM s""",
    "volume_levels": f"""WITH r AS (SELECT p_partkey, p_size::INT AS lo, floor(p_retailprice / 10)::INT AS span, (p_size + 1)::INT AS n FROM part),
        l AS (SELECT *, lo + floor(span / 3)::INT AS wanted, list_transform(range(n), lambda i: round_even(lo + span * i / (n - 1)::DOUBLE, 0)::INT) AS a FROM r)
        SELECT p_partkey, n, array_to_string(a, ',') AS levels, (list_position(list_transform(a, lambda x: abs(x - wanted)), list_min(list_transform(a, lambda x: abs(x - wanted)))) - 1)::INT AS nearest FROM l""",
    "stream_usage_window": f"""WITH {V_USAGE} SELECT (ts - INTERVAL 4 HOURS)::DATE AS period_key, tag_id, count(*) AS n, round(sum(CASE WHEN kind = 'audio' AND seconds > 0 THEN seconds ELSE 0 END), 3) AS audio_seconds FROM v_usage GROUP BY ALL""",
    "stream_sections": f"WITH RECURSIVE {BOOK_PAGES} SELECT tag_id, sequence, start_position::INT AS start_position, start_offset::INT AS start_offset, end_position::INT AS end_position, end_offset::INT AS end_offset, next_position::INT AS next_position, next_offset::INT AS next_offset, boundary_kind FROM bounds",
    "stream_pending_tail": f"""WITH {SPOKEN} SELECT tag_id, substr(s.created_at, 15, 2)::DOUBLE AS seq, side, (SELECT nullif(trim(p.tail_fragment), '') FROM spoken p WHERE p.tag_id = s.tag_id AND p.side = 'right' AND p.created_at < s.created_at ORDER BY p.created_at DESC LIMIT 1) AS pending FROM spoken s""",
    "contrast_bounds": "SELECT lang, round(quantile_cont(n_chars, 0.05), 6) AS low, round(quantile_cont(n_chars, 0.95), 6) AS high FROM documents GROUP BY lang",
    "stale_gaps": "SELECT * FROM (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since, ts AS until FROM events) WHERE until - since > INTERVAL 86400 SECONDS",
    "new_page_keys": f"WITH {V_USAGE}, f AS (SELECT tag_id, page_key, min((ts - INTERVAL 4 HOURS)::DATE) AS day FROM v_usage WHERE kind = 'scan' GROUP BY ALL) SELECT tag_id, day, count(*) AS n FROM f GROUP BY ALL",
    "neighbour_distance": """WITH p AS (SELECT DISTINCT o_orderkey % 50 AS board, o_orderkey % 7 AS r, o_orderkey % 11 AS c, (o_orderkey % 7 * 10 + o_orderkey % 50 % 3)::DOUBLE AS x, (o_orderkey % 11 * 12)::DOUBLE AS y FROM orders),
        d AS (SELECT a.board, median(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS d FROM p a JOIN p b ON a.board = b.board AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)) GROUP BY a.board) SELECT DISTINCT p.board, round(coalesce(d, 10.0), 6) AS distance FROM p LEFT JOIN d USING (board)""",
    "empty_scans": f"WITH {V_PAGES} SELECT tag_id, scan_id FROM v_pages GROUP BY ALL HAVING bool_and(page_number % 40 < 6)",
    "plausibility_score": f"""WITH {V_LINES}, p AS (SELECT tag_id, page_number, string_agg(text, ' ' ORDER BY line_index) AS t, avg(confidence) AS c FROM v_lines GROUP BY ALL),
        q AS (SELECT *, len(list_filter({words("t")}, lambda w: regexp_matches(w, '[A-Za-zÄÖÜäöüß]{{2,}}')))::DOUBLE / greatest(len({words("t")}), 1) AS v, {letters("t")}::DOUBLE / length(t) AS a, CASE WHEN regexp_matches(t, '[.?!,:;]') THEN 1.0::DOUBLE ELSE 0 END AS m, CASE WHEN regexp_matches(t, '\\p{{Ll}}') THEN 1.0::DOUBLE ELSE 0 END AS l FROM p)
        SELECT tag_id, page_number, round(c * 0.6::DOUBLE + v * 0.25::DOUBLE + a * 0.05::DOUBLE + m * 0.2::DOUBLE + l * 0.1::DOUBLE, 6) AS detector, round(c * 0.6::DOUBLE + v * 0.24::DOUBLE + (a + m + l) * 0.08::DOUBLE, 6) AS capture FROM q""",
}
