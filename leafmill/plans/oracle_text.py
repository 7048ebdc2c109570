"""SQL twins of queries on repaired and spoken text, and of folds, as recursive queries. They share no code with the queries."""

from __future__ import annotations

from .oracle import BOOK_PAGES, CARDINAL_DE, CARDINAL_EN, V_LINES, V_PAGES, chapter_number, heading_line, heading_shape, layout_heading, norm, norm_ends, title_case, upper_heading, words

W = "[\\p{L}\\p{M}\\p{N}\\p{Pc}]"


def collapsed_ctes(source: str, column: str, out: str, prefix: str) -> str:
    """Adds ``out``: runs of three or more letters that stand alone in ``column`` lose the gaps between them."""
    ends = f"regexp_matches({{}}, '(?:^|[^\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}\\p{{{{Pc}}}}])\\p{{{{L}}}}$')".format("a[i - 1]").replace("{{", "{").replace("}}", "}")
    begins = f"regexp_matches({{}}, '^\\p{{{{L}}}}(?:$|[^\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}\\p{{{{Pc}}}}])')".format("a[i + 1]").replace("{{", "{").replace("}}", "}")
    return f"""
    {prefix}a AS (SELECT *, regexp_extract_all({column}, '[^\\S\\r\\n]+|[\\S\\r\\n]+') AS a FROM {source}),
    {prefix}b AS (SELECT *, list_transform(range(1, len(a) + 1), lambda i: i > 1 AND regexp_matches(a[i], '^[^\\S\\r\\n]+$') AND coalesce({ends}, FALSE) AND coalesce({begins}, FALSE)) AS ok FROM {prefix}a),
    {prefix} AS (SELECT * EXCLUDE (a, ok), array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN ok[i] AND ((length(a[i + 1]) = 1 AND coalesce(ok[i + 2], FALSE)) OR (i > 2 AND length(a[i - 1]) = 1 AND coalesce(ok[i - 2], FALSE))) THEN '' ELSE a[i] END), '') AS {out} FROM {prefix}b)"""


GLUE = "i < len(l) AND right(l[i], 1) = '-' AND regexp_matches(l[i + 1], '^\\p{Ll}')"


def paragraph_ctes(source: str, prefix: str) -> str:
    """Replaces ``ls``, the lines of a paragraph, by its repaired ``text``."""
    return f"""
    {prefix}l AS (SELECT * EXCLUDE (ls), list_filter(list_transform(ls, lambda x: {norm_ends("coalesce(x, '')")}), lambda x: x <> '') AS l FROM {source}),
    {prefix}m AS (SELECT * EXCLUDE (l), array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN {GLUE} THEN left(l[i], -1) WHEN i < len(l) THEN l[i] || ' ' ELSE l[i] END), '') AS m FROM {prefix}l),
    {collapsed_ctes(f"{prefix}m", "m", "c", f"{prefix}c")},
    {prefix}h AS (SELECT * EXCLUDE (m, c), CASE WHEN {upper_heading("c")} THEN {title_case("c")} ELSE c END AS h FROM {prefix}c),
    {prefix}w AS (SELECT * EXCLUDE (h), string_split(array_to_string(list_filter({words("h")}, lambda w: NOT regexp_matches(w, '^\\p{{L}}$') AND NOT (regexp_matches(w, '^\\p{{L}}{{2}}$') AND NOT regexp_matches(w, '[\\p{{Lu}}\\p{{Lt}}]') AND regexp_matches(w, '\\p{{Ll}}') AND NOT regexp_matches(w, '[aeiouäöüAEIOUÄÖÜ]'))), ' '), '%') AS a FROM {prefix}h),
    {prefix} AS (SELECT * EXCLUDE (a), {norm("array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || CASE WHEN i < len(a) AND regexp_matches(rtrim(a[i]), '[0-9]$') THEN '%' ELSE '' END), '')")} AS text FROM {prefix}w)"""


#: Pages with numbers found or inferred, and the lines left without number and footer.
CLEANED = (
    V_LINES
    + """,
    c0 AS (SELECT *, max(bottom) OVER (PARTITION BY tag_id, page_number) AS m, try_cast(nullif(regexp_extract(text, '^[\\[(]?\\s*([0-9]{1,4})\\s*[\\])]?$', 1), '') AS INT) AS num FROM v_lines),
    c1 AS (SELECT tag_id, scan_id, side, page_number AS true_number, any_value(language) AS language, arg_max({'p': line_index, 'd': num}, ((top + bottom) / 2.0 / greatest(1, m), num, -line_index)) FILTER (num IS NOT NULL) AS x,
        max(line_index) FILTER (regexp_matches(text, '^[0-9IiLlOoSsZzBbGgQq]{1,4}$') AND bottom / greatest(1, m) >= 0.93) AS foot FROM c0 GROUP BY tag_id, scan_id, side, page_number),
    c2 AS (SELECT * EXCLUDE (x), x.p AS spot, CASE WHEN x.d > 0 THEN x.d END AS num FROM c1),
    c3 AS (SELECT *, count(*) OVER w AS n, count(num) OVER w AS k, max(num) OVER w AS o, max(CASE WHEN num IS NOT NULL THEN side END) OVER w AS os FROM c2 WINDOW w AS (PARTITION BY tag_id, scan_id)),
    c4 AS (SELECT *, n = 2 AND k = 1 AND num IS NULL AND coalesce(CASE WHEN side = 'left' AND os = 'right' THEN o - 1 WHEN side = 'right' AND os = 'left' THEN o + 1 END, 0) >= 1 AS inferred FROM c3),
    cl AS (SELECT c.tag_id, c.true_number, c.language, l.text, row_number() OVER (PARTITION BY c.tag_id, c.true_number ORDER BY l.line_index) - 1 AS i, count(*) OVER (PARTITION BY c.tag_id, c.true_number) AS n_lines
        FROM v_lines l JOIN c4 c ON c.tag_id = l.tag_id AND c.true_number = l.page_number WHERE l.line_index IS DISTINCT FROM c.spot AND NOT (c.inferred AND l.line_index IS NOT DISTINCT FROM c.foot))"""
)
CHAPTER = "(?i)^(?:(?:kapitel|chapter)\\s+)?([0-9]{1,3}|[ivxlcdm]+)(?:\\s*[:.-]\\s*(.+))?$"
MARKERS = (
    CLEANED
    + f""",
    m0 AS (SELECT *, lead(text) OVER (PARTITION BY tag_id, true_number ORDER BY i) AS after, regexp_matches(text, '(?i)^(kapitel|chapter)\\b') AS label, nullif({norm(f"regexp_extract(text, '{CHAPTER}', 2)")}, '') AS heading, regexp_extract(text, '{CHAPTER}', 1) AS no FROM cl),
    m1 AS (SELECT *, regexp_matches(text, '{CHAPTER}') AS is_marker, heading IS NULL AND label AND after IS NOT NULL AND coalesce({heading_line("after")}, FALSE) AS follows FROM m0),
    m2 AS (SELECT tag_id, true_number, i AS line_index, {chapter_number("no")} AS chapter_number, coalesce(heading, CASE WHEN follows THEN after END) AS chapter_heading, CASE WHEN follows THEN 2 ELSE 1 END AS consumed_line_count,
        CASE WHEN heading IS NOT NULL THEN 'explicit_inline_heading' WHEN follows THEN 'explicit_following_heading' WHEN label THEN 'explicit_label' ELSE 'number_only' END AS detection_kind FROM m1 WHERE is_marker),
    m3 AS (SELECT c.* FROM cl c WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.tag_id = c.tag_id AND m2.true_number = c.true_number AND c.i BETWEEN m2.line_index AND m2.line_index + m2.consumed_line_count - 1)),
    m4 AS (SELECT *, count(*) OVER (PARTITION BY tag_id, true_number) AS left_over FROM m3),
    markers AS (SELECT * FROM m2 UNION ALL SELECT tag_id, true_number, i, NULL, text, 1, 'heading_only_page' FROM m4 WHERE left_over = 1 AND {heading_line("text")} AND {heading_shape("text")})"""
)
SPEECH = (
    MARKERS
    + f""",
    r0 AS (SELECT c.*, m.chapter_number AS n, CASE WHEN {upper_heading("c.text")} THEN {title_case("c.text")} ELSE c.text END AS plain, {upper_heading("c.text")} AS upper
        FROM cl c LEFT JOIN markers m ON m.tag_id = c.tag_id AND m.true_number = c.true_number AND m.line_index = c.i AND m.detection_kind = 'number_only' AND m.chapter_number IS NOT NULL),
    r1 AS (SELECT *, CASE WHEN n IS NULL THEN '' WHEN n > 999 THEN n::VARCHAR WHEN language = 'en' THEN (SELECT {CARDINAL_EN}) ELSE (SELECT {CARDINAL_DE}) END AS said FROM r0),
    r2 AS (SELECT tag_id, true_number, language, i, CASE WHEN n IS NOT NULL THEN [chr(1), CASE WHEN language = 'en' THEN 'Chapter ' ELSE 'Kapitel ' END || said || '.', ''] WHEN upper AND i < n_lines - 1 THEN [plain, ''] ELSE [plain] END AS xs FROM r1),
    r3 AS (SELECT tag_id, true_number, language, i, generate_subscripts(xs, 1) AS j, unnest(xs) AS x FROM r2),
    r4 AS (SELECT *, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM r3 WINDOW w AS (PARTITION BY tag_id, true_number ORDER BY i, j)),
    r5 AS (SELECT *, px IS NOT NULL AND right(rtrim(px), 1) = '-' AND x <> '' AND regexp_matches(ltrim(x), '^\\p{{Ll}}') AS joins, coalesce(right(rtrim(x), 1) = '-' AND nx <> '' AND regexp_matches(ltrim(nx), '^\\p{{Ll}}'), FALSE) AS cut FROM r4),
    r6 AS (SELECT *, CASE WHEN x = chr(1) THEN CASE WHEN coalesce(px, '') <> '' THEN chr(10) ELSE '' END ELSE CASE WHEN px IS NULL OR joins THEN '' ELSE chr(10) END || CASE WHEN cut THEN left(rtrim(CASE WHEN joins THEN ltrim(x) ELSE x END), -1) WHEN joins THEN ltrim(x) ELSE x END END AS piece FROM r5),
    r7 AS (SELECT tag_id, true_number, any_value(language) AS language, {norm_ends("string_agg(piece, '' ORDER BY i, j)")} AS said FROM r6 GROUP BY tag_id, true_number),
    {collapsed_ctes("r7", "said", "speak", "r8")},
    r9 AS (SELECT c.tag_id, c.true_number, {norm_ends("string_agg(c.text, chr(10) ORDER BY c.i)")} AS clean_text FROM cl c WHERE c.text <> '' GROUP BY ALL)"""
)
DOCTOR = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])Dr\\.(\\s|$)', '\\1Doktor\\2', 'g')"
DAME = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_-])Notre-Dame($|[^\\p{{L}}\\p{{M}}\\p{{N}}_-])', '\\1Notre Damm\\2', 'g')"


def german(x: str) -> str:
    return DAME.format(DAME.format(DOCTOR.format(DOCTOR.format(x))))


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def unescaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def pause(ms: int) -> str:
    return f'<break time="{ms}ms"/>'


def ssml(x: str) -> str:
    """Announcements that stand as a block of their own, between marks 1 and 2, get a pause before and after."""
    t = f"regexp_replace({escaped(norm_ends(x))}, '(?im)(^kapitel [^\\n]+?\\.)\\n(?:\\s*\\n)+', chr(1) || '\\1' || chr(2), 'g')"
    body = f"regexp_replace(replace(regexp_replace(regexp_replace({t}, '^\\s*\\x01', ''), '\\s*\\x02\\s*\\x01', '{pause(1350)}', 'g'), chr(2), '{pause(1350)}'), '\\s*\\x01', '{pause(1350)}', 'g')"
    return f"CASE WHEN {norm_ends(x)} = '' THEN '<speak></speak>' ELSE '<speak>' || {body} || '</speak>' END"


QUOTED = "(regexp_matches({0}, '^(?:\"[^\"\\n]+\"|„[^“\\n]+“|»[^«\\n]+«)$') AND regexp_matches({0}, '[.!?…][\"“«]$'))"
QUESTION = "(?s)^(.*?)([A-Za-zÄÖÜäöüß]+)(\\?(?:[\"''«»”)\\]]*)?)$"
ENHANCED = (
    BOOK_PAGES
    + f""",
    e0 AS (SELECT tag_id, page_number, {norm_ends("clean_text")} AS t FROM bp),
    e1 AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(t, '([.?](?:["''»”)\\]]*)?)[ \\t]*\\n', '\\1' || chr(10) || chr(10), 'g'), '\\n\\s*\\n+'), lambda p: {norm("p")}), lambda p: p <> '') AS ps FROM e0),
    e2 AS (SELECT *, string_split(array_to_string(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i = 1 THEN '' WHEN {QUOTED.format("ps[i - 1]")} THEN ' ' ELSE chr(1) END || ps[i]), ''), chr(1)) AS js FROM e1 WHERE len(ps) > 0),
    e3 AS (SELECT tag_id, page_number, generate_subscripts(js, 1) AS k, unnest(js) AS p FROM e2),
    e4 AS (SELECT *, regexp_matches(p, '(?i)^kapitel\\s+.+[.!?]$') AS announced, (length(p) <= 80 AND len({words("p")}) <= 10 AND NOT regexp_matches(p, '[.!?…]["''«»”)\\]]?$')) AS heading,
        (len(list_filter({words("p")}, lambda w: regexp_matches(w, '\\p{{L}}'))) >= 2 AND len(list_filter({words("p")}, lambda w: regexp_matches(w, '\\p{{L}}') AND NOT regexp_matches(w, '^[^\\p{{L}}]*\\p{{Lu}}'))) = 0) AS titled,
        list_filter(list_transform(string_split(regexp_replace(p, '([.!?…]["''«»”)]?)\\s+([A-ZÄÖÜ0-9"„“»])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {norm_ends("s")}), lambda s: s <> '') AS ss FROM e3),
    e5 AS (SELECT tag_id, page_number, k, CASE WHEN announced OR heading THEN '<s><emphasis level="moderate">' || {escaped("p")} || '</emphasis></s>' || CASE WHEN announced OR titled THEN '{pause(1350)}' ELSE '{pause(700)}' END
        ELSE '<p>' || array_to_string(list_transform(range(1, len(ss) + 1), lambda i: CASE WHEN regexp_matches(ss[i], '{QUESTION}') THEN '<s>' || {escaped(f"regexp_extract(ss[i], '{QUESTION}', 1)")} || '<prosody pitch="+3st">' || regexp_extract(ss[i], '{QUESTION}', 2) || '</prosody>' || {escaped(f"regexp_extract(ss[i], '{QUESTION}', 3)")} || '</s>' ELSE '<s>' || {escaped("ss[i]")} || '</s>' END || CASE WHEN i = len(ss) THEN '{pause(2000)}' ELSE '{pause(900)}' END), '') || '</p>' END AS m FROM e4),
    e6 AS (SELECT tag_id, page_number, string_agg(m, '' ORDER BY k) AS body FROM e5 GROUP BY ALL),
    e7 AS (SELECT e0.tag_id, e0.page_number, CASE WHEN t = '' THEN '<speak></speak>' WHEN regexp_replace({unescaped("regexp_replace(body, '<[^>]+>', '', 'g')")}, '\\s+', '', 'g') = regexp_replace(t, '\\s+', '', 'g') AND NOT regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN '<speak>' || body || '</speak>' ELSE {ssml("t")} END AS ssml
        FROM e0 LEFT JOIN e6 ON e6.tag_id = e0.tag_id AND e6.page_number = e0.page_number)"""
)
SECONDS = "CASE WHEN regexp_matches({0}, '^\\s*[0-9]+(\\.[0-9]+)?\\s*ms\\s*$') THEN regexp_extract({0}, '([0-9.]+)', 1)::DOUBLE / 1000 WHEN regexp_matches({0}, '^\\s*[0-9]+(\\.[0-9]+)?\\s*s\\s*$') THEN regexp_extract({0}, '([0-9.]+)', 1)::DOUBLE END"

GUARD = (
    V_PAGES
    + """,
    g0 AS (SELECT tag_id, scan_id, page_number::DOUBLE AS seq, [page_number, page_number + 1] AS numbers FROM v_pages WHERE side = 'left'),
    g1 AS (SELECT * FROM g0 UNION ALL SELECT tag_id, 'again_' || scan_id, seq + 0.5, numbers FROM g0 WHERE seq::BIGINT % 20 = 1 UNION ALL SELECT tag_id, 'back_' || scan_id, seq + 10.5, numbers FROM g0 WHERE seq::BIGINT % 34 = 1),
    g2 AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY seq, scan_id) AS rn FROM g1),
    turn(tag_id, rn, seq, scan_id, decision, last_scan, pages, again, backward, held) AS (
        SELECT tag_id, 0::BIGINT, 0::DOUBLE, '', '', NULL::VARCHAR, []::BIGINT[], FALSE, FALSE, []::VARCHAR[] FROM (SELECT DISTINCT tag_id FROM g2)
        UNION ALL
        SELECT tag_id, rn, seq, scan_id, d, CASE WHEN d = 'take' THEN scan_id ELSE last_scan END, CASE d WHEN 'take' THEN numbers WHEN 'same' THEN list_distinct(list_concat(pages, numbers)) ELSE pages END,
            CASE d WHEN 'repeat' THEN TRUE WHEN 'take' THEN FALSE WHEN 'backward' THEN FALSE ELSE again END, CASE d WHEN 'backward' THEN TRUE WHEN 'take' THEN FALSE WHEN 'repeat' THEN FALSE ELSE backward END, CASE WHEN d IN ('repeat', 'backward') THEN list_append(held, scan_id) ELSE held END
        FROM (SELECT r.tag_id, r.rn, r.seq, r.scan_id, r.numbers, s.last_scan, s.pages, s.again, s.backward, s.held,
                CASE WHEN list_contains(s.held, r.scan_id) THEN 'held' WHEN r.scan_id = s.last_scan THEN 'same' WHEN s.backward THEN 'take' WHEN NOT s.again AND list_has_any(s.pages, r.numbers) THEN 'repeat' WHEN len(s.pages) > 0 AND list_min(r.numbers) < list_min(s.pages) THEN 'backward' ELSE 'take' END AS d
            FROM turn s JOIN g2 r ON r.tag_id = s.tag_id AND r.rn = s.rn + 1))
    SELECT tag_id, seq, scan_id, CASE WHEN decision IN ('take', 'same') THEN 'allow' ELSE decision END AS decision FROM turn WHERE rn > 0"""
)
CHORD = """
    k0 AS (SELECT user_id::VARCHAR AS panel, event_id * 0.02::DOUBLE AS t, CASE WHEN event_type IN ('click', 'view') THEN 'down' WHEN event_type = 'signup' THEN 'step' ELSE 'up' END AS kind, event_id % 4 AS c, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS delta FROM events),
    k1 AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY t) AS rn FROM k0),
    press(panel, rn, down, outs) AS (
        SELECT panel, 0::BIGINT, []::STRUCT(t DOUBLE, c BIGINT)[], []::STRUCT(t DOUBLE, action VARCHAR, delta INT)[] FROM (SELECT DISTINCT panel FROM k1)
        UNION ALL
        SELECT panel, rn, CASE WHEN kind = 'up' THEN list_filter(live, lambda x: x.c <> c) WHEN kind = 'down' AND c < 3 THEN CASE WHEN len(list_filter(live, lambda x: x.c <> c)) = 2 THEN [] ELSE list_append(list_filter(live, lambda x: x.c <> c), {'t': t, 'c': c}) END ELSE live END,
            list_concat(list_transform(gone, lambda x: {'t': x.t + 0.18::DOUBLE, 'action': names[x.c + 1], 'delta': 0}),
                CASE WHEN kind = 'up' AND c < 3 AND len(list_filter(live, lambda x: x.c = c)) > 0 THEN [{'t': t, 'action': names[c + 1], 'delta': 0}] WHEN kind = 'step' THEN [{'t': t, 'action': 'VOLUME_DELTA', 'delta': delta}]
                    WHEN kind = 'down' AND c = 3 THEN [{'t': t, 'action': 'ENCODER_BUTTON', 'delta': 0}] WHEN kind = 'down' AND len(list_filter(live, lambda x: x.c <> c)) = 2 THEN [{'t': t, 'action': 'DELETE_BOOK_REQUEST', 'delta': 0}] ELSE [] END)
        FROM (SELECT r.*, list_sort(list_filter(s.down, lambda x: r.t - x.t >= 0.18::DOUBLE - 1e-9::DOUBLE)) AS gone, list_filter(s.down, lambda x: r.t - x.t < 0.18::DOUBLE - 1e-9::DOUBLE) AS live, ['START_STOP', 'BOOK_SUMMARY', 'CHAPTER_SUMMARY'] AS names FROM press s JOIN k1 r ON r.panel = s.panel AND r.rn = s.rn + 1)),
    o AS (SELECT panel, unnest(outs) AS x FROM press
        UNION ALL SELECT panel, unnest(list_transform(down, lambda x: {'t': x.t + 0.18::DOUBLE, 'action': ['START_STOP', 'BOOK_SUMMARY', 'CHAPTER_SUMMARY'][x.c + 1], 'delta': 0})) FROM (SELECT panel, down FROM press QUALIFY row_number() OVER (PARTITION BY panel ORDER BY rn DESC) = 1))
    SELECT panel, x.t AS t, x.action AS action, x.delta::INT AS delta FROM o"""


def packed(units: str, keys: str, fits: str) -> str:
    """Units (keys, atoms: list of {x, fresh}) put together greedily; a fresh one begins a chunk. ``fits`` is over ``joined``."""
    return f"""
    f0 AS (SELECT {keys}, atoms, 1 AS i, ''::VARCHAR AS now, NULL::VARCHAR AS done, 0 AS nth FROM {units} WHERE len(atoms) > 0),
    fold({keys}, atoms, i, now, done, nth) AS (
        SELECT * FROM f0
        UNION ALL
        SELECT {keys}, atoms, i + 1, CASE WHEN i > len(atoms) THEN NULL WHEN now = '' OR push THEN atoms[i].x ELSE joined END, CASE WHEN push THEN now END, nth + CASE WHEN push THEN 1 ELSE 0 END
        FROM (SELECT *, now <> '' AND (i > len(atoms) OR atoms[i].fresh OR NOT ({fits})) AS push FROM (SELECT * EXCLUDE (done), now || ' ' || atoms[i].x AS joined FROM fold WHERE i <= len(atoms) + 1)))"""


FITS_BYTES = "octet_length(encode(joined)) <= 900"
TEXT_SQL: dict[str, str] = {
    "spaced_letters": f"""WITH s0 AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(\\p{{L}})(\\p{{L}})', '\\1 \\2', 'g'), '(\\p{{L}})(\\p{{L}})', '\\1 \\2', 'g') AS s FROM documents), {collapsed_ctes("s0", "s", "c", "s1")} SELECT doc_id, c AS text FROM s1""",
    "paragraph_text": f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), {paragraph_ctes("d", "q")} SELECT doc_id, text FROM q""",
    "layout_paragraphs": f"""WITH {V_LINES},
        n0 AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY tag_id, page_number) AS n, regexp_matches({norm_ends("text")}, '^[0-9]{{1,4}}$') AS d FROM v_lines WINDOW w AS (PARTITION BY tag_id, page_number ORDER BY line_index)),
        n1 AS (SELECT *, d AND (r = 1 OR (r = n AND NOT bool_or(d AND r = 1) OVER (PARTITION BY tag_id, page_number))) AS is_number FROM n0),
        i0 AS (SELECT *, lag(bottom) OVER w AS pb, lag(bottom - top) OVER w AS ph, lag({layout_heading("text")}) OVER w AS hd, avg(bottom - top) OVER (PARTITION BY tag_id, page_number) AS m FROM n1 WHERE NOT is_number WINDOW w AS (PARTITION BY tag_id, page_number ORDER BY line_index)),
        i1 AS (SELECT *, 1 + sum(CASE WHEN top - pb > CASE WHEN hd THEN greatest(1, ph) * 1.2::DOUBLE ELSE m * 1.4::DOUBLE END THEN 1 ELSE 0 END) OVER (PARTITION BY tag_id, page_number ORDER BY line_index) AS paragraph FROM i0),
        i2 AS (SELECT tag_id, page_number, paragraph::INT AS paragraph, list(text ORDER BY line_index) AS ls, count(*) AS k FROM i1 GROUP BY ALL), {paragraph_ctes("i2", "q")}
        SELECT tag_id, page_number, paragraph, CASE WHEN k <= 2 AND {layout_heading("text")} THEN 'chapter_heading' ELSE 'paragraph' END AS kind, text FROM q WHERE text <> ''""",
    "chapter_markers": f"WITH {MARKERS} SELECT tag_id, true_number, line_index::INT AS line_index, chapter_number, chapter_heading, consumed_line_count, detection_kind FROM markers",
    "page_speech": f"""WITH {SPEECH} SELECT p.tag_id, p.true_number, coalesce(r9.clean_text, '') AS clean_text, CASE WHEN p.language = 'de' THEN {german("coalesce(speak, '')")} ELSE coalesce(speak, '') END AS speak_text
        FROM c4 p LEFT JOIN r8 ON r8.tag_id = p.tag_id AND r8.true_number = p.true_number LEFT JOIN r9 ON r9.tag_id = p.tag_id AND r9.true_number = p.true_number""",
    "summary_stub": f"""WITH a AS (SELECT conv_id::VARCHAR AS tag_id, printf('chapter_%04d', turn + 1) AS chapter_id, string_split(replace(text, chr(10), ' '), '. ') AS s FROM conversations WHERE role <> 'system'),
        b AS (SELECT *, list_transform(s, lambda x: len({words("x")})) AS c FROM a), d AS (SELECT *, greatest(1, len(list_filter(range(1, len(s) + 1), lambda i: list_sum(c[1:i]) <= 25))) AS k FROM b),
        e AS (SELECT *, array_to_string(list_transform(s[1:k], lambda x: {norm_ends("x")}), '. ') AS t FROM d), f AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS summary FROM e)
        SELECT tag_id, chapter_id, summary, CASE WHEN len({words("summary")}) <= 25 * 1.1 THEN 'ok' ELSE 'too_long' END AS status FROM f""",
    "ssml_basic": f"WITH RECURSIVE {BOOK_PAGES}, x AS (SELECT tag_id, page_number, regexp_replace(clean_text, '^(Kapitel [0-9]+)\\n', '\\1.' || chr(10) || chr(10)) AS c FROM bp) SELECT tag_id, page_number, {ssml('c')} AS ssml FROM x",
    "ssml_enhanced": f"WITH RECURSIVE {ENHANCED} SELECT tag_id, page_number, ssml FROM e7",
    "ssml_to_text": f"""WITH RECURSIVE {ENHANCED}, h0 AS (SELECT tag_id, page_number, string_split_regex(ssml, '<break[^>]*>') AS ts, regexp_extract_all(ssml, '<break[^>]*>') AS bs FROM e7),
        h1 AS (SELECT *, list_transform(bs, lambda b: {SECONDS.format("regexp_extract(b, 'time=\"([^\"]*)\"', 1)")}) AS ms FROM h0),
        h2 AS (SELECT tag_id, page_number, array_to_string(list_transform(range(1, len(ts) + 1), lambda i: {unescaped(unescaped("regexp_replace(ts[i], '<[^>]+>', '', 'g')"))} || CASE WHEN i > len(bs) THEN '' WHEN ms[i] < 0.35 THEN ', ' WHEN ms[i] IS NULL OR ms[i] < 0.8 THEN chr(10) ELSE chr(10) || chr(10) END), '') AS s FROM h1)
        SELECT tag_id, page_number, {norm_ends("regexp_replace(regexp_replace(regexp_replace(s, '[ \\t\\r\\f\\x0b]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM h2""",
    "speech_pack_bytes": f"""WITH RECURSIVE t0 AS (SELECT conv_id, turn, {norm_ends("text")} AS t FROM conversations),
        t1 AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?…](?:["''«»”)\\]]+)?)(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda u: {norm_ends("u")}), lambda u: u <> '') AS us FROM t0),
        t2 AS (SELECT conv_id, turn, CASE WHEN t = '' THEN [] WHEN octet_length(encode(t)) <= 900 THEN [{{'x': t, 'fresh': FALSE}}] ELSE flatten(list_transform(us, lambda u: CASE WHEN octet_length(encode(u)) <= 900 THEN [{{'x': u, 'fresh': FALSE}}] ELSE list_transform({words("u")}, lambda w, i: {{'x': w, 'fresh': i = 1}}) END)) END AS atoms FROM t1),
        {packed("t2", "conv_id, turn", FITS_BYTES)} SELECT conv_id, turn, (nth - 1)::INT AS position, done AS chunk FROM fold WHERE done IS NOT NULL""",
    "pack_chars": f"""WITH RECURSIVE t0 AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: {{'x': x, 'fresh': FALSE}}) AS atoms FROM documents), {packed("t0", "doc_id", "length(joined) <= 1000")}
        SELECT doc_id, (nth - 1)::INT AS position, done AS batch FROM fold WHERE done IS NOT NULL""",
    "box_top3": f"""WITH {V_LINES}, b AS (SELECT tag_id, page_number, line_index AS id, ("right" - "left")::DOUBLE AS w, confidence, (top + 15)::DOUBLE AS y FROM v_lines WHERE "right" - "left" >= 120 AND "right" - "left" >= 90),
        p1 AS (SELECT tag_id, page_number, arg_min({{'id': id, 'y': y}}, (-(confidence * w), id)) AS b FROM b GROUP BY ALL),
        p2 AS (SELECT x.tag_id, x.page_number, arg_min({{'id': id, 'y': y}}, (-(confidence * w), id)) AS b FROM b x JOIN p1 USING (tag_id, page_number) WHERE abs(x.y - p1.b.y) >= 75 GROUP BY ALL),
        p3 AS (SELECT x.tag_id, x.page_number, arg_min({{'id': id, 'y': y}}, (-(confidence * w), id)) AS b FROM b x JOIN p1 USING (tag_id, page_number) JOIN p2 USING (tag_id, page_number) WHERE abs(x.y - p1.b.y) >= 75 AND abs(x.y - p2.b.y) >= 75 GROUP BY ALL),
        u AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) SELECT tag_id, page_number, (row_number() OVER (PARTITION BY tag_id, page_number ORDER BY b.y, b.id) - 1)::INT AS position, b.id AS box_id, b.y AS center_y FROM u""",
    "sequence_guard": f"WITH RECURSIVE {GUARD}",
    "stream_sequence_guard": f"WITH RECURSIVE {GUARD}",
    "chord_actions": f"WITH RECURSIVE {CHORD}",
    "stream_chord": f"WITH RECURSIVE {CHORD}",
}
