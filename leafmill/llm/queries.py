"""The registered queries of this folder. Each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, license_scan, line_dedup, packing, quality_cnn, quality_rules, resampling, tokens, trie, url_tree, warc
from .common import Scratch, look_up, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_tree.bad_by_document(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return url_tree.judge(pages, F.col("_bad")).select("page_id", "host", "path", "rule", "verdict")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("failed_rule")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_turns(turns.withColumn("parts", chat.text_part(F.col("text")))))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


#: The first turns that a conversation takes from another: as many as a checksum of its id says, below this number.
HEADS = 9


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt so that neighbours share first turns, each from the conversation whose id is the next multiple of five towards zero."""
    scratch = Scratch(spark, "op13")
    turns = scratch.save(trie.ordered(table(spark, sf_dir, "conversations"), scratch), "turns")
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % HEADS
    of = lambda c: c - c % 5
    c = F.col("conv_id")
    known = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    bases = known.where(c % 5 == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    known = known.withColumn("base", of(c)).join(bases, "base", "left").select("conv_id", "n", F.least(head(c), F.coalesce("n_base", F.lit(0))).alias("taken"))
    own = look_up(turns.where(F.col("position") > head(c)), known, ["conv_id"], "n", turns.count(), F.col("position"), "inner")
    own = own.select("conv_id", (F.col("position") - head(c) + F.col("taken")).alias("position"), "digest", "n_bytes")
    takers = F.explode(F.array(*[F.try_add(c, F.lit(k)) for k in range(-4, 5)]))
    first = turns.where((c % 5 == 0) & (F.col("position") < HEADS)).select(c.alias("base"), takers.alias("conv_id"), "position", "digest", "n_bytes")
    first = first.where((of(c) == F.col("base")) & (F.col("position") <= head(c))).join(known.select("conv_id"), "conv_id", "left_semi").drop("base")
    return trie.build(scratch.save(own.unionByName(first), "rebuilt"), scratch, known.select("conv_id"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_warc, op3_urls, op4_jaccard, op5_lines, op6_quality, op7_decontamination, op8_licenses, op9_rules, op10_chat, op11_resampling, op12_token_ids, op13_prefix_trie)}

SQL: dict[str, str] = {
    "op4_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS (SELECT x, y FROM p UNION SELECT y, x FROM p), r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
        c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
        SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(c.y, s.doc_id)) AS component_id FROM s LEFT JOIN c ON c.x = s.doc_id""",
    "op5_lines": """
        WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
        k AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE length(line) >= 20 GROUP BY line),
        c AS (SELECT line, first, length(line) AS n, substr(line, 1, length(line) // 2) AS head, substr(line, length(line) // 2 + 1) AS tail,
            substr(line, 1, (length(line) - 1) // 2) AS head1, substr(line, (length(line) - 1) // 2 + 2) AS tail1 FROM k),
        p AS (SELECT a.line AS x, a.first AS xf, b.line AS y, b.first AS yf FROM c a JOIN c b ON a.n = b.n AND a.head = b.head WHERE a.line <> b.line
            UNION ALL SELECT a.line, a.first, b.line, b.first FROM c a JOIN c b ON a.n = b.n AND a.tail = b.tail WHERE a.line <> b.line
            UNION ALL SELECT a.line, a.first, b.line, b.first FROM c a JOIN c b ON a.n + 1 = b.n AND a.head = b.head1
            UNION ALL SELECT a.line, a.first, b.line, b.first FROM c a JOIN c b ON a.n + 1 = b.n AND a.tail = b.tail1),
        q AS (SELECT x, xf, y, yf FROM p UNION SELECT y, yf, x, xf FROM p),
        near AS (SELECT DISTINCT x AS line FROM q WHERE yf < xf AND abs(length(x) - length(y)) <= 1 AND list_max(list_transform(range(length(x) + 1), lambda i:
            CASE WHEN substr(x, 1, i) = substr(y, 1, i) AND (substr(x, i + 2) = substr(y, i + 2) OR substr(x, i + 1) = substr(y, i + 2) OR substr(x, i + 2) = substr(y, i + 1)) THEN 1 ELSE 0 END)) = 1),
        j AS (SELECT l.*, length(l.line) >= 20 AND ((l.doc_id, l.pos) <> k.first OR near.line IS NOT NULL) AS gone FROM l LEFT JOIN k USING (line) LEFT JOIN near USING (line))
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, FALSE)), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped_lines FROM j GROUP BY doc_id""",
    "op10_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(replace(replace(text, chr(92), chr(92) || 'b'), '<|', chr(92) || 'p')) + length(replace(replace(replace(role, chr(92), chr(92) || 'b'), '<|', chr(92) || 'p'), '|>', chr(92) || 'q')) + 18)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op11_resampling": r"""
        WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM bits WHERE k < 8),
        tab AS (SELECT i, c FROM bits WHERE k = 8),
        w AS (SELECT 0 AS src, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        f AS (SELECT src, id, g, count(*) AS n FROM (SELECT src, id, unnest(w) AS g FROM w UNION ALL
            SELECT src, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) GROUP BY src, id, g),
        crc(g, h, p, c) AS (SELECT g, lower(hex(encode(g))), 0, 4294967295 FROM (SELECT DISTINCT g FROM f) UNION ALL
            SELECT g, h, p + 1, xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON tab.i = xor(crc.c & 255,
                (strpos('0123456789abcdef', substr(h, 2 * p + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 * p + 2, 1)) - 1) WHERE 2 * p < length(h)),
        b AS (SELECT src, id, n, xor(c, 4294967295) % 10000 AS b FROM f JOIN (SELECT g, c FROM crc WHERE 2 * p = length(h)) USING (g)),
        t AS (SELECT b, sum(n) FILTER (src = 0) AS s, sum(n) FILTER (src = 1) AS t FROM b GROUP BY b),
        a AS (SELECT sum(s) AS s, sum(t) AS t FROM t),
        gain AS (SELECT b, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (coalesce(a.s, 0) + 10000) / ((coalesce(t.s, 0) + 1)::DOUBLE * (coalesce(a.t, 0) + 10000))))::BIGINT AS gain FROM t, a),
        d AS (SELECT id, sum(n) AS n, sum(n * gain)::BIGINT AS g FROM b JOIN gain USING (b) WHERE src = 0 GROUP BY id),
        x AS (SELECT w.id AS doc_id, len(w) AS n_words, coalesce(d.n, 0)::BIGINT AS n_features, CASE WHEN d.n IS NULL THEN 0 ELSE floor(d.g::DOUBLE / d.n)::BIGINT END AS weight,
            list_sum(list_transform(range(8), lambda i: ((strpos('0123456789abcdef', substr(sha256('7:' || w.id), i + 1, 1)) - 1)::BIGINT << (28 - 4 * i))))::DOUBLE AS h FROM w LEFT JOIN d USING (id) WHERE src = 0),
        y AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM x),
        z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM y WHERE n_words >= 20)
        SELECT y.doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM y LEFT JOIN z USING (doc_id)""",
    "op13_prefix_trie": """
        WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM bits WHERE k < 8),
        tab AS (SELECT i, c FROM bits WHERE k = 8),
        crc(id, s, p, c) AS (SELECT id, id::VARCHAR, 1, 4294967295 FROM (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL) UNION ALL
            SELECT id, s, p + 1, xor(crc.c >> 8, tab.c) FROM crc JOIN tab ON tab.i = xor(crc.c & 255, ascii(substr(s, p, 1))) WHERE p <= length(s)),
        h AS (SELECT id, xor(c, 4294967295) % 9 AS h FROM crc WHERE p > length(s)),
        l AS (SELECT conv_id AS id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        r AS (SELECT h.id, list_concat(CASE WHEN b.l IS NULL THEN o.l[1:0] ELSE b.l[1:h] END, o.l[h + 1:]) AS l FROM h JOIN l o ON o.id = h.id LEFT JOIN l b ON b.id = h.id - h.id % 5),
        m AS (SELECT id, l, unnest(range(len(l) + 1)) AS d FROM r),
        n AS (SELECT d, l[1:d] AS p, min(id) AS c, count(*) AS n, max(CASE WHEN d > 0 THEN octet_length(encode(l[d].t)) ELSE 0 END) AS bytes,
            sha256(coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (len(l) = d), '')) AS ends FROM m GROUP BY d, l[1:d]),
        k AS (SELECT n.*, p[1:d - 1] AS up, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.p[1:x.d - 1] = n.p) AS kids FROM n)
        SELECT a.c AS conv_id, a.d AS depth, u.c AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, a.ends AS ends_sha256
        FROM k a LEFT JOIN n u ON u.d = a.d - 1 AND u.p = a.up
        JOIN (SELECT a.d, a.p, count(*) FILTER (b.kids = 0) AS leaves, sum((b.n - 1) * b.bytes)::BIGINT AS saved FROM k a JOIN k b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.d, a.p) s ON s.d = a.d AND s.p = a.p""",
    "op2_warc": """
        WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT h, max(page_id) AS m FROM d GROUP BY h)
        SELECT page_id, n AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
                (strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16
                + greatest(strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1, 0)) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '') AS payload_digest,
            CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < m THEN m END AS refers_to
        FROM d JOIN g USING (h)""",
}
