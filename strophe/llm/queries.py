"""The registered queries of the ten operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import decontam, hostrules, langid, linededup, mixing, neardup, ordering, pieces, resharding, runs, tokencounts, trie, warc

OLD_SHARDS, NEW_SHARDS = 6, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_line_dedup(spark, sf_dir):
    out = linededup.drop_boilerplate(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "host_pages", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op3_warc(spark, sf_dir):
    out = warc.archived(table(spark, sf_dir, "pages"))
    return out.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast("long").alias("refers_to"),
        F.coalesce(F.col("n_requests"), F.lit(0)).alias("n_requests"), F.coalesce(F.col("n_metadata"), F.lit(0)).alias("n_metadata"),
    )


def op4_resharding(spark, sf_dir):
    out = resharding.resharded(table(spark, sf_dir, "documents"), resharding.source_shard(OLD_SHARDS), OLD_SHARDS, NEW_SHARDS)
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, F.coalesce(F.crc32("text"), F.lit(0))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op5_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tokencounts.sample_edits().alias("edits"))
    out = tokencounts.edited(docs)
    return out.select("doc_id", "tokens_before", "tokens_after", "pieces_encoded", "nodes_updated", F.crc32("text").alias("edited_crc32"))


def op6_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_training_order(spark, sf_dir):
    return ordering.ordered(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    samples, least = langid.learn(docs.where(langid.learnable(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), samples, least)
    return out.select("doc_id", (~langid.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def op9_decontamination(spark, sf_dir):
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_host_rules(spark, sf_dir):
    return hostrules.judged(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("a"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))), 1)
    found = runs.periodic_runs(docs).withColumn("_longest", F.when(F.size("runs") > 0, longest))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_longest.start", "_longest.length", "_longest.period", F.floor(F.col("_longest.length") * 1000 / F.col("_longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op12_prefix_trie(spark, sf_dir):
    return trie.shared_opening_trie(table(spark, sf_dir, "conversations")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_piece_encoding(spark, sf_dir):
    found = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), back="decoded")
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), covered.alias("covered_bytes"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_warc, op4_resharding, op5_token_counts, op6_near_duplicates, op7_training_order, op8_language_id, op9_decontamination, op10_host_rules, op11_periodic_runs, op12_prefix_trie, op13_piece_encoding)}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce({}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The line patterns of linededup in DuckDB's dialect.
_OP2 = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\.', ''), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', chr(10), 'g'),
      '(?i)</?(p|div|li|ul|nav|h1|h2|h3|article|br|title|tr|td|table|footer|header|body|head|html)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
h AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT rid, host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM c JOIN h USING (host) WHERE host_pages >= 5 AND n > 0.3 * host_pages GROUP BY host),
k AS (SELECT page_id, p.host, host_pages, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)) AS kept
      FROM p JOIN h USING (host) LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, host_pages, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256 FROM k
"""

#: Base32 of the SHA-1: 20 bits, five hex digits, make four letters.
_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, count(*) OVER (PARTITION BY page_id, payload) AS n FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, n AS n_requests, n AS n_metadata FROM m
"""

_OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n n1 ON n1.doc_id = x JOIN n n2 ON n2.doc_id = y WHERE 100 * common >= 75 * (n1.n + n2.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP9 = f"""
WITH b AS (SELECT item_id, {_BENCH_WORDS.format('text')} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS gram, least(len(w), 10) AS m
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_BENCH_WORDS.format('text')} AS w FROM documents),
m AS (SELECT DISTINCT m FROM g),
x AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT doc_id, i, x.m, item_id FROM x JOIN g ON x.gram = g.gram AND x.m = g.m),
t AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, m)) AS k FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_OP10 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
t AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS tri FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
o AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM t) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM o) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count_if(base_failed) AS bad FROM f GROUP BY source),
s AS (SELECT avg(bad / n) AS m, coalesce(var_samp(bad / n), 0) AS v, avg(1 / n) AS inv FROM h),
q AS (SELECT m, CASE WHEN v <= 0 THEN 2.0 WHEN v - m * (1 - m) * inv <= 0 THEN 1000.0
        ELSE least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 2.0), 1000.0) END AS weight FROM s),
j AS (SELECT source, round((bad + m * weight) / (n + weight), 9) AS host_rate, round(least(0.8, m + 3 * sqrt(m * (1 - m) / (weight + 1))), 9) AS host_limit FROM h, q)
SELECT f.*, host_rate, host_limit, NOT base_failed AND NOT host_rate > host_limit AS kept FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source
"""

#: CRC-32 of a number's decimal digits, by the table of 256 remainders.
_CRC = """t AS (SELECT list(list_reduce([k] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS tab FROM (SELECT unnest(range(0, 256)) AS k)),
crc AS (SELECT id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT) AS h FROM ids, t)"""

#: Runs as islands of places whose words agree a period apart; only stretches of six equal words can be in one.
_OP11 = rf"""
WITH ids AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL), {_CRC},
d0 AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
d1 AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0 LEFT JOIN crc ON id = doc_id),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM d1),
v AS (SELECT doc_id, n, w, unnest(range(0, greatest(n, 0))) AS i FROM d),
x AS (SELECT doc_id, n, i, w[i + 1] AS word, CASE WHEN i + 6 <= n THEN array_to_string(w[i + 1:i + 6], ' ') END AS six FROM v),
p AS (SELECT b.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.six = b.six AND a.i < b.i AND 2 * (b.i - a.i) <= a.n),
l AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, s, e - s AS len, min(q) AS q FROM l WHERE e - s >= greatest(12, 2 * q) GROUP BY doc_id, s, e),
b AS (SELECT doc_id, count(*) AS n_runs, first(s ORDER BY len DESC, s, q) AS start, max(len) AS length, first(q ORDER BY len DESC, s, q) AS period, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
k AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
c AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN k ON k.doc_id = x.doc_id AND k.i = x.i WHERE k.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_OP12 = f"""
WITH ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL), {_CRC},
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
z AS (SELECT conv_id, place, role, text FROM o JOIN crc ON id = conv_id WHERE place > h % 6
      UNION ALL SELECT id, place, role, text FROM crc JOIN o ON o.conv_id = id - id % 100 WHERE place <= h % 6),
s AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY place) AS path, list(length(text) ORDER BY place) AS chars FROM z GROUP BY conv_id),
f AS (SELECT id AS conv_id, coalesce(path, []) AS path, chars FROM crc LEFT JOIN s ON s.conv_id = id),
m AS (SELECT conv_id, d AS depth, array_to_string(path[1:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], '') END AS parent, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, len(path) = d AS ended
      FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM f)),
n AS (SELECT key, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM m GROUP BY key),
c AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT substr(key, 1, 64 * k) AS key, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved FROM (SELECT n.*, n_children, unnest(range(0, depth + 1)) AS k FROM n LEFT JOIN c USING (key))),
g AS (SELECT key, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN c USING (key) JOIN g USING (key) LEFT JOIN n p ON n.parent = p.key
"""

ORACLE_SQL = {"op2_line_dedup": _OP2, "op3_warc": _OP3, "op6_near_duplicates": _OP6, "op9_decontamination": _OP9, "op10_host_rules": _OP10, "op11_periodic_runs": _OP11, "op12_prefix_trie": _OP12}
