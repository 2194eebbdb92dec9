"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.bestpos import rank_documents
from geoloom.llm.columnbwt import drop_repeats
from geoloom.llm.covertree import near_vectors
from geoloom.llm.ledger import ledger, passes
from geoloom.llm.licenses import scan_licenses
from geoloom.llm.merge_dropout import decode, encode, load_pieces, model_path
from geoloom.llm.oddsketch import near_duplicates
from geoloom.llm.packing import pack
from geoloom.llm.pii import KINDS, find_pii, listed
from geoloom.llm.pitman_yor import score_texts
from geoloom.llm.store import LOWER, UPPER
from geoloom.llm.urlrules import judge_urls
from geoloom.llm.warc import read_archive, write_archive
from geoloom.llm.whitening import whiten
from geoloom.session import work_folder
from geoloom.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


@query("op6_pii")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("row.doc_id"), *map(count, KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)),
t AS (SELECT r, p, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, tri) AS n FROM t WHERE tri IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, (SELECT count(*) FROM w WHERE w.r = d.r) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_symbols > n_words)::BIGINT
    + 8 * (word_chars > 25 * n_words)::BIGINT + 16 * (2 * word_chars < 3 * n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines)::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words,
  failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM b
""".replace("\\\\", "\\")


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    marked = ledger(table(spark, folder, "documents"))
    return marked.select(
        F.col("row.doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), F.col("bits").alias("failure_bits"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, h, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM q
"""


@query("op1_warc_archive", WARC_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    archive = work_folder(spark, "archive")
    write_archive(table(spark, folder, "pages"), archive)
    return read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RULES_SQL = "('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')"
URL_SQL = f"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, r, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host FROM p),
u AS (SELECT page_id, r, coalesce(host, '') AS host, coalesce(regexp_extract(substr(rest, length(host) + 1), '^[^?#]*'), '') AS path FROM h),
rules AS (SELECT action, rule, split_part(rule, '/', 1) AS rh, substr(rule, position('/' IN rule)) AS rp FROM (VALUES {RULES_SQL}) v(action, rule)),
fit AS (SELECT r, action, rule, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, length(rh) DESC, action DESC) AS k
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (r)
"""


@query("op2_url_filter", URL_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {RULES_SQL} AS r(action, rule)")
    return judge_urls(table(spark, folder, "pages"), rules)


@query("op7_license_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents")).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query("op4_embedding_near_dedup", VECTOR_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query("op5_merge_dropout")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    pieces = load_pieces(model_path(spark))
    found = decode(encode(table(spark, folder, "documents"), pieces), pieces)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


@query("op10_lm_score")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


@query("op11_repeated_passages")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeats(table(spark, folder, "documents"))


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".replace("{UPPER}", UPPER).replace("{LOWER}", LOWER)
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS l FROM documents),
n AS (SELECT r, doc_id, len(l) AS n FROM d WHERE len(l) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(l) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2e0 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, docs),
x AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN n USING (r), s GROUP BY item_id, doc_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score::BIGINT AS score FROM k WHERE rank <= 10
"""


@query("op12_ranked_search", SEARCH_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
