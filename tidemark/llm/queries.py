"""The queries of the operators for training text, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, decontaminate, extract, language, licences, mixing, sharding, simhash, toxicity, urllists, variants, whitening
from tidemark.llm import media as media_columns
from tidemark.llm.text import documents, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Production parameters.
SOURCE_WEIGHTS = [5.0, 2.0, 1.0]
SHARDS = 16


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over three-word shingles, linked at two or fewer differing bits."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return simhash.groups(docs, "doc_id", "text", shingle=3, distance=2).select("doc_id", "fingerprint", "component_id")


OP5_SQL = r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, places.n, i, item_id FROM places JOIN windows USING (p, n)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op5_wu_manber", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    docs, items = documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark")
    found = decontaminate.find_passages(docs, items).select("doc_id", "found")
    hit = decontaminate.n_hit(F.col("found"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP6_SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
        FROM sized GROUP BY source),
level AS (SELECT *, source_size * 2.0::DOUBLE AS top,
   (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0.0))
   / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
   FROM per WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
target AS (SELECT source, source_size, CASE WHEN top <= level * weight THEN top
   ELSE least(top, weight * (SELECT arg_min(level, (top / weight, source IS NULL, source)) FROM level WHERE top > level * weight)) END AS target FROM level),
units AS (SELECT doc_id, sized.source, size, source_size, target,
   CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {mixing.UNIT}.0::DOUBLE + 0.5) AS BIGINT) ELSE 0 END AS units,
   CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class,
   ('0x' || substr(md5('{mixing.SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 6))::BIGINT % {mixing.PARTS} AS part,
   ('0x' || substr(md5('{mixing.SEED}/offset/' || coalesce('=' || sized.source, '')), 1, 6))::BIGINT AS start
   FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source),
run AS (SELECT *, start + CAST(sum(units) OVER (PARTITION BY source ORDER BY class, part, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM units)
SELECT doc_id, size, source_size, target, (upto // {mixing.UNIT} - (upto - units) // {mixing.UNIT}) * size AS taken FROM run"""


@query("op6_systematic_mix", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    docs = documents(spark, sf_dir)
    sized = stored(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    plan = mixing.planned(sized, SOURCE_WEIGHTS)
    return plan.select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("size")).alias("taken"),
        F.col("mix_copies").alias("copies"),
    ).drop("copies")


@query("op7_sampled_splitters")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes."""
    text = F.col("text")
    digests = documents(spark, sf_dir).select(
        "doc_id", sharding.byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")
    )
    placed = sharding.sharded(stored(digests, "digests"), SHARDS, size="size", key="key")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op1_language_mixture")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from the folds that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~held).select("text", "lang"))
    name, share = language.predicted(F.col("languages"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), name.alias("lang_pred"), share.alias("score"), F.to_json("languages").alias("mixture"))


@query("op8_gif")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a GIF, and what the stored file gives back."""
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", "text", F.octet_length(text).cast("long").alias("n_bytes"))
    media = stored(media_columns.with_media(docs).select("doc_id", "n_bytes", "media"), "media")
    read = media_columns.with_digest(media)
    return read.select(
        "doc_id",
        "n_bytes",
        F.col("digest.payload_bytes").alias("payload_bytes"),
        F.col("digest.payload_sha256").alias("payload_sha256"),
        F.col("digest.tail_crc32").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "digest.frames", "digest.millis"), F.concat_ws(",", F.col("digest.histogram").cast("array<string>"))).alias("feature"),
    )


# Lists are derived from the pages themselves: hosts, domains, folders and single URLs come and go on days that follow from their digests.
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("date")
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    pages = documents(spark, sf_dir, "pages").select("url", urllists.host(F.col("url")).alias("host")).where("host <> ''")
    hosts = pages.select("host").distinct().withColumn("n", number(F.col("host")))
    n = F.col("n")

    def entry(rows: DataFrame, name: str, pattern, days, action: str) -> DataFrame:
        return rows.select(F.lit(name).alias("list"), pattern.alias("pattern"), F.date_add(start, days).alias("day"), F.lit(action).alias("action"))

    blocked, allowed = hosts.where("n % 3 <> 0"), hosts.where("n % 4 = 0")
    folder = F.concat("host", F.lit("/en"))
    single = pages.withColumn("n", number(F.col("url"))).where("n % 7 = 0")
    path = F.rtrim(F.regexp_extract("url", r"//[^/?#]*(/[^?#]*)", 1), F.lit("/"))
    parts = [
        entry(blocked, "block", F.col("host"), n % 200, "add"),
        entry(blocked, "block", F.col("host"), n % 200 + 30 + n % 60, "remove"),
        entry(blocked.where("n % 2 = 0"), "block", F.col("host"), n % 200 + 120 + n % 60, "add"),
        entry(hosts.where("n % 5 = 0"), "ads", F.regexp_replace("host", r"^[^.]*\.", ""), n % 90, "add"),
        entry(allowed, "allow", folder, n % 150, "add"),
        entry(allowed, "allow", folder, n % 150 + 100, "remove"),
        entry(single, "urls", F.concat(F.col("host"), path), n % 366, "add"),
    ]
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.union(part)
    return entries


OP4_SQL = r"""
WITH page AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS day, lower(regexp_extract(url, '//(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
              regexp_extract(url, '//[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS n FROM (SELECT DISTINCT host FROM page WHERE host <> '')),
entries AS (
 SELECT 'block' AS list, host AS pattern, DATE '2024-01-01' + n % 200 AS day, 0 AS gone FROM hosts WHERE n % 3 <> 0
 UNION ALL SELECT 'block', host, DATE '2024-01-01' + (n % 200 + 30 + n % 60), 1 FROM hosts WHERE n % 3 <> 0
 UNION ALL SELECT 'block', host, DATE '2024-01-01' + (n % 200 + 120 + n % 60), 0 FROM hosts WHERE n % 3 <> 0 AND n % 2 = 0
 UNION ALL SELECT 'ads', regexp_replace(host, '^[^.]*\.', ''), DATE '2024-01-01' + n % 90, 0 FROM hosts WHERE n % 5 = 0
 UNION ALL SELECT 'allow', host || '/en', DATE '2024-01-01' + n % 150, 0 FROM hosts WHERE n % 4 = 0
 UNION ALL SELECT 'allow', host || '/en', DATE '2024-01-01' + (n % 150 + 100), 1 FROM hosts WHERE n % 4 = 0
 UNION ALL SELECT 'urls', host || rtrim(path, '/'), DATE '2024-01-01' + n % 366, 0
   FROM (SELECT host, path, ('0x' || substr(md5(url), 1, 4))::INT AS n FROM page) WHERE n % 7 = 0),
daily AS (SELECT list, pattern, day, max(gone) AS gone FROM entries GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, lag(gone, 1, 1) OVER (PARTITION BY list, pattern ORDER BY day) AS before FROM daily) WHERE gone <> before),
intervals AS (SELECT * FROM (SELECT list, pattern, gone, day AS valid_from, lead(day, 1, DATE '9999-12-31') OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to FROM changes) WHERE gone = 0),
names AS (SELECT page_id, day, unnest(list_distinct(list_concat(
   list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
   list_transform(range(1, len(list_filter(string_split(path, '/'), lambda f: f <> '')) + 1), lambda i: host || '/' || array_to_string(list_slice(list_filter(string_split(path, '/'), lambda f: f <> ''), 1, i), '/'))))) AS pattern
   FROM page WHERE host <> ''),
active AS (SELECT page_id, list, names.pattern FROM names JOIN intervals ON names.pattern = intervals.pattern AND day >= valid_from AND day < valid_to),
judged AS (SELECT page_id, arg_max({'blocked': list <> 'allow', 'pattern': pattern}, (length(pattern), CAST(list = 'allow' AS INT), pattern)) AS top,
   string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM active GROUP BY page_id)
SELECT page_id, url, CAST(day AS VARCHAR) AS fetched, coalesce(top.blocked, false) AS blocked, top.pattern AS pattern, coalesce(lists, '') AS lists
FROM page LEFT JOIN judged USING (page_id)"""


@query("op4_url_lists", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the list entries active on the day it was fetched."""
    found = urllists.judged(captures(spark, sf_dir), list_entries(spark, sf_dir), day="fetched")
    return found.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "verdict.blocked", "verdict.pattern", "verdict.lists")


@query("op10_licence_sentences", licences.scan_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    found = licences.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("licences.ids").alias("sentence_ids"), F.array_join("licences.names", ",").alias("licences"), F.col("licences.rest").alias("rest"))


@query("op2_gear_chunks")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that an earlier document holds."""
    found = chunks.repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_bytes"), F.col("kept_id").alias("kept_doc_id"))


@query("op9_page_template")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op12_kd_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their more frequent spelling, one edit apart; every 97th run by digest has lost a letter."""
    return variants.grouped(variants.word_counts(documents(spark, sf_dir).select("doc_id", "text"), wear=97))


@query("op13_lanczos_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the four directions of largest variance."""
    return whitening.whitened(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# Score from which a document counts as toxic.
TOXIC = 0.3


@query("op11_crf_spans")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the folds that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = language.held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(~held), documents(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = F.col("toxicity.score")
    return toxicity.tagged(docs, model).select(
        "doc_id", held.alias("held_out"), score.alias("score"), (score >= TOXIC).cast("int").alias("predicted"), F.to_json("toxicity.spans").alias("spans")
    )
