"""Registered text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.plans.catalog import register
from attestry.sources.tables import table

_TOK = "regexp_extract_all(lower(text), '[a-z0-9+#._-]+')"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"


@register("tokenize_counts", f"SELECT doc_id, len({_TOK})::BIGINT AS n_tokens, len(list_distinct({_TOK}))::BIGINT AS n_distinct, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+'))::BIGINT AS n_words FROM documents")
def tokenize_counts(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), T.word_count(F.col("text")).alias("n_words"))


@register("normalize_text", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g')) AS normal FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalized(F.col("text")).cast("binary"), 256).alias("normal"))


@register("lookup_key", "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9+#./ -]+', ' ', 'g'), ' +', ' ', 'g'))) AS key FROM documents")
def lookup_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.lookup_key(F.col("text")).cast("binary"), 256).alias("key"))


@register("slug", r"SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM benchmark")
def slug(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.slug(F.col("text")).alias("slug"))


@register("truncate", r"SELECT item_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '...' ELSE t END AS short FROM (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark)")
def truncate(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.truncated(F.col("text"), 60).alias("short"))


@register("html_strip", r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS body FROM pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.stripped_html(F.col("html")).cast("binary"), 256).alias("body"))


@register("url_key", r"""WITH r AS (SELECT page_id, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM pages)
SELECT page_id, regexp_replace(lower(regexp_extract(r, '^[^/?#]*', 0)), '^www\.', '') || regexp_replace(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS key FROM r""")
def url_key(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_key(F.col("url")).alias("key"))


@register("email_phone_extract", f"SELECT doc_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '{EMAIL}'))), 'string_agg', ',') AS emails, len(regexp_extract_all(text, '{PHONE}'))::BIGINT AS n_phone FROM documents WHERE regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{PHONE}')")
def email_phone_extract(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)).alias("e"), F.regexp_extract_all("text", F.lit(PHONE), F.lit(0)).alias("p")).filter((F.size("e") > 0) | (F.size("p") > 0))
    return found.select("doc_id", F.nullif(F.array_join(F.array_sort(F.array_distinct("e")), ","), F.lit("")).alias("emails"), F.size("p").cast("long").alias("n_phone"))


@register("sha_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def sha_checksum(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))


@register("sentence_split", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))::BIGINT AS n FROM documents")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@register("content_tokens", f"SELECT item_id, len(list_filter(list_distinct({_TOK}), lambda t: length(t) > 2 AND NOT list_contains(['a','an','and','as','at','by','for','from','in','into','of','on','or','the','to','using','with'], t)))::BIGINT AS n FROM benchmark")
def content_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(T.content_tokens(F.col("text"))).cast("long").alias("n"))


@register("json_path_extract", "SELECT event_id, props->>'$.k' AS k, json_valid(props) AS valid FROM events")
def json_path_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_parse_json(props) IS NOT NULL").alias("valid"))


DATES = "(VALUES (1,'Jan 2023','Present'),(2,'2021-05','2022-11'),(3,'2019','2020'),(4,'now',''),(5,'no year','Mar 2020'),(6,'September 2018','dec 2018'),(7,'07/2017','2018')) AS t(id, s, e)"
_YM = """CASE WHEN lower(trim({0})) IN ('present','current','now','') THEN 9999*12 WHEN regexp_extract({0}, '(\\d{{4}})', 1) = '' THEN 0
ELSE CAST(regexp_extract({0}, '(\\d{{4}})', 1) AS BIGINT) * 12 + CASE WHEN regexp_extract(lower({0}), '\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)', 1) <> '' THEN list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], regexp_extract(lower({0}), '\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)', 1))
WHEN regexp_extract({0}, '\\b(0?[1-9]|1[0-2])\\b', 1) <> '' THEN CAST(regexp_extract({0}, '\\b(0?[1-9]|1[0-2])\\b', 1) AS BIGINT) ELSE 6 END END"""


@register("year_month_parse", f"SELECT id, CAST({_YM.format('s')} AS BIGINT) AS first, CAST({_YM.format('e')} AS BIGINT) AS last FROM {DATES}")
def year_month_parse(spark, d):
    return spark.sql(f"SELECT * FROM {DATES}").select("id", T.year_month(F.col("s")).alias("first"), T.year_month(F.col("e")).alias("last"))


@register("interval_overlap_pairs", f"WITH t AS (SELECT id, {_YM.format('s')} AS a, {_YM.format('e')} AS b FROM {DATES}) SELECT l.id AS l, r.id AS r FROM t l JOIN t r ON l.id < r.id AND l.a <> 0 AND r.a <> 0 AND l.a - 6 <= r.b AND r.a - 6 <= l.b")
def interval_overlap_pairs(spark, d):
    t = spark.sql(f"SELECT * FROM {DATES}").select("id", T.year_month(F.col("s")).alias("a"), T.year_month(F.col("e")).alias("b")).filter("a <> 0")
    return t.alias("l").join(t.alias("r"), F.expr("l.id < r.id AND l.a - 6 <= r.b AND r.a - 6 <= l.b")).select(F.col("l.id").alias("l"), F.col("r.id").alias("r"))
