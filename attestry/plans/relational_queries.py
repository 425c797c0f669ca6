"""Registered relational queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import relational as R
from attestry.plans.catalog import register
from attestry.sources.tables import table

AS_OF = "2024-02-15 00:00:00"


@register("scan_project_filter", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def scan_project_filter(spark, d):
    return table(spark, d, "documents").filter("lang = 'en' AND n_chars > 1000").select("doc_id", "lang", "n_chars")


@register("optional_scope_filter", "SELECT doc_id, source FROM documents WHERE source = 'src0'")
def optional_scope_filter(spark, d):
    return R.scope(table(spark, d, "documents"), source="src0", lang=None).select("doc_id", "source")


@register("in_list_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def in_list_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@register("missing_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti(spark, d):
    return R.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@register("upsert_rows", "SELECT doc_id, coalesce(l.quality, -1)::INT AS quality FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) d LEFT JOIN labels l USING (doc_id)")
def upsert_rows(spark, d):
    stored = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return R.upsert(stored, table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@register("inner_join_filter_count", "SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic <> 1 GROUP BY source")
def inner_join_filter_count(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").filter("quality = 1 AND toxic <> 1"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@register("left_join_default", "SELECT s.source, coalesce(t.n, 0)::BIGINT AS n_toxic FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) t USING (source)")
def left_join_default(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    toxic = docs.join(table(spark, d, "labels").filter("toxic = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))
    return docs.select("source").distinct().join(toxic, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n_toxic"))


@register("three_way_group_count", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def three_way_group_count(spark, d):
    # Customers are counted before the dimension joins, so the fact side is shuffled as one row for each nation.
    per_nation = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return per_nation.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sum("n").alias("n"))


@register("dashboard_counts", "SELECT count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 2000) AS long_texts, count(*) FILTER (source = 'src0' AND lang <> 'en') AS foreign_src0, count(*) FILTER (text IS NULL) AS missing_text FROM documents")
def dashboard_counts(spark, d):
    c = F.col
    return R.counts(table(spark, d, "documents"), english=c("lang") == "en", long_texts=c("n_chars") > 2000, foreign_src0=(c("source") == "src0") & (c("lang") != "en"), missing_text=c("text").isNull())


@register("count_distinct_by_key", "SELECT source, count(DISTINCT lang) AS n_lang, count(DISTINCT text) AS n_text FROM documents GROUP BY source")
def count_distinct_by_key(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_lang"), F.count_distinct(F.sha2(F.col("text").cast("binary"), 256)).alias("n_text"))


@register("sum_argmax", "SELECT l_returnflag, arg_max(l_linestatus, struct_pack(q := q, s := l_linestatus)) AS l_linestatus, max(q) AS quantity FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def sum_argmax(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return sums.groupBy("l_returnflag").agg(F.max_by("l_linestatus", F.struct("q", "l_linestatus")).alias("l_linestatus"), F.max("q").alias("quantity"))


@register("weighted_mean_nulls", "SELECT l_returnflag, round(sum(l_quantity * nullif(l_discount, 0)) / sum(l_quantity) FILTER (l_discount <> 0), 6) AS mean FROM lineitem GROUP BY 1")
def weighted_mean_nulls(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(R.weighted_mean(F.nullif("l_discount", F.lit(0.0)), F.col("l_quantity")), 6).alias("mean"))


@register("median_by_group", "SELECT l_returnflag, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def median_by_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"))


_TOK = "regexp_extract_all(lower(text), '[a-z0-9+#._-]+')"


@register("most_common_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOK}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 20")
def most_common_terms(spark, d):
    return table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)


@register("ordered_unique_collect", "SELECT lang, string_agg(source, ',' ORDER BY f, source) AS sources FROM (SELECT lang, source, min(doc_id) AS f FROM documents GROUP BY 1, 2) GROUP BY 1")
def ordered_unique_collect(spark, d):
    seen = R.first_seen(table(spark, d, "documents"), ["lang", "source"], "doc_id")
    return seen.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "source"))), lambda x: x["source"]), ",").alias("sources"))


@register("first_seen_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS checksum FROM documents GROUP BY text")
def first_seen_dedup(spark, d):
    return R.first_seen(table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum")), ["checksum"], "doc_id").select("doc_id", "checksum")


@register("top1_per_group", "SELECT source, arg_max(doc_id, struct_pack(n := n_chars, d := -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def top1_per_group(spark, d):
    return R.top_per_group(table(spark, d, "documents"), "source", F.struct("n_chars", -F.col("doc_id")), ["doc_id", "n_chars"])


@register("citation_number", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS citation FROM conversations")
def citation_number(spark, d):
    return R.numbered(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", [F.col("turn")], "citation")


@register("largest_gap", "SELECT user_id, max(gap) AS gap FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) GROUP BY user_id HAVING max(gap) IS NOT NULL")
def largest_gap(spark, d):
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = table(spark, d, "events").select("user_id", (ts - F.lag(ts).over(W.partitionBy("user_id").orderBy("ts"))).alias("gap"))
    return gaps.groupBy("user_id").agg(F.max("gap").alias("gap")).filter("gap IS NOT NULL")


@register("order_multi_limit", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def order_multi_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(50)


@register("priority_order", "SELECT lang, count(*) AS n, row_number() OVER (ORDER BY coalesce(nullif(list_position(['de', 'en'], lang), 0), 99), lang) AS place FROM documents GROUP BY lang")
def priority_order(spark, d):
    place = F.array_position(F.array(F.lit("de"), F.lit("en")), F.col("lang"))
    grouped = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return grouped.withColumn("place", F.row_number().over(W.orderBy(F.when(place > 0, place).otherwise(99), "lang")).cast("long"))


@register("union_dedup", "SELECT id, sum(score) AS score FROM (SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 0.5::DOUBLE FROM labels WHERE quality = 1) GROUP BY id")
def union_dedup(spark, d):
    a = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("score"))
    b = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score"))
    return a.unionByName(b).groupBy("id").agg(F.sum("score").alias("score"))


@register(
    "array_overlap_jaccard",
    f"""WITH t AS (SELECT item_id, list_distinct({_TOK}) AS t FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS i, len(list_distinct(list_concat(a.t, b.t))) AS u FROM t a JOIN t b ON a.item_id < b.item_id)
    SELECT a, b, round(i / u, 6) AS jaccard FROM p WHERE 10 * i >= u""",
)
def array_overlap_jaccard(spark, d):
    """Pairs of items that share a tenth of their words."""
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    return R.similar_sets(t, "item_id", "t", 1, 10).withColumn("jaccard", F.round("jaccard", 6))


@register("set_difference", f"SELECT DISTINCT unnest({_TOK}) AS term FROM benchmark EXCEPT SELECT unnest({_TOK}) FROM documents")
def set_difference(spark, d):
    terms = lambda t: table(spark, d, t).select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return terms("benchmark").join(terms("documents"), "term", "left_anti")


@register("age_bucket", f"SELECT event_id, CASE WHEN age <= 30 THEN 1.0 WHEN age <= 180 THEN 0.92 WHEN age <= 365 THEN 0.84 ELSE 0.72 END::DOUBLE AS recency FROM (SELECT event_id, greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0) AS age FROM events)")
def age_bucket(spark, d):
    return table(spark, d, "events").select("event_id", T.recency(F.col("ts"), F.lit(AS_OF).cast("timestamp")).alias("recency"))


@register("ttl_expiry", f"SELECT event_id FROM events WHERE ts + INTERVAL 30 DAY >= TIMESTAMP '{AS_OF}'")
def ttl_expiry(spark, d):
    return table(spark, d, "events").filter(F.col("ts") + F.expr("INTERVAL 30 DAYS") >= F.lit(AS_OF).cast("timestamp")).select("event_id")


@register("label_counts", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_counts(spark, d):
    q = F.col("quality")
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(q == 1).alias("good"), F.count_if(q == 0).alias("bad"), F.count_if(q.isNull()).alias("open"))


@register("array_id_expansion", "SELECT c.conv_id, string_agg(c.role, '>' ORDER BY i.pos) AS roles FROM (SELECT unnest([0, 2, 9, 1]) AS turn, unnest([1, 2, 3, 4]) AS pos) i JOIN conversations c USING (turn) GROUP BY 1")
def array_id_expansion(spark, d):
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (0, 2, 9, 1)))).alias("pos", "turn"))
    hit = table(spark, d, "conversations").join(F.broadcast(ids), "turn")  # four literals
    return hit.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]), ">").alias("roles"))
