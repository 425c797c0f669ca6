"""Registered queries of job matches and small rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.operators import details, matching
from attestry.plans.catalog import register
from attestry.sources.tables import table


def _rows(spark, values: str):
    return spark.sql("SELECT * FROM " + values.replace("::DOUBLE", "D").replace("[]", "CAST(array() AS array<string>)").replace("['", "array('").replace("']", "')"))


STOP = ["with", "must", "have", "team"]
JOBS = "(VALUES (1, 'We must have <b>Kafka</b> and Docker, Docker and streaming with 2024 deadlines; streaming OCR pipelines for the team'), (2, 'Document AI work with Angular'), (3, 'gardening')) AS j(job, text)"
HAS = "(VALUES ('p', 'Docker'), ('p', 'OCR'), ('p', 'Zig'), ('q', 'Angular'), ('q', 'docker')) AS s(profile, skill)"
ENTRIES = "(VALUES ('p', 1, 'Built streaming jobs on Kafka', ['Docker', 'Kafka']), ('p', 2, 'Angular pages', []), ('p', 3, '', ['OCR']), ('q', 4, 'deadlines and pipelines', ['Zig']), ('q', 5, 'nothing of the kind', [])) AS e(profile, id, text, skills)"
_TERMS = f"""f AS (SELECT job, unnest(t) AS term, unnest(range(len(t))) AS at FROM (SELECT job, regexp_extract_all(lower(regexp_replace(text, '<[^>]*>', ' ', 'g')), '[a-z0-9+#._-]+') AS t FROM {JOBS})),
  t AS (SELECT job, term, count(*) AS n, min("at") AS "at" FROM f WHERE length(term) >= 4 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ('with', 'must', 'have', 'team') GROUP BY ALL)"""


@register(
    "job_skills",
    f"""WITH m AS (SELECT job, profile, list_sort(list_distinct(list(skill))) AS s FROM {JOBS}, {HAS} WHERE contains(lower(text), lower(skill)) GROUP BY ALL)
    SELECT j.job, p.profile, coalesce(array_to_string(s, ','), '') AS skills, CASE WHEN list_has_any(coalesce(s, []), ['OCR', 'Docling', 'LayoutLMv3']) OR contains(lower(j.text), 'document ai') THEN 'Document AI / extraction angle' WHEN list_has_any(coalesce(s, []), ['RAG', 'LLM', 'OpenAI']) THEN 'LLM application angle'
    WHEN list_has_any(coalesce(s, []), ['FastAPI', 'Docker', 'PostgreSQL', 'Redis']) THEN 'Backend / platform angle' ELSE 'General evidence-backed fit' END AS angle FROM {JOBS} CROSS JOIN (VALUES ('p'), ('q')) AS p(profile) LEFT JOIN m ON m.job = j.job AND m.profile = p.profile""",
)
def job_skills(spark, d):
    return matching.matched_skills(_rows(spark, JOBS), _rows(spark, HAS)).withColumn("skills", F.array_join("skills", ","))


@register(
    "job_entries",
    f"""WITH {_TERMS}, e AS (SELECT * FROM {ENTRIES}),
    s AS (SELECT job, profile, id, coalesce((SELECT sum(n) FROM t WHERE t.job = j.job AND list_contains(regexp_extract_all(lower(e.text || ' ' || array_to_string(skills, ' ')), '[a-z0-9+#._-]+'), t.term)), 0) + 2 * len(list_filter(skills, lambda x: contains(lower(j.text), lower(x)))) AS score, e.text FROM {JOBS} CROSS JOIN e)
    SELECT job, profile, row_number() OVER (PARTITION BY job, profile ORDER BY score DESC, id) AS place, id, score::BIGINT AS score FROM s WHERE score > 0 AND text <> ''""",
)
def job_entries(spark, d):
    return matching.ranked_entries(_rows(spark, JOBS), _rows(spark, ENTRIES), STOP)


@register(
    "job_missing_terms",
    f"""WITH {_TERMS}, k AS (SELECT profile, unnest(regexp_extract_all(lower(text), '[a-z0-9+#._-]+')) AS term FROM {ENTRIES}), m AS (SELECT job, profile, lower(skill) AS term FROM {JOBS}, {HAS} WHERE contains(lower(text), lower(skill))),
    o AS (SELECT t.job, p.profile, t.term, t."at" FROM t CROSS JOIN (VALUES ('p'), ('q')) AS p(profile) WHERE (n >= 2 OR length(term) >= 7) AND NOT EXISTS (SELECT 1 FROM k WHERE k.profile = p.profile AND k.term = t.term) AND NOT EXISTS (SELECT 1 FROM m WHERE m.job = t.job AND m.profile = p.profile AND m.term = t.term))
    SELECT job, profile, row_number() OVER (PARTITION BY job, profile ORDER BY "at") AS place, term FROM o QUALIFY place <= 10""",
)
def job_missing_terms(spark, d):
    return matching.missing_terms(_rows(spark, JOBS), _rows(spark, ENTRIES).select("profile", "text"), _rows(spark, HAS), STOP)


@register("smart_title", "SELECT * FROM (VALUES (1, 'Hello World'), (2, 'GPU Kernels'), (3, 'McDuff And Sons'), (4, '')) AS t(id, title)")
def smart_title(spark, d):
    return _rows(spark, "(VALUES (1, ' hello   world '), (2, 'GPU kernels'), (3, 'mcDuff and sons'), (4, ' ')) AS t(id, v)").select("id", details.smart_title(F.col("v")).alias("title"))


@register("bullet_clean", "SELECT * FROM (VALUES (1, 'Built a thing for the Navy|Reduced the costs a lot'), (2, 'A second point of note')) AS t(id, bullets)")
def bullet_clean(spark, d):
    rows = [(1, ["• Built a thing for the Navy", "Acme Pvt Ltd", "- Built a thing for the  navy", "abc", "Wrote the manual of the engine", "* Reduced the costs a lot"], "Wrote the manual of the engine. Short."), (2, ["A second point of note", "Sample Inc of somewhere"], None)]
    return spark.createDataFrame(rows, "id int, items array<string>, summary string").select("id", F.array_join(details.bullets(F.col("items"), F.col("summary")), "|").alias("bullets"))


LINKS = "(VALUES ('p', 1, 'https://blog.example/x'), ('p', 2, 'https://www.code.example/me/'), ('p', 3, 'http://code.example/me'), ('p', 4, 'https://ads.example/1'), ('p', 5, ''), ('p', 6, 'https://people.example/in/me'), ('p', 7, 'https://z.example'), ('q', 8, 'https://z.example')) AS l(profile, position, url)"


@register("preferred_links", f"WITH k AS (SELECT profile, position, url, regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '/$', '') AS key FROM {LINKS} WHERE url <> '' AND NOT contains(url, 'ads.example')), r AS (SELECT *, CASE WHEN contains(key, 'people.example') THEN 0 WHEN contains(key, 'code.example') THEN 1 ELSE 2 END AS rank FROM k), o AS (SELECT DISTINCT ON (profile, key) * FROM r ORDER BY profile, key, rank, position) SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY rank, position) AS place, url FROM o QUALIFY place <= 3")
def preferred_links(spark, d):
    return details.preferred_links(_rows(spark, LINKS), ["people.example", "code.example"], ["ads.example"], 3)


ARTICLES = "(VALUES ('skills', 'b'), ('profile', 'z'), ('kubernetes', 'B'), ('general', 'a'), ('docker', 'a')) AS a(slug, title)"


@register("catalog_order", f"SELECT slug, row_number() OVER (ORDER BY CASE slug WHEN 'profile' THEN 0 WHEN 'skills' THEN 1 WHEN 'general' THEN 6 ELSE 20 END, lower(title)) AS place FROM {ARTICLES}")
def catalog_order(spark, d):
    return _rows(spark, ARTICLES).select("slug", F.row_number().over(W.orderBy(details.catalog_order(F.col("slug")), F.lower("title"))).cast("long").alias("place"))


@register("errors_last", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY quality IS NULL, coalesce(toxic, -1), doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id)")
def errors_last(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.row_number().over(W.partitionBy("lang").orderBy(F.col("quality").isNull(), F.coalesce("toxic", F.lit(-1)), "doc_id")).cast("long").alias("place"))


FOUND = "(VALUES (1, 0, 1, 'NAME', 'Sam Poe', 0.5::DOUBLE), (1, 1, 1, 'NAME', 'SAM POE', 0.9::DOUBLE), (1, 1, 2, 'CITY', 'Sam Poe', 0.1::DOUBLE), (2, 0, 1, 'NAME', 'sam poe', 0.5::DOUBLE), (2, 1, 1, 'NAME', 'Sam Poe', 0.5::DOUBLE)) AS e(grp, source, at, type, text, score)"


@register("max_merge", f"""WITH r AS (SELECT grp, source, type, text, score, row_number() OVER (PARTITION BY grp, type, lower(text) ORDER BY score DESC, source, "at") AS n FROM {FOUND.replace('source, at,', 'source, "at",')}) SELECT grp, type, text, score, source FROM r WHERE n = 1""")
def max_merge(spark, d):
    return details.most_certain(_rows(spark, FOUND).withColumnRenamed("grp", "group")).withColumnRenamed("group", "grp")


@register("softmax_scores", "WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x)) AS e FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, round(e[1] / list_sum(e), 6) AS first, round(list_max(e) / list_sum(e), 6) AS best FROM e")
def softmax_scores(spark, d):
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", details.softmax(F.col("embedding").cast("array<double>")).alias("s"))
    return v.select("vec_id", F.round(F.get("s", F.lit(0)), 6).alias("first"), F.round(F.array_max("s"), 6).alias("best"))


TAGS = "(VALUES (1, 0, 0, 3, 'B-NAME', 0.9::DOUBLE), (1, 1, 4, 7, 'I-NAME', 0.7::DOUBLE), (1, 2, 8, 10, 'O', 0.9::DOUBLE), (1, 3, 11, 14, 'I-NAME', 0.5::DOUBLE), (1, 4, 15, 18, 'B-NAME', 0.6::DOUBLE), (1, 5, 25, 29, 'I-NAME', 0.4::DOUBLE), (1, 6, 30, 33, 'I-CITY', 0.8::DOUBLE), (1, 7, 33, 33, 'O', 0.1::DOUBLE), (1, 8, 33, 36, 'I-CITY', 0.6::DOUBLE)) AS t(grp, at, start, stop, label, score)"


@register("tagged_spans", "SELECT * FROM (VALUES (1, 0, 7, 'NAME', 0.8::DOUBLE), (1, 11, 14, 'NAME', 0.5::DOUBLE), (1, 15, 18, 'NAME', 0.6::DOUBLE), (1, 25, 29, 'NAME', 0.4::DOUBLE), (1, 30, 36, 'CITY', 0.7::DOUBLE)) AS s(grp, start, stop, type, score)")
def tagged_spans(spark, d):
    return details.tagged_spans(_rows(spark, TAGS).withColumnRenamed("grp", "group")).withColumnRenamed("group", "grp")


RECTS = "(VALUES (1, 0, 0, 10, 10), (2, 5, 5, 15, 15), (3, 10, 0, 20, 10), (4, 2, 2, 3, 3)) AS r(id, x0, y0, x1, y1)"


@register("rect_intersection", f"SELECT a.id AS a, b.id AS b FROM {RECTS.replace('AS r(', 'AS a(')} JOIN {RECTS.replace('AS r(', 'AS b(')} ON a.id < b.id AND NOT (a.x1 <= b.x0 OR b.x1 <= a.x0 OR a.y1 <= b.y0 OR b.y1 <= a.y0)")
def rect_intersection(spark, d):
    a, b = _rows(spark, RECTS).alias("a"), _rows(spark, RECTS).alias("b")
    corner = lambda side: [F.col(f"{side}.{c}") for c in ("x0", "y0", "x1", "y1")]
    return a.join(b, (F.col("a.id") < F.col("b.id")) & details.rects_meet(corner("a"), corner("b"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


CLAIMS = "(VALUES (1, 'identity', 'value', 68, 0.0::DOUBLE), (2, 'skills', '', 30, 0.0::DOUBLE), (3, 'public_profiles', 'url', 99, 0.0::DOUBLE), (4, 'public_profiles', '', 70, 0.0::DOUBLE), (5, 'work_experience', 'title organization summary highlights', 80, 0.0::DOUBLE), (6, 'projects', 'name', 50, 0.97::DOUBLE), (7, 'education', '', 50, 5.0::DOUBLE)) AS c(id, section, filled, base, given)"


@register("structured_confidence", "SELECT * FROM (VALUES (1, 0.76::DOUBLE), (2, 0.46::DOUBLE), (3, 0.98::DOUBLE), (4, 0.72::DOUBLE), (5, 0.98::DOUBLE), (6, 0.97::DOUBLE), (7, 0.98::DOUBLE)) AS t(id, confidence)")
def structured_confidence(spark, d):
    names = ["value", "url", "title", "organization", "summary", "name", "degree", "institution", "issuer", "highlights"]
    has = {n: F.array_contains(F.split("filled", " "), n) for n in names}
    return _rows(spark, CLAIMS).select("id", details.claim_confidence(F.col("section"), has, F.col("base"), F.col("given")).alias("confidence"))


@register("parse_validation", "SELECT * FROM (VALUES (1, 100::BIGINT, 'strong', 0), (2, 67::BIGINT, 'usable', 3), (3, 0::BIGINT, 'needs_review', 7)) AS t(id, score, status, n_warnings)")
def parse_validation(spark, d):
    rows = spark.createDataFrame([(1, ",".join(details.CHECKS), True, 0), (2, "full_name,emails,phones,education", False, 3), (3, "", False, 0)], "id int, filled string, listed boolean, n int")
    score, status, warnings = details.validation({c: F.array_contains(F.split("filled", ","), c) for c in details.CHECKS}, F.col("listed"), F.col("n"))
    return rows.select("id", score.alias("score"), status.alias("status"), F.size(warnings).alias("n_warnings"))


@register("sync_key", """SELECT c_custkey AS id, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS key FROM customer""")
def sync_key(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), details.sync_key(F.col("c_custkey"), F.col("c_mktsegment")).alias("key"))


@register("case_insensitive_lookup", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def case_insensitive_lookup(spark, d):
    return table(spark, d, "customer").filter(F.lower("c_mktsegment") == F.lower(F.lit("Building"))).select("c_custkey", "c_mktsegment")


@register("exists_probe", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending FROM customer")
def exists_probe(spark, d):
    pending = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("pending")).distinct()
    return table(spark, d, "customer").select("c_custkey").join(pending, "c_custkey", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


@register("case_backfill", "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'labelled' WHEN n_chars > 1000 THEN 'long' ELSE 'open' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def case_backfill(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality").isNotNull(), "labelled").when(F.col("n_chars") > 1000, "long").otherwise("open").alias("state"))


@register("score_floor_fallback", "WITH s AS (SELECT lang, doc_id, n_chars - 1500 AS score FROM documents), m AS (SELECT *, max(score) OVER (PARTITION BY lang, doc_id % 50) AS top, lang || '-' || doc_id % 50 AS grp FROM s) SELECT grp, doc_id, score FROM m WHERE score > 0 OR top <= 0")
def score_floor_fallback(spark, d):
    grp = F.concat_ws("-", "lang", (F.col("doc_id") % 50).cast("string"))
    rows = table(spark, d, "documents").select(grp.alias("grp"), "doc_id", (F.col("n_chars") - 1500).alias("score"))
    return rows.withColumn("top", F.max("score").over(W.partitionBy("grp"))).filter("score > 0 OR top <= 0").drop("top")


@register("ordered_inner_join", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def ordered_inner_join(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    listed = joined.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("l"))
    return listed.select("o_custkey", F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@register("tuple_order", "SELECT l_returnflag, arg_max(l_orderkey, (l_quantity, l_shipdate, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1")
def tuple_order(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max_by("l_orderkey", F.struct("l_quantity", "l_shipdate", "l_orderkey")).alias("l_orderkey"))


@register("field_coverage", "SELECT count(quality) AS quality, count(toxic) AS toxic, count(nullif(lang, '')) AS lang, count(nullif(text, '')) AS text FROM documents LEFT JOIN labels USING (doc_id)")
def field_coverage(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    filled = lambda c: F.count(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1)).alias(c)
    return rows.agg(*[filled(c) for c in ("quality", "toxic", "lang", "text")])


NAMES = "(VALUES (1, 'Acme Pvt Ltd', 'ACME'), (2, 'Suvens', 'Suvens Consultant Pvt Ltd'), (3, 'Blue River Labs', 'River Works'), (4, 'The Co', 'A Ltd'), (5, '', 'x'), (6, 'Alpha Beta', 'Beta Gamma'), (7, 'Red Ink', 'Red Ink Inc'), (8, 'ab cd ef', 'ab cd gh')) AS n(id, a, b)"


@register("same_names", "SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, false), (5, false), (6, false), (7, true), (8, true)) AS t(id, same)")
def same_names(spark, d):
    return _rows(spark, NAMES).select("id", details.same_name(F.col("a"), F.col("b")).alias("same"))


JOBS_HELD = "(VALUES ('p', 1, 'Acme Works', 'Jan 2019', 'Dec 2020'), ('p', 2, 'ACME works Ltd', 'Mar 2021', 'present'), ('p', 3, 'Acme Works', 'Mar 2023', ''), ('p', 4, 'Acme Works', 'unknown', '2020'), ('q', 5, 'Acme Works', '2019', '2020'), ('p', 6, 'Other House', '2019', '2020')) AS e(profile, id, organization, start_date, end_date)"


@register("entry_merge_pairs", f"WITH m AS (SELECT *, CASE id WHEN 1 THEN 2019 * 12 + 1 WHEN 2 THEN 2021 * 12 + 3 WHEN 3 THEN 2023 * 12 + 3 WHEN 4 THEN 0 ELSE 2019 * 12 + 6 END AS s, CASE id WHEN 1 THEN 2020 * 12 + 12 WHEN 2 THEN 9999 * 12 WHEN 3 THEN 9999 * 12 ELSE 2020 * 12 + 6 END AS e FROM {JOBS_HELD}) SELECT x.id AS a, y.id AS b FROM m x JOIN m y ON x.profile = y.profile AND x.id < y.id AND contains(lower(x.organization), 'acme') = contains(lower(y.organization), 'acme') AND x.s > 0 AND y.s > 0 AND x.s - 6 <= y.e AND y.s - 6 <= x.e")
def entry_merge_pairs(spark, d):
    return details.one_job(_rows(spark, JOBS_HELD))


@register("parser_backend", "SELECT * FROM (VALUES (1, 'layout'), (2, NULL), (3, 'structured'), (4, 'structured'), (5, 'layout'), (6, 'layout')) AS t(id, backend)")
def parser_backend(spark, d):
    rows = [(1, "layout", "structured", "auto", True), (2, "other", None, "auto", True), (3, None, "structured", "layout", False), (4, "auto", None, "auto", True), (5, None, "gone", "layout", True), (6, None, None, "auto", False)]
    df = spark.createDataFrame(rows, "id int, requested string, stored string, configured string, pdf boolean")
    return df.select("id", details.backend(F.col("requested"), F.col("stored"), F.col("configured"), F.col("pdf"), ["layout", "structured"]).alias("backend"))
