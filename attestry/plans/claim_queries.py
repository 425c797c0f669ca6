"""Registered claim, resolver, fusion, graph and scoring queries, over literal rows that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import claims as C
from attestry.operators import order_dependent as O
from attestry.plans.catalog import register
from attestry.sources.tables import table

CLAIMS = """(VALUES
 (1, 10, 'Built a Python pipeline with Docker and Kafka for 40 users', 2, 240, 3.0),
 (1, 11, 'Led the data team as Software Engineer and improved PostgreSQL queries by 35%', 1, 90, 0.0),
 (1, 12, 'short led', 0, 0, 1.0),
 (2, 13, 'Certified in AWS and GCP at a university course that managed nothing else', 3, 500, 9.0),
 (2, 14, 'plain words without any signal at all in this line of text here', 1, 10, 2.0),
 (2, 15, 'Designed C++ and C# tools for CI/CD, 12 months of work', 2, 300, 4.0)) AS t(profile, id, body, n_chunks, n_chars, source)"""
_ACT = "(" + " OR ".join(f"contains(lower(body), '{v}')" for v in C.ACTIONS) + ")"
_SKILL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(body), '{p}') THEN '{n}' END" for n, p in C.SKILLS.items()) + "], lambda x: x IS NOT NULL))"
_METRIC = f"list_sort(list_distinct(list_transform(regexp_extract_all(body, '{C.METRIC}'), lambda x: trim(x))))"
_DIGIT = "regexp_matches(body, '[0-9]')"
_WORDS = "len(regexp_extract_all(body, '[^ ]+'))"


def _claims(spark):
    return spark.sql(f"SELECT * FROM {CLAIMS}").withColumn("source", F.col("source").cast("double"))


@register("skill_extract", f"SELECT id, array_to_string({_SKILL}, ',') AS skills FROM {CLAIMS}")
def skill_extract(spark, d):
    return _claims(spark).select("id", F.array_join(C.skills(F.col("body")), ",").alias("skills"))


@register("metric_role_extract", f"SELECT id, array_to_string({_METRIC}, ',') AS metrics, CASE WHEN regexp_matches(lower(body), 'software engineer') THEN 'Software Engineer' ELSE '' END AS roles FROM {CLAIMS}")
def metric_role_extract(spark, d):
    return _claims(spark).select("id", F.array_join(C.metrics(F.col("body")), ",").alias("metrics"), F.array_join(C.roles(F.col("body")), ",").alias("roles"))


_CAT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(body), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in C.CATEGORIES) + " ELSE 'general' END"


@register("category_infer", f"SELECT id, {_CAT} AS category FROM {CLAIMS}")
def category_infer(spark, d):
    return _claims(spark).select("id", C.category(F.col("body")).alias("category"))


@register("claim_candidates", f"SELECT id FROM {CLAIMS} WHERE length(body) BETWEEN 35 AND 280 AND {_ACT} AND ({_DIGIT} OR len({_SKILL}) > 0 OR {_WORDS} >= 8)")
def claim_candidates(spark, d):
    return _claims(spark).filter(C.claim_like(F.col("body"))).select("id")


_CONF = f"round(least(0.95::DOUBLE, 0.45::DOUBLE + CASE WHEN {_DIGIT} THEN 0.15::DOUBLE ELSE 0 END + least(0.2::DOUBLE, len({_SKILL}) * 0.05::DOUBLE) + CASE WHEN regexp_matches(body, '^[A-Z]') THEN 0.05::DOUBLE ELSE 0 END + least(0.15::DOUBLE, source::DOUBLE * 0.03::DOUBLE)), 2)"


@register("claim_confidence", f"SELECT id, {_CONF} AS confidence FROM {CLAIMS}")
def claim_confidence(spark, d):
    return _claims(spark).select("id", C.confidence(F.col("body"), F.size(C.skills(F.col("body"))), F.col("source")).alias("confidence"))


@register(
    "evidence_assess",
    f"""WITH s AS (SELECT id, round(least(98.0::DOUBLE, 32.0::DOUBLE + least(18, n_chunks * 8) + least(16, len({_SKILL}) * 4) + CASE WHEN {_DIGIT} THEN 12 ELSE 0 END + CASE WHEN {_ACT} THEN 8 ELSE 0 END + CASE WHEN n_chars >= 220 THEN 8 ELSE 0 END + CASE WHEN len({_METRIC}) > 0 THEN 4 ELSE 0 END + least(8.0::DOUBLE, {_CONF} * 10)), 1) AS score FROM {CLAIMS})
    SELECT id, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 65 THEN 'good' WHEN score >= 50 THEN 'moderate' ELSE 'weak' END AS label, CASE WHEN score >= 65 THEN 'low' WHEN score >= 50 THEN 'medium' ELSE 'high' END AS risk FROM s""",
)
def evidence_assess(spark, d):
    n = F.size(C.skills(F.col("body")))
    scored = _claims(spark).select("id", C.evidence(F.col("body"), F.col("n_chunks"), F.col("n_chars"), C.confidence(F.col("body"), n, F.col("source")), n).alias("score"))
    return scored.select("id", "score", C.evidence_label(F.col("score")).alias("label"), C.overclaim_risk(F.col("score")).alias("risk"))


_ENT = f"""e AS (SELECT profile, id, unnest({_SKILL}) AS name, 'skill' AS type FROM {CLAIMS} UNION ALL SELECT profile, id, unnest({_METRIC}), 'metric' FROM {CLAIMS}
UNION ALL SELECT profile, id, 'Software Engineer', 'role' FROM {CLAIMS} WHERE contains(lower(body), 'software engineer') UNION ALL SELECT profile, id, replace({_CAT}, '_', ' '), 'category' FROM {CLAIMS}),
n AS (SELECT profile, id, type, regexp_replace(CASE WHEN type = 'category' THEN replace(lower(name), ' ', '_') ELSE lower(name) END, '[^a-z0-9 ]+', '', 'g') AS normalized, min(name) AS name FROM e GROUP BY 1, 2, 3, 4)"""


@register("claim_entities", f"WITH {_ENT} SELECT id, type, normalized FROM n")
def claim_entities(spark, d):
    return C.entities(_claims(spark).select("id", "body"), "body").select("id", "type", "normalized")


def _found(spark):
    return C.entities(_claims(spark).select("profile", "id", "body"), "body")


@register("graph_nodes", f"WITH {_ENT} SELECT profile, node_key, count(*)::DOUBLE AS weight FROM (SELECT profile, 'profile:' || profile || ':' || type || ':' || normalized AS node_key FROM n UNION ALL SELECT DISTINCT profile, 'profile:' || profile || ':claim:' || id FROM n) GROUP BY 1, 2")
def graph_nodes(spark, d):
    return C.graph_nodes(_found(spark), "profile", "id")


@register("cooccurrence", f"WITH {_ENT} SELECT l.profile, l.normalized AS a, r.normalized AS b, count(*)::DOUBLE AS weight FROM n l JOIN n r ON l.id = r.id AND l.type = 'skill' AND r.type = 'skill' AND l.normalized < r.normalized GROUP BY 1, 2, 3")
def cooccurrence(spark, d):
    return C.co_occurrence(_found(spark), "profile", "id")


CANDIDATES = "(VALUES (1,'skill',0.9,1.0,0.9,0.8,0.2,1.0,0.0,true),(2,'skill',0.5,0.9,0.8,0.7,0.6,0.5,0.0,true),(3,'skill',0.3,0.2,0.5,0.1,0.0,0.5,0.1,false),(4,'company',0.9,1.0,0.9,0.7,0.6,0.5,0.05,true),(5,'company',0.6,0.8,0.7,0.6,0.4,0.5,0.0,false),(6,'degree',0.1,0.1,0.2,0.1,0.0,0.0,0.5,false)) AS t(id, kind, parser, alias, fuzzy, embedding, graph, section, penalty, exact)"
_PARTS = ("parser", "alias", "fuzzy", "embedding", "graph", "section", "penalty")


@register(
    "resolver_rank",
    f"""WITH s AS (SELECT id, kind, exact, round(greatest(0, least(1, 0.25::DOUBLE * parser + 0.25::DOUBLE * alias + 0.2::DOUBLE * fuzzy + 0.15::DOUBLE * embedding + 0.1::DOUBLE * graph + 0.05::DOUBLE * section - penalty)), 4) AS score FROM {CANDIDATES})
    SELECT id, score, CASE WHEN kind = 'skill' THEN CASE WHEN score >= 0.78 OR (exact AND score >= 0.68) THEN 'auto_correct' WHEN score >= 0.52 THEN 'suggest' ELSE 'needs_review' END WHEN score >= 0.84 OR (exact AND score >= 0.76) THEN 'auto_correct' WHEN score >= 0.62 THEN 'suggest' ELSE 'needs_review' END AS action FROM s""",
)
def resolver_rank(spark, d):
    rows = spark.sql(f"SELECT * FROM {CANDIDATES}")
    scored = rows.select("id", "kind", "exact", C.resolver_score({p: F.col(p).cast("double") for p in _PARTS}).alias("score"))
    return scored.select("id", "score", C.resolver_action(F.col("kind"), F.col("score"), F.col("exact")).alias("action"))


QUALITY = "(VALUES (1,'a@x.org',0.9,0.7,0.8,0.9,1.0,1.0,1.0,0.9),(1,'b@x.org',0.85,0.9,0.8,0.9,1.0,0.0,0.92,0.9),(1,'a@x.org',0.2,0.1,0.5,0.5,0.72,0.0,0.72,0.72),(2,'c@x.org',1.2,0.0,0.3,0.2,0.72,0.0,0.65,0.72),(3,'d',0.9,0.9,0.9,0.9,1.0,1.0,1.0,1.0),(3,'e',0.3,0.3,0.3,0.3,0.72,0.0,0.72,0.5)) AS t(profile, value, parser, resolver, document, source_quality, section, accepted, recency, priority)"
_QCOLS = ("parser", "resolver", "document", "source_quality", "section", "accepted", "recency", "priority")
_Q = "round(greatest(0, least(1, 0.24::DOUBLE * least(1, parser) + 0.22::DOUBLE * greatest(least(1, parser), least(1, resolver)) + 0.12::DOUBLE * document + 0.1::DOUBLE * source_quality + 0.1::DOUBLE * section + 0.1::DOUBLE * accepted + 0.05::DOUBLE * recency + 0.07::DOUBLE * priority)), 4)"


def _quality(spark):
    return spark.sql(f"SELECT * FROM {QUALITY}").select("profile", "value", C.claim_quality({c: F.col(c).cast("double") for c in _QCOLS}).alias("quality"))


@register("claim_quality", f"SELECT profile, value, {_Q} AS quality FROM {QUALITY}")
def claim_quality(spark, d):
    return _quality(spark)


@register("single_truth_merge", f"WITH v AS (SELECT profile, value, max({_Q}) AS q FROM {QUALITY} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY q DESC, value DESC) AS n, lead(q) OVER (PARTITION BY profile ORDER BY q DESC, value DESC) AS next FROM v) SELECT profile, value, q AS quality, coalesce(next >= 0.65 AND q - next < 0.15, false) AS review FROM r WHERE n = 1")
def single_truth_merge(spark, d):
    return C.single_truth(_quality(spark), "profile", "value", "quality")


GOLD = "(VALUES (1,'python,sql,docker','python,sql'),(2,'','python'),(3,'aws','gcp'),(4,'a,b,c,d','a,b,c,d'),(5,'a,b,c,d','a,b,c')) AS t(id, gold, found)"


@register(
    "field_scores",
    f"""WITH l AS (SELECT id, list_filter(string_split(gold, ','), lambda x: x <> '') AS g, list_filter(string_split(found, ','), lambda x: x <> '') AS f FROM {GOLD}),
    s AS (SELECT id, CASE WHEN len(g) = 0 THEN NULL ELSE 2.0::DOUBLE * len(list_filter(g, lambda x: list_contains(f, x))) / (len(g) + len(f)) END AS score FROM l)
    SELECT id, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'not_scored' WHEN score >= 0.95 THEN 'match' WHEN score >= 0.75 THEN 'close' ELSE 'miss' END AS status FROM s""",
)
def field_scores(spark, d):
    values = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    scored = spark.sql(f"SELECT * FROM {GOLD}").select("id", C.f1(values("gold"), values("found")).alias("score"))
    return scored.select("id", F.round("score", 6).alias("score"), C.field_status(F.col("score")).alias("status"))


@register("job_match", f"""WITH j AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9+#._-]+'), lambda t: length(t) >= 4))) AS t FROM benchmark),
    w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#._-]+'))) AS t FROM documents),
    o AS (SELECT item_id, doc_id, count(*) AS overlap FROM j JOIN w USING (t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS place FROM o) SELECT item_id, doc_id, overlap, place FROM r WHERE place <= 6""")
def job_match(spark, d):
    """The six documents that share most different words of four or more signs with an item. The items' words are broadcast below a checked size, so no frequent word gathers the documents."""
    from pyspark.sql import Window as W

    from attestry.operators.matching import BROADCAST_TERMS

    j = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda t: F.length(t) >= 4))).alias("t"))
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    overlap = w.join(F.broadcast(j) if j.count() <= BROADCAST_TERMS else j, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))
    return overlap.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id")).cast("long")).filter("place <= 6")


NAMES = "(VALUES (1,1,'Acme Data Platform'),(1,2,'Acme Data Platforms'),(1,3,'Sample Store'),(2,4,'acme'),(2,5,'Sample Stores'),(2,6,'Sample Store')) AS t(profile, id, name)"


@register("greedy_cluster")
def greedy_cluster(spark, d):
    return O.greedy_clusters(spark.sql(f"SELECT * FROM {NAMES}"), "profile", "id", "name", 0.9)


@register("seq_ratio_pairs")
def seq_ratio_pairs(spark, d):
    n = spark.sql(f"SELECT * FROM {NAMES}")
    pairs = n.alias("a").join(n.alias("b"), F.expr("a.profile = b.profile AND a.id < b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.name").alias("x"), F.col("b.name").alias("y"))
    return pairs.select("a", "b", F.round(O.sequence_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))
