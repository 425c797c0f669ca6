"""Registered queries of resolving, clustering, graphs, views and guards, over literal rows where the tables hold no such values."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.operators import clusters, extraction, fuse, graph, guards, resolving, views
from attestry.plans.catalog import register
from attestry.sources.tables import table


def _rows(spark, values: str):
    return spark.sql("SELECT * FROM " + values.replace("::DOUBLE", "D").replace("[", "array(").replace("]", ")"))


_KEY = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9+#./ -]+', ' ', 'g'), ' +', ' ', 'g'))"

RAW = "(VALUES (1, 'p', 'skill', 'Fast API', 1.0::DOUBLE, 0.6::DOUBLE), (2, 'p', 'skill', 'pgsql', 1.0::DOUBLE, 0.7::DOUBLE), (3, 'p', 'skill', 'Postgress', 0.0::DOUBLE, 0.5::DOUBLE), (4, 'q', 'skill', 'kafka!', 1.0::DOUBLE, 0.9::DOUBLE), (5, 'p', 'role', 'ml dev', 1.0::DOUBLE, 0.4::DOUBLE), (6, 'q', 'skill', 'zzz', 0.0::DOUBLE, 0.1::DOUBLE)) AS r(id, profile, kind, raw, section, parser)"
RULES = "(VALUES ('p', 'skill', 'fast api', 'rename', 'FastAPI', 0.8::DOUBLE, 1), ('p', 'skill', 'FAST  API', 'rename', 'Fast-API', 0.8::DOUBLE, 2), ('p', 'skill', 'pgsql', 'drop', '', 0.99::DOUBLE, 3), ('q', 'skill', 'kafka', 'rename', 'Apache Kafka', 1.4::DOUBLE, 1), ('q', 'role', 'zzz', 'rename', 'Nothing', 0.9::DOUBLE, 1)) AS u(profile, kind, pattern, action, target, confidence, created)"
VALUES = "(VALUES ('p', 'skill', 'PostgreSQL', ['pgsql', 'postgres'], 0.9::DOUBLE), ('p', 'skill', 'Redis', ['redis cache'], 0.7::DOUBLE), ('q', 'skill', 'Kafka', ['kafka'], 0.5::DOUBLE)) AS v(profile, kind, value, aliases, confidence)"
ALIASES = "(VALUES ('skill', 0, 'FastAPI', ['fast api', 'fastapi']), ('skill', 1, 'PostgreSQL', ['postgres', 'pgsql']), ('role', 0, 'AI/ML Developer', ['ml dev'])) AS a(kind, at, value, aliases)"


@register(
    "rule_lookup",
    f"""WITH m AS (SELECT r.id, u.target, u.action, u.confidence, row_number() OVER (PARTITION BY r.id ORDER BY u.confidence DESC, u.created DESC) AS n FROM {RAW} JOIN {RULES} ON r.profile = u.profile AND r.kind = u.kind AND {_KEY.format('r.raw')} = {_KEY.format('u.pattern')} WHERE target <> '')
    SELECT id, target AS value, 'rule:' || action AS evidence, least(1.0::DOUBLE, confidence) AS alias, least(1.0::DOUBLE, confidence) AS graph FROM m WHERE n = 1""",
)
def rule_lookup(spark, d):
    found = resolving.rule_candidates(_rows(spark, RAW), _rows(spark, RULES))
    return found.select("id", "value", F.array_join("evidence", ",").alias("evidence"), "alias", "graph")


@register("resolver_candidates")
def resolver_candidates(spark, d):
    """Fuzzy ratios have no SQL form; tests hold the rows against plain Python."""
    found = resolving.ranked(_rows(spark, RAW), _rows(spark, RULES), _rows(spark, VALUES), _rows(spark, ALIASES))
    return found.select("id", "place", "value", "source", F.array_join("evidence", ",").alias("evidence"), "fuzzy", "score")


PAIRS = "(VALUES (1, 'fast api', 'fastapi'), (2, 'new york mets', 'new york mets vs atlanta'), (3, 'machine learning engineer', 'engineer machine learning'), (4, '', 'x'), (5, 'Kubernetes', 'kubernetes cluster administration and much more than that'), (6, 'Built ETL jobs', 'built etl jobs!')) AS p(id, a, b)"


@register("fuzzy_ratios")
def fuzzy_ratios(spark, d):
    """Token ratios of pairs; tests hold them against definitions by edit distance."""
    measures = {"weighted": S.weighted_ratio, "sort": S.token_sort_ratio, "set": S.token_set_ratio, "part": S.partial_ratio, "gold": S.gold_similarity, "claim": S.claim_similarity}
    return _rows(spark, PAIRS).select("id", *[F.round(S.compared(m)(F.col("a"), F.col("b")), 6).alias(n) for n, m in measures.items()])


SKILL_CLAIMS = """(VALUES ('p', 'd1', 'fast api', 'skills', 'suggested', 0.6::DOUBLE, 0.9::DOUBLE, 0.7::DOUBLE), ('p', 'd2', 'FastAPI', 'projects', 'accepted', 0.5::DOUBLE, 0.0::DOUBLE, 0.6::DOUBLE), ('p', 'd1', 'Query Planning', 'skills', 'suggested', 0.9::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE),
 ('p', 'd1', 'abc', 'skills', 'suggested', 0.9::DOUBLE, 0.9::DOUBLE, 0.5::DOUBLE), ('p', 'd1', 'peline', 'skills', 'suggested', 1.0::DOUBLE, 0.9::DOUBLE, 0.5::DOUBLE), ('p', 'd3', 'Helm', 'skills', 'suggested', 0.8::DOUBLE, 0.8::DOUBLE, 0.5::DOUBLE), ('p', 'd1', 'Data Contracts', 'other', 'edited', 1.0::DOUBLE, 1.0::DOUBLE, 0.9::DOUBLE),
 ('q', 'd9', 'Data Contracts', 'skills', 'suggested', 1.0::DOUBLE, 1.0::DOUBLE, 0.9::DOUBLE), ('p', 'd1', '  ', 'skills', 'suggested', 1.0::DOUBLE, 1.0::DOUBLE, 0.9::DOUBLE)) AS c(profile, document, name, section, status, confidence, resolver_confidence, quality)"""


@register(
    "skill_merge",
    f"""WITH c AS (SELECT *, CASE WHEN lower(name) IN ('fast api', 'fastapi') THEN 'FastAPI' ELSE trim(name) END AS skill, greatest(confidence, resolver_confidence) AS sure FROM {SKILL_CLAIMS}),
    g AS (SELECT profile, skill, arg_max(sure, quality) AS sure, bool_or(section = 'skills') AS listed, count(DISTINCT document) AS docs, bool_or(status IN ('accepted', 'edited')) AS accepted, count(*) AS n, list_sort(list_distinct(list(document))) AS documents FROM c WHERE skill <> '' GROUP BY 1, 2),
    k AS (SELECT *, skill IN ('FastAPI', 'Helm') AS known, skill IN ('abc', 'peline') AS looks, skill = 'peline' AS listed_fragment FROM g),
    s AS (SELECT *, greatest(0, least(1, round(0.55::DOUBLE * sure + CASE WHEN known THEN 0.16::DOUBLE ELSE 0 END + CASE WHEN listed THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN known THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN docs > 1 THEN least(0.12::DOUBLE, 0.06::DOUBLE * docs) ELSE 0 END + CASE WHEN accepted THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN looks THEN 0.45::DOUBLE ELSE 0 END - CASE WHEN listed_fragment THEN 0.35::DOUBLE ELSE 0 END, 4)))::DOUBLE AS confidence FROM k)
    SELECT profile, skill, 'skill:' || lower(skill) AS canonical_key, confidence, CASE WHEN confidence < 0.55 THEN 'ignored' WHEN confidence < 0.8 THEN 'review' ELSE 'merged' END AS status,
    CASE WHEN confidence < 0.55 AND looks THEN 'garbage_skill_fragment' WHEN confidence < 0.8 THEN 'low_confidence_skill' END AS review_reason, n AS source_count, docs AS document_count, array_to_string(documents, ',') AS documents,
    concat_ws(',', CASE WHEN known THEN 'known_skill_whitelist' END, CASE WHEN listed THEN 'skills_section' END, CASE WHEN known THEN 'known_skill_dictionary_match' END, CASE WHEN docs > 1 THEN 'seen_in_multiple_documents' END, CASE WHEN accepted THEN 'accepted_before' END, CASE WHEN looks THEN 'looks_like_fragment' END, CASE WHEN listed_fragment THEN 'blacklisted_token' END) AS reasons FROM s""",
)
def skill_merge(spark, d):
    found = clusters.merged_skills(_rows(spark, SKILL_CLAIMS))
    return found.withColumns({c: F.array_join(c, ",") for c in ("documents", "reasons")})


GROUPS = """(VALUES ('p', 1, 'skill', 0.8::DOUBLE, 'Python', 'Python', '', '', '', '', '', '', '', []), ('p', 2, 'skill', 0.9::DOUBLE, 'x', ' python ', '', '', '', '', '', '', '', []), ('p', 3, 'project', 0.5::DOUBLE, 'Shop', 'Shop', '', '', '', '', '', '', '', ['https://www.shop.example/a/']),
 ('p', 4, 'project', 0.4::DOUBLE, 'Store', 'Store', '', '', '', '', '', '', '', ['http://shop.example/a']), ('p', 5, 'project', 0.4::DOUBLE, 'Shop', 'Shop', '', '', '', '', '', '', '', []), ('p', 6, 'education', 0.4::DOUBLE, 'x', '', 'State University', 'BSc', '', '', '', '', '', []),
 ('p', 7, 'education', 0.4::DOUBLE, 'y', '', 'STATE university', 'bsc', '', '', '', '', '', []), ('p', 8, 'work_experience', 0.4::DOUBLE, 'x', '', '', '', 'Acme', 'Dev', '2019', 'present', '', []), ('q', 9, 'skill', 0.7::DOUBLE, 'Python', 'Python', '', '', '', '', '', '', '', []), ('p', 10, 'identity', 0.7::DOUBLE, 'Sam', '', '', '', '', '', '', '', '', []),
 ('p', 11, 'public_profile', 0.6::DOUBLE, 'x', '', '', '', '', '', '', '', 'https://www.code.example/me/', []), ('p', 12, 'public_profile', 0.7::DOUBLE, 'x', '', '', '', '', '', '', '', 'http://code.example/me', [])) AS g(profile, id, kind, confidence, value, name, institution, degree, organization, title, start_date, end_date, url, links)"""


@register(
    "exact_group_dedupe",
    f"""WITH k AS (SELECT id, profile, confidence, kind || ':' || CASE kind WHEN 'skill' THEN lower(trim(name)) WHEN 'education' THEN lower(institution || '|' || degree) WHEN 'work_experience' THEN lower(organization || '|' || title || '|' || start_date || '|' || end_date)
      WHEN 'project' THEN CASE WHEN len(links) > 0 THEN regexp_replace(regexp_replace(links[1], '^https?://(www\\.)?', ''), '/$', '') ELSE lower(name) END WHEN 'public_profile' THEN regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '/$', '') ELSE lower(value) END AS key FROM {GROUPS})
    SELECT id, first_value(id) OVER (PARTITION BY profile, key ORDER BY confidence DESC, id) AS kept, count(*) OVER (PARTITION BY profile, key) AS n FROM k""",
)
def exact_group_dedupe(spark, d):
    rows = spark.sql("SELECT * FROM " + GROUPS.replace("::DOUBLE", "D").replace("[]", "CAST(array() AS array<string>)").replace("[", "array(").replace("]", ")").replace("array<string)>", "array<string>"))
    return clusters.exact_duplicates(rows.withColumn("issuer", F.lit("")))


WORK = """(VALUES ('p', 1, 1, 0.5::DOUBLE, 'Acme Corp', 'Data Engineer', 'Jan 2019', 'Dec 2021', ''), ('p', 2, 2, 0.9::DOUBLE, 'ACME corp', 'Senior Data Engineer', '2020', 'present', ''), ('p', 3, 3, 0.5::DOUBLE, 'Acme Corp', 'Cook', '2001', '2002', ''), ('p', 4, 4, 0.5::DOUBLE, '', 'Data Engineer', '2019', '2021', 'b1'),
 ('p', 5, 5, 0.5::DOUBLE, '', 'Data Enginer', '2019', '2020', 'b1'), ('q', 6, 1, 0.5::DOUBLE, 'Acme Corp', 'Data Engineer', '2019', '2021', ''), ('p', 7, 6, 0.1::DOUBLE, 'acme corp', 'Janitor', '2020', 'now', '')) AS w(profile, id, position, quality, organization, title, start_date, end_date, block)"""


@register("work_clusters")
def work_clusters(spark, d):
    return clusters.work_clusters(_rows(spark, WORK))


SPANS = "(VALUES (1, 'Jan 2019', 'Dec 2021', '2021', '2022'), (2, '2019', 'Present', '2023', NULL), (3, NULL, '2020', '1999', '2000'), (4, '2010', '2011', '2012', '2013'), (5, 'May 2010', NULL, '2030', ''), (6, '2015', 'until now', '2016', 'unknown')) AS s(id, a, b, c, d)"
_Y = "coalesce(try_cast(nullif(regexp_extract(coalesce({}, ''), '\\b(19|20)\\d\\d\\b'), '') AS INT), {})"
_END = "CASE WHEN regexp_matches(lower(coalesce({0}, '')), '\\b(present|current|now)\\b') THEN 9999 ELSE " + _Y.format("{0}", 9999) + " END"


@register("year_windows", f"SELECT id, {_Y.format('a', 0)} || ':' || {_END.format('b')} AS window_key, {_Y.format('a', 0)} = 0 OR {_Y.format('c', 0)} = 0 OR greatest({_Y.format('a', 0)}, {_Y.format('c', 0)}) <= least({_END.format('b')}, {_END.format('d')}) AS overlap FROM {SPANS}")
def year_windows(spark, d):
    c = [F.col(x) for x in "abcd"]
    return _rows(spark, SPANS).select("id", clusters.window_key(c[0], c[1]).alias("window_key"), clusters.years_overlap(*c).alias("overlap"))


APPROVED = """(VALUES ('p', 1, 'd1', 'cv.txt', 'work_experience', 'Built Python and SQL pipelines for 40 users', ['Python', 'SQL'], 1), ('p', 2, 'd1', 'cv.txt', 'project', 'Python and Docker tool by a software engineer', ['Docker', 'Python', 'python'], 2),
 ('p', 3, 'd2', NULL, 'general', 'Nothing much', [], 3), ('q', 4, 'd3', 'x.txt', 'project', 'SQL and Python again', ['Python', 'SQL'], 1)) AS c(profile, claim, document, filename, category, text, skills, position)"""
_SAID = f"""WITH c AS (SELECT * FROM {APPROVED}),
  e AS (SELECT profile, claim, position, 3 AS place, 'skill' AS type, unnest(skills) AS label FROM c UNION ALL SELECT profile, claim, position, 20, 'metric', '40 users' FROM c WHERE claim = 1 UNION ALL SELECT profile, claim, position, 30, 'role', 'Software Engineer' FROM c WHERE claim = 2 UNION ALL SELECT profile, claim, position, 40, 'category', replace(category, '_', ' ') FROM c),
  n AS (SELECT DISTINCT ON (profile, claim, type, id) * FROM (SELECT *, CASE WHEN type = 'category' THEN replace(label, ' ', '') ELSE lower(label) END AS id, row_number() OVER () AS r FROM e) ORDER BY profile, claim, type, id, r),
  said AS (SELECT profile, claim, position, place, type, id, label FROM n UNION ALL SELECT profile, claim, position, 0, 'claim', claim::VARCHAR, text FROM c UNION ALL SELECT profile, claim, position, 1, 'category', category, replace(category, '_', ' ') FROM c UNION ALL SELECT profile, claim, position, 2, 'document', document, coalesce(filename, document) FROM c),
  k AS (SELECT *, 'profile:' || profile || ':' || type || ':' || id AS key, 'profile:' || profile || ':claim:' || claim AS claim_key FROM said)"""


def _approved(spark):
    return spark.sql("SELECT * FROM " + APPROVED.replace("[]", "CAST(array() AS array<string>)").replace("['", "array('").replace("']", "')"))


@register("graph_nodes_full", _SAID + " SELECT profile, key, arg_min(type, position * 100 + place) AS type, arg_min(label, position * 100 + place) AS label, count(*)::DOUBLE AS weight FROM k GROUP BY 1, 2")
def graph_nodes_full(spark, d):
    return graph.nodes(graph.mentions(_approved(spark)))


@register(
    "graph_edges",
    _SAID + """, m AS (SELECT profile, claim_key AS source, key AS target, CASE place WHEN 1 THEN 'classified_as' WHEN 2 THEN 'supported_by' ELSE 'mentions_' || type END AS relation FROM k WHERE place > 0
      UNION ALL SELECT a.profile, a.key, b.key, 'co_occurs' FROM k a JOIN k b ON a.claim_key = b.claim_key AND a.type = 'skill' AND b.type = 'skill' AND a.place >= 3 AND b.place >= 3 AND a.key < b.key)
    SELECT profile, source, target, relation, count(*)::DOUBLE AS weight FROM m GROUP BY ALL""",
)
def graph_edges(spark, d):
    return graph.edges(graph.mentions(_approved(spark)))


@register("full_refresh", "SELECT o_orderkey AS id, o_custkey AS profile, 'old' AS state FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderstatus = 'P'")
def full_refresh(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("profile"), "o_orderstatus")
    fresh = orders.filter("o_orderstatus = 'P'").select("id", "profile", F.lit("new").alias("state"))
    return graph.refreshed(orders.select("id", "profile", F.lit("old").alias("state")), fresh)


@register("delete_cascade", "SELECT 'orders' AS child, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def delete_cascade(spark, d):
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders")
    kept = guards.cascaded(gone, "o_custkey", orders=orders)["orders"]
    lost = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    items = guards.cascaded(lost, "l_orderkey", lineitem=table(spark, d, "lineitem"))["lineitem"]
    return kept.agg(F.lit("orders").alias("child"), F.count("*").alias("n")).unionByName(items.agg(F.lit("lineitem").alias("child"), F.count("*").alias("n")))


REQUESTS = "(VALUES (1, 'u', NULL, '  My   Profile '), (2, 'u', 'a', 'main'), (3, 'u', 'b', 'MAIN'), (4, 'u', NULL, ' '), (5, 'v', NULL, 'Main'), (6, 'u', NULL, NULL), (7, 'v', 'c', 'Other')) AS r(id, user, profile, name)"
PROFILES = "(VALUES ('u', 'a', 'Main', 2), ('u', 'b', 'Second', 1), ('v', 'c', 'Only', 1), ('w', 'e', 'Beta', 1), ('w', 'f', 'Alpha', 1)) AS p(user, profile, name, created)"


def _quoted(sql: str) -> str:
    return sql.replace("(id, user,", '(id, "user",').replace("p(user,", 'p("user",')


@register(
    "profile_names",
    f"""WITH r AS (SELECT id, "user", profile, trim(regexp_replace(coalesce(name, ''), '\\s+', ' ', 'g')) AS clean FROM {_quoted(REQUESTS)})
    SELECT id, clean, CASE WHEN clean = '' OR length(clean) > 120 THEN 422 WHEN EXISTS (SELECT 1 FROM {_quoted(PROFILES)} WHERE p."user" = r."user" AND lower(p.name) = lower(clean) AND p.profile IS DISTINCT FROM r.profile) THEN 409 ELSE 200 END AS status FROM r""",
)
def profile_names(spark, d):
    return guards.named(_rows(spark, REQUESTS.replace("user", "`user`")), _rows(spark, PROFILES.replace("user", "`user`")))


@register("last_profile_guard", f"""SELECT w."user" AS "user", w.profile, CASE WHEN p.profile IS NULL THEN 404 WHEN (SELECT count(*) FROM {_quoted(PROFILES)} WHERE p."user" = w."user") <= 1 THEN 409 ELSE 200 END AS status FROM (VALUES ('u', 'a'), ('v', 'c'), ('v', 'a'), ('x', 'z')) AS w("user", profile) LEFT JOIN {_quoted(PROFILES)} ON p."user" = w."user" AND p.profile = w.profile""")
def last_profile_guard(spark, d):
    wanted = spark.createDataFrame([("u", "a"), ("v", "c"), ("v", "a"), ("x", "z")], "user string, profile string")
    return guards.deletable(wanted, _rows(spark, PROFILES.replace("user", "`user`")))


@register("default_profile", f"""SELECT "user", arg_min(profile, created || name) AS profile FROM {_quoted(PROFILES)} GROUP BY 1""")
def default_profile(spark, d):
    return guards.default_profile(_rows(spark, PROFILES.replace("user", "`user`")))


@register("tenant_lookup", "SELECT * FROM (VALUES (1, 'a', 200), (2, NULL, 404), (3, 'b', 200), (4, NULL, 404), (5, 'f', 200)) AS t(id, profile, status)")
def tenant_lookup(spark, d):
    requests = spark.createDataFrame([(1, "u", "a"), (2, "u", "c"), (3, "u", None), (4, "x", None), (5, "w", "")], "id int, user string, profile string")
    return guards.resolved(requests, _rows(spark, PROFILES.replace("user", "`user`")))


ENTRIES = """(VALUES ('p', 1, 1, 'Engineer', 'Acme', '', 'Built RAG and OCR services', ['Python', 'FastAPI'], ['a', 'b'], [], '2020', 'present'), ('p', 2, 2, 'Developer', 'Beta', '', 'React and Angular shops', ['React'], [], [], '2016', '2019'), ('p', 3, 3, 'Intern', 'Gamma', '', 'css', [], [], [], '2014', '2015'),
 ('p', 4, 4, 'Cook', 'Diner', '', '', [], [], [], '2010', '2012'), ('p', 5, 5, 'Clerk', 'Office', '', 'docker at work', [], ['x'], [], '2012', '2014'), ('p', 6, 6, 'Guide', 'Museum', '', '', [], [], [], '2008', '2009')) AS e(profile, id, position, title, organization, name, summary, technologies, highlights, links, start_date, end_date)"""
PROJECTS = """(VALUES ('p', 1, 1, '', '', 'Search', 'RAG over notes', ['Python', 'Redis'], [], ['http://x.example'], '', ''), ('p', 2, 2, '', '', 'Shop', 'React and Angular', ['React', 'CSS', 'Node'], [], [], '', ''), ('p', 3, 3, '', '', 'Blog', 'plain pages', [], [], [], '', ''), ('p', 4, 4, '', '', 'Alpha', 'plain pages', [], [], [], '', ''), ('p', 5, 5, '', '', 'Zeta', 'docker', ['Docker'], [], [], '', '')) AS e(profile, id, position, title, organization, name, summary, technologies, highlights, links, start_date, end_date)"""


def _entries(spark, values: str):
    return spark.sql("SELECT * FROM " + values.replace("[]", "CAST(array() AS array<string>)").replace("['", "array('").replace("']", "')"))


_WORDS = "(VALUES ('ai_ml', ['ai','ml','machine learning','llm','rag','ocr','bert','fastapi','document ai','layoutlm']), ('web_dev', ['react','angular','asp.net','django','javascript','typescript','mvc','shopify','jquery','css']), ('full_stack', ['fastapi','react','angular','asp.net','django','javascript','typescript','docker','redis']), ('master', []), ('ats_short', [])) AS v(view, words)"
_ENTRY = "lower(concat_ws(' ', title, organization, name, summary, array_to_string(technologies, ' '), array_to_string(highlights, ' ')))"


@register(
    "view_experience",
    f"""WITH s AS (SELECT profile, view, id, position, CASE WHEN view = 'master' THEN CASE WHEN end_date = 'present' THEN 9999 ELSE end_date::INT END ELSE round((id = 1)::INT * 2.0::DOUBLE + 0.4::DOUBLE * len(list_filter(words, lambda w: contains({_ENTRY}, w))) + least(0.8::DOUBLE, 0.08::DOUBLE * len(technologies)) + least(0.6::DOUBLE, 0.04::DOUBLE * len(highlights)) + CASE WHEN view = 'ats_short' THEN 0.2::DOUBLE ELSE 0 END, 6) END AS a,
      CASE WHEN view = 'master' THEN start_date::INT WHEN end_date = 'present' THEN 9999 ELSE end_date::INT END AS b FROM {ENTRIES}, {_WORDS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY profile, view ORDER BY a DESC, b DESC, position) AS place FROM s)
    SELECT profile, view, place, id FROM r WHERE view = 'master' OR place <= CASE WHEN view = 'ats_short' THEN 4 ELSE 5 END""",
)
def view_experience(spark, d):
    work = _entries(spark, ENTRIES)
    return views.compiled_experience(work, spark.createDataFrame([("p", "Engineer · Acme")], "profile string, current_position string"))


@register(
    "view_projects",
    f"""WITH s AS (SELECT profile, view, id, position, name, len(technologies) AS n, round(0.45::DOUBLE * len(list_filter(words, lambda w: contains({_ENTRY}, w))) + least(0.6::DOUBLE, 0.08::DOUBLE * len(technologies)) + CASE WHEN len(links) > 0 THEN 0.35::DOUBLE ELSE 0 END, 6) AS a FROM {PROJECTS}, {_WORDS}),
    r AS (SELECT *, CASE WHEN view = 'master' THEN row_number() OVER (PARTITION BY profile, view ORDER BY position) ELSE row_number() OVER (PARTITION BY profile, view ORDER BY a DESC, n DESC, lower(name) DESC, position) END AS place FROM s)
    SELECT profile, view, place, id FROM r WHERE place <= CASE view WHEN 'master' THEN 10 WHEN 'ats_short' THEN 4 ELSE 6 END""",
)
def view_projects(spark, d):
    return views.compiled_projects(_entries(spark, PROJECTS))


SKILLS = "(VALUES ('p', 'SQL', 1), ('p', 'Docker', 2), ('p', 'python', 3), ('p', 'Python', 4), ('p', 'OCR', 5), ('p', 'LLM', 6), ('p', 'Zig', 7), ('p', 'Awk', 8), ('q', 'React', 1), ('q', 'Angular', 2), ('q', 'Cobol', 3)) AS s(profile, name, position)"
_ORDER = "(VALUES ('ai_ml', ['Python','FastAPI','RAG','OCR','LLM','BERT','PyTorch','TensorFlow','Redis','Docker','LangChain','LlamaIndex','LayoutLMv3','Docling','PyMuPDF','NSQ'], 'AI/ML Engineer'), ('web_dev', ['JavaScript','TypeScript','Angular','React','ASP.NET','ASP.NET Core','Django','Flask','SQL','Bootstrap','Azure','Shopify','CSS','HTML','jQuery'], 'Full-stack Developer'), ('full_stack', ['Python','FastAPI','JavaScript','TypeScript','React','Angular','ASP.NET','Django','SQL','Docker','Redis','Azure','AWS','GCP'], 'Full-stack Engineer'), ('master', [], 'Software Engineer'), ('ats_short', [], 'Software Engineer')) AS v(view, words, base)"
_VIEWED = f"WITH o AS (SELECT profile, arg_min(name, position) AS name, min(position) AS position FROM {SKILLS} GROUP BY profile, lower(name)), r AS (SELECT profile, view, words, base, name, CASE WHEN view = 'master' THEN row_number() OVER (PARTITION BY profile, view ORDER BY position) ELSE row_number() OVER (PARTITION BY profile, view ORDER BY coalesce(list_position(words, name), 1000), lower(name)) END AS place FROM o, {_ORDER})"


@register("view_skills", f"{_VIEWED} SELECT profile, view, place, name FROM r")
def view_skills(spark, d):
    return views.compiled_skills(_rows(spark, SKILLS))


@register("view_headlines", f"{_VIEWED}, h AS (SELECT profile, view, any_value(base) AS base, any_value(words) AS words, list(name) AS names FROM r GROUP BY 1, 2), c AS (SELECT *, list_filter(words, lambda w: list_contains(names, w))[1:4] AS chosen FROM h) SELECT profile, view, CASE WHEN profile = 'q' AND view IS NOT NULL THEN 'Set by hand' WHEN view = 'ai_ml' AND list_contains(chosen, 'LLM') AND list_contains(chosen, 'OCR') THEN base || ' · Python · FastAPI · RAG · OCR · LLM Systems' WHEN len(chosen) > 0 THEN base || ' · ' || array_to_string(chosen, ' · ') ELSE base END AS headline FROM c")
def view_headlines(spark, d):
    return views.target_headlines(views.compiled_skills(_rows(spark, SKILLS)), spark.createDataFrame([("q", "Set by hand")], "profile string, headline string"))


@register("view_summaries", "SELECT profile, view, coalesce(CASE WHEN profile = 'p' AND view = 'ai_ml' THEN 'Models and data' WHEN profile = 'p' THEN 'Pages and shops' END, CASE WHEN profile = 'q' THEN 'Plain' END) AS summary FROM (VALUES ('p'), ('q'), ('r')) AS p(profile), (VALUES ('master'), ('ai_ml'), ('web_dev'), ('full_stack'), ('ats_short')) AS v(view)")
def view_summaries(spark, d):
    rows = [("p", "web_dev", "x", {"ai_ml": "Models  and data", "web_dev": "Pages and shops"}), ("q", "ai_ml", " Plain ", {}), ("r", None, None, None)]
    return views.view_summaries(spark.createDataFrame(rows, "profile string, focus string, summary string, modes map<string,string>"))


POSITIONS = "(VALUES ('p', 1, 'Dev', 'Acme', '2019', 'present', 0.5::DOUBLE, 0.7::DOUBLE), ('p', 2, 'Lead', 'Beta', '2021', '', 0.5::DOUBLE, 0.7::DOUBLE), ('p', 3, 'Boss', '', '2022', '', 1.0::DOUBLE, 1.0::DOUBLE), ('q', 4, 'Cook', 'Diner', '2001', '2003', 0.9::DOUBLE, 0.9::DOUBLE), ('q', 5, 'Chef', 'Diner', '2003', '2009', 0.9::DOUBLE, 0.9::DOUBLE), ('r', 6, '', 'X', '2001', '', 0.9::DOUBLE, 0.9::DOUBLE)) AS w(profile, id, title, organization, start_date, end_date, confidence, priority)"


@register("current_position", f"WITH s AS (SELECT *, end_date IN ('', 'present') AS open FROM {POSITIONS}), c AS (SELECT profile, title || ' · ' || organization AS at, row_number() OVER (PARTITION BY profile ORDER BY round(1.25::DOUBLE * open::INT + 0.55::DOUBLE * confidence + 0.35::DOUBLE * priority, 6) DESC, CASE WHEN open THEN 9999 ELSE end_date::INT END DESC, start_date::INT DESC, id) AS n FROM s WHERE title <> '' AND organization <> '' AND start_date <> '') SELECT p.profile, c.at AS current_position FROM (SELECT DISTINCT profile FROM {POSITIONS}) p LEFT JOIN c ON c.profile = p.profile AND n = 1")
def current_position(spark, d):
    return views.current_position(_rows(spark, POSITIONS))


SOURCES = """(VALUES (1, 'cv.pdf', 'LLM RAG OCR work with PyTorch', 2, 1, 1, 5, 0, true), (2, 'web.pdf', 'React, Angular and CSS with jQuery', 1, 0, 2, 14, 0, false), (3, 'full_cv.pdf', 'all sorts', 4, 0, 0, 0, 0, true), (4, 'cert.pdf', '', 0, 0, 0, 0, 2, false), (5, 'readme.md', 'a project', 0, 0, 1, 0, 0, false), (6, 'portfolio.md', 'one react page', 1, 1, 2, 3, 0, false), (7, 'career.txt', 'plain', 2, 0, 0, 0, 0, true), (8, 'x.txt', 'nlp notes', 1, 0, 0, 1, 0, false)) AS s(id, filename, text, n_work, n_current, n_projects, n_skills, n_certificates, has_summary)"""


@register(
    "document_roles",
    f"""WITH f AS (SELECT *, CASE id WHEN 1 THEN 'ai_ml' WHEN 2 THEN 'web_dev' WHEN 3 THEN 'master' WHEN 6 THEN 'web_dev' WHEN 8 THEN 'ai_ml' ELSE 'master' END AS focus,
      CASE id WHEN 1 THEN 'latest_ai_resume' WHEN 2 THEN 'asp_react_resume' WHEN 3 THEN 'detailed_old_resume' WHEN 4 THEN 'certificate' WHEN 5 THEN 'project_note' WHEN 6 THEN 'portfolio_note' WHEN 7 THEN 'work_experience_resume' ELSE 'general_resume' END AS role FROM {SOURCES})
    SELECT id, focus, role, round(least(1, 0.55::DOUBLE + 0.15::DOUBLE * least(1, n_work / 3.0::DOUBLE) + 0.12::DOUBLE * least(1, n_projects / 4.0::DOUBLE) + 0.10::DOUBLE * least(1, n_skills / 12.0::DOUBLE) + CASE WHEN has_summary THEN 0.08::DOUBLE ELSE 0 END), 4) AS quality FROM f""",
)
def document_roles(spark, d):
    s = _rows(spark, SOURCES).withColumn("focus", views.focus(F.col("text"), F.col("filename")))
    c = {x: F.col(x) for x in s.columns}
    role = views.document_role(c["focus"], c["filename"], c["text"], c["n_work"], c["n_current"], c["n_projects"], c["n_certificates"])
    return s.select("id", "focus", role.alias("role"), views.source_quality(c["n_work"], c["n_projects"], c["n_skills"], c["has_summary"]).alias("quality"))


FIELDS = "(VALUES (1, 'identity', 'headline', '', 'latest_ai_resume'), (2, 'identity', 'summary', '', 'asp_react_resume'), (3, 'identity', 'email', '', 'unknown_role'), (4, 'work_experience', '', 'present', 'work_experience_resume'), (5, 'work_experience', '', '2019', 'work_experience_resume'), (6, 'projects', '', '', 'project_note'), (7, 'skills', '', '', NULL), (8, 'certifications', '', '', 'detailed_old_resume')) AS f(id, section, field, end_date, role)"


@register("source_priority", "SELECT * FROM (VALUES (1, 'current_headline', 1.0::DOUBLE), (2, 'summary', 0.8::DOUBLE), (3, 'public_profile', 0.8::DOUBLE), (4, 'current_experience', 0.95::DOUBLE), (5, 'historical_experience', 0.92::DOUBLE), (6, 'projects', 1.0::DOUBLE), (7, 'skills', 0.72::DOUBLE), (8, 'historical_experience', 0.96::DOUBLE)) AS t(id, bucket, priority)")
def source_priority(spark, d):
    rows = _rows(spark, FIELDS).withColumn("bucket", views.bucket(F.col("section"), F.col("field"), F.col("end_date")))
    return rows.select("id", "bucket", views.priority(F.col("bucket"), F.col("role")).alias("priority"))


PROSE = """(VALUES (1, 'Sure: {"a": {"b": 1}} done'), (2, 'none here'), (3, '} {'), (4, 'x {a} y {b} z'), (5, NULL)) AS p(id, text)"""


@register("first_json_object", f"SELECT id, CASE WHEN strpos(text, '{{') > 0 AND length(text) - strpos(reverse(text), '}}') + 1 > strpos(text, '{{') THEN substr(text, strpos(text, '{{'), length(text) - strpos(reverse(text), '}}') + 2 - strpos(text, '{{')) END AS object FROM {PROSE}")
def first_json_object(spark, d):
    return _rows(spark, PROSE.replace("{", "\x01").replace("\x01", "{")).select("id", extraction.first_object(F.col("text")).alias("object"))


RETRIEVED = """(VALUES ('r', 1, 'c1', 'Built a Python service that cut costs by 30 percent. Short one. - Designed SQL views for 12 teams across the company', 1.5::DOUBLE), ('r', 2, 'c2', 'Built a Python service that cut the costs by 30 percent', 0.5::DOUBLE), ('r', 3, 'c3', 'Led weekly meetings with many people from different places', 9.0::DOUBLE), ('s', 1, 'c4', 'No verbs of that kind in this quite long sentence of words', 1.0::DOUBLE), ('s', 2, 'c5', 'Managed Docker hosts for five years in two data centres', 0.2::DOUBLE)) AS c(run, rank, id, text, score)"""


@register("claim_extraction")
def claim_extraction(spark, d):
    found = extraction.merged(extraction.candidates(_rows(spark, RETRIEVED), "run"), "run", 5)
    return found.select("run", "place", "text", "category", "confidence", F.array_join("skills", ",").alias("skills"), F.array_join("chunks", ",").alias("chunks"))


#: profile, id, position, document, quality, section, field, and a value's parts.
CLAIMS = """(VALUES ('p', 1, 1, 'd1', 0.9::DOUBLE, 'identity', 'full_name', 'Sample Person', '', '', '', '', '', '', '', '', ''), ('p', 2, 2, 'd2', 0.5::DOUBLE, 'identity', 'full_name', 'S. Person', '', '', '', '', '', '', '', '', ''), ('p', 3, 3, 'd1', 0.8::DOUBLE, 'identity', 'headline', 'Data Engineer', '', '', '', '', '', '', '', '', ''),
 ('p', 4, 4, 'd2', 0.75::DOUBLE, 'identity', 'headline', 'Analyst', '', '', '', '', '', '', '', '', ''), ('p', 5, 5, 'd1', 0.7::DOUBLE, 'identity', 'email', 'A@mail.example', '', '', '', '', '', '', '', '', ''), ('p', 6, 6, 'd1', 0.9::DOUBLE, 'skills', '', '', 'Python', '', '', '', '', '', '', '', ''), ('p', 7, 7, 'd2', 0.9::DOUBLE, 'skills', '', '', 'python', '', '', '', '', '', '', '', ''),
 ('p', 8, 8, 'd1', 0.6::DOUBLE, 'work_experience', '', '', '', 'Engineer', 'Acme', '2019', 'present', '', '', '', ''), ('p', 9, 9, 'd2', 0.7::DOUBLE, 'work_experience', '', '', '', 'Engineer', 'ACME', '2019', '', '', '', '', ''), ('p', 10, 10, 'd2', 0.5::DOUBLE, 'work_experience', '', '', '', 'Cook', '', '2001', '2002', '', '', '', ''),
 ('p', 11, 11, 'd1', 0.5::DOUBLE, 'education', '', '', '', '', '', '2010', '2014', '', '', 'BSc', 'State University'), ('p', 12, 12, 'd1', 0.5::DOUBLE, 'projects', '', '', 'Shop', '', '', '', '', '', '', '', ''), ('p', 13, 13, 'd2', 0.6::DOUBLE, 'projects', '', '', 'shop', '', '', '', '', '', '', '', ''),
 ('p', 14, 14, 'd1', 0.6::DOUBLE, 'public_profiles', '', '', '', '', '', '', '', 'https://www.linkedin.com/in/sample', 'LinkedIn', '', ''), ('p', 15, 15, 'd1', 0.6::DOUBLE, 'public_profiles', '', '', '', '', '', '', '', 'https://github.com/x/y', 'Code', '', ''), ('q', 16, 1, 'd3', 0.4::DOUBLE, 'certifications', '', '', 'Cloud Exam', '', '', '', '', '', '', '', '')
) AS c(profile, id, position, document, quality, section, field, value, name, title, organization, start_date, end_date, url, label, degree, institution)"""


def _claims(spark):
    empty = {"status": F.lit("suggested"), "confidence": F.lit(0.9), "resolver_confidence": F.lit(0.0), "highlights": F.array().cast("array<string>"), "technologies": F.array().cast("array<string>"), "links": F.array().cast("array<string>"), "block": F.lit(""), "issuer": F.lit(""), "suggested_section": F.lit(""), "summary": F.lit(""), "location": F.lit("")}
    return _rows(spark, CLAIMS).withColumns(empty)


@register(
    "fuse_profile",
    """SELECT * FROM (VALUES ('p', 'identity', 'identity:full_name', 'Sample Person', 0.9::DOUBLE, 'merged', NULL, NULL), ('p', 'identity', 'identity:headline', 'Data Engineer', 0.8::DOUBLE, 'review', 'current_headline_conflict', 'critical'), ('p', 'identity', 'identity:email', 'a@mail.example', 0.7::DOUBLE, 'merged', NULL, NULL),
    ('p', 'skill', 'skill:python', 'Python', round(0.55 * 0.9 + 0.14 + 0.2 + 0.12, 4)::DOUBLE, 'merged', NULL, NULL), ('p', 'work_experience', 'experience:acme:2019', 'Engineer · ACME · 2019 - present', 0.7::DOUBLE, 'merged', NULL, NULL), ('p', 'work_experience', 'experience:cook:2001', 'Cook · 2001 - 2002', 0.5::DOUBLE, 'review', 'missing_organization', 'critical'),
    ('p', 'education', 'education:state university', 'BSc · State University', 0.5::DOUBLE, 'merged', NULL, NULL), ('p', 'project', 'project:shop', 'Shop', 0.6::DOUBLE, 'merged', NULL, NULL), ('p', 'public_profile', 'public_profile:linkedin', 'https://www.linkedin.com/in/sample', 0.6::DOUBLE, 'merged', NULL, NULL),
    ('p', 'public_profile', 'ignored_public_profile:github.com/x/y', 'https://github.com/x/y', 0.6::DOUBLE, 'ignored', 'not_a_personal_link', 'optional'), ('q', 'certification', 'certification:cloud exam', 'Cloud Exam', 0.4::DOUBLE, 'merged', NULL, NULL)) AS t(profile, kind, canonical_key, canonical_value, confidence, status, review_reason, review_level)""",
)
def fuse_profile(spark, d):
    return fuse.groups(_claims(spark))


@register("canonical_profile", "SELECT * FROM (VALUES ('p', 'Sample Person', 'Data Engineer', 'a@mail.example', 'Python', 1, 1, 1, 0, 1, 2, 0), ('q', NULL, NULL, NULL, '', 0, 0, 0, 1, 0, 0, 0)) AS t(profile, full_name, headline, email, skills, n_work_experience, n_education, n_project, n_certification, n_public_profile, n_critical, n_optional)")
def canonical_profile(spark, d):
    return fuse.canonical(fuse.groups(_claims(spark)))
