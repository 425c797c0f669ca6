"""Registered queries of overviews, anomalies, duplicates and articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import deciding, overview
from attestry.plans.catalog import register
from attestry.sources.tables import table


def _rows(spark, values: str):
    return spark.sql("SELECT * FROM " + values.replace("[]", "CAST(array() AS array<string>)").replace("['", "array('").replace("']", "')"))


WORK = """(VALUES ('p', 1, 'Dev', 'Acme', '2019', '2021'), ('p', 2, 'Engineer', 'ACME', '2019', '2021'), ('p', 3, 'dev', 'acme', '2020', ''), ('p', 4, 'Dev', 'Beta', '2010', '2012'), ('p', 5, 'Dev', 'Beta', '2015', '2016'), ('p', 6, 'Dev', 'Gamma', '', ''), ('p', 7, 'Dev', 'gamma', '', ''), ('p', 8, 'Dev', '', '', ''), ('q', 9, 'Dev', 'Acme', '2019', '2021'), ('p', 10, 'Cook', 'Beta', '2014', 'present'), ('p', 11, 'cook', 'beta', '2018', '2019')) AS w(profile, id, title, organization, start_date, end_date)"""
_Y = "coalesce(try_cast(nullif({}, '') AS INT), {})"
_E = "CASE WHEN {0} = 'present' THEN 9999 ELSE coalesce(try_cast(nullif({0}, '') AS INT), 9999) END"


@register(
    "work_duplicates",
    f"""WITH w AS (SELECT *, {_Y.format('start_date', 0)} AS s, {_E.format('end_date')} AS e, coalesce(try_cast(nullif(coalesce(nullif(start_date, ''), end_date), '') AS INT), 0) AS f FROM {WORK}),
    p AS (SELECT x.id AS a, y.id AS b, lower(x.title) = lower(y.title) AS t, x.s = 0 OR y.s = 0 OR greatest(x.s, y.s) <= least(x.e, y.e) AS o, x.s = y.s AND x.e = y.e AS same, x.start_date || x.end_date || y.start_date || y.end_date = '' AS undated, abs(x.f - y.f) <= 1 AS near
      FROM w x JOIN w y ON x.profile = y.profile AND lower(x.organization) = lower(y.organization) AND x.organization <> '' AND x.id < y.id)
    SELECT a, b, CASE WHEN (o AND same) OR (t AND (undated OR near)) THEN 'exact' ELSE 'potential' END AS decision FROM p WHERE (o AND same) OR (t AND (undated OR near)) OR (t AND o)""",
)
def work_duplicates(spark, d):
    return overview.work_duplicates(_rows(spark, WORK))


PROJECTS = """(VALUES ('p', 1, 'Note Search', 'Search over notes', ['Python', 'Redis'], ['https://x.example/a']), ('p', 2, 'Other', 'Something else', [], ['http://www.x.example/a/']), ('p', 3, 'note search', '', [], []), ('p', 4, 'Ledger', 'Keeps the books of a shop', ['SQL'], []), ('p', 5, 'Ledgers', 'Keeps the books of a shop', ['sql'], []), ('q', 6, 'Note Search', '', [], [])) AS g(profile, id, name, summary, technologies, links)"""


@register("project_duplicates", "SELECT * FROM (VALUES (1, 2, 'exact'), (1, 3, 'exact'), (4, 5, 'exact')) AS t(a, b, decision)")
def project_duplicates(spark, d):
    return overview.project_duplicates(_rows(spark, PROJECTS))


GROUPS = """(VALUES (1, 'public_profile', 'merged', '', '', '', '', [], ['https://x.example/', 'http://www.x.example'], ''), (2, 'public_profile', 'merged', '', '', '', '', [], ['https://x.example', 'https://y.example'], ''), (3, 'ignored_public_profile', 'ignored', '', '', '', '', [], [], 'client_site'), (4, 'ignored_public_profile', 'ignored', '', '', '', '', [], [], 'else'),
 (5, 'work_experience', 'merged', '', 'Maintainer', '', 'An open source tool', [], [], ''), (6, 'work_experience', 'merged', '', 'Engineer', 'Acme', 'An open source tool', [], [], ''), (7, 'work_experience', 'merged', '', '', 'Acme', '', ['https://github.com/sample-user/demo'], [], ''), (8, 'work_experience', 'review', 'project_inside_experience', 'x', '', 'a project', [], [], ''), (9, 'work_experience', 'ignored', '', 'x', '', 'a project', [], [], '')) AS g(id, kind, status, reason, title, organization, summary, links, formats, link_type)"""


@register("anomaly_kinds", "SELECT * FROM (VALUES (1, 'duplicate_url_different_format', 'low', 'The same destination URL appeared in multiple formats and was canonicalized automatically.'), (3, 'section_misclassification', 'low', 'A client or external site was kept out of personal profile links.'), (4, 'section_misclassification', 'low', 'A non-profile website was kept out of personal profile links.'), (5, 'project_inside_experience', 'medium', 'Maintainer looks more like a project than a job.'), (7, 'project_inside_experience', 'medium', 'This experience entry looks more like a project than a job.')) AS t(id, anomaly, severity, message)")
def anomaly_kinds(spark, d):
    return overview.anomalies(_rows(spark, GROUPS))


ENTRIES = """(VALUES ('p', 'projects', 1, 1, 'd1', 0.5, 'Shop', 'Sells things', ['SQL'], []), ('p', 'projects', 2, 2, 'd2', 0.6, 'shop', 'sells things', ['Go', 'sql'], ['http://s.example']), ('p', 'projects', 3, 3, 'd2', 0.6, 'Shop', 'Sells other things', [], []), ('q', 'projects', 4, 1, 'd3', 0.4, '', '', ['C'], [])) AS e(profile, kind, id, position, document, quality, name, summary, technologies, links)"""


@register("overview_fold", "SELECT * FROM (VALUES ('p', 'Shop', 'Sells things', 'SQL,Go', 'http://s.example', 'd1,d2'), ('p', 'Shop', 'Sells other things', '', '', 'd2'), ('q', NULL, NULL, 'C', '', 'd3')) AS t(profile, name, summary, technologies, links, documents)")
def overview_fold(spark, d):
    found = overview.folded(_rows(spark, ENTRIES).withColumn("quality", F.col("quality").cast("double")), "projects")
    joined = {c: F.array_join(c, ",") for c in ("technologies", "links", "documents")}
    return found.select("profile", F.nullif("name", F.lit("")).alias("name"), F.nullif("summary", F.lit("")).alias("summary"), *[v.alias(k) for k, v in joined.items()])


@register("overview_resolution", "SELECT * FROM (VALUES ('a', 'auto', 'web_dev', 'User A', 'Auto headline', 'SQL'), ('b', 'canonical', 'ai_ml', 'Set Name', 'View headline', 'RAG'), ('c', 'canonical', 'none', 'C', 'Canonical headline', 'By hand'), ('d', 'auto', NULL, 'User D', NULL, '')) AS t(profile, mode, view, full_name, headline, skills)")
def overview_resolution(spark, d):
    part = "struct<identity:map<string,string>,skills:array<string>,profile_view:string,profile_focus:string>"
    o = lambda name, headline, skills, view=None, focus=None: ({k: v for k, v in (("full_name", name), ("headline", headline)) if v is not None}, skills, view, focus)
    rows = [
        ("a", "User A", o("", "Auto headline", ["SQL"], None, "web_dev"), o("", "", []), {}, None, None),
        ("b", "User B", o("x", "y", []), o("B", "Canonical headline", ["SQL"], " ai_ml "), {"ai_ml": o("B", "View headline", ["RAG"])}, {"full_name": "Set Name", "headline": None}, None),
        ("c", "User C", o("x", "y", []), o("C", "Canonical headline", ["SQL"], "none"), {"ai_ml": o("C", "View headline", ["RAG"])}, {}, ["By hand"]),
        ("d", "User D", o(None, None, []), None, None, None, None),
    ]
    profiles = spark.createDataFrame(rows, f"profile string, user_name string, auto {part}, canonical {part}, views map<string,{part}>, manual map<string,string>, manual_skills array<string>")
    return overview.resolved(profiles).select("profile", "mode", "view", F.col("identity")["full_name"].alias("full_name"), F.col("identity")["headline"].alias("headline"), F.array_join("skills", ",").alias("skills"))


@register(
    "profile_summaries",
    """SELECT c_custkey AS profile, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS document_count, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_linestatus = 'O') AS pending_claim_count,
    (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R') AS approved_claim_count, CASE WHEN c_custkey % 2 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS sections_ready FROM customer""",
)
def profile_summaries(spark, d):
    """Customers stand for profiles, orders for documents and lines for claims."""
    profiles = table(spark, d, "customer").select(F.col("c_custkey").alias("profile"))
    documents = table(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("profile"))
    lines = table(spark, d, "lineitem")
    claims = lines.select(F.col("l_orderkey").alias("document"), F.when(F.col("l_linestatus") == "O", "pending").alias("status"))
    section = F.when(F.col("profile") % 2 == 0, F.array(F.lit("skills"), F.lit("projects"), F.lit("skills"), F.lit("other"))).when(F.col("profile") % 3 == 0, F.array(F.lit("identity"))).otherwise(F.array().cast("array<string>"))
    entries = profiles.select("profile", F.explode(section).alias("section"))
    return overview.summaries(profiles, documents, claims, lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document")), entries)


@register("claim_review_sync", "SELECT * FROM (VALUES (1, 'new one'), (2, 'two'), (4, 'four')) AS t(claim, text)")
def claim_review_sync(spark, d):
    approved = spark.createDataFrame([(1, "old one"), (2, "two"), (3, "three")], "claim int, text string")
    claims = spark.createDataFrame([(1, "new one"), (3, "three"), (4, "four"), (5, "five")], "claim int, text string")
    reviews = spark.createDataFrame([(1, 1, "approved"), (3, 1, "rejected"), (4, 1, "rejected"), (4, 2, "approved"), (5, 1, "approved"), (5, 2, "pending")], "claim int, at int, status string")
    return overview.reviewed(approved, claims, reviews)


LINES = """(VALUES ('p', 'work-experience', 1, 'Dev', 'Acme', '2019', 'present', 'Built it', '', '', '', '', [], ''), ('p', 'work-experience', 2, '', '', '', '', '', '', '', '', '', [], ''), ('p', 'education', 1, '', '', '', '', '', 'BSc', 'Some School', 'Physics', '', [], ''), ('p', 'projects', 1, '', '', '', '', 'Sells', '', '', '', 'Shop', ['a', 'b', 'c', 'd', 'e', 'f'], ''), ('q', 'certifications', 1, '', '', '', '', '', '', '', '', 'Exam', [], 'Board')) AS e(profile, kind, position, title, organization, start_date, end_date, summary, degree, institution, field, name, technologies, issuer)"""


@register("wiki_articles", "SELECT profile, slug, n::BIGINT AS n, body FROM (VALUES ('p', 'work-experience', 2, '- Dev at Acme (2019 - present): Built it' || chr(10) || '- Role'), ('p', 'education', 1, '- BSc, Some School in Physics'), ('p', 'projects', 1, '- Shop: Sells (a, b, c, d, e)'), ('q', 'certifications', 1, '- Exam, Board')) AS t(profile, slug, n, body)")
def wiki_articles(spark, d):
    return overview.articles(_rows(spark, LINES))


CONTACTS = "(VALUES (1, 'email', ' A@Mail.Example ', ''), (2, 'email', 'no mail', ''), (3, 'url', 'www.github.com/x.', 'Code'), (4, 'url', 'https://site.example', 'Site'), (5, 'url', '', ''), (6, 'phone', '+1 (212) 555-0187', ''), (7, 'phone', '555', ''), (8, 'location', 'new  delhi', ''), (9, 'location', 'Nowhere', ''), (10, 'other', 'x', ''), (11, 'url', 'https://linkedin.com/in/x', 'LinkedIn')) AS c(id, kind, raw, label)"


@register(
    "field_decisions",
    """SELECT * FROM (VALUES (1, 'a@mail.example', NULL, 'auto_correct', 0.99::DOUBLE, 2), (2, 'no mail', NULL, 'needs_review', 0.42::DOUBLE, 0), (3, 'https://www.github.com/x', 'GitHub', 'auto_correct', 0.98::DOUBLE, 2), (4, 'https://site.example', 'Site', 'keep', 0.98::DOUBLE, 2), (5, '', '', 'needs_review', 0.35::DOUBLE, 0), (6, '+12125550187', NULL, 'suggest', 0.78::DOUBLE, 1),
    (7, '555', NULL, 'needs_review', 0.25::DOUBLE, 0), (8, 'New Delhi', NULL, 'suggest', 0.84::DOUBLE, 1), (9, 'Nowhere', NULL, 'keep', 0.58::DOUBLE, 1), (10, 'x', NULL, 'keep', 0.4::DOUBLE, 0), (11, 'https://linkedin.com/in/x', 'LinkedIn', 'keep', 0.98::DOUBLE, 2)) AS t(id, value, label, action, confidence, n_evidence)""",
)
def field_decisions(spark, d):
    rows = _rows(spark, CONTACTS).select("id", deciding.contact(F.col("kind"), F.col("raw"), F.col("label"), ["delhi", "london"]).alias("d"))
    return rows.select("id", "d.value", "d.label", "d.action", "d.confidence", F.size("d.evidence").alias("n_evidence"))


RECORDS = "(VALUES ('p', 1, 'Dev', 'Acme', '2019', '2020'), ('p', 2, '', 'Beta Works', '', ''), ('p', 3, 'Cook', 'Diner', '1999', ''), ('q', 4, 'Dev', 'Acme', '2019', '2020')) AS r(profile, id, title, organization, start_date, end_date)"
HINTS = "(VALUES ('p', 11, 'Senior Dev', 'Acme Ltd', '2019', ''), ('p', 12, 'Dev', 'Acme', '2019', '2020'), ('p', 13, 'Lead', 'Beta', '', ''), ('p', 14, 'Guide', 'Museum', '1999', '')) AS h(profile, id, title, organization, start_date, end_date)"
_NEAR = "CASE WHEN {0} <> '' AND {1} <> '' AND (contains(lower({0}), lower({1})) OR contains(lower({1}), lower({0}))) THEN {2}::DOUBLE WHEN {0} = '' AND {1} <> '' THEN 0.05::DOUBLE ELSE 0 END"


@register("hint_match", f"WITH s AS (SELECT r.id, h.id AS hint, round({_NEAR.format('r.organization', 'h.organization', 0.45)} + {_NEAR.format('r.title', 'h.title', 0.35)} + CASE WHEN r.start_date <> '' AND r.start_date = h.start_date THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN r.end_date <> '' AND r.end_date = h.end_date THEN 0.15::DOUBLE ELSE 0 END, 4) AS score FROM {RECORDS} JOIN {HINTS} ON r.profile = h.profile), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, hint) AS n FROM s) SELECT id, hint, score FROM b WHERE n = 1 AND score >= 0.4")
def hint_match(spark, d):
    return deciding.hinted(_rows(spark, RECORDS), _rows(spark, HINTS))


@register("repository_links", "SELECT * FROM (VALUES (1, 'http://a.example,https://github.com/x/note-search'), (2, ''), (3, '')) AS t(id, links)")
def repository_links(spark, d):
    projects = spark.createDataFrame([("p", 1, "Note Search", ["http://a.example"]), ("p", 2, "Ledger", None), ("q", 3, "Note Search", [])], "profile string, id int, name string, links array<string>")
    links = spark.createDataFrame([("p", "https://github.com/x/note-search"), ("p", "https://github.com/x/other"), ("p", None)], "profile string, url string")
    return deciding.with_repositories(projects, links).select("id", F.array_join("links", ",").alias("links"))


@register("group_focus", "WITH w AS (SELECT id, o_orderpriority AS focus, round(sum(0.5 + (o_orderkey % 7) / 14.0::DOUBLE), 6) AS w FROM (SELECT DISTINCT l_suppkey AS id, l_orderkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, focus) AS n FROM w) SELECT id, focus FROM r WHERE n = 1")
def group_focus(spark, d):
    """Suppliers stand for groups, orders for their documents."""
    groups = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("document")).distinct()
    documents = table(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.col("o_orderpriority").alias("focus"), (0.5 + (F.col("o_orderkey") % 7) / 14.0).alias("quality"))
    return deciding.focus_of(groups, documents)
