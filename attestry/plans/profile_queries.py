"""Registered intake, query, link, skill, page and profile queries, over literal rows that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import profiles as P
from attestry.plans.catalog import register
from attestry.sources import documents as D
from attestry.sources.tables import table


def _rows(spark, values):
    return spark.sql(f"SELECT * FROM {values}")


ASKED = "(VALUES (1,'ML and SQL job at a company'),(2,'html email'),(3,'REST api'),(4,'which university degree'),(5,'ci/cd awards'),(6,'')) AS t(id, q)"
_EXP = "q"
for _k, _v in P.EXPANSIONS.items():
    _EXP = f"regexp_replace({_EXP}, '\\b{_k}\\b', '{_v}', 'gi')"


@register("query_expand", f"SELECT id, {_EXP} AS expanded FROM {ASKED}")
def query_expand(spark, d):
    return _rows(spark, ASKED).select("id", P.expanded(F.col("q")).alias("expanded"))


_HITS = ", ".join(f"struct_pack(n := {' + '.join(f'contains(lower(q), {chr(39)}{s}{chr(39)})::INT' for s in signals)}, k := {-i}, kind := '{kind}')" for i, (kind, signals) in enumerate(P.SIGNALS.items()))


@register("query_classify", f"SELECT id, CASE WHEN b.n > 0 THEN b.kind ELSE 'general' END AS kind FROM (SELECT id, list_max([{_HITS}]) AS b FROM {ASKED})")
def query_classify(spark, d):
    return _rows(spark, ASKED).select("id", P.query_kind(F.col("q")).alias("kind"))


PHONES = "(VALUES (1,'98765 43210'),(2,'+91-98765-43210'),(3,'+1 212 555 0187'),(4,' 12  34 '),(5,'')) AS t(id, v)"


@register("phone_normalize", f"WITH r AS (SELECT id, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS raw, regexp_replace(v, '[^0-9]+', '', 'g') AS g FROM {PHONES}), f AS (SELECT id, raw, CASE WHEN length(g) = 10 THEN '91' || g ELSE g END AS g FROM r) SELECT id, CASE WHEN length(g) >= 12 AND starts_with(g, '91') THEN '+91 ' || substr(g, 3, 5) || ' ' || substr(g, 8) ELSE raw END AS phone FROM f")
def phone_normalize(spark, d):
    return _rows(spark, PHONES).select("id", P.phone(F.col("v")).alias("phone"))


LINKS = "(VALUES (1,'linkedin.com/in/sample-user',''),(1,'https://www.linkedin.com/in/sample-user/',''),(2,'github.com/sample-user',''),(2,'github.com/sample-user/demo-repo',''),(3,'https://huggingface.co/spaces/x',''),(3,'https://huggingface.co/',''),(4,'sample.org','Website'),(4,'sample.org',''),(5,'sample.dev','portfolio'),(5,'shop.example.com/a/b','')) AS t(grp, url, label)"
_KEY = "regexp_replace(lower(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*', 0)), '^www\\.', '') || regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*([^?#]*)', 1), '/+$', '')"


@register(
    "link_classify",
    f"""WITH k AS (SELECT grp, url, label, {_KEY} AS key FROM {LINKS}), h AS (SELECT *, string_split(key, '/')[1] AS host, len(string_split(key, '/')) - 1 AS depth, string_split(key, '/')[2] AS first FROM k)
    SELECT grp, url, label, CASE WHEN host = 'linkedin.com' THEN 'linkedin' WHEN host = 'github.com' THEN CASE WHEN depth >= 2 THEN 'project_repo' ELSE 'github_profile' END WHEN host = 'huggingface.co' THEN CASE WHEN depth >= 2 OR first IN ('spaces', 'datasets', 'models') THEN 'project_repo' ELSE 'organization_site' END
    WHEN lower(label) IN ('portfolio', 'personal website', 'website') THEN CASE WHEN host LIKE '%.org' THEN 'organization_site' ELSE 'personal_portfolio' END WHEN depth > 0 THEN 'client_site' WHEN host LIKE '%.org' THEN 'community_site' ELSE 'website' END AS kind FROM h""",
)
def link_classify(spark, d):
    return _rows(spark, LINKS).select("grp", "url", "label", P.link_kind(F.col("url"), F.col("label")).alias("kind"))


@register("anomalies", f"SELECT grp, count(DISTINCT url) AS formats FROM {LINKS} GROUP BY grp HAVING count(DISTINCT url) > 1 AND count(DISTINCT {_KEY}) = 1")
def anomalies(spark, d):
    return P.same_destination(_rows(spark, LINKS), "grp", "url")


BLOCKS = "(VALUES (1,600.0,1,20.0,30.0,500.0),(1,600.0,2,20.0,200.0,200.0),(1,600.0,3,340.0,150.0,200.0),(1,600.0,4,22.0,300.0,200.0),(1,600.0,5,341.0,400.0,200.0),(2,600.0,6,20.0,300.0,100.0),(2,600.0,7,400.0,100.0,100.0)) AS t(page, page_width, id, x0, y0, width)"


@register(
    "page_block_order",
    f"""WITH b AS (SELECT *, (y0 <= 120 AND width >= 0.55 * page_width) OR width >= 0.72 * page_width AS top FROM {BLOCKS}), g AS (SELECT page, page_width, x0, lead(x0) OVER (PARTITION BY page ORDER BY x0) - x0 AS step, count(*) OVER (PARTITION BY page) AS n FROM b WHERE NOT top),
    e AS (SELECT page, arg_max(x0 + step / 2, step) AS edge FROM g WHERE n >= 4 AND step >= 0.08 * page_width GROUP BY page)
    SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN top THEN 0 WHEN edge IS NULL OR x0 < edge THEN 1 ELSE 2 END, y0, x0, id) AS place FROM b LEFT JOIN e USING (page)""",
)
def page_block_order(spark, d):
    rows = _rows(spark, BLOCKS)
    return P.page_order(rows.select("page", "id", *[F.col(c).cast("double").alias(c) for c in ("page_width", "x0", "y0", "width")]))


FILES = "(VALUES ('cv final.docx', 10),('../x.TXT', 0),('a b?.md', 99999999),('__.exe', 5),('notes.txt', 7),('no/tes.txt', 7),('???', 3),('cv.pdf', 9),('page.html', 9),('k.YAML', 9)) AS t(raw, length)"


@register("file_intake", f"""WITH n AS (SELECT raw, length, CASE WHEN trim(regexp_replace(raw, '[^a-zA-Z0-9._-]+', '_', 'g'), '._') = '' THEN 'document' ELSE trim(regexp_replace(raw, '[^a-zA-Z0-9._-]+', '_', 'g'), '._') END AS name FROM {FILES}), m AS (SELECT raw, name, length, CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'yaml' THEN 'application/yaml' END AS media_type FROM n)
SELECT raw, name, media_type, CASE WHEN length > 26214400 THEN 413 WHEN media_type IS NULL THEN 400 WHEN length = 0 THEN 422 ELSE 200 END AS status FROM m""")
def file_intake(spark, d):
    kept, rejected = D.accepted(_rows(spark, FILES).withColumn("name", D.safe_name(F.col("raw"))))
    out = kept.select("raw", "name").withColumn("status", F.lit(200)).unionByName(rejected.select("raw", "name", "status"))
    return out.select("raw", "name", D.media_type(F.col("name")).alias("media_type"), "status")


@register("name_collisions", "SELECT * FROM (VALUES ('a', 1, 'cv.txt'), ('a', 2, 'cv_1.txt'), ('a', 3, 'cv_2.txt'), ('b', 4, 'cv.txt'), ('a', 5, 'cv'), ('a', 6, 'cv_1')) AS t(folder, position, name)")
def name_collisions(spark, d):
    files = spark.createDataFrame([("a", 1, "cv.txt"), ("a", 2, "cv.txt"), ("a", 3, "cv.txt"), ("b", 4, "cv.txt"), ("a", 5, "cv"), ("a", 6, "cv")], "folder string, position int, name string")
    return D.numbered_names(files, "folder")


@register("jsonish_cells", """SELECT * FROM (VALUES (1, '["a", 1]'), (2, '["a", "b"]'), (3, NULL), (4, NULL), (5, '{"k": null}'), (6, NULL), (7, '3')) AS t(id, value)""")
def jsonish_cells(spark, d):
    cells = [(1, '["a", 1]'), (2, "['a', 'b']"), (3, "plain words"), (4, None), (5, "{'k': None}"), (6, " "), (7, "3 ")]
    return spark.createDataFrame(cells, "id int, cell string").select("id", D.jsonish(F.col("cell")).alias("value"))


GOLD = "(VALUES ('r1', 'a.pdf'), ('r2', 'b.pdf'), ('r3', ''), ('', 'x.pdf'), (NULL, 'y.pdf')) AS g(resume_id, local_pdf_name)"
MANIFEST = "(VALUES ('r1', '/data/one.pdf', '/src/one.pdf'), ('r2', ' ', '/src/two.pdf'), ('', '/no', '')) AS m(resume_id, local_pdf_path, source_pdf_path)"


@register("manifest_join", f"SELECT g.resume_id, g.local_pdf_name, coalesce(nullif(trim(m.local_pdf_path), ''), nullif(trim(m.source_pdf_path), ''), '/base/sample_pdfs/' || nullif(g.local_pdf_name, ''), '') AS file_path FROM {GOLD} LEFT JOIN {MANIFEST} ON m.resume_id = g.resume_id WHERE g.resume_id <> ''")
def manifest_join(spark, d):
    return D.with_manifest(_rows(spark, GOLD), _rows(spark, MANIFEST), "/base/")


FACTS = "(VALUES (1,1,'identity','Sample User'),(1,2,'skills','Python'),(1,3,'skills','python'),(1,4,'skills','SQL'),(1,5,'identity',''),(1,6,'identity','Sample B. User'),(2,1,'projects','x')) AS t(profile, at, section, value)"


@register("profile_rollup", f"""WITH f AS (SELECT profile, lower(value) AS k, min(struct_pack(a := "at", v := value)) AS m FROM {FACTS.replace('(profile, at,', '(profile, "at",')} WHERE section = 'skills' GROUP BY 1, 2), s AS (SELECT profile, string_agg(m.v, ', ' ORDER BY m.a) AS skills, count(*) AS n FROM f GROUP BY 1),
i AS (SELECT profile, arg_max(value, "at") AS name FROM {FACTS.replace('(profile, at,', '(profile, "at",')} WHERE section = 'identity' AND value <> '' GROUP BY 1) SELECT profile, name, skills, coalesce(n, 0)::BIGINT AS n_skills FROM (SELECT DISTINCT profile FROM {FACTS.replace('(profile, at,', '(profile, "at",')}) LEFT JOIN i USING (profile) LEFT JOIN s USING (profile)""")
def profile_rollup(spark, d):
    return P.rollup(_rows(spark, FACTS), "profile")


@register("source_rollup", "SELECT source, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, min(doc_id) AS first, max(n_chars) AS longest FROM documents GROUP BY source")
def source_rollup(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.min("doc_id").alias("first"), F.max("n_chars").alias("longest"))


@register("coalesce_precedence", "SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'manual' END, CASE WHEN quality = 1 THEN 'compiled' END, nullif(CASE WHEN n_chars > 3000 THEN 'canonical' ELSE '' END, ''), 'auto') AS mode FROM documents LEFT JOIN labels USING (doc_id)")
def coalesce_precedence(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    mode = F.coalesce(F.when(F.col("toxic") == 1, "manual"), F.when(F.col("quality") == 1, "compiled"), F.when(F.col("n_chars") > 3000, "canonical"), F.lit("auto"))
    return rows.select("doc_id", mode.alias("mode"))
