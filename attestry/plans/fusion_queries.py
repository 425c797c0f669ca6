"""Registered fusion queries, over literal rows that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import fusion as U
from attestry.plans.catalog import register

#: profile, cluster, position, document, quality, title, organization, start_date, end_date, summary, highlights and links (items between semicolons).
WORK = """(VALUES (1,1,1,'a',0.7,'Engineer','Acme','Jan 2021','Present','Kept the ledgers','Wrote tests;Kept the  ledgers','x.dev'),(1,1,2,'b',0.9,'engineer','Acme Ltd','2020','2022','','wrote tests;Cut costs',''),(1,2,3,'a',0.5,'Clerk','','','','Filed letters','',''),(1,3,4,'a',0.6,'Engineer','Beta','2019','','','',''),(1,3,5,'b',0.6,'Manager','Beta','2018','','','',''),
(1,4,6,'a',0.6,'Engineer','Gamma','','','','',''),(1,4,7,'a',0.6,'Engineer','Delta Works','','','','',''),(2,1,8,'c',0.4,'Maintainer','Acme','','','An open source thing','',''),(2,2,9,'c',0.4,'Engineer','Acme','soon','','','','github.com/sample-user/demo-repo'),(2,3,10,'c',0.3,'','','','','','','')) AS t(profile, cluster, position, document, quality, title, organization, start_date, end_date, summary, highlights, links)"""
_HELD = lambda text, words: "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"
_KEY = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9+#./ -]+', ' ', 'g'), ' +', ' ', 'g'))"
_BEST = lambda x: f"arg_max({x}, struct_pack(a := quality, b := length({x}), c := -position)) FILTER ({x} <> '')"


@register(
    "experience_merge",
    f"""WITH w AS (SELECT *, try_cast(nullif(regexp_extract(start_date, '(19|20)[0-9][0-9]'), '') AS INT) AS y0, try_cast(nullif(regexp_extract(end_date, '(19|20)[0-9][0-9]'), '') AS INT) AS y1 FROM {WORK}),
    i AS (SELECT profile, cluster, 0 AS part, position, 0 AS n, summary AS v FROM w UNION ALL SELECT profile, cluster, 1, position, n, parts[n] FROM (SELECT *, string_split(highlights, ';') AS parts, unnest(range(1, 1 + len(string_split(highlights, ';')))) AS n FROM w)),
    k AS (SELECT profile, cluster, lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) AS l, min(struct_pack(part, position, n, t := trim(regexp_replace(v, '\\s+', ' ', 'g')))) AS o FROM i WHERE trim(v) <> '' GROUP BY 1, 2, 3),
    h AS (SELECT profile, cluster, string_agg(o.t, ';' ORDER BY o) AS highlights, arg_min(o.t, o) AS summary FROM k GROUP BY 1, 2),
    g AS (SELECT profile, cluster, {_BEST('title')} AS title, {_BEST('organization')} AS organization, arg_max(start_date, struct_pack(a := (y0 IS NOT NULL)::INT, b := -coalesce(y0, 9999), c := quality, d := length(start_date), e := -position)) FILTER (start_date <> '') AS start_date,
     arg_max(end_date, struct_pack(a := (y1 IS NOT NULL)::INT, b := coalesce(y1, -1), c := quality, d := length(end_date), e := -position)) FILTER (end_date <> '') AS end_date, max(quality)::DOUBLE AS confidence, string_agg(links, ' ') AS links, count(DISTINCT {_KEY('title')}) FILTER ({_KEY('title')} <> '') AS titles, count(DISTINCT {_KEY('organization')}) FILTER ({_KEY('organization')} <> '') AS orgs,
     array_to_string(list_sort(list_distinct(list(document))), ',') AS documents FROM w GROUP BY 1, 2),
    m AS (SELECT g.*, h.highlights, h.summary, concat_ws(' ', title, organization, summary, highlights, links) AS body, concat_ws(' · ', title, organization, nullif(concat_ws(' - ', start_date, end_date), '')) AS v FROM g LEFT JOIN h USING (profile, cluster)),
    r AS (SELECT *, CASE WHEN ({_HELD('body', U.PROJECT_WORDS)} AND NOT {_HELD("coalesce(title, '')", U.ROLE_WORDS)}) OR contains(links, 'github.com/sample-user/') THEN 'project_inside_experience' WHEN organization IS NULL THEN 'missing_organization' WHEN titles > 1 THEN 'same_company_different_roles' WHEN orgs > 1 THEN 'same_dates_different_company' END AS review_reason FROM m)
    SELECT profile, cluster, title, organization, start_date, end_date, summary, coalesce(highlights, '') AS highlights, documents, confidence, review_reason, CASE WHEN review_reason IS NULL THEN 'merged' ELSE 'review' END AS status, coalesce(nullif(v, ''), 'Experience entry') AS canonical_value,
    'experience:' || {_KEY('coalesce(organization, title, v)')} || ':' || {_KEY("coalesce(start_date, '')")} AS canonical_key FROM r""",
)
def experience_merge(spark, d):
    items = lambda c: F.split(c, ";")
    claims = spark.sql(f"SELECT * FROM {WORK}").withColumns({"highlights": items("highlights"), "links": items("links"), "quality": F.col("quality").cast("double")})
    out = U.merged_experience(claims)
    return out.select("profile", "cluster", "title", "organization", "start_date", "end_date", "summary", F.array_join("highlights", ";").alias("highlights"), F.array_join(F.array_sort("documents"), ",").alias("documents"), "confidence", "review_reason", "status", "canonical_value", "canonical_key")


STUDY = "(VALUES (1,1,1,'a',0.7,'MSc','Some School','2019','2021'),(1,1,2,'b',0.6,'msc','Some School of Arts','2018','2020'),(1,2,3,'a',0.5,'BSc','Other School','',''),(1,2,4,'b',0.5,'Bachelor','Other School','',''),(2,1,5,'c',0.5,'','','','')) AS t(profile, cluster, position, document, quality, degree, institution, start_date, end_date)"


@register("education_merge", f"""WITH g AS (SELECT profile, cluster, {_BEST('degree')} AS degree, {_BEST('institution')} AS institution, min(nullif(start_date, '')) AS start_date, max(nullif(end_date, '')) AS end_date, count(DISTINCT nullif(lower(degree), '')) AS n, max(quality)::DOUBLE AS confidence FROM {STUDY} GROUP BY 1, 2)
SELECT profile, cluster, degree, institution, start_date, end_date, confidence, CASE WHEN n > 1 THEN 'review' ELSE 'merged' END AS status, CASE WHEN n > 1 THEN 'degree_wording_conflict' END AS review_reason, 'education:' || lower(coalesce(institution, degree, '')) AS canonical_key, coalesce(nullif(concat_ws(' · ', degree, institution), ''), 'Education entry') AS canonical_value FROM g""")
def education_merge(spark, d):
    claims = spark.sql(f"SELECT * FROM {STUDY}").withColumn("quality", F.col("quality").cast("double"))
    return U.merged_education(claims).drop("summary", "links", "documents")


KEYED = "(VALUES (1,'skills','','Fast API','',''),(2,'skills','','Zig','',''),(3,'work_experience','','Engineer','Acme, Ltd','2020'),(4,'education','','MSc','Some School',''),(5,'projects','','','one two three four five six seven',''),(6,'projects','','Log Reader','x',''),(7,'certifications','','Cloud Exam','Board',''),(8,'identity','email','A@b.org','',''),(9,'identity','phone','+1 212','',''),(10,'identity','full_name','x','',''),(11,'public_profiles','','https://www.linkedin.com/in/x','',''),(12,'public_profiles','','github.com/x/y/','',''),(13,'other','','','','')) AS t(id, section, field, a, b, c)"


@register("claim_keys", f"""SELECT id, CASE section WHEN 'skills' THEN 'skill:' || CASE WHEN lower(a) = 'fast api' THEN 'fastapi' ELSE {_KEY('a')} END WHEN 'work_experience' THEN 'work_experience|' || {_KEY('b')} || '|' || {_KEY('a')} || '|' || {_KEY('c')} || '|' WHEN 'education' THEN 'education|' || {_KEY('b')} || '|' || {_KEY('a')}
WHEN 'projects' THEN 'project:' || CASE WHEN a <> '' THEN lower(a) ELSE array_to_string(string_split(b, ' ')[1:6], ' ') END WHEN 'certifications' THEN 'certification|' || {_KEY('a')} || '|' || {_KEY('b')} WHEN 'identity' THEN 'identity:' || field || CASE field WHEN 'email' THEN ':' || lower(a) WHEN 'phone' THEN ':' || regexp_replace(a, '[^0-9]', '', 'g') ELSE '' END
WHEN 'public_profiles' THEN CASE WHEN contains(a, 'linkedin') THEN 'public_profile:linkedin' ELSE 'ignored_public_profile:github.com/x/y' END ELSE section END AS key FROM {KEYED}""")
def claim_keys(spark, d):
    pick = lambda c, *sections: F.when(F.col("section").isin(*sections), F.col(c))
    claims = spark.sql(f"SELECT * FROM {KEYED}").select(
        "id", "section", "field", pick("a", "identity").alias("value"), pick("a", "skills", "projects", "certifications").alias("name"), pick("a", "work_experience").alias("title"), pick("b", "work_experience").alias("organization"), pick("c", "work_experience").alias("start_date"),
        pick("a", "education").alias("degree"), pick("b", "education").alias("institution"), pick("b", "projects").alias("summary"), pick("b", "certifications").alias("issuer"), pick("a", "public_profiles").alias("url"),
    )
    return U.claim_key(claims)


ITEMS = "(VALUES (1,1,1,'a',0.7,'Log Reader','','Reads logs','Go;SQL','x.dev'),(1,1,2,'b',0.9,'log reader','','Reads logs quickly and well','sql;Redis',''),(1,2,3,'a',0.5,'','','Makes maps of old towns by hand','',''),(2,1,4,'c',0.5,'','Board','','',''),(2,2,5,'c',0.4,'','','','','')) AS t(profile, cluster, position, document, quality, name, issuer, summary, technologies, links)"


@register(
    "project_merge",
    f"""WITH u AS (SELECT profile, cluster, position, n, parts[n] AS v FROM (SELECT *, string_split(technologies, ';') AS parts, unnest(range(1, 1 + len(string_split(technologies, ';')))) AS n FROM {ITEMS})),
    k AS (SELECT profile, cluster, lower(v) AS l, min(struct_pack(position, n, t := v)) AS o FROM u WHERE v <> '' GROUP BY 1, 2, 3), t AS (SELECT profile, cluster, string_agg(o.t, ';' ORDER BY o) AS technologies FROM k GROUP BY 1, 2),
    g AS (SELECT profile, cluster, arg_min(name, position) FILTER (name <> '') AS named, arg_max(summary, struct_pack(a := length(summary), b := -position)) FILTER (summary <> '') AS summary, max(quality)::DOUBLE AS confidence FROM {ITEMS} GROUP BY 1, 2),
    m AS (SELECT *, coalesce(named, array_to_string(string_split(summary, ' ')[1:6], ' ')) AS name FROM g)
    SELECT profile, cluster, name, summary, coalesce(technologies, '') AS technologies, confidence, 'merged' AS status, 'project:' || coalesce(lower(name), '') AS canonical_key, coalesce(nullif(concat_ws(' · ', name, summary), ''), 'Project') AS canonical_value FROM m LEFT JOIN t USING (profile, cluster)""",
)
def project_merge(spark, d):
    claims = spark.sql(f"SELECT * FROM {ITEMS}").withColumns({"technologies": F.split("technologies", ";"), "links": F.split("links", ";"), "quality": F.col("quality").cast("double")})
    return U.merged_items(claims, "project").select("profile", "cluster", "name", "summary", F.array_join("technologies", ";").alias("technologies"), "confidence", "status", "canonical_key", "canonical_value")


@register("certification_merge", f"SELECT profile, cluster, arg_min(name, position) FILTER (name <> '') AS name, arg_min(issuer, position) FILTER (issuer <> '') AS issuer, max(quality)::DOUBLE AS confidence, 'certification:' || lower(coalesce(arg_min(name, position) FILTER (name <> ''), arg_min(issuer, position) FILTER (issuer <> ''), '')) AS canonical_key FROM {ITEMS} GROUP BY 1, 2")
def certification_merge(spark, d):
    claims = spark.sql(f"SELECT * FROM {ITEMS}").drop("technologies", "links").withColumn("quality", F.col("quality").cast("double"))
    return U.merged_items(claims, "certification").select("profile", "cluster", "name", "issuer", "confidence", "canonical_key")
