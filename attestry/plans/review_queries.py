"""Registered admission, review and scoring queries, over literal rows that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import admission as A
from attestry.operators import order_dependent as O
from attestry.operators import review as R
from attestry.operators import scoring as S
from attestry.plans.catalog import register


def _rows(spark, values):
    return spark.sql(f"SELECT * FROM {values}")


def _in(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _key(x):
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9+#./ -]+', ' ', 'g'), ' +', ' ', 'g'))"


_LONG = "Engineer of data systems who turns slow reports into quick ones and likes plain words "
#: id, document, section, suggested_section, status, resolver_action, sure, field, a, b, c, d: what a to d mean depends on the section.
_CLAIMS = [
    (1, "d1", "skills", "", "pending", "keep", 0.3, "", "PostgreSQL", "", "", ""), (2, "d1", "skills", "", "pending", "keep", 0.9, "", "tools", "", "", ""), (3, "d1", "skills", "", "pending", "keep", 0.9, "", "xy", "", "", ""),
    (4, "d1", "skills", "", "pending", "keep", 0.1, "", "k8s", "", "", ""), (5, "d1", "skills", "", "pending", "keep", 0.1, "", "Terraform", "", "", ""), (6, "d1", "skills", "", "pending", "keep", 0.1, "", "crewai", "", "", ""), (7, "d1", "skills", "", "pending", "keep", 0.1, "", "Query Plans", "", "", ""),
    (8, "d1", "skills", "", "pending", "keep", 0.1, "", "Data Mesh", "", "", ""), (9, "d2", "other", "skills", "pending", "keep", 0.1, "", "data mesh", "", "", ""), (10, "d1", "skills", "", "pending", "keep", 0.72, "", "Stream Joins", "", "", ""), (11, "d1", "skills", "", "pending", "keep", 0.55, "", "Range Joins", "", "", ""),
    (12, "d1", "skills", "", "pending", "keep", 0.54, "", "Odd Thing", "", "", ""), (13, "d1", "skills", "", "pending", "keep", 0.9, "", "/CD", "", "", ""), (14, "d1", "skills", "", "rejected", "keep", 0.9, "", "Python", "", "", ""), (15, "d1", "skills", "", "duplicate", "keep", 0.9, "", "Python", "", "", ""),
    (16, "d1", "skills", "", "edited", "keep", 0.9, "", "zz", "", "", ""), (17, "d1", "projects", "", "pending", "keep", 0.5, "", "Pipeline Tool", "", "", ""), (18, "d1", "projects", "", "pending", "keep", 0.5, "", "Pipeline Tool", "Reads logs and writes daily tables", "", ""),
    (19, "d1", "projects", "", "pending", "keep", 0.5, "", "pipeline tool", "", "", ""), (20, "d1", "projects", "", "pending", "keep", 0.5, "", "A b c d e f", "", "", ""), (21, "d1", "projects", "", "pending", "keep", 0.5, "", "Tool.", "", "", ""), (22, "d1", "projects", "", "pending", "keep", 0.5, "", "Tool", "two words", "", ""),
    (23, "d1", "projects", "", "pending", "keep", 0.5, "", "", "", "", ""), (24, "d1", "work_experience", "", "pending", "keep", 0.5, "", "Engineer", "Acme Ltd", "Jan 2023", ""), (25, "d1", "work_experience", "", "pending", "keep", 0.5, "", "Engineer", "Acme Ltd", "", ""), (26, "d1", "work_experience", "", "pending", "keep", 0.5, "", "Engineer", "", "", ""),
    (27, "d1", "work_experience", "", "pending", "keep", 0.5, "", "", "Acme Ltd", "", "Some summary"), (28, "d1", "work_experience", "", "pending", "keep", 0.5, "", "", "Acme Ltd", "", ""), (29, "d1", "work_experience", "", "pending", "keep", 0.5, "", "", "", "", ""),
    (30, "d1", "public_profiles", "", "pending", "keep", 0.5, "", "https://www.linkedin.com/in/sample-user/", "", "", ""), (31, "d1", "public_profiles", "", "pending", "keep", 0.5, "", "github.com/sample-user/demo-repo", "", "", ""), (32, "d1", "public_profiles", "", "pending", "keep", 0.5, "", "demo.vercel.app", "", "", ""),
    (33, "d1", "public_profiles", "", "pending", "keep", 0.5, "", "sample.dev", "Portfolio", "", ""), (34, "d1", "public_profiles", "", "pending", "keep", 0.5, "", "sample.dev", "", "", ""), (35, "d1", "public_profiles", "", "pending", "keep", 0.5, "", "sample.dev/x", "", "", ""), (36, "d1", "public_profiles", "", "pending", "keep", 0.5, "", "", "", "", ""),
    (37, "d1", "public_profiles", "", "pending", "keep", 0.5, "", "meetup.com", "website", "", ""), (38, "d1", "education", "", "pending", "keep", 0.5, "", "BTech Comp Engg", "", "", ""), (39, "d1", "education", "", "pending", "keep", 0.5, "", "MSc Weaving", "", "", ""), (40, "d1", "education", "", "pending", "keep", 0.5, "", "MSc Maths", "Some School", "", ""),
    (41, "d1", "education", "", "pending", "keep", 0.5, "", "", "Some School", "", ""), (42, "d1", "education", "", "pending", "keep", 0.5, "", "", "", "", ""), (43, "d1", "identity", "", "pending", "keep", 0.5, "email", "sample@example.org", "", "", ""), (44, "d1", "identity", "", "pending", "keep", 0.5, "email", "none", "", "", ""),
    (45, "d1", "identity", "", "pending", "keep", 0.5, "phone", "+1 (212) 555-0187", "", "", ""), (46, "d1", "identity", "", "pending", "keep", 0.5, "phone", "123", "", "", ""), (47, "d1", "identity", "", "pending", "keep", 0.5, "full_name", "Sample User", "", "", ""), (48, "d1", "identity", "", "pending", "keep", 0.5, "full_name", "Sample", "", "", ""),
    (49, "d1", "identity", "", "pending", "keep", 0.5, "headline", "Data Engineer", "", "", ""), (50, "d1", "identity", "", "pending", "keep", 0.5, "headline", "Engineer", "", "", ""), (51, "d1", "identity", "", "pending", "keep", 0.5, "location", "", "", "", ""), (52, "d1", "identity", "", "pending", "keep", 0.5, "other", "x", "", "", ""),
    (53, "d1", "identity", "", "pending", "keep", 0.5, "summary", "", "", "", ""), (54, "d1", "identity", "", "pending", "keep", 0.5, "summary", "Built " + _LONG, "", "", ""), (55, "d1", "identity", "", "pending", "keep", 0.5, "summary", "x" * 79, "", "", ""), (56, "d1", "identity", "", "pending", "keep", 0.5, "summary", "x" * 80, "", "", ""),
    (57, "d1", "identity", "", "pending", "keep", 0.5, "summary", "x" * 900, "", "", ""), (58, "d1", "identity", "", "pending", "keep", 0.5, "summary", "x" * 901, "", "", ""), (59, "d1", "identity", "", "pending", "keep", 0.5, "summary", "Managed " + _LONG, "", "", ""), (60, "d1", "identity", "", "pending", "keep", 0.5, "summary", "Since 2019 " + _LONG, "", "", ""),
    (61, "d1", "identity", "", "pending", "keep", 0.5, "summary", _LONG + "| sea", "", "", ""), (62, "d1", "identity", "", "pending", "keep", 0.5, "summary", _LONG, "", "", ""), (63, "d1", "certifications", "", "pending", "keep", 0.5, "", "Cloud Exam", "Some Board", "", ""), (64, "d1", "certifications", "", "pending", "keep", 0.5, "", "Cloud Exam", "", "", ""), (65, "d1", "other", "", "pending", "keep", 0.5, "", "", "", "", ""),
]
_LITERAL = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
CLAIMS = f"(VALUES {', '.join('(' + ', '.join(map(_LITERAL, r)) + ')' for r in _CLAIMS)}) AS t(id, document, section, suggested_section, status, resolver_action, sure, field, a, b, c, d)"
_W = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END".format
_FOUND = f"""WITH c AS (SELECT id, document, status, resolver_action, sure::DOUBLE AS sure, field, trim(a) AS a, trim(b) AS b, trim(c) AS c, trim(d) AS d, CASE WHEN suggested_section <> '' THEN suggested_section ELSE section END AS sec FROM {CLAIMS}),
k AS (SELECT *, {_key('a')} AS key, replace({_key('a')}, ' ', '') AS tight, {_W('a')} AS wa, {_W('b')} AS wb, regexp_replace(lower(regexp_extract(regexp_replace(a, '^[a-z]+://', ''), '^[^/]*')), '^www\\.', '') AS host, len(list_filter(string_split(regexp_replace(a, '^[a-z]+://', ''), '/'), lambda x: x <> '')) - 1 AS depth FROM c),
n AS (SELECT key, count(DISTINCT document) AS docs FROM k WHERE sec = 'skills' GROUP BY 1),
s AS (SELECT k.*, docs, a IN ({_in(A.WHITELIST)}) OR key IN ({_in(A._keys(A.SKILL_ALIASES))}) AS known, key IN ({_in(A.TAXONOMY)}) AS listed FROM k LEFT JOIN n USING (key)),
r AS (SELECT id, sec, CASE WHEN status = 'rejected' THEN 'reject_noise:manually_rejected:0' WHEN status = 'duplicate' OR resolver_action = 'duplicate' THEN 'reject_noise:duplicate_value:0' WHEN status = 'edited' OR resolver_action = 'manual' THEN 'admit:manual_override:1'
WHEN sec = 'skills' THEN CASE WHEN NOT known AND NOT listed AND key NOT IN ({_in(A.SHORT)}) AND (key IN ({_in(A.HEADINGS + A.FRAGMENTS)}) OR length(tight) <= 2 OR regexp_matches(tight, '^[a-z]{{1,4}}$')) THEN 'reject_noise:skill_noise_fragment:0.02' WHEN known THEN 'admit:known_skill_dictionary:0.99' WHEN listed THEN 'admit:skill_taxonomy_match:0.95'
 WHEN key = 'query plans' THEN 'admit:accepted_before:0.96' WHEN docs >= 2 THEN 'admit:seen_in_multiple_documents:0.88' WHEN sure >= 0.72 THEN 'admit:skills_section_quality:0.84' WHEN sure >= 0.55 THEN 'needs_review:low_confidence_skill:0.64' ELSE 'reject_noise:unverified_skill_fragment:0.1' END
WHEN sec = 'projects' THEN CASE WHEN a || b = '' OR (regexp_matches(a, '^[a-z]') AND NOT regexp_matches(a, '[A-Z]')) OR (wa > 5 AND b = '') OR (b <> '' AND wb < 4) THEN 'reject_noise:project_fragment:0.04' WHEN length(a) >= 3 AND a NOT LIKE '%.' AND wb >= 5 THEN 'admit:project_has_structure:0.92'
 WHEN (length(a) >= 3 AND a NOT LIKE '%.') OR wb >= 5 THEN 'admit:project_has_enough_signals:0.82' ELSE 'reject_noise:weak_project_claim:0.18' END
WHEN sec = 'work_experience' THEN CASE WHEN a || b || d = '' THEN 'reject_noise:empty_experience_claim:0.02' WHEN a <> '' AND b <> '' AND c <> '' THEN 'admit:dated_role_with_organization:0.95' WHEN a <> '' AND b <> '' THEN 'admit:role_with_organization:0.82' WHEN a <> '' THEN 'needs_review:missing_organization:0.48' WHEN b <> '' AND d <> '' THEN 'needs_review:organization_without_title:0.42' ELSE 'quarantine:weak_experience_claim:0.18' END
WHEN sec = 'public_profiles' THEN CASE WHEN a = '' THEN 'reject_noise:missing_url:0' WHEN host = 'linkedin.com' THEN 'admit:linkedin_link:0.94' WHEN host = 'github.com' AND depth >= 2 THEN 'quarantine:project_repo_not_personal_profile:0.24' WHEN host LIKE '%vercel.app' THEN 'quarantine:project_demo_not_personal_profile:0.24' WHEN host LIKE '%meetup%' THEN 'quarantine:community_site_not_personal_profile:0.24'
 WHEN lower(b) IN ('portfolio', 'website') THEN 'admit:personal_portfolio_link:0.94' WHEN depth > 0 THEN 'quarantine:client_site_not_personal_profile:0.24' ELSE 'needs_review:unknown_link_type:0.5' END
WHEN sec = 'education' THEN CASE WHEN a || b = '' THEN 'reject_noise:empty_education_claim:0' WHEN key IN ({_in(A._keys(A.DEGREE_ALIASES))}) THEN 'admit:known_degree_alias:0.94' WHEN key = 'msc weaving' THEN 'admit:accepted_degree_before:0.92' WHEN a <> '' AND b <> '' THEN 'admit:degree_with_institution:0.86' ELSE 'needs_review:partial_education_claim:0.56' END
WHEN sec = 'identity' THEN CASE field WHEN 'summary' THEN CASE WHEN a = '' THEN 'reject_noise:empty_summary:0' WHEN regexp_matches(a, '{A.MISPLACED}') THEN 'reject_noise:summary_misclassified_experience:0.06' WHEN length(a) < 80 THEN 'reject_noise:summary_too_short:0.08' WHEN length(a) > 900 THEN 'needs_review:summary_too_long:0.36'
  WHEN regexp_matches(a, '{A.BULLET}') AND wa < 28 THEN 'needs_review:looks_like_experience_bullet:0.42' WHEN regexp_matches(a[1:120], '{A.YEAR}') THEN 'reject_noise:summary_date_heavy:0.08' WHEN contains(a, '|') AND wa < 32 THEN 'reject_noise:summary_looks_like_header:0.06' ELSE 'admit:summary_like_text:0.92' END
 WHEN 'email' THEN CASE WHEN regexp_matches(a, '{A.EMAIL}') THEN 'admit:valid_email:0.98' ELSE 'admit:valid_email:0.28' END WHEN 'phone' THEN CASE WHEN length(regexp_replace(a, '[^0-9]', '', 'g')) >= 10 THEN 'admit:phone_like_value:0.9' ELSE 'reject_noise:invalid_phone:0.04' END
 WHEN 'full_name' THEN CASE WHEN wa >= 2 THEN 'admit:full_name_like_value:0.94' ELSE 'needs_review:weak_name_claim:0.42' END WHEN 'headline' THEN CASE WHEN wa >= 2 THEN 'admit:headline_like_value:0.84' ELSE 'needs_review:weak_headline_claim:0.48' END WHEN 'location' THEN CASE WHEN a <> '' THEN 'admit:location_like_value:0.78' ELSE 'admit:location_like_value:0' END ELSE 'needs_review:generic_identity_claim:0.5' END
WHEN sec = 'certifications' THEN CASE WHEN a <> '' AND b <> '' THEN 'admit:certification_with_issuer:0.82' ELSE 'needs_review:partial_certification_claim:0.5' END ELSE 'needs_review:untyped_claim:0.45' END AS f FROM s)
SELECT id, sec AS preview_section, string_split(f, ':')[1] AS status, string_split(f, ':')[2] AS reason, string_split(f, ':')[3]::DOUBLE AS score FROM r"""


def _claims(spark):
    s = F.coalesce(F.nullif("suggested_section", F.lit("")), F.col("section"))
    pick = lambda a, *sections: F.when(s.isin(*sections), F.col(a))
    return _rows(spark, CLAIMS).select(
        F.lit(1).alias("profile"), "id", "document", "section", "suggested_section", "field", "status", "resolver_action", F.col("sure").cast("double").alias("confidence"), pick("a", "identity").alias("value"), pick("a", "skills", "projects", "certifications").alias("name"),
        pick("a", "work_experience").alias("title"), pick("b", "work_experience").alias("organization"), pick("c", "work_experience").alias("start_date"), F.coalesce(pick("b", "projects"), pick("d", "work_experience")).alias("summary"), pick("a", "public_profiles").alias("url"), pick("b", "public_profiles").alias("label"),
        pick("a", "education").alias("degree"), pick("b", "education").alias("institution"), pick("b", "certifications").alias("issuer"),
    )


@register("claim_admission", _FOUND)
def claim_admission(spark, d):
    accepted = spark.createDataFrame([(1, "skill", "Plans", ["query  plans"]), (1, "degree", "MSc Weaving", None), (2, "skill", "Odd Thing", [])], "profile int, value_type string, value string, aliases array<string>")
    return A.admit(_claims(spark), accepted).drop("profile")


#: Rows of a review: id, profile, document, section, suggested_section, value, status, admission_status, resolver_action.
REVIEW = "(VALUES (1,1,'a','skills','','SQL','pending','admit','keep'),(2,1,'a','skills','','sql','pending','admit','auto_correct'),(3,1,'b','skills','','Redis','rejected','reject_noise','keep'),(4,1,'b','skills','','redis','pending','needs_review','suggest'),(5,1,'b','identity','','x y','accepted','admit','keep'),(6,1,'b','identity','','x y','edited','admit','manual'),(7,2,'c','work_experience','projects','T','pending','quarantine','suggest'),(8,2,'c','public_profiles','','u','duplicate','reject_noise','duplicate'),(9,2,'c','public_profiles','','U','edited','admit','keep'),(10,2,'d','public_profiles','','u','pending','admit','auto_correct')) AS t(id, profile, document, section, suggested_section, value, status, admission_status, resolver_action)"
_COUNTS = {
    "auto_corrected": "admission_status = 'admit' AND resolver_action = 'auto_correct' AND status <> 'duplicate'", "suggested": "resolver_action = 'suggest'", "needs_review": "admission_status IN ('needs_review', 'quarantine')", "ready": "status NOT IN ('rejected', 'duplicate') AND admission_status = 'admit'",
    "duplicates": "'duplicate' IN (status, resolver_action)", "manual": "resolver_action = 'manual' OR status = 'edited'", "rejected": "status = 'rejected' OR admission_status = 'reject_noise'", "quarantined": "admission_status = 'quarantine'",
    "pending_total": "status = 'pending'", "accepted_total": "status = 'accepted'", "edited_total": "status = 'edited'", "rejected_total": "status = 'rejected'",
}


@register("review_counts", f"SELECT profile, count(*) AS claims_total, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _COUNTS.items())} FROM {REVIEW} GROUP BY profile")
def review_counts(spark, d):
    return R.review_counts(_rows(spark, REVIEW))


@register("accept_all", f"SELECT id, status NOT IN ('rejected', 'duplicate', 'accepted') AND admission_status = 'admit' AND document = 'a' AS updated, CASE WHEN updated THEN 'accepted' ELSE status END AS status FROM {REVIEW}")
def accept_all(spark, d):
    return R.accept_all(_rows(spark, REVIEW), "a").select("id", "updated", "status")


@register(
    "duplicate_claims",
    f"""WITH r AS (SELECT *, coalesce(nullif(suggested_section, ''), section) AS shown, status = 'edited' OR resolver_action = 'manual' AS hand FROM {REVIEW}),
    p AS (SELECT *, status <> 'rejected' AND NOT hand AND shown IN ('skills', 'public_profiles') AND EXISTS (SELECT 1 FROM r AS o WHERE o.profile = r.profile AND o.shown = r.shown AND lower(o.value) = lower(r.value) AND o.status <> 'rejected' AND o.id < r.id) AS again FROM r)
    SELECT id, CASE WHEN again THEN 'duplicate' WHEN hand OR status IN ('accepted', 'rejected') THEN status WHEN resolver_action = 'auto_correct' THEN 'accepted' WHEN resolver_action = 'duplicate' THEN 'duplicate' ELSE 'pending' END AS status, CASE WHEN again THEN 'duplicate' ELSE resolver_action END AS resolver_action FROM p""",
)
def duplicate_claims(spark, d):
    return R.duplicates_marked(_rows(spark, REVIEW).withColumn("field", F.lit("f")).withColumn("position", F.col("id"))).select("id", "status", "resolver_action")


EDITS = "(VALUES (1,'accepted','',''),(2,'','projects',''),(4,'','','Redis 7'),(7,'','projects',''),(8,'rejected','',''),(5,'edited','','x y')) AS t(id, new_status, new_section, given)"


@register(
    "edit_claims",
    f"""WITH e AS (SELECT r.*, e.new_status, coalesce(nullif(e.new_section, ''), section) AS sec, coalesce(nullif(given, ''), value) AS v FROM {REVIEW.replace(' AS t(', ' AS r(')} LEFT JOIN {EDITS.replace(' AS t(', ' AS e(')} USING (id)),
    m AS (SELECT *, sec <> section AND sec = suggested_section AS took, (sec <> section AND sec <> suggested_section) OR v <> value AS hand FROM e),
    s AS (SELECT *, CASE WHEN new_status <> '' THEN new_status WHEN hand THEN 'edited' WHEN took AND status = 'pending' THEN 'accepted' ELSE status END AS now FROM m)
    SELECT id, sec AS section, now AS status, CASE WHEN took AND resolver_action = 'suggest' THEN 'accepted_suggestion' WHEN hand AND NOT took THEN 'manual' ELSE resolver_action END AS resolver_action,
    CASE WHEN now = 'rejected' THEN 'manually_rejected' WHEN new_status = 'accepted' THEN 'user_accepted' WHEN hand OR new_status = 'edited' THEN 'manual_override' ELSE 'rule' END AS admission_reason,
    CASE WHEN now = 'rejected' THEN 0.0 WHEN new_status = 'accepted' THEN 0.94 WHEN hand OR new_status = 'edited' THEN 1.0 ELSE 0.5 END::DOUBLE AS admission_score FROM s""",
)
def edit_claims(spark, d):
    claims = _rows(spark, REVIEW).withColumns({"confidence": F.lit(0.5), "resolver_confidence": F.lit(0.4), "resolver_evidence": F.array(F.lit("e"))})
    after = R.edited(claims, _rows(spark, EDITS).withColumn("new_value", F.nullif("given", F.lit(""))).drop("given"))
    ruled = after.withColumns({"rule_status": F.lit("needs_review"), "rule_reason": F.lit("rule"), "rule_score": F.lit(0.5)})
    return after.select("id", "section", "resolver_action").join(R.settled(ruled).select("id", "status", "admission_reason", "admission_score"), "id")


MOVES = "(VALUES (1,'work_experience','Platform work','','','Acme'),(2,'work_experience','Platform work','','Jan 2020','Acme'),(3,'work_experience','Clerk','','',''),(4,'projects','','Backend engineer at a shop','Jan 2020',''),(5,'projects','','Backend engineer','',''),(6,'skills','tool','','','')) AS t(id, section, title, summary, start_date, organization)"
_HELD = lambda text, words: "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


@register(
    "section_move",
    f"""WITH m AS (SELECT id, section = 'work_experience' AND start_date = '' AND {_HELD("title || ' ' || organization || ' ' || summary", R.PROJECT_HINTS)} AS p, section = 'projects' AND start_date <> '' AND {_HELD('summary', R.ROLE_HINTS)} AS w FROM {MOVES})
    SELECT id, CASE WHEN p THEN 'projects' WHEN w THEN 'work_experience' END AS suggested_section, CASE WHEN p THEN 'project_like_experience_item' WHEN w THEN 'experience_like_project_item' END AS reason, CASE WHEN p THEN 0.81 WHEN w THEN 0.78 ELSE 0 END::DOUBLE AS score FROM m""",
)
def section_move(spark, d):
    return R.section_move(_rows(spark, MOVES))


CANDIDATES = "(VALUES (1,'skill','a',0.80,0.5,0.5),(1,'skill','b',0.70,0.5,0.5),(2,'skill','a',0.80,0.5,0.5),(2,'skill','b',0.60,0.5,0.5),(3,'role','a',0.91,0.5,0.5),(3,'role','b',0.9,0.5,0.5),(4,'degree','a',0.8,1.0,1.0),(4,'degree','b',0.8,0.5,0.5),(5,'url','a',0.8,0.5,0.5),(5,'url','b',0.8,0.5,0.5),(6,'skill','a',0.8,0.5,0.5)) AS t(claim, kind, value, score, alias, fuzzy)"


@register("arbiter_gate", f"WITH r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM {CANDIDATES} WINDOW w AS (PARTITION BY claim, kind ORDER BY score DESC, value)) SELECT claim, kind, coalesce(kind IN ('skill', 'company', 'role', 'degree') AND NOT (alias >= 0.99 AND fuzzy >= 0.99) AND score BETWEEN 0.65 AND 0.90 AND score - second <= 0.12, false) AS asked FROM r WHERE n = 1")
def arbiter_gate(spark, d):
    return R.arbiter_asked(_rows(spark, CANDIDATES).select("claim", "kind", "value", *[F.col(c).cast("double").alias(c) for c in ("score", "alias", "fuzzy")]))


LEARNT = "(VALUES (1,'skills','postgres','PostgreSQL',0.5,0.95),(1,'skills','postgres','PostgreSQL',0.5,0.0),(1,'skills','Sql','SQL',0.5,0.9),(1,'education','BE','B.E. Computer Engineering',0.9,0.0),(1,'public_profiles','old.dev','new.dev',0.1,0.2),(2,'skills','','Kafka',0.5,0.5),(2,'projects','a','b',0.5,0.5),(2,'work_experience','Acme','Acme Ltd',0.5,0.5)) AS t(profile, section, was, now, confidence, resolver_confidence)"


@register("correction_rules", f"SELECT profile, CASE section WHEN 'skills' THEN 'skill' WHEN 'public_profiles' THEN 'url' WHEN 'education' THEN 'degree' ELSE 'company' END AS kind, was AS pattern, now AS target, section, max(greatest(0.88, CASE WHEN resolver_confidence <> 0 THEN resolver_confidence ELSE confidence END))::DOUBLE AS confidence FROM {LEARNT} WHERE section <> 'projects' AND was <> '' AND now <> '' AND lower(was) <> lower(now) AND was <> 'old.dev' GROUP BY ALL")
def correction_rules(spark, d):
    whole = lambda c: F.struct(*[F.col(c).alias(f) for f in ("name", "url", "degree", "organization", "title")])
    claims = _rows(spark, LEARNT).select("profile", "section", whole("was").alias("raw"), whole("now").alias("value"), *[F.col(c).cast("double").alias(c) for c in ("confidence", "resolver_confidence")])
    return R.new_rules(claims, spark.createDataFrame([(1, "url", "old.dev", "new.dev")], "profile int, kind string, pattern string, target string"))


OVERVIEW = "(VALUES (1,'skill','Redis'),(1,'skill',' Zig '),(1,'skill',''),(1,'role','Backend Engineer'),(1,'company','Acme Ltd'),(2,'degree','B.E. Computer Engineering'),(2,'institution','Some School'),(2,'url','sample.dev')) AS t(profile, kind, v)"


@register("canonical_values", f"SELECT profile, kind AS value_type, trim(v) AS value, CASE v WHEN 'Redis' THEN 'redis' WHEN 'Backend Engineer' THEN 'backend engineer,backend developer' WHEN 'B.E. Computer Engineering' THEN 'be computer,b.e computer,be computer engineering,b.e computer engineering' ELSE '' END AS aliases, CASE kind WHEN 'skill' THEN 1 WHEN 'role' THEN 0.95 WHEN 'institution' THEN 0.92 WHEN 'url' THEN 0.94 ELSE 0.98 END::DOUBLE AS confidence FROM {OVERVIEW} WHERE trim(v) <> ''")
def canonical_values(spark, d):
    o = _rows(spark, OVERVIEW)
    part = lambda **columns: o.select("profile", *[F.coalesce(F.when(F.col("kind") == k, F.col("v")), F.lit("")).alias(c) for c, k in columns.items()])
    found = R.accepted_values(part(name="skill"), part(title="role", organization="company"), part(degree="degree", institution="institution"), part(url="url"))
    return found.withColumn("aliases", F.array_join("aliases", ","))


@register("top_reasons", "WITH t AS (SELECT source AS profile, lang AS reason, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY n DESC, reason) AS place FROM t) SELECT profile, place, reason, n FROM r WHERE place <= 2")
def top_reasons(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return R.top_reasons(docs.select(F.col("source").alias("profile"), F.array("lang").alias("resolver_evidence")), 2)


SCORES = "(VALUES (1,'name',1.0),(1,'skills',0.8),(1,'links',NULL),(2,'name',0.5),(2,'skills',0.95),(3,'links',NULL)) AS t(\"case\", field, score)"


def _scores(spark):
    rows = _rows(spark, SCORES.replace('"', "`")).withColumn("score", F.col("score").cast("double"))
    return rows.withColumn("status", S.field_status(F.col("score")))


@register("case_scores", f"""WITH w AS (SELECT "case", score::DOUBLE AS score, CASE field WHEN 'name' THEN 0.25 WHEN 'skills' THEN 1.0 ELSE 0.55 END::DOUBLE AS w FROM {SCORES}) SELECT "case", round(sum(w * score) / sum(w) FILTER (score IS NOT NULL), 6) AS score FROM w GROUP BY 1""")
def case_scores(spark, d):
    return S.case_scores(_scores(spark))


@register("benchmark_metrics", f"WITH f AS (SELECT unnest([{_in(S.WEIGHTS)}]) AS field) SELECT field, count(score) AS scored_cases, 3 - count(score) AS skipped_cases, round(avg(score::DOUBLE), 6) AS average_score, count(*) FILTER (score >= 0.95) AS match_cases, count(*) FILTER (score >= 0.75 AND score < 0.95) AS close_cases, count(*) FILTER (score < 0.75) AS miss_cases FROM f LEFT JOIN {SCORES} USING (field) GROUP BY field")
def benchmark_metrics(spark, d):
    return S.field_metrics(_scores(spark))


GOLD = [(1, "skills", 0, "python"), (1, "skills", 1, "postgresql"), (1, "skills", 2, ""), (1, "links", 0, "a.dev"), (1, "links", 1, "b.dev"), (1, "projects", 0, "log reader in go"), (2, "skills", 0, "kafka")]
SEEN = [(1, "skills", 0, "postgresq"), (1, "skills", 1, "Python"), (1, "links", 0, "A.dev"), (1, "projects", 0, "log reader in Go!"), (2, "skills", 0, "redis"), (2, "links", 0, "c.dev")]


@register("set_field_scores")
def set_field_scores(spark, d):
    kind = "case int, field string, at int, item string"
    return S.set_scores(spark.createDataFrame(GOLD, kind), spark.createDataFrame(SEEN, kind))


@register("greedy_bipartite")
def greedy_bipartite(spark, d):
    rows = "(VALUES (1,'a','x',0.9),(1,'a','y',0.95),(1,'b','y',0.94),(1,'b','x',0.5),(2,'a','x',0.2)) AS t(id, gold, found, score)"
    pairs = spark.sql(f"SELECT id, gold, found, CAST(score AS DOUBLE) AS score, CAST(0.4 AS DOUBLE) AS least FROM {rows}")
    return S.matches_in_order(pairs, ["id"], "gold", "found", "score", "least")


@register("greedy_by_score")
def greedy_by_score(spark, d):
    rows = "(VALUES (1,'a','x',0.9),(1,'a','y',0.95),(1,'b','y',0.99),(1,'b','x',0.5),(2,'a','x',0.2)) AS t(id, gold, found, score)"
    return O.greedy_matches(spark.sql(f"SELECT id, gold, found, CAST(score AS DOUBLE) AS score FROM {rows}"), "id", "gold", "found", "score", 0.4)
