"""Admission of structured claims: a decision (status, reason, score) by the rules of each section.

A claim is a flat row: profile, id, document, section, suggested_section, field,
status, resolver_action, admission_status, admission_reason, confidence,
resolver_confidence, and the fields of its value (value, name, title,
organization, start_date, end_date, summary, technologies, links, url, label,
degree, institution, issuer, record_type, location, client). Missing columns
count as nulls, nulls as empty text. Rules are expressions; what other rows say
(accepted values, documents of a skill) comes from equality joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T

TEXTS = ["section", "suggested_section", "field", "status", "resolver_action", "admission_status", "admission_reason", "value", "name", "title", "organization", "start_date", "end_date", "summary", "url", "label", "degree", "institution", "issuer", "record_type", "location", "client"]
LISTS, NUMBERS = ["technologies", "links"], ["confidence", "resolver_confidence"]

#: Skills by canonical name with their other spellings.
SKILL_ALIASES = {
    "FastAPI": ["fast api", "fastapi"], "PostgreSQL": ["postgres", "postgre sql", "pgsql", "postgresql"], "JavaScript": ["javascript", "js"], "Node.js": ["node", "nodejs", "node js"], "Kubernetes": ["k8s", "kube", "kubernetes"], "TypeScript": ["typescript", "ts"],
    "Machine Learning": ["machine learning", "ml"], "Document AI": ["document ai", "document intelligence"], "OCR": ["ocr", "optical character recognition"], "Redis": ["redis"], "Docker": ["docker"], "Python": ["python", "py"], "RAG": ["rag", "retrieval augmented generation"],
    "LayoutLMv3": ["layoutlmv3", "layoutlm v3"],
}
#: Degrees by canonical name with their other spellings.
DEGREE_ALIASES = {
    "B.Tech in Computer Engineering": ["btech comp engg", "b tech comp engg", "btech computer engineering", "b.tech computer engineering", "b.tech in computer engineering"],
    "B.E. Computer Engineering": ["be computer", "b.e computer", "be computer engineering", "b.e computer engineering"],
    "Bachelor of Technology in Computer Science": ["bachelor of technology in computer science", "btech computer science", "b.tech computer science"],
}
#: Roles by canonical name with their other spellings.
ROLE_ALIASES = {
    "AI/ML Developer": ["ai ml developer", "ai/ml developer", "ml dev", "ai developer"], "Machine Learning Developer": ["machine learning developer", "ml developer"],
    "Document AI Engineer": ["document ai engineer", "document intelligence engineer"], "Backend Engineer": ["backend engineer", "backend developer"],
}
#: Names that are skills as they are written.
WHITELIST = [
    "C#", "C++", "CSS", "SQL", "Git", "AWS", "GCP", "MVC", "NLP", "OCR", "RAG", "LLM", "BERT", "T5", "NSQ", "Helm", "Flask", "Kafka", "Redis", "MLflow", "FastAPI", "PyTorch", "TensorFlow", "Docker", "LangChain", "LlamaIndex", "React", "Angular", "Django", "ASP.NET", "ASP.NET Core",
    "NumPy", "Pandas", "RoBERTa", "Terraform", "MongoDB", "RabbitMQ", "XGBoost", "Sass", "WebGL", "Bootstrap", "HTML", "jQuery", "Shopify", "Azure", "gRPC", "Weights & Biases", "Adobe XD", "Figma",
]
#: Keys of the taxonomy of skills.
TAXONOMY = [
    "python", "javascript", "typescript", "c#", "c++", "sql", "html", "css", "sass", "angular", "react", "django", "flask", "fastapi", "asp.net", "asp.net core", "bootstrap", "jquery", "webgl", "bert", "roberta", "t5", "ocr", "rag", "llm", "nlp", "pytorch", "tensorflow", "numpy", "pandas",
    "xgboost", "langchain", "llamaindex", "langgraph", "autogen", "crewai", "mlflow", "weights biases", "mongodb", "redis", "postgresql", "rabbitmq", "terraform", "docker", "helm", "github actions", "aws", "azure", "gcp", "nsq", "kafka", "grpc",
]
#: Short keys that are skills, fragments and headings that are none, and project fragments.
SHORT = ["c#", "c++", "css", "sql", "git", "aws", "gcp", "mvc", "nlp", "ocr", "rag", "llm", "bert", "t5", "nsq"]
FRAGMENTS = ["/cd", "ify", "peline", "lang", "langg", "tor", "zure", "moti", "fire", "ang", "men", "ima", "tern"]
HEADINGS = ["languages", "language", "tools", "technical skills", "soft skills", "cloud", "data", "skills", "programming", "technical", "frameworks", "technologies", "backend", "frontend", "front end"]
PROJECT_FRAGMENTS = ["app that auto", "tech-fest budget", "volunteers. freelance", "python nsq", "student rep", "leadership mentor"]
#: Kinds of links by their hosts, and the kinds that a person's profile shows.
DEMO_HOSTS = ["web.app", "vercel.app", "netlify.app", "pages.dev", "onrender.com", "streamlit.app"]
COMMUNITY_HOSTS = ["anitab", "chaoss", "community", "meetup", "womenwhocode", "fossasia"]
CLIENT_HOSTS = ["shopify", "wix", "studio", "digital", "agency"]
ORGANIZATION_HOSTS = ["university", "college", "academy", "foundation", "society", "council", "org", "association"]
PERSONAL_LINKS = ["linkedin", "github_profile", "leetcode", "hackerrank", "personal_portfolio"]
#: Patterns of summaries and addresses.
MISPLACED = r"(?i)^(?:worked on|created|implemented|built|developed|designed|refactored|migrated|led)\b"
BULLET = r"(?i)^(?:built|developed|designed|implemented|led|managed|created|refactored|migrated|optimized)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"


def decision(status: str, reason: str | Column, score: float | Column) -> Column:
    reason, score = (x if isinstance(x, Column) else F.lit(x) for x in (reason, score))
    return F.struct(F.lit(status).alias("status"), reason.alias("reason"), score.cast("double").alias("score"))


def flat(claims: DataFrame) -> DataFrame:
    """The claim's columns with texts collapsed and never null; others pass."""
    have = {c.lower() for c in claims.columns}
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " ")) if c in have else F.lit("")
    lists = {c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "") if c in have else F.array().cast("array<string>") for c in LISTS}
    return claims.withColumns({**{c: text(c) for c in TEXTS}, **lists, **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in NUMBERS}})


def preview_section() -> Column:
    return F.when(F.col("suggested_section") != "", F.col("suggested_section")).otherwise(F.col("section"))


def _any(text: Column, parts: list[str], test) -> Column:
    return reduce(Column.__or__, [test(text, F.lit(p)) for p in parts])


def _keys(aliases: dict[str, list[str]]) -> list[str]:
    return [x.lower() for name, other in aliases.items() for x in (name, *other)]


def owned_link_kind(url: Column, label: Column) -> Column:
    """Kind of a link as admission sees it: hints in the host come before labels; the first rule that holds."""
    key = T.url_key(F.trim(url))
    host = F.regexp_extract(key, "^[^/]*", 0)
    depth = F.size(F.filter(F.split(F.regexp_extract(key, "^[^/]*(.*)$", 1), "/"), lambda x: x != ""))
    return (
        F.when(F.trim(url) == "", "invalid").when(host == "linkedin.com", "linkedin").when((host == "github.com") & (depth >= 2), "project_repo").when(host == "github.com", "github_profile")
        .when(F.contains(host, F.lit("leetcode.com")), "leetcode").when(F.contains(host, F.lit("hackerrank.com")), "hackerrank").when(_any(host, DEMO_HOSTS, F.endswith), "project_demo")
        .when(_any(host, COMMUNITY_HOSTS, F.contains), "community_site").when(_any(host, CLIENT_HOSTS, F.contains), "client_site").when(_any(host, ORGANIZATION_HOSTS, F.contains), "organization_site")
        .when(T.lookup_key(label).isin("portfolio", "personal website", "website"), "personal_portfolio").when(depth > 0, "client_site").otherwise("website")
    )


def skill_rule(name: Column, key: Column, accepted: Column, documents: Column, sure: Column) -> Column:
    """``sure``: the resolver's confidence, or the parser's where that is zero."""
    known = name.isin(*WHITELIST) | key.isin(*_keys(SKILL_ALIASES))
    listed = key.isin(*TAXONOMY)
    compact = F.replace(key, F.lit(" "), F.lit(""))
    short = (F.length(compact) <= 2) | ((F.length(compact) <= 4) & F.regexp_like(compact, F.lit("^[a-z]+$")))
    noise = (key == "") | (~known & ~listed & ~key.isin(*SHORT) & (key.isin(*HEADINGS, *FRAGMENTS) | (~compact.isin(*SHORT) & short)))
    return (
        F.when(noise, decision("reject_noise", "skill_noise_fragment", 0.02)).when(known, decision("admit", "known_skill_dictionary", 0.99)).when(listed, decision("admit", "skill_taxonomy_match", 0.95))
        .when(accepted, decision("admit", "accepted_before", 0.96)).when(documents >= 2, decision("admit", "seen_in_multiple_documents", 0.88))
        .when(sure >= 0.72, decision("admit", "skills_section_quality", 0.84)).when(sure >= 0.55, decision("needs_review", "low_confidence_skill", 0.64)).otherwise(decision("reject_noise", "unverified_skill_fragment", 0.1))
    )


def project_rule() -> Column:
    name, summary = F.col("name"), F.col("summary")
    combined = T.lookup_key(F.trim(F.concat_ws(" ", name, summary)))
    bare = (F.size("technologies") == 0) & (F.size("links") == 0)
    lower = F.regexp_like(name, F.lit(r"^\p{Ll}")) & ~F.regexp_like(name, F.lit(r"\p{Lu}"))
    fragment = (combined == "") | ((F.col("record_type") != "") & (F.col("record_type") != "project")) | combined.isin(*PROJECT_FRAGMENTS) | lower | ((T.word_count(name) > 5) & (summary == "")) | ((summary != "") & (T.word_count(summary) < 4) & bare)
    dated = reduce(Column.__or__, [F.col(c) != "" for c in ("start_date", "end_date", "organization", "issuer", "client", "location")])
    signs = [(F.length(name) >= 3) & ~F.endswith(name, F.lit(".")), T.word_count(summary) >= 5, F.size("technologies") > 0, F.size("links") > 0, dated, preview_section() == "projects"]
    n = sum((s.cast("int") for s in signs), F.lit(0))
    return (
        F.when(fragment, decision("reject_noise", "project_fragment", 0.04)).when(n >= 3, decision("admit", "project_has_structure", 0.92)).when(n == 2, decision("admit", "project_has_enough_signals", 0.82))
        .when(n == 1, decision("reject_noise", "weak_project_claim", 0.18)).otherwise(decision("reject_noise", "project_fragment", 0.08))
    )


def experience_rule() -> Column:
    title, org, summary = (F.col(c) != "" for c in ("title", "organization", "summary"))
    dated = (F.col("start_date") != "") | (F.col("end_date") != "")
    return (
        F.when(~title & ~org & ~summary, decision("reject_noise", "empty_experience_claim", 0.02)).when(title & org & dated, decision("admit", "dated_role_with_organization", 0.95)).when(title & org, decision("admit", "role_with_organization", 0.82))
        .when(title, decision("needs_review", "missing_organization", 0.48)).when(org & summary, decision("needs_review", "organization_without_title", 0.42)).otherwise(decision("quarantine", "weak_experience_claim", 0.18))
    )


def summary_rule(value: Column) -> Column:
    words = T.word_count(value)
    return (
        F.when(value == "", decision("reject_noise", "empty_summary", 0.0)).when(F.regexp_like(value, F.lit(MISPLACED)), decision("reject_noise", "summary_misclassified_experience", 0.06))
        .when(F.length(value) < 80, decision("reject_noise", "summary_too_short", 0.08)).when(F.length(value) > 900, decision("needs_review", "summary_too_long", 0.36))
        .when(F.regexp_like(value, F.lit(BULLET)) & (words < 28), decision("needs_review", "looks_like_experience_bullet", 0.42)).when(F.regexp_like(F.substring(value, 1, 120), F.lit(YEAR)), decision("reject_noise", "summary_date_heavy", 0.08))
        .when(F.contains(value, F.lit("|")) & (words < 32), decision("reject_noise", "summary_looks_like_header", 0.06)).otherwise(decision("admit", "summary_like_text", 0.92))
    )


def identity_rule() -> Column:
    """An e-mail address or a place is admitted in any case, with a low score if it doesn't look like one."""
    value, field = F.col("value"), F.col("field")
    several = T.word_count(value) >= 2
    return (
        F.when(field == "summary", summary_rule(value)).when(field == "email", decision("admit", "valid_email", F.when(F.regexp_like(value, F.lit(EMAIL)), 0.98).otherwise(0.28)))
        .when((field == "phone") & (F.length(F.regexp_replace(value, "[^0-9]+", "")) >= 10), decision("admit", "phone_like_value", 0.9)).when(field == "phone", decision("reject_noise", "invalid_phone", 0.04))
        .when((field == "full_name") & several, decision("admit", "full_name_like_value", 0.94)).when(field == "full_name", decision("needs_review", "weak_name_claim", 0.42))
        .when((field == "headline") & several, decision("admit", "headline_like_value", 0.84)).when(field == "headline", decision("needs_review", "weak_headline_claim", 0.48))
        .when(field == "location", decision("admit", "location_like_value", F.when(value != "", 0.78).otherwise(0.0))).otherwise(decision("needs_review", "generic_identity_claim", 0.5))
    )


def link_rule() -> Column:
    kind = owned_link_kind(F.col("url"), F.col("label"))
    return (
        F.when(F.col("url") == "", decision("reject_noise", "missing_url", 0.0)).when(kind.isin(*PERSONAL_LINKS), decision("admit", F.concat(kind, F.lit("_link")), 0.94))
        .when(kind != "website", decision("quarantine", F.concat(kind, F.lit("_not_personal_profile")), 0.24)).otherwise(decision("needs_review", "unknown_link_type", 0.5))
    )


def education_rule(accepted: Column) -> Column:
    degree, place = F.col("degree"), F.col("institution")
    return (
        F.when((degree == "") & (place == ""), decision("reject_noise", "empty_education_claim", 0.0)).when(T.lookup_key(degree).isin(*_keys(DEGREE_ALIASES)), decision("admit", "known_degree_alias", 0.94))
        .when(accepted, decision("admit", "accepted_degree_before", 0.92)).when((degree != "") & (place != ""), decision("admit", "degree_with_institution", 0.86)).otherwise(decision("needs_review", "partial_education_claim", 0.56))
    )


def admit(claims: DataFrame, accepted: DataFrame) -> DataFrame:
    """(profile, id, preview_section, status, reason, score) of every claim.

    accepted: (profile, value_type, value, aliases) of values that were
    accepted before. Manual states come first, then the rule of the section
    that the claim is shown in. A skill's documents are counted once for each
    profile and key, so a key named by many claims meets one row.
    """
    c = flat(claims).withColumn("preview_section", preview_section())
    c = c.withColumn("key", F.when(F.col("preview_section") == "skills", T.lookup_key(F.col("name"))).when(F.col("preview_section") == "education", T.lookup_key(F.col("degree"))).otherwise(""))
    c = c.withColumn("kind", F.when(F.col("preview_section") == "skills", "skill").when(F.col("preview_section") == "education", "degree"))
    before = accepted.select("profile", F.col("value_type").alias("kind"), F.explode(F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("v")).select("profile", "kind", T.lookup_key(F.col("v")).alias("key")).filter("key <> ''").distinct().withColumn("before", F.lit(True))
    seen = c.filter("kind = 'skill' AND key <> ''").groupBy("profile", "kind", "key").agg(F.count_distinct("document").alias("documents"))
    c = c.join(before, ["profile", "kind", "key"], "left").join(seen, ["profile", "kind", "key"], "left")
    was, n = F.coalesce("before", F.lit(False)), F.coalesce("documents", F.lit(0))
    sure = F.when(F.col("resolver_confidence") != 0, F.col("resolver_confidence")).otherwise(F.col("confidence"))
    at = F.col("preview_section")
    manual = (F.col("status") == "edited") | (F.col("resolver_action") == "manual") | ((F.col("status") == "accepted") & (F.col("admission_status") == "admit") & (F.col("admission_reason") == "user_accepted"))
    found = (
        F.when(F.col("status") == "rejected", decision("reject_noise", "manually_rejected", 0.0)).when((F.col("status") == "duplicate") | (F.col("resolver_action") == "duplicate"), decision("reject_noise", "duplicate_value", 0.0))
        .when(manual, decision("admit", "manual_override", 1.0)).when(at == "skills", skill_rule(F.col("name"), F.col("key"), was, n, sure)).when(at == "projects", project_rule()).when(at == "work_experience", experience_rule())
        .when(at == "public_profiles", link_rule()).when(at == "education", education_rule(was)).when(at == "identity", identity_rule())
        .when((at == "certifications") & (F.col("name") != "") & (F.col("issuer") != ""), decision("admit", "certification_with_issuer", 0.82)).when(at == "certifications", decision("needs_review", "partial_certification_claim", 0.5))
        .otherwise(decision("needs_review", "untyped_claim", 0.45))
    )
    return c.select("profile", "id", "preview_section", found.alias("d")).select("profile", "id", "preview_section", "d.*")
