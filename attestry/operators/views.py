"""A document's role and weight as a source, current position, and the five compiled views of a profile.

Entries are rows (profile, kind, id, title, organization, name, summary,
technologies, highlights, links, start_date, end_date, position); skills are rows
(profile, name, position).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.operators.fusion import year

VIEWS = ["master", "ai_ml", "web_dev", "full_stack", "ats_short"]
#: Skills that a view lists first, words that make an entry fit, and headlines.
SKILL_ORDER = {
    "ai_ml": ["Python", "FastAPI", "RAG", "OCR", "LLM", "BERT", "PyTorch", "TensorFlow", "Redis", "Docker", "LangChain", "LlamaIndex", "LayoutLMv3", "Docling", "PyMuPDF", "NSQ"],
    "web_dev": ["JavaScript", "TypeScript", "Angular", "React", "ASP.NET", "ASP.NET Core", "Django", "Flask", "SQL", "Bootstrap", "Azure", "Shopify", "CSS", "HTML", "jQuery"],
    "full_stack": ["Python", "FastAPI", "JavaScript", "TypeScript", "React", "Angular", "ASP.NET", "Django", "SQL", "Docker", "Redis", "Azure", "AWS", "GCP"],
}
WORDS = {
    "ai_ml": ["ai", "ml", "machine learning", "llm", "rag", "ocr", "bert", "fastapi", "document ai", "layoutlm"],
    "web_dev": ["react", "angular", "asp.net", "django", "javascript", "typescript", "mvc", "shopify", "jquery", "css"],
    "full_stack": ["fastapi", "react", "angular", "asp.net", "django", "javascript", "typescript", "docker", "redis"],
}
HEADLINES = {"ai_ml": "AI/ML Engineer", "web_dev": "Full-stack Developer", "full_stack": "Full-stack Engineer", "master": "Software Engineer", "ats_short": "Software Engineer"}
#: Words that speak for a focus, and how much a role of a document counts for a field.
AI_SIGNALS = ["llm", "rag", "ocr", "nlp", "layoutlmv3", "langchain", "llamaindex", "langgraph", "pytorch", "tensorflow", "document ai", "genai", "machine learning", "mlflow", "azure openai"]
WEB_SIGNALS = ["react", "angular", "asp.net", "mvc", "jquery", "shopify", "wix", "css", "html", "typescript", "javascript", "django", "flask"]
MASTER_SIGNALS = ["detailed", "master", "full experience", "all projects", "comprehensive"]
PRIORITY = {
    "current_headline": {"latest_ai_resume": 1.0, "work_experience_resume": 0.86, "asp_react_resume": 0.68, "detailed_old_resume": 0.46, "general_resume": 0.74},
    "summary": {"latest_ai_resume": 0.98, "work_experience_resume": 0.82, "asp_react_resume": 0.8, "detailed_old_resume": 0.58, "general_resume": 0.74},
    "skills": {"latest_ai_resume": 0.96, "asp_react_resume": 0.9, "work_experience_resume": 0.82, "detailed_old_resume": 0.76, "general_resume": 0.78},
    "projects": {"project_note": 1.0, "detailed_old_resume": 0.96, "latest_ai_resume": 0.82, "asp_react_resume": 0.84, "general_resume": 0.78},
    "current_experience": {"latest_ai_resume": 1.0, "work_experience_resume": 0.95, "general_resume": 0.78, "detailed_old_resume": 0.6, "asp_react_resume": 0.66},
    "historical_experience": {"detailed_old_resume": 0.96, "work_experience_resume": 0.92, "asp_react_resume": 0.84, "latest_ai_resume": 0.78, "general_resume": 0.8},
    "education": {"latest_ai_resume": 0.84, "detailed_old_resume": 0.88, "general_resume": 0.8},
    "public_profile": {"latest_ai_resume": 0.94, "detailed_old_resume": 0.82, "general_resume": 0.8},
}
#: What a source without a role counts.
NO_ROLE = 0.72
OPEN_END = r"(?i)\b(?:present|current|now)\b"


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def focus(text: Column, filename: Column) -> Column:
    """ai_ml, web_dev or master: the field with three signals and more than the other; then the file's name and words of completeness; then any signal."""
    whole = F.concat_ws(" ", filename, text)
    ai, web = hits(whole, AI_SIGNALS), hits(whole, WEB_SIGNALS)
    complete = (hits(filename, ["master", "detailed", "full"]) > 0) | (hits(whole, MASTER_SIGNALS) > 0)
    return F.when(ai >= F.greatest(F.lit(3), web + 1), "ai_ml").when(web >= F.greatest(F.lit(3), ai + 1), "web_dev").when(complete, "master").when(ai + web > 0, F.when(ai >= web, "ai_ml").otherwise("web_dev")).otherwise("master")


def document_role(focus_: Column, filename: Column, summary: Column, n_work: Column, n_current: Column, n_projects: Column, n_certificates: Column) -> Column:
    """What a document is as a source, the first rule that holds. summary: headline, summary and skills together."""
    name = lambda *words: hits(filename, list(words)) > 0
    says = lambda *words: hits(summary, list(words)) > 0
    return (
        F.when((n_certificates > 0) & (n_work == 0) & (n_projects == 0), "certificate").when(name("portfolio", "case-study", "case_study", "demo") & (n_projects > 0), "portfolio_note")
        .when(name("project", "open-source", "opensource", "readme") & (n_projects > 0) & (n_work == 0), "project_note").when(name("work-experience", "experience", "career") & (n_work > 0), "work_experience_resume")
        .when((focus_ == "ai_ml") & ((n_current > 0) | says("genai", "llm", "rag", "ocr", "document ai")), "latest_ai_resume").when((focus_ == "web_dev") & says("react", "angular", "asp.net", "mvc", "shopify", "wix", "jquery", "css"), "asp_react_resume")
        .when((n_work >= 3) | (n_projects >= 4) | name("detailed", "master", "full"), "detailed_old_resume").otherwise("general_resume")
    )


def source_quality(n_work: Column, n_projects: Column, n_skills: Column, has_summary: Column) -> Column:
    part = lambda n, whole, weight: weight * F.least(F.lit(1.0), n / whole)
    return F.round(F.least(F.lit(1.0), 0.55 + part(n_work, 3, 0.15) + part(n_projects, 4, 0.12) + part(n_skills, 12, 0.10) + F.when(has_summary, 0.08).otherwise(0.0)), 4)


def priority(bucket: Column, role: Column) -> Column:
    """How much a role counts for a kind of field; an unlisted role counts as a general one, a missing one NO_ROLE."""
    listed = F.create_map(*[x for b, roles in PRIORITY.items() for r, v in roles.items() for x in (F.lit(f"{b} {r}"), F.lit(v))])
    found = F.coalesce(listed[F.concat_ws(" ", bucket, role)], listed[F.concat_ws(" ", bucket, F.lit("general_resume"))], F.lit(NO_ROLE))
    return F.when(F.coalesce(role, F.lit("")) == "", F.lit(NO_ROLE)).otherwise(found)


def bucket(section: Column, field: Column, end_date: Column) -> Column:
    """The kind of field that a claim fills, for ``priority``."""
    current = (F.trim(F.coalesce(end_date, F.lit(""))) == "") | F.regexp_like(end_date, F.lit(OPEN_END))
    identity = F.when(field == "summary", "summary").when(field.isin("email", "phone"), "public_profile").otherwise("current_headline")
    return F.when(section == "identity", identity).when(section == "public_profiles", "public_profile").when(section.isin("skills", "projects", "education"), section).when((section == "work_experience") & current, "current_experience").otherwise("historical_experience")


def current_position(groups: DataFrame) -> DataFrame:
    """(profile, current_position) from merged work groups (profile, id, title, organization, start_date, end_date, confidence, priority): current ones first, then confidence and source, then the years. Entries without title, organization or start don't count."""
    running = (F.trim(F.coalesce("end_date", F.lit(""))) == "") | F.regexp_like(F.col("end_date"), F.lit(OPEN_END))
    whole = reduce(Column.__and__, [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("title", "organization", "start_date")])
    score = F.round(1.25 * running.cast("int") + 0.55 * F.coalesce("confidence", F.lit(0.0)) + 0.35 * F.col("priority"), 6)
    key = F.struct(score.alias("s"), F.when(running, 9999).otherwise(F.coalesce(year(F.col("end_date")), F.lit(0))).alias("e"), F.coalesce(year(F.col("start_date")), F.lit(0)).alias("y"), (-F.col("id")).alias("i"))
    best = groups.filter(whole).groupBy("profile").agg(F.max_by(F.concat_ws(" · ", "title", "organization"), key).alias("current_position"))
    return groups.select("profile").distinct().join(best, "profile", "left")


def entry_text() -> Column:
    return F.lower(F.concat_ws(" ", "title", "organization", "name", "summary", F.array_join(F.coalesce("technologies", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("highlights", F.array().cast("array<string>")), " ")))


def _per_view(rows: DataFrame) -> DataFrame:
    return rows.withColumn("view", F.explode(F.array(*[F.lit(v) for v in VIEWS])))


def _fit(each: float) -> Column:
    words = lambda view: each * hits(F.col("text"), WORDS[view])
    return reduce(lambda c, view: c.when(F.col("view") == view, words(view)), WORDS, F.when(F.lit(False), 0.0)).otherwise(0.0)


def compiled_experience(work: DataFrame, current: DataFrame) -> DataFrame:
    """(profile, view, place, id): master by the last years; the others by how well an entry fits, four in the short view and five else."""
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    rows = _per_view(work.withColumn("text", entry_text())).join(current, "profile", "left")
    open_ = F.regexp_like(F.coalesce("end_date", F.lit("")), F.lit(OPEN_END))
    start = F.coalesce(year(F.col("start_date")), F.lit(0))
    mine = F.concat_ws(" · ", "title", "organization") == F.col("current_position")
    score = F.when(mine & (F.col("title") != "") & (F.col("organization") != ""), 2.0).otherwise(0.0) + _fit(0.4) + F.least(F.lit(0.8), 0.08 * size("technologies")) + F.least(F.lit(0.6), 0.04 * size("highlights")) + F.when(F.col("view") == "ats_short", 0.2).otherwise(0.0)
    master = F.col("view") == "master"
    first = F.when(master, F.coalesce(year(F.col("end_date")), F.lit(9999)).cast("double")).otherwise(F.round(score, 6))
    second = F.when(master, start).otherwise(F.when(open_, 9999).otherwise(F.coalesce(year(F.col("end_date")), start)))
    third = F.when(master, 0).otherwise(start)
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("profile", "view").orderBy(first.desc(), second.desc(), third.desc(), "position")).cast("long"))
    return placed.filter(master | (F.col("place") <= F.when(F.col("view") == "ats_short", 4).otherwise(5))).select("profile", "view", "place", "id")


def compiled_projects(projects: DataFrame) -> DataFrame:
    """(profile, view, place, id): master in the given order, ten of them; the others by fit, technologies and name, four in the short view and six else."""
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    rows = _per_view(projects.withColumn("text", entry_text()))
    score = F.round(_fit(0.45) + F.least(F.lit(0.6), 0.08 * size("technologies")) + F.when(size("links") > 0, 0.35).otherwise(0.0), 6)
    master = F.col("view") == "master"
    order = [F.when(master, F.col("position")), F.when(~master, -score), F.when(~master, -size("technologies")), F.when(~master, F.lower("name")).desc(), F.col("position")]
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("profile", "view").orderBy(*order)).cast("long"))
    return placed.filter(F.col("place") <= F.when(master, 10).when(F.col("view") == "ats_short", 4).otherwise(6)).select("profile", "view", "place", "id")


def compiled_skills(skills: DataFrame) -> DataFrame:
    """(profile, view, place, name): different names; master in the given order, the others with their preferred skills first, then by name; 18 in the short view and 25 else."""
    once = skills.groupBy("profile", F.lower(F.trim("name")).alias("k")).agg(F.min_by("name", "position").alias("name"), F.min("position").alias("position"))
    at = reduce(lambda c, view: c.when(F.col("view") == view, F.array_position(F.array(*[F.lit(x) for x in SKILL_ORDER[view]]), F.col("name"))), SKILL_ORDER, F.when(F.lit(False), 0)).otherwise(0)
    master = F.col("view") == "master"
    order = [F.when(master, F.col("position")), F.when(at > 0, 0).otherwise(1), at, F.lower("name")]
    placed = _per_view(once).withColumn("place", F.row_number().over(W.partitionBy("profile", "view").orderBy(*order)).cast("long"))
    return placed.filter(master | (F.col("place") <= F.when(F.col("view") == "ats_short", 18).otherwise(25))).select("profile", "view", "place", "name")


def target_headlines(compiled: DataFrame, edited: DataFrame) -> DataFrame:
    """(profile, view, headline): a headline that a person set (profile, headline) holds; else the view's own and its first four preferred skills that the profile has."""
    preferred = reduce(lambda c, view: c.when(F.col("view") == view, F.array(*[F.lit(x) for x in SKILL_ORDER[view]])), SKILL_ORDER, F.when(F.lit(False), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    base = reduce(lambda c, e: c.when(F.col("view") == e[0], F.lit(e[1])), HEADLINES.items(), F.when(F.lit(False), F.lit("")))
    rows = compiled.groupBy("profile", "view").agg(F.collect_set("name").alias("names")).withColumn("chosen", F.slice(F.filter(preferred, lambda x: F.array_contains("names", x)), 1, 4))
    both = (F.col("view") == "ai_ml") & F.array_contains("chosen", "LLM") & F.array_contains("chosen", "OCR")
    made = F.when(both, F.concat(base, F.lit(" · Python · FastAPI · RAG · OCR · LLM Systems"))).otherwise(F.array_join(F.concat(F.array(base), F.col("chosen")), " · "))
    return rows.join(edited, "profile", "left").select("profile", "view", F.coalesce(F.nullif("headline", F.lit("")), made).alias("headline"))


def view_summaries(profiles: DataFrame) -> DataFrame:
    """(profile, view, summary) from (profile, focus, summary, modes: a map of summaries by view): the view's own, that of the focus, the profile's."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return _per_view(profiles).select("profile", "view", F.coalesce(clean(F.col("modes")[F.col("view")]), clean(F.col("modes")[F.col("focus")]), clean(F.col("summary"))).alias("summary"))
