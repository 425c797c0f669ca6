"""Queries, links, skills, pages and profiles: rules as columns, rollups as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T

#: Abbreviations, replaced one after the other in this order.
EXPANSIONS = {
    "ml": "machine learning", "nlp": "natural language processing", "cv": "computer vision", "ai": "artificial intelligence", "dl": "deep learning", "rl": "reinforcement learning", "gan": "generative adversarial network", "llm": "large language model", "llms": "large language models",
    "rag": "retrieval augmented generation", "api": "application programming interface", "rest": "representational state transfer", "graphql": "graph query language", "sql": "structured query language", "nosql": "non relational database", "ui": "user interface", "ux": "user experience",
    "ci": "continuous integration", "cd": "continuous deployment", "cicd": "continuous integration continuous deployment", "oop": "object oriented programming", "fp": "functional programming", "ds": "data science", "etl": "extract transform load", "kpi": "key performance indicator",
    "sla": "service level agreement", "aws": "amazon web services", "gcp": "google cloud platform", "azure": "microsoft azure cloud", "k8s": "kubernetes", "js": "javascript", "ts": "typescript", "py": "python programming", "mlops": "machine learning operations", "devops": "development operations",
    "swe": "software engineer", "sde": "software development engineer", "sr": "senior", "jr": "junior", "pm": "product manager", "tpm": "technical program manager", "eda": "exploratory data analysis", "ocr": "optical character recognition", "erp": "enterprise resource planning",
    "crm": "customer relationship management", "bert": "transformer language model", "gpt": "generative pretrained transformer", "cnn": "convolutional neural network", "rnn": "recurrent neural network", "lstm": "long short term memory", "svm": "support vector machine", "xgb": "gradient boosting",
    "rf": "random forest", "ab": "a b testing", "fe": "front end", "be": "back end", "fs": "full stack", "spa": "single page application", "mvc": "model view controller", "orm": "object relational mapping", "cdn": "content delivery network", "dsa": "data structures and algorithms",
}
#: Signals of each kind of query; the first kind with the most wins.
SIGNALS = {
    "skills": ["skill", "technology", "tech", "language", "framework", "tool", "stack", "proficient", "familiar", "know", "used", "work with", "experience with", "expertise"],
    "experience": ["work", "job", "role", "position", "company", "employer", "career", "year", "history", "previous", "past", "employment", "worked at", "joined", "left"],
    "projects": ["project", "built", "developed", "created", "implemented", "launched", "shipped", "side project", "portfolio", "github", "personal"],
    "education": ["degree", "university", "college", "school", "study", "graduate", "bachelor", "master", "phd", "gpa", "major", "course", "graduated"],
    "certifications": ["certification", "certificate", "certified", "license", "credential", "award", "achievement", "exam", "passed"],
    "achievements": ["achievement", "accomplish", "award", "recognition", "promoted", "led", "managed", "impact", "result", "metric", "percent", "improve", "saved", "reduced", "increased", "delivered"],
}


def expanded(query: Column) -> Column:
    """The query with every abbreviation written out; later ones also act on what earlier ones wrote."""
    return reduce(lambda q, e: F.regexp_replace(q, rf"(?i)\b{e[0]}\b", e[1]), EXPANSIONS.items(), query)


def query_kind(query: Column) -> Column:
    low = F.lower(query)
    hits = [F.struct(sum((F.when(F.contains(low, F.lit(s)), 1).otherwise(0) for s in signals), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(kind).alias("kind")) for k, (kind, signals) in enumerate(SIGNALS.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["kind"]).otherwise(F.lit("general"))


def phone(value: Column) -> Column:
    """+91 and two groups for ten digits or a number that begins so; otherwise the collapsed text."""
    raw = F.trim(F.regexp_replace(value, r"\s+", " "))
    digits = F.regexp_replace(raw, "[^0-9]+", "")
    full = F.when(F.length(digits) == 10, F.concat(F.lit("91"), digits)).otherwise(digits)
    return F.when((F.length(full) >= 12) & F.startswith(full, F.lit("91")), F.concat(F.lit("+91 "), F.substring(full, 3, 5), F.lit(" "), F.substring(full, 8, 64))).otherwise(raw)


def link_kind(url: Column, label: Column) -> Column:
    """Kind of a link by host, path and label; the first rule that holds."""
    key = T.url_key(url)
    host, path = F.regexp_extract(key, "^[^/]*", 0), F.regexp_extract(key, "^[^/]*(.*)$", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    first = F.element_at(F.split(path, "/"), 2)
    named = F.lower(F.coalesce(label, F.lit(""))).isin("portfolio", "personal website", "website")
    org = F.endswith(host, F.lit(".org"))
    return (
        F.when(host == "linkedin.com", "linkedin").when((host == "github.com") & (depth >= 2), "project_repo").when(host == "github.com", "github_profile")
        .when(F.contains(host, F.lit("leetcode.com")), "leetcode").when(F.contains(host, F.lit("hackerrank.com")), "hackerrank")
        .when((host == "huggingface.co") & ((depth >= 2) | ((depth == 1) & first.isin("spaces", "datasets", "models"))), "project_repo").when(host == "huggingface.co", "organization_site")
        .when(named & org, "organization_site").when(named, "personal_portfolio").when(depth > 0, "client_site").when(org, "community_site").otherwise("website")
    )


def same_destination(links: DataFrame, group: str, url: str) -> DataFrame:
    """Groups whose links are written in several ways and lead to one place."""
    return links.groupBy(group).agg(F.count_distinct(url).alias("formats"), F.count_distinct(T.url_key(F.col(url))).alias("places")).filter("formats > 1 AND places = 1").select(group, "formats")


def page_order(blocks: DataFrame, header_y: float = 120.0, wide: float = 0.72, gap: float = 0.08) -> DataFrame:
    """(page, id, place): headers and wide blocks first, then the columns left of and right of the widest gap, each by y, then x. Blocks: page, page_width, id, x0, y0, width."""
    top = ((F.col("y0") <= header_y) & (F.col("width") >= 0.55 * F.col("page_width"))) | (F.col("width") >= wide * F.col("page_width"))
    marked = blocks.withColumn("top", top)
    steps = marked.filter(~F.col("top")).withColumn("step", F.lead("x0").over(W.partitionBy("page").orderBy("x0")) - F.col("x0"))
    widest = steps.groupBy("page").agg(F.count("*").alias("n"), F.max_by(F.struct("x0", "step"), F.struct("step", -F.col("x0"))).alias("g"), F.max("page_width").alias("w"))
    edge = widest.filter((F.col("n") >= 4) & (F.col("g.step") >= gap * F.col("w"))).select("page", (F.col("g.x0") + F.col("g.step") / 2).alias("edge"))
    column = F.when(F.col("top"), 0).when(F.col("edge").isNull() | (F.col("x0") < F.col("edge")), 1).otherwise(2)
    return marked.join(edge, "page", "left").withColumn("place", F.row_number().over(W.partitionBy("page").orderBy(column, "y0", "x0", "id")).cast("long")).select("page", "id", "place")


def rollup(claims: DataFrame, profile: str) -> DataFrame:
    """One row for each profile: the latest name, distinct skills in order of first sight, and counts. Claims: profile, at, section, value."""
    skills = claims.filter("section = 'skills'").groupBy(profile, F.lower("value").alias("k")).agg(F.min(F.struct("at", "value")).alias("f"))
    listed = skills.groupBy(profile).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["value"]), ", ").alias("skills"), F.count("*").alias("n_skills"))
    names = claims.filter("section = 'identity' AND value <> ''").groupBy(profile).agg(F.max_by("value", "at").alias("name"))
    return claims.select(profile).distinct().join(names, profile, "left").join(listed, profile, "left").select(profile, "name", "skills", F.coalesce("n_skills", F.lit(0)).cast("long").alias("n_skills"))
