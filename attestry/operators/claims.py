"""Claims: candidates, confidence, evidence, entities, graph; resolution and fusion scores; benchmark scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T

#: Verbs whose presence as a substring marks an action.
ACTIONS = ["built", "developed", "implemented", "designed", "launched", "optimized", "created", "automated", "deployed", "improved", "managed", "integrated", "trained", "fine-tuned", "led", "delivered"]
#: Patterns of skills over lower-cased text. A sign at the end of a name is no word sign, so it needs no word border behind it.
SKILLS = {
    "Python": r"\bpython\b", "C#": r"\bc#|\bcsharp\b", "C++": r"\bc\+\+", "FastAPI": r"\bfastapi\b", "RAG": r"\brag\b|\bretrieval[- ]augmented\b", "LLM": r"\bllm\b|\blarge language model", "OpenAI": r"\bopenai\b", "OCR": r"\bocr\b|\boptical character recognition\b",
    "Docker": r"\bdocker\b", "Kubernetes": r"\bkubernetes\b|\bk8s\b", "Redis": r"\bredis\b", "PostgreSQL": r"\bpostgres(ql)?\b", "SQL": r"\bsql\b", "CSS": r"\bcss\b", "PyMuPDF": r"\bpymupdf\b", "Docling": r"\bdocling\b", "LayoutLMv3": r"\blayoutlmv3\b", "NSQ": r"\bnsq\b",
    "Kafka": r"\bkafka\b", "PyTorch": r"\bpytorch\b", "TensorFlow": r"\btensorflow\b", "BERT": r"\bbert\b", "Flask": r"\bflask\b", "Helm": r"\bhelm\b", "MLflow": r"\bmlflow\b", "MVC": r"\bmvc\b", "React": r"\breact\b", "Next.js": r"\bnext\.?js\b", "TypeScript": r"\btypescript\b",
    "JavaScript": r"\bjavascript\b", "AWS": r"\baws\b|\bamazon web services\b", "GCP": r"\bgcp\b|\bgoogle cloud\b", "CI/CD": r"\bci/cd\b|\bcontinuous integration\b", "Playwright": r"\bplaywright\b", "Selenium": r"\bselenium\b", "NLP": r"\bnlp\b|\bnatural language processing\b",
}
#: Measures and roles.
METRIC = r"(?i)\b\d[\d,]*(?:\.\d+)?\+?\s?(?:%|percent\b|pages?\b|users?\b|docs?\b|documents?\b|hours?\b|days?\b|weeks?\b|months?\b|years?\b|x\b|ms\b|s\b)"
ROLE = r"(?i)\b(machine learning engineer|ml engineer|software engineer|backend engineer|data engineer|developer|manager|intern|researcher)\b"
#: Categories by words, first match first.
CATEGORIES = [("education", ["bachelor", "master", "university", "college"]), ("certification", ["certificate", "certification", "certified"]), ("work_experience", ["intern", "engineer", "manager", "worked as", "company"]), ("project", ["project", "pipeline", "system", "application", "platform", "tool"])]


def holds_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])


def skills(text: Column) -> Column:
    """Names of the skills whose pattern occurs, sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(F.regexp_like(low, F.lit(p)), F.lit(n)) for n, p in SKILLS.items()])))


def metrics(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(METRIC), F.lit(0)), F.trim)))


def roles(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ROLE), F.lit(1)), F.initcap)))


def category(text: Column) -> Column:
    return F.coalesce(*[F.when(holds_any(text, words), F.lit(name)) for name, words in CATEGORIES], F.lit("general"))


def claim_like(text: Column) -> Column:
    """35 to 280 signs with an action, and a digit, a skill or eight words."""
    signal = F.regexp_like(text, F.lit("[0-9]")) | (F.size(skills(text)) > 0) | (T.word_count(text) >= 8)
    return F.length(text).between(35, 280) & holds_any(text, ACTIONS) & signal


def confidence(text: Column, n_skills: Column, source: Column) -> Column:
    total = 0.45 + F.when(F.regexp_like(text, F.lit("[0-9]")), 0.15).otherwise(0.0) + F.least(F.lit(0.2), n_skills * 0.05) + F.when(F.regexp_like(text, F.lit("^[A-Z]")), 0.05).otherwise(0.0) + F.least(F.lit(0.15), source * 0.03)
    return F.round(F.least(total, F.lit(0.95)), 2)


def evidence(text: Column, n_chunks: Column, n_chars: Column, sure: Column, n_skills: Column) -> Column:
    """Evidence score of 98 at most."""
    bonus = lambda condition, x: F.when(condition, x).otherwise(0.0)
    total = 32.0 + F.least(F.lit(18.0), n_chunks * 8.0) + F.least(F.lit(16.0), n_skills * 4.0) + bonus(F.regexp_like(text, F.lit("[0-9]")), 12.0) + bonus(holds_any(text, ACTIONS), 8.0) + bonus(n_chars >= 220, 8.0) + bonus(F.size(metrics(text)) > 0, 4.0) + F.least(F.lit(8.0), sure * 10.0)
    return F.round(F.least(total, F.lit(98.0)), 1)


def evidence_label(score: Column) -> Column:
    return F.when(score >= 80, "strong").when(score >= 65, "good").when(score >= 50, "moderate").otherwise("weak")


def overclaim_risk(score: Column) -> Column:
    return F.when(score >= 65, "low").when(score >= 50, "medium").otherwise("high")


def entities(claims: DataFrame, text: str) -> DataFrame:
    """One row (type, name, normalized) for each entity of a claim, the first of equal ones."""
    part = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name"), T.normalized(n).alias("normalized")))
    body = F.col(text)
    cat = category(body)
    every = F.concat(part("skill", skills(body)), part("metric", metrics(body)), part("role", roles(body)), F.array(F.struct(F.lit("category").alias("type"), F.replace(cat, F.lit("_"), F.lit(" ")).alias("name"), T.normalized(cat).alias("normalized"))))
    rows = claims.select(*[c for c in claims.columns if c != text], F.posexplode(every).alias("at", "e")).select(*[c for c in claims.columns if c != text], "at", "e.*")
    keys = [c for c in claims.columns if c != text]
    return rows.groupBy(*keys, "type", "normalized").agg(F.min_by("name", "at").alias("name"))


def graph_nodes(found: DataFrame, profile: str, claim: str) -> DataFrame:
    """(profile, node_key, weight): a node's weight is how often it was named."""
    key = lambda kind, value: F.concat(F.lit("profile:"), F.col(profile).cast("string"), F.lit(":"), kind, F.lit(":"), value.cast("string"))
    named = found.select(profile, key(F.col("type"), F.col("normalized")).alias("node_key"))
    claims = found.select(profile, claim).distinct().select(profile, key(F.lit("claim"), F.col(claim)).alias("node_key"))
    return named.unionByName(claims).groupBy(profile, "node_key").agg(F.count("*").cast("double").alias("weight"))


def co_occurrence(found: DataFrame, profile: str, claim: str) -> DataFrame:
    """(profile, a, b, weight): skills named by one claim, unordered; pairs are made within a claim's few skills."""
    grouped = found.filter("type = 'skill'").groupBy(profile, claim).agg(F.array_sort(F.collect_set("normalized")).alias("s"))
    l = grouped.select(profile, claim, F.explode("s").alias("a"), "s")
    return l.select(profile, "a", F.explode("s").alias("b")).filter("a < b").groupBy(profile, "a", "b").agg(F.count("*").cast("double").alias("weight"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def resolver_score(c: dict[str, Column]) -> Column:
    return F.round(clamp(0.25 * c["parser"] + 0.25 * c["alias"] + 0.20 * c["fuzzy"] + 0.15 * c["embedding"] + 0.10 * c["graph"] + 0.05 * c["section"] - c["penalty"]), 4)


def resolver_action(kind: Column, score: Column, exact: Column) -> Column:
    skill = kind == "skill"
    return (
        F.when(skill & ((score >= 0.78) | (exact & (score >= 0.68))), "auto_correct").when(skill & (score >= 0.52), "suggest").when(skill, "needs_review")
        .when((score >= 0.84) | (exact & (score >= 0.76)), "auto_correct").when(score >= 0.62, "suggest").otherwise("needs_review")
    )


def claim_quality(c: dict[str, Column]) -> Column:
    """Weighted quality of a structured claim; the resolver is never less sure than the parser."""
    parser = clamp(c["parser"])
    weights = ((0.24, parser), (0.22, F.greatest(parser, F.least(F.lit(1.0), c["resolver"]))), (0.12, c["document"]), (0.10, c["source_quality"]), (0.10, c["section"]), (0.10, c["accepted"]), (0.05, c["recency"]), (0.07, c["priority"]))
    return F.round(clamp(sum((w * x for w, x in weights), F.lit(0.0))), 4)


def single_truth(groups: DataFrame, key: str, value: str, quality: str, margin: float = 0.15, runner_up: float = 0.65) -> DataFrame:
    """(key, value, quality, review): the best value of a key; review where a runner-up of ``runner_up`` or more is closer than ``margin``."""
    per_value = groups.groupBy(key, value).agg(F.max(quality).alias("q"))
    two = per_value.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("q", F.col(value).alias("v"))), asc=False), 1, 2).alias("t"))
    second = F.when(F.size("t") > 1, F.element_at(F.col("t"), 2)["q"])
    best = F.element_at(F.col("t"), 1)
    return two.select(key, best["v"].alias("value"), best["q"].alias("quality"), F.coalesce((second >= runner_up) & (best["q"] - second < margin), F.lit(False)).alias("review"))


def field_status(score: Column) -> Column:
    return F.when(score.isNull(), "not_scored").when(score >= 0.95, "match").when(score >= 0.75, "close").otherwise("miss")


def f1(gold: Column, found: Column) -> Column:
    """F1 of two arrays as lists of normalised values; null without gold."""
    hits = F.size(F.filter(gold, lambda g: F.array_contains(found, g)))
    return F.when(F.size(gold) == 0, F.lit(None).cast("double")).otherwise(F.when(hits == 0, 0.0).otherwise(2.0 * hits / (F.size(gold) + F.size(found))))
