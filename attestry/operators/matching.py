"""A job description against a profile: matched skills, uncovered terms, the best entries.

Descriptions (job, text), skills (profile, skill) and entries (profile, id, type,
text, skills). What a description asks for is a short list of terms, which is
broadcast only below ``BROADCAST_TERMS`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T

BROADCAST_TERMS = 1_000_000
#: What a profile's strongest skills make of an application, the first that holds.
ANGLES = [("Document AI / extraction angle", ["OCR", "Docling", "LayoutLMv3"]), ("LLM application angle", ["RAG", "LLM", "OpenAI"]), ("Backend / platform angle", ["FastAPI", "Docker", "PostgreSQL", "Redis"])]
NO_ANGLE = "General evidence-backed fit"


def asked_terms(jobs: DataFrame, stopwords: list[str]) -> DataFrame:
    """(job, term, n, at): tokens of four and more signs that are no stop words or numbers, how often and where first."""
    tok = jobs.select("job", F.posexplode(T.tokens(T.stripped_html(F.col("text")))).alias("at", "term"))
    kept = tok.filter((F.length("term") >= 4) & ~F.regexp_like("term", F.lit("^[0-9]+$")) & ~F.col("term").isin(*stopwords))
    return kept.groupBy("job", "term").agg(F.count("*").alias("n"), F.min("at").alias("at"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def matched_skills(jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """(job, profile, skills, angle): a profile's skills that the description names, in any case, and the angle that they open."""
    low = _small(jobs.select("job", F.lower("text").alias("low")))
    pairs = skills.select("profile", "skill").distinct().join(low, F.contains(F.col("low"), F.lower("skill")))
    found = pairs.groupBy("job", "profile").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    every = jobs.select("job", F.contains(F.lower("text"), F.lit("document ai")).alias("documents")).crossJoin(F.broadcast(skills.select("profile").distinct()))
    holds = lambda names: F.arrays_overlap("skills", F.array(*[F.lit(x) for x in names]))
    rows = every.join(found, ["job", "profile"], "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    angle = F.when(holds(ANGLES[0][1]) | F.col("documents"), ANGLES[0][0]).when(holds(ANGLES[1][1]), ANGLES[1][0]).when(holds(ANGLES[2][1]), ANGLES[2][0]).otherwise(NO_ANGLE)
    return rows.select("job", "profile", "skills", angle.alias("angle"))


def ranked_entries(jobs: DataFrame, entries: DataFrame, stopwords: list[str], most: int = 6) -> DataFrame:
    """(job, profile, place, id, score): how often the description says an entry's words, and two for each of its skills that the description names."""
    terms = _small(asked_terms(jobs, stopwords).select("job", "term", "n"))
    skills = F.coalesce("skills", F.array().cast("array<string>"))
    words = entries.select("profile", "id", F.explode(F.array_distinct(T.tokens(F.concat_ws(" ", "text", F.array_join(skills, " "))))).alias("term"))
    said = words.join(terms, "term").groupBy("job", "profile", "id").agg(F.sum("n").alias("score"))
    low = _small(jobs.select("job", F.lower("text").alias("low")))
    named = entries.select("profile", "id", F.explode(skills).alias("skill")).join(low, F.contains(F.col("low"), F.lower("skill"))).groupBy("job", "profile", "id").agg((2 * F.count("*")).alias("score"))
    total = said.unionByName(named).groupBy("job", "profile", "id").agg(F.sum("score").cast("long").alias("score"))
    kept = total.join(entries.filter(F.coalesce("text", F.lit("")) != "").select("profile", "id"), ["profile", "id"])
    return kept.withColumn("place", F.row_number().over(W.partitionBy("job", "profile").orderBy(F.desc("score"), "id")).cast("long")).filter(F.col("place") <= most).select("job", "profile", "place", "id", "score")


def missing_terms(jobs: DataFrame, corpus: DataFrame, skills: DataFrame, stopwords: list[str], most: int = 10) -> DataFrame:
    """(job, profile, place, term): terms that a profile's corpus (profile, text) and matched skills don't have and that are said twice or have seven signs, in order."""
    terms = asked_terms(jobs, stopwords).filter("n >= 2 OR length(term) >= 7")
    profiles = F.broadcast(corpus.select("profile").distinct())
    known = corpus.select("profile", F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    listed = matched_skills(jobs, skills).select("job", "profile", F.explode("skills").alias("s")).select("job", "profile", F.lower("s").alias("term"))
    open_ = terms.crossJoin(profiles).join(known, ["profile", "term"], "left_anti").join(listed, ["job", "profile", "term"], "left_anti")
    return open_.withColumn("place", F.row_number().over(W.partitionBy("job", "profile").orderBy("at")).cast("long")).filter(F.col("place") <= most).select("job", "profile", "place", "term")
