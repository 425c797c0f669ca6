"""Claims of retrieved chunks: candidates as columns, then the greedy merge of those that say the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions import text as T
from attestry.operators import claims as C
from attestry.session import ship


def candidates(chunks: DataFrame, group: str) -> DataFrame:
    """(group, at, text, category, skills, confidence, chunk) for each sentence of chunks (group, rank, id, text, score) that reads like a claim; ``at`` is its place in the list."""
    parts = F.transform(T.sentences(F.col("text")), lambda s: F.trim(F.regexp_replace(s, r"^[-* ]+", "")))
    rows = chunks.select(group, "rank", "id", "score", F.posexplode(parts).alias("place", "text")).filter((F.col("text") != "") & C.claim_like(F.col("text")))
    rows = rows.withColumn("skills", C.skills(F.col("text")))
    return rows.select(group, F.struct("rank", "place").alias("at"), "text", C.category(F.col("text")).alias("category"), "skills", C.confidence(F.col("text"), F.size("skills"), F.col("score")).alias("confidence"), F.col("id").alias("chunk"))


def merged(found: DataFrame, group: str, most: int) -> DataFrame:
    """(group, place, text, category, confidence, chunks): by falling confidence, each candidate joins the first claim that says the same, or is one, until a group has ``most``.

    A group is one retrieval's list, which bounds it.
    """
    ship(found.sparkSession)
    rows = found.select(group, F.col("at.rank").alias("rank"), F.col("at.place").alias("at"), "text", "category", "skills", "confidence", F.col("chunk").cast("string").alias("chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in pdf.sort_values(["confidence", "rank", "at"], ascending=[False, True, True], kind="stable").itertuples(index=False):
            same = next((k for k in kept if S.same_claim(r.text, k["text"], list(r.skills), k["skills"])), None)
            if same is not None:
                same["chunks"] += [r.chunk] * (r.chunk not in same["chunks"])
                same["confidence"] = max(same["confidence"], r.confidence)
                continue
            kept.append({group: getattr(r, group), "place": len(kept) + 1, "text": r.text, "category": r.category, "confidence": r.confidence, "skills": list(r.skills), "chunks": [r.chunk]})
            if len(kept) >= most:
                break
        return pd.DataFrame(kept, columns=[group, "place", "text", "category", "confidence", "skills", "chunks"])

    kind = dict(rows.dtypes)[group]
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, place long, text string, category string, confidence double, skills array<string>, chunks array<string>")


def first_object(text):
    """The JSON object that prose holds: from its first opening to its last closing brace; null where there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)
