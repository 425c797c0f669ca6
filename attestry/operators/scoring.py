"""Extraction scored against gold rows: fields of a case, cases, and metrics over all cases.

Set fields are matched one to one: gold items in their order, each to the best
extracted item that is still free. The similarity of texts is the sequence
ratio; other fuzzy ratios need a library that isn't here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.operators.claims import clamp, field_status
from attestry.session import ship

#: The weight of each field in a case's score.
WEIGHTS = {"name": 0.25, "email": 0.3, "phone": 0.3, "location": 0.35, "summary": 0.5, "links": 0.55, "skills": 1.0, "experience": 1.2, "education": 0.95, "projects": 1.0, "certifications": 0.65, "achievements": 0.55}
#: Similarity from which items of a field match, and the share of the F1 in its score.
LEAST = {"skills": 0.92, "experience": 0.72, "education": 0.72, "projects": 0.82, "certifications": 0.82, "achievements": 0.82}
SHARE = {"skills": 0.8, "experience": 0.75, "education": 0.75, "projects": 0.75, "certifications": 0.75, "achievements": 0.75}


def _by_field(values: dict[str, float], default: float) -> Column:
    return F.coalesce(*[F.when(F.col("field") == k, F.lit(v)) for k, v in values.items()], F.lit(default))


def matches_in_order(pairs: DataFrame, case: list[str], gold: str, found: str, score: str, least: str) -> DataFrame:
    """One-to-one pairs of a case: each gold item, in its order, takes the best free extracted item, the first of equal ones, if that is similar enough.

    ``least`` is a column with the threshold. A group is one case's field, so its items fit a task.
    """
    ship(pairs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([gold, score, found], ascending=[True, False, True])
        used, keep, done = set(), [], set()
        for k, (g, f, s, t) in enumerate(zip(pdf[gold], pdf[found], pdf[score], pdf[least], strict=True)):
            if g in done or f in used:
                continue
            # The best free item decides; a worse one can't pass where it fails.
            done.add(g)
            if s > 0 and s >= t:
                used.add(f)
                keep.append(k)
        return pdf.iloc[keep].drop(columns=least)

    rows = pairs.select(*case, gold, found, score, least)
    return rows.groupBy(*case).applyInPandas(run, rows.drop(least).schema)


def set_scores(gold: DataFrame, extracted: DataFrame) -> DataFrame:
    """(case, field, gold_count, extracted_count, matched, score, status) for fields of several items; rows (case, field, at, item) on both sides.

    Empty items don't count. Links match by equality, repeats of a gold link
    each; other fields by the best of the token ratios. A field without gold isn't scored.
    """
    clean = lambda df: df.filter(F.trim(F.coalesce("item", F.lit(""))) != "").select("case", "field", "at", F.lower(F.trim("item")).alias("item"))
    g, e = clean(gold), clean(extracted)
    links = g.filter("field = 'links'").join(e.select("case", "field", "item").distinct(), ["case", "field", "item"], "left_semi").select("case", "field", F.lit(1.0).alias("score"))
    pairs = g.filter("field <> 'links'").alias("g").join(e.alias("e"), ["case", "field"])
    pairs = pairs.select("case", "field", F.col("g.at").alias("gold_at"), F.col("e.at").alias("found_at"), S.compared(S.gold_similarity)(F.col("g.item"), F.col("e.item")).alias("score"), _by_field(LEAST, 0.82).alias("least"))
    matched = links.unionByName(matches_in_order(pairs, ["case", "field"], "gold_at", "found_at", "score", "least").select("case", "field", "score"))
    hits = matched.groupBy("case", "field").agg(F.count("*").alias("matched"), F.avg("score").alias("mean"))
    count = lambda df, name: df.groupBy("case", "field").agg(F.count("*").alias(name))
    rows = count(g, "gold_count").join(count(e, "extracted_count"), ["case", "field"], "full").join(hits, ["case", "field"], "left").fillna(0, ["gold_count", "extracted_count", "matched"])
    f1 = F.when(F.col("matched") == 0, 0.0).otherwise(2.0 * F.col("matched") / (F.col("gold_count") + F.col("extracted_count")))
    share = _by_field({**SHARE, "links": 1.0}, 0.75)
    score = F.when(F.col("gold_count") > 0, clamp(F.when(F.col("matched") > 0, f1 * share + F.col("mean") * (1 - share)).otherwise(0.0)))
    return rows.select("case", "field", "gold_count", "extracted_count", "matched", F.round(score, 6).alias("score")).withColumn("status", field_status(F.col("score")))


def case_scores(fields: DataFrame) -> DataFrame:
    """(case, score): the weighted mean over scored fields; null where none is."""
    weight = F.when(F.col("score").isNotNull(), _by_field(WEIGHTS, 1.0))
    return fields.groupBy("case").agg(F.round(clamp_or_null(F.sum(weight * F.col("score")) / F.nullif(F.sum(weight), F.lit(0.0))), 6).alias("score"))


def clamp_or_null(x: Column) -> Column:
    return F.when(x.isNotNull(), clamp(x))


def field_metrics(fields: DataFrame) -> DataFrame:
    """(field, scored_cases, skipped_cases, average_score, match_cases, close_cases, miss_cases) over all cases; a case without a row of a field skips it."""
    cases = fields.select(F.count_distinct("case").alias("cases"))
    scored = F.col("status") != "not_scored"
    each = fields.groupBy("field").agg(F.count_if(scored).alias("scored_cases"), F.round(F.avg(F.when(scored, F.col("score"))), 6).alias("average_score"), *[F.count_if(F.col("status") == s).alias(f"{s}_cases") for s in ("match", "close", "miss")])
    every = fields.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, WEIGHTS))).alias("field"))
    out = every.join(each, "field", "left").join(F.broadcast(cases))  # one row
    return out.fillna(0, ["scored_cases", "match_cases", "close_cases", "miss_cases"]).select("field", "scored_cases", (F.col("cases") - F.col("scored_cases")).alias("skipped_cases"), "average_score", "match_cases", "close_cases", "miss_cases")
