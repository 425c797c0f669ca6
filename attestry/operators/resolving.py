"""Candidates for a raw value: stored rules, canonical values of the profile and their aliases, built-in aliases, each exact or fuzzy; merged and scored.

Dictionaries are joined by their lookup key. A fuzzy candidate is the best of a
profile's own values or of the built-in names, which a person's profile bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions import text as T
from attestry.operators import claims as C

SIGNALS = ["alias", "fuzzy", "embedding", "graph", "section"]


def _candidate(rows: DataFrame, order: int, value, source: str, evidence, **signals) -> DataFrame:
    scores = [F.coalesce(signals.get(s, F.lit(0.0)).cast("double"), F.lit(0.0)).alias(s) for s in SIGNALS]
    return rows.select("id", F.lit(order).alias("order"), F.col(value).alias("value"), F.lit(source).alias("source"), F.array(*[e if not isinstance(e, str) else F.lit(e) for e in evidence]).alias("evidence"), *scores)


def rule_candidates(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """For values (id, profile, kind, raw, section) the most certain, then newest, rule (profile, kind, pattern, action, target, confidence, created) whose pattern is the value."""
    keyed = raw.withColumn("key", T.lookup_key(F.col("raw")))
    own = rules.filter("target <> ''").withColumn("key", T.lookup_key(F.col("pattern")))
    found = keyed.join(own, ["profile", "kind", "key"])
    best = found.groupBy("id").agg(F.max_by(F.struct("target", "action", "confidence"), F.struct("confidence", "created", "target")).alias("best_")).select("id", "best_.*")
    sure = F.least(F.lit(1.0), F.col("confidence"))
    return _candidate(best, 0, "target", "correction_rule", [F.concat(F.lit("rule:"), F.col("action"))], alias=sure, graph=sure)


def canonical_candidates(raw: DataFrame, values: DataFrame) -> DataFrame:
    """Among a profile's canonical values (profile, kind, value, aliases, confidence): the most similar one, and those whose name or alias the value is."""
    keyed = raw.withColumn("key", T.lookup_key(F.col("raw")))
    named = values.withColumn("name", T.lookup_key(F.col("value")))
    pairs = keyed.join(named, ["profile", "kind"]).withColumn("near", F.round(S.compared(S.weighted_ratio)(F.col("key"), F.col("name")) / 100, 6)).filter("key <> '' AND near > 0")
    top = pairs.groupBy("id").agg(F.max_by(F.struct("value", "near", "confidence", "section"), F.struct(F.col("near"), F.col("confidence"), F.col("value"))).alias("best_")).select("id", "best_.*")
    sure = F.least(F.lit(1.0), F.col("confidence"))
    fuzzy = _candidate(top, 1, "value", "canonical_fuzzy", ["canonical_fuzzy_match"], fuzzy=F.col("near"), graph=sure, section=F.col("section"))
    names = named.withColumn("key", F.explode(F.array_distinct(F.concat(F.array("name"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.lookup_key)))))
    exact = keyed.join(names.drop("name"), ["profile", "kind", "key"])
    return fuzzy.unionByName(_candidate(exact, 2, "value", "canonical_alias", ["canonical_alias_match"], alias=F.lit(1.0), fuzzy=F.lit(1.0), graph=sure, section=F.col("section")))


def builtin_candidates(raw: DataFrame, aliases: DataFrame, least: float = 0.82) -> DataFrame:
    """Among built-in names (kind, at, value, aliases): those whose name or alias the value is, and the one that holds the most similar spelling, from ``least`` on."""
    keyed = raw.withColumn("key", T.lookup_key(F.col("raw")))
    spelt = aliases.withColumn("spelling", F.explode(F.array_distinct(F.concat(F.array(T.lookup_key(F.col("value"))), F.transform("aliases", T.lookup_key))))).select("kind", "at", "value", "spelling")
    exact = keyed.join(spelt.withColumnRenamed("spelling", "key"), ["kind", "key"])
    hits = _candidate(exact, 3, "value", "builtin_alias", ["builtin_alias_match", "exact_lookup_match"], alias=F.lit(1.0), fuzzy=F.lit(1.0), graph=F.lit(0.95), section=F.col("section"))
    pairs = keyed.join(spelt, "kind").withColumn("near", F.round(S.compared(S.weighted_ratio)(F.col("key"), F.col("spelling")) / 100, 6)).filter(F.col("near") >= least)
    top = pairs.groupBy("id").agg(F.max_by(F.struct("value", "near", "section"), F.struct(F.col("near"), -F.col("at"), F.col("spelling"))).alias("best_")).select("id", "best_.*")
    return hits.unionByName(_candidate(top, 4, "value", "builtin_fuzzy", ["builtin_fuzzy_match"], fuzzy=F.col("near"), section=F.col("section")))


def merged(candidates: list[DataFrame]) -> DataFrame:
    """(id, value, source, evidence, signals): candidates of one lookup key are one, with the best of each signal, all sources and all evidence in order."""
    rows = reduce(DataFrame.unionByName, candidates).withColumn("key", T.lookup_key(F.col("value")))
    ordered = F.array_sort(F.collect_list(F.struct("order", "source", "evidence", "value")))
    group = rows.groupBy("id", "key").agg(ordered.alias("l"), *[F.max(s).alias(s) for s in SIGNALS])
    listed = F.array_distinct(F.transform("l", lambda x: x["source"]))
    return group.select("id", F.get("l", F.lit(0))["value"].alias("value"), F.array_join(listed, ",").alias("source"), F.array_distinct(F.flatten(F.transform("l", lambda x: x["evidence"]))).alias("evidence"), *SIGNALS)


def ranked(raw: DataFrame, rules: DataFrame, values: DataFrame, aliases: DataFrame) -> DataFrame:
    """All merged candidates of values (id, profile, kind, raw, section, parser), scored and placed, the best first."""
    found = merged([rule_candidates(raw, rules), canonical_candidates(raw, values), builtin_candidates(raw, aliases)])
    rows = found.join(raw.select("id", "parser"), "id")
    names = {"parser": F.col("parser"), "alias": F.col("alias"), "fuzzy": F.col("fuzzy"), "embedding": F.col("embedding"), "graph": F.col("graph"), "section": F.col("section"), "penalty": F.lit(0.0)}
    scored = rows.withColumn("score", C.resolver_score(names))
    return scored.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "value")).cast("long")).drop("parser")
