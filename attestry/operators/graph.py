"""A profile's graph: nodes of claims, categories, documents and entities, and all kinds of edges, weighted by how often they are said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import claims as C


def mentions(approved: DataFrame) -> DataFrame:
    """One row for each node that a claim (profile, claim, document, filename, category, text, skills, position) speaks of: claim_key, place, type, key, label. Of a claim's equal entities the first counts."""
    key = lambda kind, value: F.concat(F.lit("profile:"), F.col("profile").cast("string"), F.lit(":"), kind, F.lit(":"), value.cast("string"))
    spec = lambda k, kind, value, label: F.struct(F.lit(k).alias("place"), F.lit(kind).alias("type"), value.cast("string").alias("id"), label.alias("label"))
    body, shown = F.col("text"), F.replace(F.col("category"), F.lit("_"), F.lit(" "))
    fixed = F.array(spec(0, "claim", F.col("claim"), body), spec(1, "category", F.col("category"), shown), spec(2, "document", F.col("document"), F.coalesce("filename", F.col("document").cast("string"))))
    part = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), T.normalized(n).alias("id"), n.alias("label")))
    named = F.concat(part("skill", F.col("skills")), part("metric", C.metrics(body)), part("role", C.roles(body)), F.array(F.struct(F.lit("category").alias("type"), T.normalized(F.col("category")).alias("id"), shown.alias("label"))))
    keyed = lambda xs: F.transform(xs, lambda x: F.struct(x["type"], x["id"]))
    once = F.filter(F.transform(named, lambda x, i: F.struct((F.lit(3) + i).alias("place"), x["type"].alias("type"), x["id"].alias("id"), x["label"].alias("label"))), lambda x: F.array_position(keyed(named), F.struct(x["type"], x["id"])) == x["place"] - 2)
    said = approved.select("profile", "position", key(F.lit("claim"), F.col("claim")).alias("claim_key"), F.explode(F.concat(fixed, once)).alias("n")).select("profile", "position", "claim_key", "n.*")
    return said.select("profile", "position", "claim_key", "place", "type", key(F.col("type"), F.col("id")).alias("key"), "label")


def nodes(said: DataFrame) -> DataFrame:
    """(profile, key, type, label, weight): the label and type of the first mention, the number of mentions."""
    first = F.struct("position", "place")
    return said.groupBy("profile", "key").agg(F.min_by("type", first).alias("type"), F.min_by("label", first).alias("label"), F.count("*").cast("double").alias("weight"))


def edges(said: DataFrame) -> DataFrame:
    """(profile, source, target, relation, weight): a claim's category, document and entities, and skills that a claim names together."""
    other = said.filter("place > 0")
    relation = F.when(F.col("place") == 1, "classified_as").when(F.col("place") == 2, "supported_by").otherwise(F.concat(F.lit("mentions_"), F.col("type")))
    spoken = other.select("profile", F.col("claim_key").alias("source"), F.col("key").alias("target"), relation.alias("relation"))
    skills = said.filter("place >= 3 AND type = 'skill'").groupBy("profile", "position", "claim_key").agg(F.array_sort(F.collect_list("key")).alias("k"))
    pairs = F.flatten(F.transform("k", lambda a, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    together = skills.select("profile", F.explode(pairs).alias("p")).select("profile", "p.source", "p.target", F.lit("co_occurs").alias("relation"))
    return spoken.unionByName(together).groupBy("profile", "source", "target", "relation").agg(F.count("*").cast("double").alias("weight"))


def refreshed(stored: DataFrame, fresh: DataFrame, key: str = "profile") -> DataFrame:
    """What a full refresh leaves: the fresh rows, and stored ones of keys outside the refresh."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def busiest(said: DataFrame, k: int) -> DataFrame:
    """The k heaviest nodes of every profile."""
    n = nodes(said)
    return n.withColumn("place", F.row_number().over(W.partitionBy("profile").orderBy(F.desc("weight"), "key")).cast("long")).filter(F.col("place") <= k)
