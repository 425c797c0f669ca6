"""Rules of a workspace's profiles as relational checks: names, uniqueness, the last profile, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_NAME = 120


def clean_name(name: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))


def named(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests (id, user, profile, name) with ``clean`` and ``status``: 422 for empty and long names, 409 for one that the user's other profiles (user, profile, name) have in any case, else 200. ``profile`` is null for a new one."""
    r = requests.withColumn("clean", clean_name(F.col("name")))
    taken = profiles.select(F.col("user").alias("u"), F.col("profile").alias("p"), F.lower("name").alias("n"))
    clash = r.join(taken, (F.col("user") == F.col("u")) & (F.lower("clean") == F.col("n")) & ~F.col("p").eqNullSafe(F.col("profile")), "left_semi").select("id").distinct().withColumn("clash", F.lit(True))
    status = F.when((F.col("clean") == "") | (F.length("clean") > LONGEST_NAME), 422).when(F.col("clash"), 409).otherwise(200)
    return r.join(clash, "id", "left").select("id", "clean", status.alias("status"))


def deletable(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, status) of profiles (user, profile) that are to go: 404 for another's or unknown ones, 409 for a user's last one, else 200."""
    count = profiles.groupBy("user").agg(F.count("*").alias("n"))
    owned = profiles.select("user", "profile", F.lit(True).alias("owned"))
    return wanted.join(owned, ["user", "profile"], "left").join(count, "user", "left").select("user", "profile", F.when(F.col("owned").isNull(), 404).when(F.col("n") <= 1, 409).otherwise(200).alias("status"))


def cascaded(gone: DataFrame, key: str, **children: DataFrame) -> dict[str, DataFrame]:
    """What stays of each child table when the rows of ``gone`` go."""
    return {name: child.join(gone.select(key).distinct(), key, "left_anti") for name, child in children.items()}


def default_profile(profiles: DataFrame) -> DataFrame:
    """Each user's first profile (user, profile, name, created): the oldest, of equally old ones the first by name."""
    return profiles.groupBy("user").agg(F.min_by("profile", F.struct("created", "name", "profile")).alias("profile"))


def resolved(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, profile, status) of requests (id, user, profile): the user's own profile, the default one where none is named, 404 for another's, unknown ones and users without any."""
    owned = profiles.select(F.col("user").alias("u"), F.col("profile").alias("p"))
    named = requests.join(owned, (F.col("user") == F.col("u")) & (F.col("profile") == F.col("p")), "left").join(default_profile(profiles).withColumnsRenamed({"user": "du", "profile": "dp"}), F.col("user") == F.col("du"), "left")
    found = F.when(F.coalesce("profile", F.lit("")) == "", F.col("dp")).otherwise(F.col("p"))
    return named.select("id", found.alias("profile"), F.when(found.isNull(), 404).otherwise(200).alias("status"))
