"""Filters, joins, aggregates, ranks and set operations of the profile engine, as plain relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scope(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every argument that is given; None means any."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner: what an incremental refresh still has to make."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows, replaced by fresh ones of the same key, and fresh rows of new keys."""
    return missing(stored, fresh, [key]).unionByName(fresh)


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with a count for each condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def first_seen(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The least ``order`` of each key: an aggregate with map-side combining, not a window."""
    return df.groupBy(*key).agg(F.min(order).alias(order))


def top_per_group(df: DataFrame, group: str, best: Column, row: list[str]) -> DataFrame:
    """The row with the greatest ``best`` in each group, by one aggregate."""
    return df.groupBy(group).agg(F.max_by(F.struct(*row), best).alias("r")).select(group, *[F.col(f"r.{c}").alias(c) for c in row])


def numbered(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """1, 2, ... in each group."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows with a value."""
    return F.sum(F.when(value.isNotNull(), weight * value)) / F.sum(F.when(value.isNotNull(), weight))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def similar_sets(rows: DataFrame, key: str, items: str, share: int, of: int) -> DataFrame:
    """(a, b, jaccard) for the pairs a < b of sets (arrays without repeats) with a similarity of ``share`` / ``of`` or more.

    Sets meet where they share one of their rarest items, of each set so many
    that no such pair misses; a frequent item leads few sets, so it makes few
    pairs. The sets of a pair that meets are then compared.
    """
    exploded = rows.select(F.col(key).alias("key"), F.size(items).alias("n"), F.explode(items).alias("x"))
    often = exploded.groupBy("x").agg(F.count("*").alias("often"))
    ranked = exploded.join(often, "x").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "x"))).alias("l"))
    lead = F.col("n") - F.ceil(F.col("n") * share / of).cast("int") + 1
    first = ranked.select("key", "n", F.explode(F.slice("l", F.lit(1), lead)).alias("e")).select("key", "n", "e.x")
    one, two = first.select(F.col("key").alias("a"), F.col("n").alias("na"), "x"), first.select(F.col("key").alias("b"), F.col("n").alias("nb"), "x")
    meet = one.join(two, "x").filter((F.col("a") < F.col("b")) & (of * F.least("na", "nb") >= share * F.greatest("na", "nb"))).select("a", "b").distinct()
    sets = rows.select(F.col(key).alias("key"), F.col(items).alias("set"))
    pairs = meet.join(sets.withColumnsRenamed({"key": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"key": "b", "set": "y"}), "b")
    return pairs.withColumn("jaccard", jaccard(F.col("x"), F.col("y"))).filter(F.col("jaccard") * of >= share).select("a", "b", "jaccard")
