"""Vectors of texts: what is stored stays, what lacks is made by a given function and added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import relational


def hashed(text: Column) -> Column:
    """A vector of sixteen numbers that needs no model: tokens counted by the first digit of their MD5, scaled to length one."""
    digits = F.transform(T.tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 1), 16, 10).cast("int"))
    counts = T.let(digits, lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.size(F.filter(d, lambda x: x == k)).cast("double")))
    return T.let(counts, lambda c: T.let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def ensured(stored: DataFrame, texts: DataFrame, embed: Callable[[Column], Column] = hashed, key: str = "key") -> DataFrame:
    """The stored rows (key, checksum, vector), renewed and completed for texts (key, text): a row is made where none is stored, or the stored one is of another text. ``embed`` is a column function, of the JVM or in Arrow batches."""
    wanted = texts.withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    lacking = relational.missing(wanted, stored, [key, "checksum"])
    return relational.upsert(stored.select(key, "checksum", "vector"), lacking.select(key, "checksum", embed(F.coalesce("text", F.lit(""))).alias("vector")), key)
