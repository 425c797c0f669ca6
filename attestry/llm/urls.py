"""URL rules by a sort-merge range join on reversed-host keys.

A rule (host, path) becomes the key ``labels of the host, last first # path``,
and covers the interval of all keys that begin with it. An address appears once
for each suffix of its host that has no more labels than some rule, with the key
that a rule of that suffix would have, so a rule fits if and only if one of the
address's keys lies in the rule's interval. Intervals of prefixes are nested or apart: a sweep over rules and
addresses in key order keeps the open rules on a stack, whose top is the most
specific one.

Rules and addresses are dealt to ranges of keys. The borders come from a fixed
number of keys for each range, the first by hash, so they need no pass of their
own and results don't depend on them; equal keys of different addresses may lie
in different ranges. A rule goes to every range that its interval meets, so no
range has to know another, and rules needn't fit anywhere.

Of the rules that fit, the longest (host and path together, then host) wins; of
equal rules with different verdicts, block. Addresses that no rule fits get
``default``.

Defined results: null addresses and those without ``://`` have an empty host and
path, which no rule with a host fits; empty labels and ports are kept as they
are; rules with a null host or verdict are ignored, a null path is empty;
hosts and paths of any length are judged whole; repeated rows are judged each;
further columns pass.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import column, cut, free_name, ship

#: Ranges for each shuffle partition, and sampled keys for each range.
RANGES, SAMPLED, BORDER = 4, 16, 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty for null or where ``://`` is missing."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("#"), path)


def suffix_keys(host: Column, path: Column, most: int) -> Column:
    """The keys of every suffix of the host, whole labels at a time, up to ``most`` of them."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, most)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit("#"), path))


def match(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule_host, rule_path, verdict) for every distinct (host, path) that some rule fits."""
    spark = addresses.sparkSession
    ship(spark)
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").filter("rule_host IS NOT NULL AND verdict IS NOT NULL")
    own = own.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).withColumn("key", reversed_key(F.col("rule_host"), F.col("rule_path")))
    most = own.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 1
    points = addresses.select("host", "path", F.explode(suffix_keys(F.col("host"), F.col("path"), most)).alias("key"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sampled = points.select(F.substring("key", 1, BORDER).alias("key"), F.substring("host", 1, BORDER).alias("host")).orderBy(F.xxhash64("key", "host"), "key", "host").limit(ranges * SAMPLED).collect()
    ordered = sorted({(r[0], r[1]) for r in sampled})
    borders = spark.sparkContext.broadcast([ordered[k * len(ordered) // ranges] for k in range(1, ranges)] if ordered else [])
    names = ["range", "key", "is_address", "host", "path", "verdict"]
    kind = "range int, key string, is_address int, host string, path string, verdict string"

    def deal_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = borders.value
        for x in batches:
            at = [bisect_right(b, pair) for pair in zip(x.column("key").to_pylist(), x.column("host").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), x.column("key"), pa.array([1] * len(at), pa.int32()), x.column("host"), x.column("path"), pa.nulls(len(at), pa.string())], names)

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = borders.value
        for x in batches:
            for row in x.to_pylist():
                at = range(bisect_right(b, (row["key"], "")), bisect_right(b, (row["key"] + _LAST, "")) + 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array([v] * n, k) for v, k in ((row["key"], pa.string()), (0, pa.int32()), (row["rule_host"], pa.string()), (row["rule_path"], pa.string()), (row["verdict"], pa.string()))]], names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_ = None, []
        for x in batches:
            out = []
            for at, key, is_address, host, path, verdict in zip(*(x.column(n).to_pylist() for n in names), strict=True):
                if at != here:
                    here, open_ = at, []
                while open_ and not key.startswith(open_[-1][0]):
                    open_.pop()
                if not is_address:
                    open_.append((key, host, path, verdict))
                elif open_:
                    out.append((host, path, *open_[-1][1:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 5, ["host", "path", "rule_host", "rule_path", "verdict"])

    rows = points.select("key", "host", "path").mapInArrow(deal_points, kind).unionByName(own.select("key", "rule_host", "rule_path", "verdict").mapInArrow(deal_rules, kind))
    found = rows.repartition("range").sortWithinPartitions("range", "key", "is_address", "host").mapInArrow(sweep, "host string, path string, rule_host string, rule_path string, verdict string")
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), "rule_host", "rule_path", "verdict")).alias("best")
    return found.groupBy("host", "path").agg(best).select("host", "path", "best.rule_host", "best.rule_path", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row (names get underscores appended where they are taken)."""
    host, path = host_and_path(column(url))
    names = {n: free_name(pages, n) for n in ("host", "path", "rule", "verdict")}
    base = pages.withColumns({names["host"]: host, names["path"]: path})
    addresses = pages.select(host.alias("host"), path.alias("path")).distinct()
    found = cut(match(addresses, rules)).select(F.col("host").alias("found_host"), F.col("path").alias("found_path"), F.concat("rule_host", "rule_path").alias("found_rule"), F.col("verdict").alias("found_verdict"))
    joined = base.join(found, (column(names["host"]) == F.col("found_host")) & (column(names["path"]) == F.col("found_path")), "left")
    return joined.select(*[column(c) for c in base.columns], F.col("found_rule").alias(names["rule"]), F.coalesce("found_verdict", F.lit(default)).alias(names["verdict"]))


#: The query's rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def digest(pages: DataFrame) -> DataFrame:
    """The query's columns."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages.select("page_id", "url"), rules).drop("url")


ORACLE_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT p.host AS host, p.path AS path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules ON (p.host = rh OR suffix(p.host, '.' || rh)) AND starts_with(p.path, rp)
  GROUP BY 1, 2)
SELECT page_id, parts.host AS host, parts.path AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN judged USING (host, path)
"""
