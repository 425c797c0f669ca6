"""Small rules that several steps share: titles, bullets, links, entities, confidences, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T

#: Words of organizations, and verbs that begin an achievement.
STUB = r"(?i)\b(pvt|ltd|limited|inc|llc|corp|l\.l\.c|navy|army|defence|defense)\b"
VERBS = r"(?i)^(built|developed|designed|implemented|created|led|managed|optimized|deployed|architected|delivered|worked|contributed|maintained|researched|analyzed|improved|automated|integrated|launched|coordinated|supported|established|drove|scaled|reduced|increased|achieved|spearheaded|extended|diagnosed|fixed|conducted|authored|co-authored|migrated|refactored|streamlined|documented|monitored|evaluated|trained|fine-tuned|ingested|processed)\b"
#: Words that say the form of an organization.
NOISE = ["pvt", "ltd", "limited", "inc", "llc", "corp", "co", "the", "and", "of", "for", "a", "an", "is", "consultants", "consultant", "technologies", "tech", "solutions", "services", "private"]
#: The order of articles.
CATALOG = ["profile", "skills", "projects", "work-experience", "education", "certifications", "general"]
#: The checks of a parse, and fields that complete an entry.
CHECKS = ["full_name", "emails", "phones", "work_experience", "education", "projects"]
COMPLETE = {"work_experience": ["title", "organization", "summary"], "projects": ["name", "summary"], "education": ["degree", "institution"], "certifications": ["name", "issuer"]}


def smart_title(value: Column) -> Column:
    """Words with a capital first letter; the rest of a word stays as it is."""
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def name_tokens(name: Column) -> Column:
    """Different words of two and more signs that say more than the form of an organization."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9_\s]", " "), r"\s+"), lambda t: F.length(t) > 1)
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(x) for x in NOISE]))


def same_name(a: Column, b: Column, least: float = 0.4) -> Column:
    """Whether two names likely are one: equal, one of more than five signs inside the other, a common word of five signs, or a Jaccard similarity of the words."""
    x, y = T.normalized(F.coalesce(a, F.lit(""))), T.normalized(F.coalesce(b, F.lit("")))
    short, long_ = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    s, t = name_tokens(a), name_tokens(b)
    both = F.array_intersect(s, t)
    union = F.size(F.array_union(s, t))
    return (x != "") & (y != "") & ((x == y) | ((F.length(short) > 5) & F.contains(long_, short)) | F.exists(both, lambda w: F.length(w) >= 5) | ((F.size(s) > 0) & (F.size(t) > 0) & (F.size(both) >= least * union)))


def one_job(entries: DataFrame, tolerance: int = 6) -> DataFrame:
    """(a, b) of a profile's entries (profile, id, organization, start_date, end_date) with one name whose months overlap, ``tolerance`` apart at most; entries without a year don't count."""
    pairs = entries.alias("x").join(entries.alias("y"), F.expr("x.profile = y.profile AND x.id < y.id"))
    at = lambda side, c: T.year_month(F.coalesce(F.col(f"{side}.{c}"), F.lit("")))
    a0, a1, b0, b1 = at("x", "start_date"), at("x", "end_date"), at("y", "start_date"), at("y", "end_date")
    return pairs.filter(same_name(F.col("x.organization"), F.col("y.organization")) & (a0 > 0) & (b0 > 0) & (a0 - tolerance <= b1) & (b0 - tolerance <= a1)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def backend(requested: Column, stored: Column, configured: Column, pdf: Column, available: list[str], auto: str = "auto", plain: str = "layout", structured: str = "structured") -> Column:
    """The parser to use: the requested one, the document's, the configured one; with none of these the structured one for PDF files and images, else the plain one. An unavailable request is null."""
    known = lambda c: c.isin(*available)
    best = F.when(pdf & F.lit(structured in available), F.lit(structured)).otherwise(F.lit(plain))
    asked = F.coalesce(requested, F.lit(auto))
    return F.when((asked != auto) & known(asked), asked).when(asked != auto, F.lit(None).cast("string")).when(known(stored), stored).when(known(configured), configured).otherwise(best)


def bullets(items: Column, summary: Column) -> Column:
    """Bullets without marks; too short ones, names of organizations, repeats and sentences of the summary go."""
    clean = F.filter(F.transform(items, lambda b: F.regexp_replace(b, r"^[\s•·–*-]+|[\s•·–*-]+$", "")), lambda b: F.length(b) >= 5)
    stub = lambda b: (T.word_count(b) <= 10) & ~F.regexp_like(b, F.lit(VERBS)) & F.regexp_like(b, F.lit(STUB))
    said = F.concat(F.filter(F.transform(F.split(F.coalesce(summary, F.lit("")), r"(?<=[.!?])\s+"), T.normalized), lambda s: F.length(s) > 15), F.filter(F.array(T.normalized(F.coalesce(summary, F.lit("")))), lambda s: s != ""))
    kept = F.filter(clean, lambda b: ~stub(b) & ~T.let(T.normalized(b), lambda n: (F.length(n) > 15) & F.exists(said, lambda s: F.contains(n, s) | F.contains(s, n))))
    return T.let(kept, lambda xs: T.let(F.transform(xs, T.normalized), lambda keys: F.filter(xs, lambda b, i: F.array_position(keys, T.normalized(b)) == i + 1)))


def preferred_links(links: DataFrame, preferred: list[str], excluded: list[str], most: int = 5) -> DataFrame:
    """(profile, place, url) of links (profile, position, url): the domains of ``preferred`` first in their order, none of ``excluded``, one of each address, ``most`` of them."""
    key = T.url_key(F.trim("url"))
    rank = F.coalesce(*[F.when(F.contains(key, F.lit(d)), F.lit(k)) for k, d in enumerate(preferred)], F.lit(len(preferred)))
    none = reduce(Column.__or__, [F.contains(key, F.lit(d)) for d in excluded], F.lit(False))
    rows = links.filter(F.trim(F.coalesce("url", F.lit(""))) != "").withColumns({"key": key, "rank": rank, "none": none}).filter(~F.col("none"))
    once = rows.groupBy("profile", "key").agg(F.min(F.struct("rank", "position", "url")).alias("first")).select("profile", "first.*")
    return once.withColumn("place", F.row_number().over(W.partitionBy("profile").orderBy("rank", "position")).cast("long")).filter(F.col("place") <= most).select("profile", "place", "url")


def catalog_order(slug: Column) -> Column:
    """An article's place in the catalog; unlisted ones come after."""
    at = F.array_position(F.array(*[F.lit(s) for s in CATALOG]), slug)
    return F.when(at > 0, at - 1).otherwise(20)


def most_certain(entities: DataFrame) -> DataFrame:
    """Of entities (group, source, at, type, text, score) that are equal but for case, the one with the highest score; of equally certain ones the first."""
    one = F.max_by(F.struct("text", "score", "source"), F.struct("score", -F.col("source"), -F.col("at")))
    return entities.groupBy("group", "type", F.lower("text").alias("key")).agg(one.alias("best_")).select("group", "type", "best_.*")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    return T.let(F.transform(values, lambda x: F.exp(x - top)), lambda e: T.let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)))


def tagged_spans(tokens: DataFrame) -> DataFrame:
    """(group, start, stop, type, score) from tokens (group, at, start, stop, label, score) tagged B-, I- and O: a span goes on with I- of its type where no more than one sign lies between, and ends elsewhere; score is the mean."""
    rows = tokens.filter("start < stop").withColumns({"kind": F.when(F.col("label") != "O", F.substring_index("label", "-", -1)), "begins": F.startswith("label", F.lit("B-"))})
    order = W.partitionBy("group").orderBy("at")
    new = F.col("begins") | F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != F.col("kind")) | (F.col("start") > F.lag("stop").over(order) + 1)
    runs = rows.withColumn("new", F.when(F.col("kind").isNotNull(), F.coalesce(new, F.lit(True)).cast("int"))).withColumn("run", F.sum("new").over(order)).filter("kind IS NOT NULL")
    return runs.groupBy("group", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("kind").alias("type"), F.round(F.avg("score"), 6).alias("score")).drop("run")


def rects_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two rectangles (x0, y0, x1, y1) share an area."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def claim_confidence(section: Column, has: dict[str, Column], base: Column, given: Column) -> Column:
    """The parse's score from 0.4 to 0.92 and what completes the claim (``has``: whether a field is filled), or the confidence that it came with; 0.98 at most."""
    part = lambda *names: sum((0.06 * has[n].cast("int") for n in names), F.lit(0.0))
    entry = reduce(lambda c, e: c.when(section == e[0], F.least(F.lit(0.18), part(*e[1]))), COMPLETE.items(), F.when(F.lit(False), 0.0)).otherwise(0.0) + 0.04 * has["highlights"].cast("int")
    bonus = F.when(section == "identity", 0.08 * has["value"].cast("int")).when(section == "skills", 0.06).when(section == "public_profiles", F.when(has["url"], 0.08).otherwise(0.02)).otherwise(entry)
    return F.round(F.least(F.lit(0.98), F.greatest(F.greatest(F.lit(0.4), F.least(F.lit(0.92), base / 100)) + bonus, F.coalesce(given, F.lit(0.0)))), 3)


def validation(filled: dict[str, Column], has_skills: Column, n_skills: Column) -> tuple[Column, Column, Column]:
    """(score, status, warnings) of a parse: the share of checks that are filled, in percent."""
    score = F.round(100 * sum((filled[c].cast("int") for c in CHECKS), F.lit(0)) / len(CHECKS)).cast("long")
    missing = [F.when(~filled[c], F.lit(f"{c.replace('_', ' ').title()} is missing or weak.")) for c in CHECKS]
    inferred = F.when(~has_skills & (n_skills < 4), F.lit("No explicit skills section was detected, so skills were inferred from the document text."))
    return score, F.when(score >= 85, "strong").when(score >= 65, "usable").otherwise("needs_review"), F.array_compact(F.array(*missing, inferred))


def sync_key(*fields: Column) -> Column:
    """A hash of fields as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*fields)).cast("binary"), 256)
