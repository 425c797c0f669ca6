"""Decisions on single fields, hints that fit a record, links that belong to projects, and a group's focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions import text as T
from attestry.operators.details import smart_title

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
#: Labels of well-known hosts.
HOSTS = [("github.com", "GitHub"), ("linkedin.com", "LinkedIn"), ("huggingface.co", "Hugging Face")]


def _decision(value: Column, action: Column | str, sure: float | Column, evidence: list[str], label: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    return F.struct(value.alias("value"), (F.lit(None).cast("string") if label is None else label).alias("label"), as_column(action).alias("action"), as_column(sure).alias("confidence"), F.array(*[F.lit(e) for e in evidence]).cast("array<string>").alias("evidence"))


def contact(kind: Column, raw: Column, label: Column, places: list[str]) -> Column:
    """The corrected value of an e-mail, url, phone or location, what to do with it, how sure, and why.

    Deterministic corrections are automatic, digits alone a suggestion, and what
    no rule reads is reviewed. Places are known by the words of ``places``.
    """
    given = F.trim(F.coalesce(raw, F.lit("")))
    changed = lambda new: F.when(new != given, "auto_correct").otherwise("keep")
    mail = F.lower(given)
    email = F.when(F.regexp_like(mail, F.lit(EMAIL)), _decision(mail, changed(mail), 0.99, ["email_regex", "deterministic_normalization"])).otherwise(_decision(raw, "needs_review", 0.42, []))
    bare = F.regexp_replace(given, r"[.,);]+$", "")
    link = F.when(F.startswith(bare, F.lit("www.")), F.concat(F.lit("https://"), bare)).otherwise(bare)
    host = F.regexp_replace(F.lower(F.regexp_extract(F.when(F.contains(link, F.lit("://")), link).otherwise(F.concat(F.lit("https://"), link)), r"^[^:]+://([^/?#]*)", 1)), r"^www\.", "")
    named = F.coalesce(*[F.when(F.contains(host, F.lit(h)), F.lit(n)) for h, n in HOSTS], F.coalesce(F.nullif(label, F.lit("")), F.lit("Link")))
    same = (link == given) & F.coalesce(named == label, F.lit(False))
    url = F.when(host != "", _decision(link, F.when(same, "keep").otherwise("auto_correct"), 0.98, ["url_parser", "contact_section"], named)).otherwise(_decision(raw, "needs_review", 0.35, [], label))
    digits = F.regexp_replace(given, "[^0-9]+", "")
    phone = F.when(F.length(digits) >= 10, _decision(F.when(F.startswith(given, F.lit("+")), F.concat(F.lit("+"), digits)).otherwise(digits), "suggest", 0.78, ["digit_normalization"])).otherwise(_decision(raw, "needs_review", 0.25, []))
    place = smart_title(given)
    known = F.exists(F.array(*[F.lit(p) for p in places]), lambda p: F.contains(T.lookup_key(place), p))
    location = _decision(place, F.when(place != given, "suggest").otherwise("keep"), F.when(known, 0.84).otherwise(0.58), ["location_case_normalization"])
    return F.when(kind == "email", email).when(kind == "url", url).when(kind == "phone", phone).when(kind == "location", location).otherwise(_decision(raw, "keep", 0.4, []))


def hinted(records: DataFrame, hints: DataFrame, least: float = 0.4) -> DataFrame:
    """(id, hint, score): for each record (profile, id, title, organization, start_date, end_date) the hint of its profile that fits best, from ``least`` on; of equal ones the first."""
    key = lambda side, c: T.lookup_key(F.coalesce(F.col(f"{side}.{c}"), F.lit("")))
    pairs = records.alias("r").join(hints.alias("h"), F.expr("r.profile = h.profile"))
    add = lambda condition, x: F.when(condition, x).otherwise(0.0)

    def part(c: str, weight: float) -> Column:
        a, b = key("r", c), key("h", c)
        return add((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), weight) + add((a == "") & (b != ""), 0.05)

    date = lambda c, weight: add((key("r", c) != "") & (key("r", c) == key("h", c)), weight)
    score = F.round(part("organization", 0.45) + part("title", 0.35) + date("start_date", 0.2) + date("end_date", 0.15), 4)
    scored = pairs.select(F.col("r.id").alias("id"), F.col("h.id").alias("hint"), score.alias("score"))
    return scored.groupBy("id").agg(F.max_by(F.struct("hint", "score"), F.struct(F.col("score"), -F.col("hint"))).alias("best_")).select("id", "best_.*").filter(F.col("score") >= least)


def with_repositories(projects: DataFrame, links: DataFrame, least: float = 0.78) -> DataFrame:
    """Projects (profile, id, name, links) with the links (profile, url) whose last part is nearly their name; a link goes to the first such project. A profile's projects and links are few."""
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace(T.url_key(F.col("url")), "/+$", ""), "/"), -1), "[-_]", " ")
    named = links.filter(F.coalesce("url", F.lit("")) != "").select("profile", "url", last.alias("said"))
    near = projects.select("profile", "id", "name").join(named, "profile").withColumn("near", S.compared(S.alike)(F.col("name"), F.col("said"))).filter(F.col("near") >= least)
    mine = near.groupBy("profile", "url").agg(F.min("id").alias("id")).groupBy("id").agg(F.array_sort(F.collect_set("url")).alias("more"))
    none = F.array().cast("array<string>")
    return projects.join(mine, "id", "left").withColumn("links", F.array_distinct(F.concat(F.coalesce("links", none), F.coalesce("more", none)))).drop("more")


def focus_of(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, focus): the focus with the most weight among a group's documents (id, document) and (document, focus, quality); ``master`` without any, of equal ones the first by name."""
    weighed = groups.join(documents, "document").groupBy("id", "focus").agg(F.sum(F.coalesce("quality", F.lit(0.72))).alias("w"))
    best = weighed.groupBy("id").agg(F.min_by("focus", F.struct(-F.round("w", 6), F.col("focus"))).alias("focus"))
    return groups.select("id").distinct().join(best, "id", "left").withColumn("focus", F.coalesce("focus", F.lit("master")))
