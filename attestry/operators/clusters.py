"""Clusters of a profile's claims for the merges, and what they compare.

Sections that match by a key are grouped by it. Work and projects compare with
the best claim of each open cluster in the claims' order; a profile's claims are
one group, which bounds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions import text as T
from attestry.operators import admission
from attestry.operators.views import OPEN_END
from attestry.session import ship


def year_window(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last year: 0 without a start, 9999 for open and unknown ends."""
    y = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(?:19|20)\d{2}\b", 0).try_cast("int")
    return F.coalesce(y(start), F.lit(0)), F.when(F.regexp_like(F.coalesce(end, F.lit("")), F.lit(OPEN_END)), 9999).otherwise(F.coalesce(y(end), F.lit(9999)))


def window_key(start: Column, end: Column) -> Column:
    a, b = year_window(start, end)
    return F.concat_ws(":", a.cast("string"), b.cast("string"))


def years_overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two spans share a year; a span without a start overlaps any."""
    (a, b), (c, d) = year_window(start, end), year_window(other_start, other_end)
    return (a == 0) | (c == 0) | (F.greatest(a, c) <= F.least(b, d))


def _window(start: str, end: str) -> tuple[int, int]:
    y = lambda s: int(m[0]) if (m := re.search(r"\b(?:19|20)\d{2}\b", s or "")) else 0
    return y(start), 9999 if re.search(OPEN_END, end or "") else y(end) or 9999


def same_work(a, b) -> bool:
    """One organization with one window of years, or with an overlap and similar titles; without an organization only one block of a page with an overlap and similar titles."""
    x, y = _window(a.start_date, a.end_date), _window(b.start_date, b.end_date)
    overlap = not x[0] or not y[0] or max(x[0], y[0]) <= min(x[1], y[1])
    org, other = S.lookup(a.organization or ""), S.lookup(b.organization or "")
    similar = S.alike(a.title or "", b.title or "") >= 0.72
    if org and org == other:
        return x == y or overlap and similar
    if not org or not other:
        return bool(a.block) and a.block == b.block and overlap and similar
    return False


def same_project(a, b) -> bool:
    """One link, equal names, or names that are similar at 0.9."""
    links = lambda r: {re.sub(r"^[a-z]+://(www\.)?|/+$", "", x.lower()) for x in r.links if x} if r.links is not None else set()
    return bool(links(a) & links(b)) or S.alike(a.name or "", b.name or "") >= 0.9


def greedy(claims: DataFrame, same: Callable, columns: list[str]) -> DataFrame:
    """(profile, id, cluster): in the claims' order, each joins the first cluster whose best claim (of equal quality the first) is the same, or opens one; clusters count from 0."""
    ship(claims.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: list = []
        out = []
        for r in pdf.sort_values(["position", "id"]).itertuples(index=False):
            k = next((k for k, h in enumerate(heads) if same(r, h)), len(heads))
            if k == len(heads):
                heads.append(r)
            elif r.quality > heads[k].quality:
                heads[k] = r
            out.append((r.profile, r.id, k))
        return pd.DataFrame(out, columns=["profile", "id", "cluster"])

    kinds = dict(claims.dtypes)
    return claims.select("profile", "id", "position", "quality", *columns).groupBy("profile").applyInPandas(run, f"profile {kinds['profile']}, id {kinds['id']}, cluster long")


def work_clusters(claims: DataFrame) -> DataFrame:
    return greedy(claims, same_work, ["organization", "title", "start_date", "end_date", "block"])


def project_clusters(claims: DataFrame) -> DataFrame:
    return greedy(claims, same_project, ["name", "links"])


def canonical_skill(name: Column) -> Column:
    """The canonical name of a skill by its other spellings, or its collapsed text."""
    key = T.lookup_key(name)
    listed = F.create_map(*[F.lit(x) for canonical, others in admission.SKILL_ALIASES.items() for spelling in dict.fromkeys([canonical.lower(), *others]) for x in (spelling, canonical)])
    return F.coalesce(listed[key], F.trim(F.regexp_replace(name, r"\s+", " ")))


def fragment(name: Column) -> Column:
    """Whether a name is no skill by its looks: a heading, a listed fragment, or short and unknown."""
    key = T.lookup_key(name)
    known = name.isin(*admission.WHITELIST) | key.isin(*[x.lower() for x in admission.WHITELIST], *admission.TAXONOMY, *[x for c, o in admission.SKILL_ALIASES.items() for x in (c.lower(), *o)])
    short = key.isin(*admission.SHORT)
    vowels = F.length(key) - F.length(F.translate(key, "aeiou", ""))
    looks = ((F.length(key) <= 2) & ~short) | (F.startswith(key, F.lit("/")) & ~key.isin("c/c++", "ci/cd")) | ((F.length(key) <= 4) & F.regexp_like(key, F.lit("^[a-z]+$")) & ~short) | ((F.length(key) <= 6) & (vowels <= 1) & ~short)
    return (key == "") | (~known & (key.isin(*admission.HEADINGS, *admission.FRAGMENTS) | looks))


def merged_skills(claims: DataFrame) -> DataFrame:
    """One row for each (profile, skill) of claims (profile, document, name, section, status, confidence, resolver_confidence, quality): confidence, reasons, status and review_reason.

    A known name, the best claim's certainty, the skills section, several
    documents and earlier acceptance count for it, the looks of a fragment
    against it; below 0.55 it is ignored, below 0.80 reviewed.
    """
    rows = claims.withColumn("skill", canonical_skill(F.col("name"))).filter("skill <> ''")
    sure = F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce("resolver_confidence", F.lit(0.0)))
    group = rows.groupBy("profile", "skill").agg(
        F.max_by(sure, F.struct("quality", sure)).alias("sure"), F.max((F.col("section") == "skills").cast("int")).alias("listed"), F.count_distinct("document").alias("document_count"),
        F.max(F.col("status").isin("accepted", "edited").cast("int")).alias("accepted"), F.count("*").alias("source_count"), F.array_sort(F.collect_set("document")).alias("documents"),
    )
    key = T.lookup_key(F.col("skill"))
    known = key.isin(*[x.lower() for x in admission.WHITELIST])
    alias = key.isin(*admission.TAXONOMY, *[x for c, o in admission.SKILL_ALIASES.items() for x in (c.lower(), *o)])
    steps = [(known, 0.16, "known_skill_whitelist"), (F.col("listed") == 1, 0.14, "skills_section"), (alias, 0.20, "known_skill_dictionary_match"), (F.col("document_count") > 1, F.least(F.lit(0.12), 0.06 * F.col("document_count")), "seen_in_multiple_documents"), (F.col("accepted") == 1, 0.08, "accepted_before"), (fragment(F.col("skill")), -0.45, "looks_like_fragment"), (key.isin(*admission.FRAGMENTS), -0.35, "blacklisted_token")]
    total = 0.55 * F.col("sure") + sum((F.when(c, x).otherwise(0.0) for c, x, _ in steps), F.lit(0.0))
    scored = group.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 4))), "reasons": F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, _, n in steps]))})
    low, middle = F.col("confidence") < 0.55, F.col("confidence") < 0.80
    reason = F.when(low & fragment(F.col("skill")), "garbage_skill_fragment").when(middle, "low_confidence_skill")
    return scored.select("profile", "skill", F.concat(F.lit("skill:"), key).alias("canonical_key"), "confidence", F.when(low, "ignored").when(middle, "review").otherwise("merged").alias("status"), reason.alias("review_reason"), "source_count", "document_count", "documents", "reasons")


def duplicate_key(groups: DataFrame) -> DataFrame:
    """Adds ``key``, which groups that say the same share: links by address, projects by their first link or name, the others by their names."""
    k = lambda name: T.lookup_key(F.coalesce(name, F.lit("")))
    named = F.coalesce(F.nullif("name", F.lit("")), "value")
    kind = F.col("kind")
    link = F.get("links", F.lit(0))
    body = (
        F.when(kind == "public_profile", T.url_key(F.coalesce(F.nullif("url", F.lit("")), "value"))).when(kind == "skill", T.lookup_key(named)).when(kind == "education", F.concat_ws("|", k("institution"), k("degree")))
        .when((kind == "project") & link.isNotNull(), T.url_key(link)).when(kind == "project", T.lookup_key(named)).when(kind == "certification", F.concat_ws("|", k("name"), k("issuer")))
        .when(kind == "work_experience", F.concat_ws("|", k("organization"), k("title"), k("start_date"), k("end_date"))).otherwise(T.lookup_key(F.col("value")))
    )
    return groups.withColumn("key", F.concat(kind, F.when(kind == "work_experience", "|").otherwise(":"), body))


def exact_duplicates(groups: DataFrame) -> DataFrame:
    """(id, kept, n): for each group (profile, id, kind, confidence, ...) the one of its key that stays, the most certain and then the first, and how many share the key."""
    keyed = duplicate_key(groups)
    best = keyed.groupBy("profile", "key").agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("kept"), F.count("*").alias("n"))
    return keyed.join(best, ["profile", "key"]).select("id", "kept", "n")
