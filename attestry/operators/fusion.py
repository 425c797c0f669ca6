"""Fusion of clustered claims: blocking keys, and one merged row for each cluster with what needs review.

Claims of a cluster are flat rows with profile, cluster, position (their order),
document, quality and the fields of the value. Lists are kept in that order, the
first of equal items (by lower case) wins. A merge is one aggregate; a cluster's
lists are bounded by its claims.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import admission
from attestry.operators.profiles import link_kind

#: Words that make an experience look like a project, and titles that say it is none.
PROJECT_WORDS = ["project", "pipeline", "tool", "platform", "application", "agent", "open source", "github"]
ROLE_WORDS = ["engineer", "developer", "analyst", "scientist", "architect", "manager", "intern", "consultant"]


def first_of_equal(items: Column) -> Column:
    """Items that aren't blank, collapsed, without those that were there before in any case."""
    clean = F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))), lambda x: x != "")
    return T.let(clean, lambda c: T.let(F.transform(c, F.lower), lambda low: F.filter(c, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def year(date: Column) -> Column:
    return F.regexp_extract(date, r"((?:19|20)\d{2})", 1).try_cast("int")


def best_text(text: str) -> Column:
    """The text of the best claim; of equally good ones the longest, then the first."""
    return F.max_by(F.col(text), F.when(F.col(text) != "", F.struct("quality", F.length(text), -F.col("position"))))


def best_date(date: str, latest: bool) -> Column:
    """The earliest start or the latest end; dates without a year lose against any with one."""
    y = year(F.col(date))
    order = F.coalesce(y, F.lit(-1)) if latest else -F.coalesce(y, F.lit(9999))
    return F.max_by(F.col(date), F.when(F.col(date) != "", F.struct(y.isNotNull().cast("int"), order, "quality", F.length(date), -F.col("position"))))


def in_order(item: Column) -> Column:
    """All values of an aggregate in the claims' order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("position", "document", item.alias("v")))), lambda x: x["v"])


def different(text: str) -> Column:
    """How many keys the texts have."""
    key = T.lookup_key(F.col(text))
    return F.count_distinct(F.when(key != "", key))


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower(text), F.lit(w)) for w in words])


def _joined(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def claim_key(claims: DataFrame) -> DataFrame:
    """(id, key) that blocks claims which may say the same; links that aren't a person's own are keyed apart."""
    c = admission.flat(claims)
    key = lambda name: T.lookup_key(F.col(name))
    alias = F.coalesce(*[F.when(key("name").isin(*[x.lower() for x in (name, *other)]), F.lit(name.lower())) for name, other in admission.SKILL_ALIASES.items()], key("name"))
    kind = link_kind(F.col("url"), F.col("label"))
    own = ~kind.isin("project_repo", "project_demo", "client_site", "organization_site", "community_site")
    f = F.col("field")
    identity = F.when(f == "email", F.concat(F.lit("identity:email:"), F.lower("value"))).when(f == "phone", F.concat(F.lit("identity:phone:"), F.regexp_replace("value", "[^0-9]+", ""))).otherwise(F.concat(F.lit("identity:"), f))
    at = admission.preview_section()
    return c.select(
        "id",
        F.when(at == "identity", identity).when((at == "public_profiles") & own, F.concat(F.lit("public_profile:"), kind)).when(at == "public_profiles", F.concat(F.lit("ignored_public_profile:"), T.url_key(F.col("url"))))
        .when(at == "skills", F.concat(F.lit("skill:"), alias)).when(at == "work_experience", F.concat_ws("|", F.lit("work_experience"), key("organization"), key("title"), key("start_date"), key("end_date")))
        .when(at == "education", F.concat_ws("|", F.lit("education"), key("institution"), key("degree"))).when(at == "projects", F.concat(F.lit("project:"), T.lookup_key(F.when(F.col("name") != "", F.col("name")).otherwise(F.substring_index("summary", " ", 6)))))
        .when(at == "certifications", F.concat_ws("|", F.lit("certification"), key("name"), key("issuer"))).otherwise(at).alias("key"),
    )


def _whole(claims: DataFrame) -> DataFrame:
    lists = {"highlights": F.coalesce("highlights", F.array().cast("array<string>"))} if "highlights" in claims.columns else {"highlights": F.array().cast("array<string>")}
    return admission.flat(claims).withColumns(lists)


def merged_experience(claims: DataFrame) -> DataFrame:
    """One row for each (profile, cluster): best title, organization and place, widest dates, all highlights, technologies and links; under review without an organization, with conflicting titles or organizations, or if it reads like a project."""
    lists = {name: first_of_equal(F.flatten(in_order(F.col(name)))) for name in ("technologies", "links")}
    rows = _whole(claims).groupBy("profile", "cluster").agg(
        *[best_text(x).alias(x) for x in ("title", "organization", "location")], best_date("start_date", False).alias("start_date"), best_date("end_date", True).alias("end_date"),
        first_of_equal(F.concat(in_order(F.col("summary")), F.flatten(in_order(F.col("highlights"))))).alias("highlights"), *[v.alias(k) for k, v in lists.items()],
        first_of_equal(in_order(F.col("document"))).alias("documents"), F.max("quality").alias("confidence"), different("title").alias("titles"), different("organization").alias("organizations"),
    )
    rows = rows.withColumn("summary", F.get("highlights", F.lit(0)))
    body = F.concat_ws(" ", F.concat(F.array_compact(F.array("title", "organization", "summary")), F.slice("highlights", 1, 4), F.col("links")))
    project = (_holds(body, PROJECT_WORDS) & ~_holds(F.coalesce("title", F.lit("")), ROLE_WORDS)) | F.exists("links", lambda x: link_kind(x, F.lit("")) == "project_repo")
    reason = F.when(project, "project_inside_experience").when(F.col("organization").isNull(), "missing_organization").when(F.col("titles") > 1, "same_company_different_roles").when(F.col("organizations") > 1, "same_dates_different_company")
    value = _joined(" · ", F.col("title"), F.col("organization"), _joined(" - ", F.col("start_date"), F.col("end_date")))
    key = F.concat(F.lit("experience:"), T.lookup_key(F.coalesce("organization", "title", value)), F.lit(":"), T.lookup_key(F.coalesce("start_date", F.lit(""))))
    return rows.withColumns({"review_reason": reason, "canonical_key": key, "canonical_value": F.coalesce(F.nullif(value, F.lit("")), F.lit("Experience entry"))}).withColumn("status", F.when(F.col("review_reason").isNull(), "merged").otherwise("review")).drop("titles", "organizations")


def merged_education(claims: DataFrame) -> DataFrame:
    """One row for each (profile, cluster): best degree, institution and summary, widest dates; under review with degrees in several wordings."""
    rows = _whole(claims).groupBy("profile", "cluster").agg(
        *[best_text(x).alias(x) for x in ("degree", "institution", "summary")], best_date("start_date", False).alias("start_date"), best_date("end_date", True).alias("end_date"), first_of_equal(F.flatten(in_order(F.col("links")))).alias("links"),
        first_of_equal(in_order(F.col("document"))).alias("documents"), F.max("quality").alias("confidence"), F.count_distinct(F.nullif(F.lower("degree"), F.lit(""))).alias("degrees"),
    )
    value = _joined(" · ", F.col("degree"), F.col("institution"))
    conflict = F.col("degrees") > 1
    return rows.withColumns({
        "review_reason": F.when(conflict, "degree_wording_conflict"), "status": F.when(conflict, "review").otherwise("merged"), "canonical_key": F.concat(F.lit("education:"), T.lookup_key(F.coalesce("institution", "degree", value))),
        "canonical_value": F.coalesce(F.nullif(value, F.lit("")), F.lit("Education entry")),
    }).drop("degrees")


def merged_items(claims: DataFrame, kind: str) -> DataFrame:
    """One row for each (profile, cluster) of projects or certifications (``kind``): the first value of each field, the longest summary (of equally long ones the first), all technologies, highlights and links. A project without a name is called by its summary's first six words."""
    first = lambda name: F.min_by(F.col(name), F.when(F.col(name) != "", F.col("position"))).alias(name)
    longest = F.max_by(F.col("summary"), F.when(F.col("summary") != "", F.struct(F.length("summary"), -F.col("position"))))
    rows = _whole(claims).groupBy("profile", "cluster").agg(
        *[first(x) for x in ("name", "issuer", "organization", "location", "start_date", "end_date")], longest.alias("summary"), *[first_of_equal(F.flatten(in_order(F.col(x)))).alias(x) for x in ("technologies", "highlights", "links")],
        first_of_equal(in_order(F.col("document"))).alias("documents"), F.max("quality").alias("confidence"),
    )
    project = kind == "project"
    if project:
        rows = rows.withColumn("name", F.coalesce("name", F.substring_index("summary", " ", 6)))
    value = _joined(" · ", F.col("name"), F.col("summary" if project else "issuer"))
    empty = "Project" if project else "Certification"
    return rows.withColumns({"status": F.lit("merged"), "canonical_key": F.concat(F.lit(f"{kind}:"), T.lookup_key(F.coalesce("name", value))), "canonical_value": F.coalesce(F.nullif(value, F.lit("")), F.lit(empty))})
