"""From claims to one profile: clusters, merges, groups with what needs review, and the canonical row.

Claims are rows as ``admission.flat`` takes them, with profile, id, document,
position, quality, highlights and block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import admission, claims, clusters, fusion
from attestry.operators.profiles import link_kind, phone

#: Reasons that a person must look at.
CRITICAL = ["current_headline_conflict", "same_company_different_roles", "same_dates_different_company", "missing_organization", "degree_wording_conflict", "portfolio_conflict", "conflicting_contact_value", "wrong_company_bullet"]
#: What a conflict of an identity field is called.
CONFLICTS = {"headline": "current_headline_conflict", "email": "conflicting_contact_value", "phone": "conflicting_contact_value"}
#: Links that are a project's or an organization's, not a person's.
FOREIGN = ["project_repo", "project_demo", "client_site", "organization_site", "community_site"]
COLUMNS = ["profile", "kind", "canonical_key", "canonical_value", "confidence", "status", "review_reason"]


def review_level(reason: Column) -> Column:
    return F.when(reason.isin(*CRITICAL), "critical").when(reason.isNotNull(), "optional")


def identity_groups(rows: DataFrame) -> DataFrame:
    """The best value of every identity field; a close runner-up puts it under review."""
    value = F.when(F.col("field") == "email", F.lower("value")).when(F.col("field") == "phone", phone(F.col("value"))).otherwise(F.col("value"))
    said = rows.filter("field <> ''").select(F.struct("profile", "field").alias("k"), value.alias("v"), "quality").filter("v <> ''")
    best = claims.single_truth(said, "k", "v", "quality")
    names = reduce(lambda c, e: c.when(F.col("k.field") == e[0], e[1]), CONFLICTS.items(), F.when(F.lit(False), "")).otherwise("conflicting_value")
    reason = F.when(F.col("review"), names)
    return best.select("k.profile", F.lit("identity").alias("kind"), F.concat(F.lit("identity:"), F.col("k.field")).alias("canonical_key"), F.col("value").alias("canonical_value"), F.col("quality").alias("confidence"), F.when(F.col("review"), "review").otherwise("merged").alias("status"), reason.alias("review_reason"))


def link_groups(rows: DataFrame) -> DataFrame:
    """The best link of every kind that is a person's own; the others are ignored, each by its address."""
    r = rows.filter("url <> ''").withColumn("of", link_kind(F.col("url"), F.col("label")))
    own = ~F.col("of").isin(*FOREIGN)
    key = F.when(own, F.concat(F.lit("public_profile:"), F.col("of"))).otherwise(F.concat(F.lit("ignored_public_profile:"), T.url_key(F.col("url"))))
    best = r.groupBy("profile", key.alias("canonical_key"), own.alias("own")).agg(F.max_by("url", F.struct("quality", -F.col("position"))).alias("canonical_value"), F.max("quality").alias("confidence"))
    return best.select("profile", F.lit("public_profile").alias("kind"), "canonical_key", "canonical_value", "confidence", F.when(F.col("own"), "merged").otherwise("ignored").alias("status"), F.when(~F.col("own"), "not_a_personal_link").alias("review_reason"))


def groups(given: DataFrame) -> DataFrame:
    """(profile, kind, canonical_key, canonical_value, confidence, status, review_reason, review_level) of everything that the claims say; of groups with one key the most certain stays."""
    rows = admission.flat(given).withColumn("section", admission.preview_section())
    of = lambda section: rows.filter(F.col("section") == section)
    clustered = lambda section, found: of(section).join(found, ["profile", "id"])
    keyed = lambda section, *names: of(section).withColumn("cluster", F.concat_ws("|", *[T.lookup_key(F.col(n)) for n in names]))
    part = lambda df, kind: df.withColumn("kind", F.lit(kind)).withColumn("review_reason", F.col("review_reason") if "review_reason" in df.columns else F.lit(None).cast("string")).select(*COLUMNS)
    skills = clusters.merged_skills(of("skills")).withColumn("canonical_value", F.col("skill"))
    parts = [
        identity_groups(of("identity")), link_groups(of("public_profiles")), part(skills, "skill"), part(fusion.merged_experience(clustered("work_experience", clusters.work_clusters(of("work_experience")))), "work_experience"),
        part(fusion.merged_education(keyed("education", "institution", "degree")), "education"), part(fusion.merged_items(clustered("projects", clusters.project_clusters(of("projects"))), "project"), "project"),
        part(fusion.merged_items(keyed("certifications", "name", "issuer"), "certification"), "certification"),
    ]
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy("profile", "kind", "canonical_key").agg(F.max_by(F.struct("canonical_value", "confidence", "status", "review_reason"), F.struct("confidence", "canonical_value")).alias("best_"))
    return best.select("profile", "kind", "canonical_key", "best_.*").withColumn("review_level", review_level(F.col("review_reason")))


def canonical(found: DataFrame) -> DataFrame:
    """One row for each profile: identity fields and skills that are merged, how many groups of each other kind, and how many need a look."""
    merged = F.col("status") == "merged"
    field = lambda name: F.max(F.when(F.col("canonical_key") == f"identity:{name}", F.col("canonical_value"))).alias(name)
    count = lambda kind: F.count_if(merged & (F.col("kind") == kind)).alias(f"n_{kind}")
    skills = F.array_join(F.array_sort(F.collect_set(F.when(merged & (F.col("kind") == "skill"), F.col("canonical_value")))), ",")
    return found.groupBy("profile").agg(field("full_name"), field("headline"), field("email"), skills.alias("skills"), *[count(k) for k in ("work_experience", "education", "project", "certification", "public_profile")], F.count_if(F.col("review_level") == "critical").alias("n_critical"), F.count_if((F.col("review_level") == "optional") & (F.col("status") == "review")).alias("n_optional"))
