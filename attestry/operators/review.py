"""Review of structured claims: edits as a state machine, bulk acceptance, counts, duplicates, learnt rules and accepted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import admission

#: Words that make an experience look like a project, and a project like an experience.
PROJECT_HINTS = ["project", "pipeline", "github", "demo", "portfolio", "platform", "application", "tool", "system", "agent"]
ROLE_HINTS = ["engineer", "developer", "analyst", "scientist", "architect", "manager", "intern", "consultant", "freelance", "freelancing"]
#: Kinds of values that an arbiter may choose among, the band of its scores and the margin.
ARBITER_KINDS, ARBITER_BAND, ARBITER_MARGIN = ["skill", "company", "role", "degree"], (0.65, 0.90), 0.12


def edited(claims: DataFrame, edits: DataFrame) -> DataFrame:
    """Claims after at most one edit each: (id, new_status, new_section, new_value), nulls change nothing.

    Moving a claim to its suggested section accepts the suggestion; any other
    move and any change of the value is manual. Claims have id, section,
    suggested_section, value, status, resolver_action, resolver_confidence,
    resolver_evidence and confidence; ``touched`` says whether it was changed by hand.
    """
    c = claims.join(edits, "id", "left")
    section = F.when(F.coalesce("new_section", F.lit("")) != "", F.col("new_section")).otherwise(F.col("section"))
    moved = section != F.col("section")
    took = moved & F.coalesce(section == F.col("suggested_section"), F.lit(False))
    changed = F.col("new_value").isNotNull() & ~F.col("new_value").eqNullSafe(F.col("value"))
    by_hand = (moved & ~took) | changed
    c = c.withColumns({"took": took, "by_hand": by_hand, "only_hand": by_hand & ~took})
    old = F.coalesce("resolver_evidence", F.array().cast("array<string>"))
    lead = F.col("took") & (F.col("resolver_action") == "suggest")
    given = F.nullif("new_status", F.lit(""))
    status = F.coalesce(given, F.when(F.col("by_hand"), "edited").when(F.col("took") & (F.col("status") == "pending"), "accepted"), F.col("status"))
    return c.withColumns({
        "section": section, "value": F.coalesce("new_value", "value"), "status": status,
        "suggested_section": F.when(~F.col("took") & ~F.col("by_hand"), F.col("suggested_section")),
        "resolver_evidence": F.when(F.col("took"), F.array_distinct(F.concat(old, F.array(F.lit("accepted_suggestion"))))).when(F.col("only_hand"), F.array(F.lit("manual_edit"))).otherwise(F.col("resolver_evidence")),
        "resolver_confidence": F.when(lead, F.greatest(F.coalesce("resolver_confidence", F.lit(0.0)), F.coalesce("confidence", F.lit(0.0)))).when(F.col("only_hand"), F.lit(1.0)).otherwise(F.col("resolver_confidence")),
        "resolver_action": F.when(lead, "accepted_suggestion").when(F.col("only_hand"), "manual").otherwise(F.col("resolver_action")),
        "touched": F.col("by_hand"),
    }).drop("took", "by_hand", "only_hand", "new_section", "new_value")


def settled(rows: DataFrame) -> DataFrame:
    """(id, status, admission_status, admission_reason, admission_score) after an edit: what ``edited`` returns with the rule's decision (rule_status, rule_reason, rule_score)."""
    out = F.col("status") == "rejected"
    taken = F.coalesce(F.col("new_status") == "accepted", F.lit(False))
    hand = F.col("touched") | F.coalesce(F.col("new_status") == "edited", F.lit(False))
    pick = lambda a, b, c, d: F.when(out, a).when(taken, b).when(hand, c).otherwise(d)
    return rows.select(
        "id", "status", pick(F.lit("reject_noise"), F.lit("admit"), F.lit("admit"), F.col("rule_status")).alias("admission_status"),
        pick(F.lit("manually_rejected"), F.lit("user_accepted"), F.lit("manual_override"), F.col("rule_reason")).alias("admission_reason"),
        pick(F.lit(0.0), F.greatest(F.lit(0.94), F.col("rule_score")), F.lit(1.0), F.col("rule_score")).alias("admission_score"),
    )


def accept_all(claims: DataFrame, document: str | None = None) -> DataFrame:
    """The claims with admitted ones accepted; ``updated`` marks those that were not before. ``document`` restricts it."""
    open_ = ~F.col("status").isin("rejected", "duplicate", "accepted") & (F.col("admission_status") == "admit")
    if document is not None:
        open_ = open_ & (F.col("document") == document)
    return claims.withColumn("updated", F.coalesce(open_, F.lit(False))).withColumn("status", F.when(F.col("updated"), "accepted").otherwise(F.col("status")))


def review_counts(claims: DataFrame, profile: str = "profile") -> DataFrame:
    """The counts of a profile's review; one aggregate with partial sums."""
    s, a, r = F.col("status"), F.col("admission_status"), F.col("resolver_action")
    held = {
        "auto_corrected": (a == "admit") & (r == "auto_correct") & (s != "duplicate"), "suggested": r == "suggest", "needs_review": a.isin("needs_review", "quarantine"), "ready": ~s.isin("rejected", "duplicate") & (a == "admit"),
        "duplicates": (s == "duplicate") | (r == "duplicate"), "manual": (r == "manual") | (s == "edited"), "rejected": (s == "rejected") | (a == "reject_noise"), "quarantined": a == "quarantine",
        **{f"{x}_total": s == x for x in ("pending", "accepted", "edited", "rejected")},
    }
    return claims.groupBy(profile).agg(F.count("*").alias("claims_total"), *[F.count_if(v).alias(k) for k, v in held.items()])


def top_reasons(claims: DataFrame, k: int = 8, profile: str = "profile") -> DataFrame:
    """(profile, place, reason, n): the reasons most often named as evidence; ties by name."""
    counted = claims.select(profile, F.explode("resolver_evidence").alias("reason")).groupBy(profile, "reason").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(profile).orderBy(F.desc("n"), "reason")).cast("long")
    return counted.withColumn("place", place).filter(F.col("place") <= k).select(profile, "place", "reason", "n")


def signature(section: Column, field: Column, value: Column) -> Column:
    """A claim's identity: section, field and lower-cased value, at most 512 signs."""
    return F.substring(F.concat_ws("|", section, field, F.lower(value)), 1, 512)


def duplicates_marked(claims: DataFrame, order: str = "position") -> DataFrame:
    """Claims with the status that resolution leaves them: repeated skills and links are duplicates of the first, automatic corrections are accepted, other open claims are pending.

    Rejected claims don't count as a first; claims edited by hand do and keep
    their status, also where they repeat another. Of equal places the smaller id comes first.
    """
    shown = F.coalesce(F.nullif("suggested_section", F.lit("")), F.col("section"))
    live = F.col("status") != "rejected"
    c = claims.withColumn("signature", signature(shown, F.col("field"), F.col("value"))).withColumn("shown", shown)
    place = F.sum(live.cast("int")).over(W.partitionBy("profile", "signature").orderBy(order, "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    by_hand = (F.col("status") == "edited") | (F.col("resolver_action") == "manual")
    repeat = live & ~by_hand & (F.col("nth") > 1) & F.col("shown").isin("skills", "public_profiles")
    open_ = live & ~by_hand & ~F.col("status").isin("accepted", "edited", "rejected")
    status = F.when(repeat, "duplicate").when(open_ & (F.col("resolver_action") == "auto_correct"), "accepted").when(open_ & (F.col("resolver_action") == "duplicate"), "duplicate").when(open_, "pending").otherwise(F.col("status"))
    return c.withColumn("nth", place).withColumn("repeat", repeat).withColumn("status", status).withColumn("suggested_section", F.when(~F.col("repeat"), F.col("suggested_section"))).withColumn("resolver_action", F.when(F.col("repeat"), "duplicate").otherwise(F.col("resolver_action"))).drop("signature", "shown", "nth", "repeat")


def section_move(claims: DataFrame) -> DataFrame:
    """(id, suggested_section, reason, score): undated experiences that read like projects, dated projects that read like experiences."""
    c = admission.flat(claims)
    holds = lambda parts, words: reduce(Column.__or__, [F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(w)) for w in words])
    project = (F.col("section") == "work_experience") & (F.col("start_date") == "") & holds([F.col(x) for x in ("title", "organization", "summary")] + [F.array_join("links", " ")], PROJECT_HINTS)
    work = (F.col("section") == "projects") & (F.col("start_date") != "") & holds([F.col("name"), F.col("summary")], ROLE_HINTS)
    pick = lambda a, b: F.when(project, a).when(work, b)
    return c.select("id", pick("projects", "work_experience").alias("suggested_section"), pick("project_like_experience_item", "experience_like_project_item").alias("reason"), F.coalesce(pick(0.81, 0.78), F.lit(0.0)).alias("score"))


def arbiter_asked(candidates: DataFrame) -> DataFrame:
    """(claim, kind, asked): whether the best two candidates (claim, kind, value, score, alias, fuzzy) are close enough, and the best in the band, to ask an arbiter."""
    best = W.partitionBy("claim", "kind").orderBy(F.desc("score"), "value")
    two = candidates.withColumn("place", F.row_number().over(best)).withColumn("next", F.lead("score").over(best)).filter("place = 1")
    asked = F.col("kind").isin(*ARBITER_KINDS) & ~((F.col("alias") >= 0.99) & (F.col("fuzzy") >= 0.99)) & F.col("score").between(*ARBITER_BAND) & (F.abs(F.round(F.col("score") - F.col("next"), 9)) <= ARBITER_MARGIN)
    return two.select("claim", "kind", F.coalesce(asked, F.lit(False)).alias("asked"))


def new_rules(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (profile, kind, pattern, target, section, confidence) that corrections teach and ``rules`` lacks, each once.

    Claims: profile, section, raw and value as structs of name, url, degree,
    organization and title, confidence, resolver_confidence. Changes of case and
    signs alone teach nothing.
    """
    part = lambda kind, field: F.struct(F.lit(kind).alias("kind"), F.trim(F.coalesce(f"raw.{field}", F.lit(""))).alias("pattern"), F.trim(F.coalesce(f"value.{field}", F.lit(""))).alias("target"))
    both = lambda field: (F.coalesce(f"raw.{field}", F.lit("")) != "") & (F.coalesce(f"value.{field}", F.lit("")) != "")
    at = F.col("section")
    taught = F.when(at == "skills", part("skill", "name")).when(at == "public_profiles", part("url", "url")).when(at == "education", part("degree", "degree")).when((at == "work_experience") & both("organization"), part("company", "organization")).when((at == "work_experience") & both("title"), part("role", "title"))
    sure = F.greatest(F.lit(0.88), F.when(F.coalesce("resolver_confidence", F.lit(0.0)) != 0, F.col("resolver_confidence")).otherwise(F.col("confidence")))
    found = claims.select("profile", "section", taught.alias("learnt"), sure.alias("confidence")).select("profile", "learnt.*", "section", "confidence").filter((F.col("pattern") != "") & (F.col("target") != "") & (T.lookup_key(F.col("pattern")) != T.lookup_key(F.col("target"))))
    once = found.groupBy("profile", "kind", "pattern", "target").agg(F.min("section").alias("section"), F.max("confidence").alias("confidence"))
    return once.join(rules.select("profile", "kind", "pattern", "target"), ["profile", "kind", "pattern", "target"], "left_anti")


def accepted_values(skills: DataFrame, work: DataFrame, education: DataFrame, links: DataFrame) -> DataFrame:
    """(profile, value_type, value, aliases, confidence): typed rows of an overview's skills (profile, name), experience (title, organization), education (degree, institution) and links (url); empty values give none."""
    known = lambda value, table: F.coalesce(*[F.when(value == k, F.array(*map(F.lit, v))) for k, v in table.items()], F.array().cast("array<string>")) if table else F.array().cast("array<string>")

    def rows(df: DataFrame, column: str, kind: str, sure: float, table: dict[str, list[str]]) -> DataFrame:
        return df.select("profile", F.lit(kind).alias("value_type"), F.trim(F.col(column)).alias("value"), known(F.col(column), table).alias("aliases"), F.lit(sure).alias("confidence")).filter("value <> ''")

    parts = [rows(skills, "name", "skill", 1.0, admission.SKILL_ALIASES), rows(work, "organization", "company", 0.98, {}), rows(work, "title", "role", 0.95, admission.ROLE_ALIASES), rows(education, "degree", "degree", 0.98, admission.DEGREE_ALIASES), rows(education, "institution", "institution", 0.92, {}), rows(links, "url", "url", 0.94, {})]
    return reduce(DataFrame.unionByName, parts)
