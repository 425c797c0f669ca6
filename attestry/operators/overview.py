"""A profile's overview: entries folded over documents, what holds of several sources, summaries, anomalies, duplicates and articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.functions import text as T
from attestry.operators import clusters, fusion
from attestry.operators.profiles import link_kind

#: The fields whose lower-cased values make two entries one.
KEYS = {"education": ["institution", "degree", "field_of_study"], "work_experience": ["title", "organization", "start_date", "end_date"], "projects": ["name", "summary"], "certifications": ["name", "issuer", "credential_id"]}
SECTIONS = ["identity", "skills", "work_experience", "education", "projects", "certifications"]
#: Why a link isn't a person's.
WHY = {"project_repo": "A repository link was kept with project evidence instead of personal profile links.", "project_demo": "A project demo link was kept with project evidence instead of personal profile links.", "client_site": "A client or external site was kept out of personal profile links.", "community_site": "A community link was kept out of personal portfolio links.", "organization_site": "An organization link was kept out of personal portfolio links."}
PROJECT_HINTS = ["project", "open source", "github", "repository", "hackathon"]


def entry_key(kind: str) -> Column:
    """Equal for entries of a kind that are one; of an entry without any of the fields its id."""
    parts = F.concat_ws("|", *[F.nullif(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in KEYS[kind]])
    return F.when(parts != "", parts).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))


def folded(entries: DataFrame, kind: str) -> DataFrame:
    """One row for each different entry of a profile: the first value of every field, the longest summary, all technologies, highlights, links and documents in their order."""
    return fusion.merged_items(entries.withColumn("cluster", entry_key(kind)), "project" if kind == "projects" else "certification")


def resolved(profiles: DataFrame, view: str | None = None) -> DataFrame:
    """(profile, mode, view, identity, skills) of rows (profile, user_name, auto, canonical, views, manual, manual_skills).

    auto, canonical and the values of views are structs (identity: a map, skills,
    profile_view, profile_focus); a canonical one without content doesn't count, a
    compiled view takes its place where it has one. What a person set holds, field
    by field; an empty name is the user's.
    """
    content = lambda o: o.isNotNull() & ((F.size(o["skills"]) > 0) | F.exists(F.map_values(o["identity"]), lambda v: F.coalesce(v, F.lit("")) != ""))
    full = F.coalesce(content(F.col("canonical")), F.lit(False))
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    rows = profiles.withColumns({"mode": F.when(full, "canonical").otherwise("auto"), "base": F.when(full, F.col("canonical")).otherwise(F.col("auto"))})
    wanted = F.coalesce(F.lit(view), some(F.col("base.profile_view")), some(F.col("base.profile_focus")))
    rows = rows.withColumn("view", wanted)
    rows = rows.withColumn("base", F.when((F.col("mode") == "canonical") & F.col("views")[F.col("view")].isNotNull(), F.col("views")[F.col("view")]).otherwise(F.col("base")))
    set_ = F.map_filter(F.coalesce("manual", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    identity = F.map_concat(F.map_filter(F.col("base.identity"), lambda k, v: ~F.map_contains_key(set_, k)), set_)
    named = F.when(F.coalesce(identity["full_name"], F.lit("")) == "", F.map_concat(F.map_filter(identity, lambda k, v: k != "full_name"), F.create_map(F.lit("full_name"), F.col("user_name")))).otherwise(identity)
    return rows.select("profile", "mode", "view", named.alias("identity"), F.coalesce("manual_skills", "base.skills").alias("skills"))


def summaries(profiles: DataFrame, documents: DataFrame, claims: DataFrame, approved: DataFrame, entries: DataFrame) -> DataFrame:
    """(profile, document_count, pending_claim_count, approved_claim_count, sections_ready) of profiles (profile), documents (document, profile), claims (document, status), approved (document) and entries (profile, section)."""
    count = lambda df, name: df.groupBy("profile").agg(F.count("*").alias(name))
    of = documents.select("document", "profile")
    parts = [count(of, "document_count"), count(claims.filter("status = 'pending'").join(of, "document"), "pending_claim_count"), count(approved.join(of, "document"), "approved_claim_count"), entries.filter(F.col("section").isin(*SECTIONS)).groupBy("profile").agg(F.count_distinct("section").alias("sections_ready"))]
    return reduce(lambda df, p: df.join(p, "profile", "left"), parts, profiles.select("profile")).fillna(0)


def reviewed(approved: DataFrame, claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """The approved claims (claim, text) after reviews (claim, status): an approval adds the claim or renews it, any other status takes it away."""
    last = reviews.groupBy("claim").agg(F.max_by("status", "at").alias("status"))
    fresh = claims.join(last.filter("status = 'approved'"), "claim").select("claim", "text")
    return approved.select("claim", "text").join(last, "claim", "left_anti").unionByName(fresh)


def anomalies(groups: DataFrame) -> DataFrame:
    """(id, anomaly, severity, message) of groups (id, kind, status, reason, title, organization, summary, links, formats, link_type): links in several formats, links that aren't a person's, and work that looks like a project."""
    same = (F.size(F.array_distinct("formats")) > 1) & (F.size(F.array_distinct(F.transform("formats", T.url_key))) == 1)
    why = reduce(lambda c, e: c.when(F.col("link_type") == e[0], e[1]), WHY.items(), F.when(F.lit(False), "")).otherwise("A non-profile website was kept out of personal profile links.")
    text = F.lower(F.concat_ws(" ", "title", "summary", F.array_join(F.slice("links", 1, 4), " ")))
    hinted = reduce(Column.__or__, [F.contains(text, F.lit(h)) for h in PROJECT_HINTS]) & (F.trim(F.coalesce("organization", F.lit(""))) == "")
    repository = F.exists("links", lambda x: link_kind(x, F.lit("")) == "project_repo")
    row = lambda kind, severity, message: F.struct(F.lit(kind).alias("anomaly"), F.lit(severity).alias("severity"), message.alias("message"))
    found = (
        F.when((F.col("kind") == "public_profile") & (F.col("status") != "ignored") & same, row("duplicate_url_different_format", "low", F.lit("The same destination URL appeared in multiple formats and was canonicalized automatically.")))
        .when(F.col("kind") == "ignored_public_profile", row("section_misclassification", "low", why))
        .when((F.col("kind") == "work_experience") & (F.col("status") != "ignored") & (F.coalesce("reason", F.lit("")) != "project_inside_experience") & (repository | hinted), row("project_inside_experience", "medium", F.concat(F.coalesce(F.nullif("title", F.lit("")), F.lit("This experience entry")), F.lit(" looks more like a project than a job."))))
    )
    return groups.select("id", found.alias("a")).filter("a IS NOT NULL").select("id", "a.*")


def work_duplicates(groups: DataFrame) -> DataFrame:
    """(a, b, decision) of work groups (profile, id, title, organization, start_date, end_date) of one organization: ``exact`` with one window of years, or with one title and near or no dates; ``potential`` with one title and an overlap."""
    keyed = groups.withColumns({"org": T.lookup_key(F.coalesce("organization", F.lit(""))), "name": T.lookup_key(F.coalesce("title", F.lit("")))}).filter("org <> ''")
    first = lambda side: F.coalesce(F.regexp_extract(F.coalesce(F.nullif(F.col(f"{side}.start_date"), F.lit("")), F.col(f"{side}.end_date"), F.lit("")), r"\b(?:19|20)\d{2}\b", 0).try_cast("int"), F.lit(0))
    span = lambda side: (F.col(f"{side}.start_date"), F.col(f"{side}.end_date"))
    pairs = keyed.alias("x").join(keyed.alias("y"), F.expr("x.profile = y.profile AND x.org = y.org AND x.id < y.id"))
    title = (F.col("x.name") != "") & (F.col("x.name") == F.col("y.name"))
    overlap, window = clusters.years_overlap(*span("x"), *span("y")), clusters.window_key(*span("x")) == clusters.window_key(*span("y"))
    undated = F.concat(*[F.coalesce(c, F.lit("")) for c in (*span("x"), *span("y"))]) == ""
    exact = (overlap & window) | (title & (undated | (F.abs(first("x") - first("y")) <= 1)))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.when(exact, "exact").when(title & overlap, "potential").alias("decision")).filter("decision IS NOT NULL")


def project_duplicates(groups: DataFrame) -> DataFrame:
    """(a, b, decision) of a profile's project groups (profile, id, name, summary, technologies, links): ``exact`` with a common link, one name or similar names, or alike in name, technologies and summary; ``potential`` a little below. A profile's projects are few."""
    near = lambda c: F.round(S.compared(S.alike)(F.col(f"x.{c}"), F.col(f"y.{c}")), 6)
    rows = groups.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("technologies", "links")})
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.profile = y.profile AND x.id < y.id"))
    keys = lambda side: F.transform(F.filter(F.col(f"{side}.links"), lambda x: F.trim(x) != ""), T.url_key)
    low = lambda side: F.array_distinct(F.transform(F.col(f"{side}.technologies"), F.lower))
    least = F.least(F.size(low("x")), F.size(low("y")))
    shared = F.when(least > 0, F.size(F.array_intersect(low("x"), low("y"))) / least).otherwise(0.0)
    s = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.arrays_overlap(keys("x"), keys("y")).alias("link"), near("name").alias("name"), near("summary").alias("said"), shared.alias("tech"))
    exact = F.coalesce("link", F.lit(False)) | (F.col("name") > 0.92) | ((F.col("name") > 0.82) & (F.col("tech") > 0.5) & (F.col("said") > 0.8))
    return s.select("a", "b", F.when(exact, "exact").when((F.col("name") > 0.76) & (F.col("tech") > 0.35) & (F.col("said") > 0.68), "potential").alias("decision")).filter("decision IS NOT NULL")


def article_line(kind: Column) -> Column:
    """An entry (title, organization, start_date, end_date, summary, degree, institution, field, name, technologies, issuer) as a line of an article."""
    c = lambda name: F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))
    add = lambda before, x, after="": F.coalesce(F.concat(F.lit(before), x, F.lit(after)), F.lit(""))
    dates = F.nullif(F.concat_ws(" - ", c("start_date"), c("end_date")), F.lit(""))
    work = F.concat(F.coalesce(c("title"), F.lit("Role")), add(" at ", c("organization")), add(" (", dates, ")"), add(": ", c("summary")))
    study = F.concat(F.coalesce(c("degree"), F.lit("Education")), add(", ", c("institution")), add(" in ", c("field")))
    tech = F.nullif(F.array_join(F.slice(F.coalesce("technologies", F.array().cast("array<string>")), 1, 5), ", "), F.lit(""))
    project = F.concat(F.coalesce(c("name"), F.lit("Project")), add(": ", c("summary")), add(" (", tech, ")"))
    return F.when(kind == "work-experience", work).when(kind == "education", study).when(kind == "projects", project).otherwise(F.concat(F.coalesce(c("name"), F.lit("Certification")), add(", ", c("issuer"))))


def articles(entries: DataFrame) -> DataFrame:
    """(profile, slug, n, body): an article for each kind of entry, its lines in their order."""
    lines = entries.select("profile", F.col("kind").alias("slug"), "position", article_line(F.col("kind")).alias("line"))
    grouped = lines.groupBy("profile", "slug").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    return grouped.select("profile", "slug", F.size("l").cast("long").alias("n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("body"))
