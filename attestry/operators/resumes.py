"""Résumé texts to records and back, in Arrow batches of texts; whatever follows is rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import resume
from attestry.operators import claims as C
from attestry.operators import details
from attestry.session import ship

_ENTRY = "array<struct<title:string,organization:string,location:string,start_date:string,end_date:string,summary:string,highlights:array<string>,links:array<string>,confidence:double>>"
SCHEMA = {
    "identity": "struct<full_name:string,headline:string,location:string,emails:array<string>,phones:array<string>,links:array<string>,summary:string>", "skills": "array<string>", "work": _ENTRY, "projects": _ENTRY,
    "education": "array<struct<institution:string,degree:string,field:string,gpa:double,start_date:string,end_date:string>>", "certifications": "array<struct<name:string,issuer:string,start_date:string>>",
}


def parsed(text: Column) -> Column:
    """The struct of SCHEMA for a résumé's text; null and empty texts have empty parts."""
    ship()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([resume.parsed(t or "") for t in texts], columns=list(SCHEMA))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, ", ".join(f"{k} {v}" for k, v in SCHEMA.items()))(text)


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, place, title, organization, start_date, end_date, n_highlights, technologies) of every entry."""
    whole = df.select(key, parsed(F.col(text)).alias("p"))
    kept = lambda name: whole.select(key, F.lit(name).alias("section"), F.posexplode(F.col("p")[{"work_experience": "work"}.get(name, name)]).alias("place", "r"))
    entry = lambda name: kept(name).select(key, "section", "place", F.col("r")["title"].alias("title"), F.col("r")["organization"].alias("organization"), F.col("r")["start_date"].alias("start_date"), F.col("r")["end_date"].alias("end_date"), F.size(F.col("r")["highlights"]).alias("n_highlights"), C.skills(F.array_join(F.col("r")["highlights"], " ")).alias("technologies"))
    other = lambda name, a, b, end: kept(name).select(key, "section", "place", F.col("r")[a].alias("title"), F.col("r")[b].alias("organization"), F.col("r")["start_date"].alias("start_date"), end.alias("end_date"), F.lit(0).alias("n_highlights"), F.array().cast("array<string>").alias("technologies"))
    return entry("work_experience").unionByName(entry("projects")).unionByName(other("education", "degree", "institution", F.col("r")["end_date"])).unionByName(other("certifications", "name", "issuer", F.lit(None).cast("string")))


def validated(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, score, status, warnings) of the parse."""
    whole = df.select(key, parsed(F.col(text)).alias("p"))
    p, some = F.col("p"), lambda c: F.size(c) > 0
    filled = {"full_name": p["identity"]["full_name"].isNotNull(), "emails": some(p["identity"]["emails"]), "phones": some(p["identity"]["phones"]), "work_experience": some(p["work"]), "education": some(p["education"]), "projects": some(p["projects"])}
    score, status, warnings = details.validation(filled, some(p["skills"]), F.size(p["skills"]))
    return whole.select(key, score.alias("score"), status.alias("status"), warnings.alias("warnings"))


def rendered(parsed_: Column) -> Column:
    """A parsed résumé as text: name, headline, contacts, and a section for each part that isn't empty."""
    identity = parsed_["identity"]
    line = lambda sep, *parts: F.concat_ws(sep, *[F.nullif(F.coalesce(x, F.lit("")), F.lit("")) for x in parts])
    span = lambda r: line(" - ", r["start_date"], r["end_date"])
    marked = lambda r: F.transform(r["highlights"], lambda h: F.concat(F.lit("- "), h))
    entry = lambda r: F.concat(F.array(line(" | ", r["title"], r["organization"], span(r))), marked(r))
    part = lambda name, lines: F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(""), F.lit(name), F.array_join(lines, "\n")))
    head = line("\n", identity["full_name"], identity["headline"], line(" | ", identity["location"], F.array_join(F.concat(identity["emails"], identity["phones"], identity["links"]), " | ")))
    return F.concat_ws(
        "\n", head, part("SUMMARY", F.array_compact(F.array(identity["summary"]))), part("SKILLS", F.when(F.size(parsed_["skills"]) > 0, F.array(F.array_join(parsed_["skills"], ", "))).otherwise(F.array().cast("array<string>"))),
        part("WORK EXPERIENCE", F.flatten(F.transform(parsed_["work"], entry))), part("PROJECTS", F.flatten(F.transform(parsed_["projects"], lambda r: F.concat(F.array(F.lit("")), entry(r))))),
        part("EDUCATION", F.transform(parsed_["education"], lambda r: line(" | ", r["degree"], r["institution"], span(r)))), part("CERTIFICATIONS", F.transform(parsed_["certifications"], lambda r: line(" | ", r["name"], r["issuer"], r["start_date"]))),
    )


def claims(df: DataFrame, key: str, profile: str, text: str) -> DataFrame:
    """A row for each thing that résumés (key, profile, text) say, as the merges take them: section, field, the parts of its value, its signature and how sure it is."""
    whole = df.select(F.col(key).alias("document"), F.col(profile).alias("profile"), parsed(F.col(text)).alias("p")).withColumn("base", F.lit(68))
    none, empty = F.lit("").cast("string"), F.array().cast("array<string>")
    names = ["value", "name", "title", "organization", "location", "start_date", "end_date", "summary", "url", "label", "degree", "institution", "issuer"]
    row = lambda section, field="", lists=None, sure=None, **parts: F.struct(F.lit(section).alias("section"), F.lit(field).alias("field"), *[F.coalesce(parts.get(n, none), none).alias(n) for n in names], *[(lists or {}).get(n, empty).alias(n) for n in ("technologies", "highlights", "links")], (F.lit(0.0) if sure is None else sure).alias("given"))
    i, p = F.col("p.identity"), F.col("p")
    one = lambda field, value: F.filter(F.array(row("identity", field, value=value)), lambda r: r["value"] != "")
    entry = lambda section, r, **parts: row(section, "entry", {"highlights": r["highlights"], "links": r["links"], "technologies": C.skills(F.array_join(r["highlights"], " "))}, r["confidence"], organization=r["organization"], location=r["location"], start_date=r["start_date"], end_date=r["end_date"], summary=r["summary"], **parts)
    every = F.concat(
        *[one(f, i[f]) for f in ("full_name", "headline", "location", "summary")], one("email", F.get(i["emails"], F.lit(0))), one("phone", F.get(i["phones"], F.lit(0))),
        F.transform(i["links"], lambda u: row("public_profiles", url=u)), F.transform(p["skills"], lambda s: row("skills", name=s)), F.transform(p["work"], lambda r: entry("work_experience", r, title=r["title"])),
        F.transform(p["projects"], lambda r: entry("projects", r, name=r["title"])), F.transform(p["education"], lambda r: row("education", "entry", degree=r["degree"], institution=r["institution"], start_date=r["start_date"], end_date=r["end_date"])),
        F.transform(p["certifications"], lambda r: row("certifications", "entry", name=r["name"], issuer=r["issuer"], start_date=r["start_date"])),
    )
    rows = whole.select("document", "profile", "base", F.posexplode(every).alias("position", "c")).select("document", "profile", "base", "position", "c.*")
    has = {n: F.col(n) != "" for n in names} | {"highlights": F.size("highlights") > 0}
    sure = details.claim_confidence(F.col("section"), has, F.col("base"), F.col("given"))
    signature = F.substring(F.lower(F.concat_ws("|", "section", "field", F.to_json(F.struct(*sorted(names))))), 1, 512)
    return rows.withColumns({"confidence": sure, "signature": signature, "id": F.xxhash64("document", "position"), "resolver_confidence": F.lit(0.0), "status": F.lit("suggested"), "suggested_section": F.lit(""), "block": F.lit("")}).withColumn("quality", F.col("confidence")).drop("base", "given")
