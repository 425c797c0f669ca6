"""Registered queries of the résumé parser, over texts of several layouts. Their oracles are the rows that a reader of the texts would write."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import resumes
from attestry.plans.catalog import register

BARS = """SAMPLE PERSON
Data Engineer | Springfield
sample@mail.example | +1 212 555 0187 | https://code.example/sample

SUMMARY
Data engineer with 5 years of work on pipelines.

SKILLS
Languages: Python, SQL, C# | Tools: Docker; Kafka

WORK EXPERIENCE
Senior Data Engineer | Acme Systems | Jan 2021 - Present | Springfield
- Built pipelines in Python and SQL.
- Led 4 people. See https://acme.example/p.
Data Analyst | Beta Labs | 2018 - 2020
- Built 12 reports.

PROJECTS
Note Search
Small search over notes.
- Built with Python and Redis.

EDUCATION
B.Sc. in Computer Science, State University
2014 - 2018, GPA: 8.3 / 10

CERTIFICATIONS
Cloud Basics by Example Org, 2022
"""
BLOCKS = """Other Person

EXPERIENCE
Sample Pvt Ltd
Apr 2024 – Present
Senior ML Engineer
Springfield

• Deployed a service.
• Scaled it.

Open Navy Council
May 2022 – Feb 2024
Developer

• Built a model.

SELECTED PROJECTS
Notes–Search bot over many notes. | Books–Store with many books and carts. | Queue–Task queue with 20k jobs

WORK HISTORY
Software Developer in Sample Learning (10 months)(01 Jun 2021 - 23 Mar 2022)
-Worked on pages.
-Worked on APIs.
"""
TEXTS = [(1, BARS), (2, BLOCKS), (3, ""), (4, None)]


def _texts(spark):
    return spark.createDataFrame(TEXTS, "id int, text string")


@register(
    "resume_parse",
    """SELECT * FROM (VALUES
    (1, 'work_experience', 0, 'Senior Data Engineer', 'Acme Systems', 'Jan 2021', 'Present', 2, 'Python,SQL'), (1, 'work_experience', 1, 'Data Analyst', 'Beta Labs', '2018', '2020', 1, ''), (1, 'projects', 0, 'Note Search', NULL, NULL, NULL, 2, 'Python,Redis'),
    (1, 'education', 0, 'B.Sc. in Computer Science', 'State University', '2014', '2018', 0, ''), (1, 'certifications', 0, 'Cloud Basics', 'Example Org', '2022', NULL, 0, ''),
    (2, 'work_experience', 0, 'Senior ML Engineer', 'Sample Pvt Ltd', 'Apr 2024', 'Present', 2, ''), (2, 'work_experience', 1, 'Developer', 'Open Navy Council', 'May 2022', 'Feb 2024', 1, ''), (2, 'work_experience', 2, 'Software Developer', 'Sample Learning', '01 Jun 2021', '23 Mar 2022', 2, ''),
    (2, 'projects', 0, 'Notes', NULL, NULL, NULL, 1, ''), (2, 'projects', 1, 'Books', NULL, NULL, NULL, 1, ''), (2, 'projects', 2, 'Queue', NULL, NULL, NULL, 1, '')
    ) AS t(id, section, place, title, organization, start_date, end_date, n_highlights, technologies)""",
)
def resume_parse(spark, d):
    return resumes.records(_texts(spark), "id", "text").withColumn("technologies", F.array_join("technologies", ","))


@register("resume_identity", "SELECT * FROM (VALUES (1, 'SAMPLE PERSON', 'Data Engineer', 'Springfield', 'sample@mail.example', '+1 212 555 0187', 'https://code.example/sample', 'Python,SQL,C#,Docker,Kafka'), (2, 'Other Person', NULL, NULL, '', '', '', ''), (3, NULL, NULL, NULL, '', '', '', ''), (4, NULL, NULL, NULL, '', '', '', '')) AS t(id, full_name, headline, location, emails, phones, links, skills)")
def resume_identity(spark, d):
    p = _texts(spark).select("id", resumes.parsed(F.col("text")).alias("p"))
    joined = lambda c: F.array_join(F.col("p.identity")[c], ",").alias(c)
    return p.select("id", "p.identity.full_name", "p.identity.headline", "p.identity.location", joined("emails"), joined("phones"), joined("links"), F.array_join("p.skills", ",").alias("skills"))


@register("resume_validation", "SELECT * FROM (VALUES (1, 100::BIGINT, 'strong', 0), (2, 50::BIGINT, 'needs_review', 4), (3, 0::BIGINT, 'needs_review', 7), (4, 0::BIGINT, 'needs_review', 7)) AS t(id, score, status, n_warnings)")
def resume_validation(spark, d):
    return resumes.validated(_texts(spark), "id", "text").select("id", "score", "status", F.size("warnings").alias("n_warnings"))


@register("resume_render")
def resume_render(spark, d):
    """Tests parse the rendered text again."""
    return _texts(spark).select("id", resumes.rendered(resumes.parsed(F.col("text"))).alias("text"))


@register(
    "structured_claims",
    """SELECT * FROM (VALUES (1, 'certifications', 1, 0.8::DOUBLE), (1, 'education', 1, 0.8::DOUBLE), (1, 'identity', 6, 0.76::DOUBLE), (1, 'projects', 1, 0.84::DOUBLE), (1, 'public_profiles', 1, 0.76::DOUBLE), (1, 'skills', 5, 0.74::DOUBLE), (1, 'work_experience', 2, 0.98::DOUBLE),
    (2, 'identity', 1, 0.76::DOUBLE), (2, 'projects', 3, 0.84::DOUBLE), (2, 'work_experience', 3, 0.98::DOUBLE)) AS t(document, section, n, best)""",
)
def structured_claims(spark, d):
    found = resumes.claims(_texts(spark).withColumn("profile", F.lit("p")), "id", "profile", "text")
    return found.groupBy("document", "section").agg(F.count("*").cast("int").alias("n"), F.max("confidence").alias("best"))


@register("texts_to_profile", "SELECT * FROM (VALUES ('a', 'SAMPLE PERSON', 'Data Engineer', 'sample@mail.example', 2, 1, 1, 1, 0, 0), ('b', 'Other Person', NULL, NULL, 3, 0, 3, 0, 0, 0)) AS t(profile, full_name, headline, email, n_work_experience, n_education, n_project, n_certification, n_public_profile, n_critical)")
def texts_to_profile(spark, d):
    """From résumé texts over claims, clusters and merges to the canonical row."""
    from attestry.operators import fuse

    texts = _texts(spark).withColumn("profile", F.when(F.col("id") == 1, "a").otherwise("b"))
    return fuse.canonical(fuse.groups(resumes.claims(texts, "id", "profile", "text"))).drop("skills", "n_optional")
