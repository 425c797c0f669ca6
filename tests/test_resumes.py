"""The résumé parser on layouts, odd texts and its own output."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestry.functions import resume
from attestry.operators import resumes
from attestry.plans import resume_queries


def test_a_rendered_text_gives_the_same_records(spark):
    first = resume_queries._texts(spark).select("id", resumes.rendered(resumes.parsed(F.col("text"))).alias("text"))
    again = [tuple(r) for r in resumes.records(first, "id", "text").drop("technologies").collect()]
    assert sorted(again, key=str) == sorted((tuple(r) for r in resumes.records(resume_queries._texts(spark), "id", "text").drop("technologies").collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["EXPERIENCE", "Projects", "EDUCATION", "Skills:", "", "- Built a thing", "Engineer | Acme Ltd | 2019 - 2020", "Jan 2020 to present", "A–b and some more words | C–d and more words", "BSc, Some University", "•", "|", "x@y.zz", "9" * 30, "(12 months)(2020)", "名前"]), max_size=25))
def test_no_text_breaks_the_parser(lines):
    found = resume.parsed("\n".join(lines))
    assert all(r["title"] or r["organization"] for r in found["work"]) and all(r["title"] for r in found["projects"])
    assert all(0 <= r["confidence"] <= 1 for r in found["work"] + found["projects"])


def test_rules_of_lines():
    assert [resume.heading(x) for x in ("WORK EXPERIENCE", "Technical Skills & more", "- Skills", "Led a team of four people here", "OPEN SOURCE & LEADERSHIP", "INTERESTS")] == ["work_experience", "skills", None, None, "projects", "unknown_section"]
    assert [resume.dates(x) for x in ("Jan 2020 - Present", "2019–2021", "01 Jun 2022 - 23 Mar 2023", "May 2020", "none")] == [("Jan 2020", "Present"), ("2019", "2021"), ("01 Jun 2022", "23 Mar 2023"), ("May 2020", None), (None, None)]
    assert [resume.looks_like_name(x) for x in ("Jean-Luc O'Neil", "José García", "One", "a@b c", "Poe, Sam", "Sam 2")] == [True, True, False, False, False, False]
    assert resume.inline_projects("one line only") == [] and len(resume.inline_projects("A1 - some long words | B2 – other long words")) == 2
    assert resume.education([["M.Sc. Physics", "Some College", "2010 – 2012 | GPA 3.5/4"]])[0] == {"institution": "Some College", "degree": "M.Sc. Physics", "field": None, "gpa": 3.5, "start_date": "2010", "end_date": "2012"}
    assert resume.certifications([["• Cloud Basics - Example Org (2020)"]])[0] == {"name": "Cloud Basics", "issuer": "Example Org", "start_date": "2020"}
