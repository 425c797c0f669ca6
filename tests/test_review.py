"""Admission, review, scoring and fusion with nulls, empty tables and missing columns."""

import duckdb
import pytest

from attestry.operators import admission, fusion, review, scoring
from attestry.plans import catalog

KIND = "profile int, id long, document string, section string, name string, confidence double"


def test_admission_of_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "profile int, value_type string, value string, aliases array<string>")
    rows = spark.createDataFrame([(1, 1, None, None, None, None), (None, 2, "d", "skills", None, None), (1, 3, None, "skills", "Query Plans", None), (1, 4, "d", "work_experience", None, 0.5)], KIND)
    got = {r.id: (r.status, r.reason) for r in admission.admit(rows, none).collect()}
    assert got == {1: ("needs_review", "untyped_claim"), 2: ("reject_noise", "skill_noise_fragment"), 3: ("reject_noise", "unverified_skill_fragment"), 4: ("reject_noise", "empty_experience_claim")}
    assert admission.admit(rows.limit(0), none).count() == 0


def test_edits_of_unknown_claims_change_nothing(spark):
    claims = spark.createDataFrame([(1, "skills", None, "a", "pending", "keep", None, None, 0.5)], "id long, section string, suggested_section string, value string, status string, resolver_action string, resolver_confidence double, resolver_evidence array<string>, confidence double")
    edits = spark.createDataFrame([(9, "rejected", None, None)], "id long, new_status string, new_section string, new_value string")
    got = review.edited(claims, edits).collect()
    assert [(r.id, r.section, r.value, r.status, r.resolver_action, r.touched) for r in got] == [(1, "skills", "a", "pending", "keep", False)]


def test_matches_follow_the_gold_order(spark):
    pairs = [(1, 0, 0, 0.9, 0.5), (1, 0, 1, 0.9, 0.5), (1, 1, 0, 0.99, 0.5), (1, 1, 1, 0.4, 0.5), (1, 2, 1, 0.6, 0.5)]
    got = scoring.matches_in_order(spark.createDataFrame(pairs, "c int, g int, f int, s double, t double"), ["c"], "g", "f", "s", "t").collect()
    # The first gold item takes the first of two equal ones; the second has only a bad one left, which stays free for the third.
    assert sorted((r.g, r.f) for r in got) == [(0, 0), (2, 1)]


def test_scores_without_gold_or_finds(spark):
    kind = "case int, field string, at int, item string"
    gold, none = spark.createDataFrame([(1, "skills", 0, "sql"), (1, "links", 0, None)], kind), spark.createDataFrame([], kind)
    assert [(r.field, r.score, r.status) for r in scoring.set_scores(gold, none).collect()] == [("skills", 0.0, "miss")]
    assert [(r.field, r.score, r.status) for r in scoring.set_scores(none, gold).collect()] == [("skills", None, "not_scored")]


def test_fusion_of_claims_without_lists(spark):
    claims = spark.createDataFrame([(1, 1, 1, None, None, "Engineer", None)], "profile int, cluster int, position int, document string, quality double, title string, organization string")
    row = fusion.merged_experience(claims).first()
    assert (row.title, row.organization, row.highlights, row.review_reason) == ("Engineer", None, [], "missing_organization")
    assert fusion.merged_experience(claims.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["claim_admission", "edit_claims"])
def test_literal_rows_reach_every_reason(name):
    found = duckdb.sql(catalog.oracle_sql()[name]).df()
    assert found[[c for c in found.columns if "reason" in c][0]].nunique() >= (40 if name == "claim_admission" else 4)
