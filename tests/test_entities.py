"""Operators without SQL against definitions and hand-made rows: token ratios, resolver candidates, clusters, claim extraction, search."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import similarity as S
from attestry.operators import chunking, clusters, extraction, graph, search
from attestry.plans import catalog, entity_queries, search_queries


def subsequence(a, b):
    """The longest common subsequence by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for k, y in enumerate(b):
            out.append(row[k] + 1 if x == y else max(row[k + 1], out[k]))
        row = out
    return row[-1]


def test_ratios_by_their_definition():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))
    for _ in range(400):
        a, b = word(), word()
        assert S.common(a, b) == subsequence(a, b)
        short, long_ = sorted((a, b), key=len)
        if short:
            stretches = {long_[i:j] for i in range(len(long_)) for j in range(i, min(len(long_), i + len(short)) + 1) if j - i == len(short) or i == 0 or j == len(long_)}
            assert S.partial_ratio(a, b) == pytest.approx(max(200 * subsequence(short, x) / (len(short) + len(x)) for x in stretches))
    assert S.ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(90.909, abs=1e-3)
    assert S.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert S.weighted_ratio("new york mets", "new york mets vs atlanta") == 90
    assert S.weighted_ratio("", "x") == S.token_set_ratio("", "x") == 0
    assert S.claim_similarity("Built ETL jobs.", "built  etl jobs") == 1 and S.claim_similarity("", "x") == 0
    assert S.same_claim("Built fast search tools", "Built fast search tools for teams", ["SQL"], ["SQL"]) and not S.same_claim("a", "b", [], [])


def test_resolver_candidates(spark):
    rows = {(r.id, r.place): r for r in catalog.queries()["resolver_candidates"](spark, "").collect()}
    assert [(rows[k, 1].value, rows[k, 1].source) for k in (1, 2, 5)] == [("FastAPI", "builtin_alias,builtin_fuzzy"), ("PostgreSQL", "canonical_fuzzy,canonical_alias,builtin_alias,builtin_fuzzy"), ("AI/ML Developer", "builtin_alias,builtin_fuzzy")]
    assert rows[1, 2].value == "Fast-API" and rows[1, 2].evidence == "rule:rename"  # the newer of two rules
    assert rows[2, 1].score == pytest.approx(0.25 * 0.7 + 0.25 + 0.2 + 0.1 * 0.95 + 0.05)
    assert not any(k == 6 and r.source != "canonical_fuzzy" for (k, _), r in rows.items())


def test_work_and_project_clusters(spark):
    got = {r.id: r.cluster for r in catalog.queries()["work_clusters"](spark, "").collect()}
    assert got[1] == got[2] == got[7] == 0 and got[4] == got[5] and len({got[k] for k in (1, 3, 4)}) == 3 and got[6] == 0
    projects = [("p", 1, 1, 0.5, "Shop Front", ["http://www.shop.example/"]), ("p", 2, 2, 0.5, "Other", ["https://shop.example"]), ("p", 3, 3, 0.5, "shop front", []), ("p", 4, 4, 0.5, None, None)]
    found = clusters.project_clusters(spark.createDataFrame(projects, "profile string, id int, position int, quality double, name string, links array<string>"))
    assert {r.id: r.cluster for r in found.collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert clusters.work_clusters(spark.createDataFrame([], "profile string, id int, position int, quality double, organization string, title string, start_date string, end_date string, block string")).count() == 0


def test_claims_merge_greedily(spark):
    rows = sorted(catalog.queries()["claim_extraction"](spark, "").collect(), key=lambda r: (r.run, r.place))
    assert [(r.run, r.place, r.chunks) for r in rows] == [("r", 1, "c1,c2"), ("r", 2, "c1"), ("r", 3, "c3"), ("s", 1, "c5")]
    one = extraction.merged(extraction.candidates(entity_queries._rows(spark, entity_queries.RETRIEVED), "run"), "run", 1).collect()
    assert sorted((r.run, r.place) for r in one) == [("r", 1), ("s", 1)]


def test_search_of_nothing_and_with_vectors(spark):
    chunks = search_queries._chunks(spark)
    assert search.search(chunks, "  ").count() == 0 and search.search(chunks.limit(0), "sql").count() == 0
    assert search.variants("CI for html") == ["CI for html", "continuous integration for html"] and search.variants("plain") == ["plain"]
    vectors = chunks.select(F.col("id").alias("vec_id"), F.when(F.col("id") == "c03", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    query = spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")
    found = search.search(chunks, "sql ml", 10, vectors, query).collect()
    assert {"c01", "c03"} <= {r.id for r in found} and next(r for r in found if r.id == "c03").semantic == 1.0


def test_contexts_and_chunks_of_nothing(spark):
    assert search.context(search_queries._results(spark).limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven eight")], "id int, body string")
    got = chunking.document_chunks(empty, "body").collect()
    assert [(r.id, r.strategy) for r in got] == [(3, "paragraph")]


def test_a_graph_of_nothing(spark):
    none = graph.mentions(entity_queries._approved(spark).limit(0))
    assert graph.nodes(none).count() == graph.edges(none).count() == 0
