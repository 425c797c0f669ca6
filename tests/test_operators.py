"""Hand-computed fixtures and properties."""

from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import chunking, retrieval
from attestry.operators import claims as C
from attestry.operators import order_dependent as O
from attestry.operators import relational as R


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_budget_groups_carry_overlap_and_leave_oversize_alone(spark):
    groups = one(spark, chunking.budget_groups(F.col("a"), 4), a=["w w", "w w w", "w w w w w w", "w"])
    # The third item follows a flush, so it joins what was carried; the last one overflows again.
    assert groups == [["w w"], ["w w", "w w w"], ["w w w", "w w w w w w"], ["w w w w w w", "w"]]
    assert one(spark, chunking.budget_groups(F.col("a"), 2, 0), a=["w w w", "w", "w"]) == [["w w w"], ["w", "w"]]
    assert chunking.budget_tokens(1200) == 218


def test_windows_of_few_items(spark):
    assert one(spark, chunking.windows(F.col("a"), 3, 2), a=["a", "b", "c", "d"]) == [["a", "b", "c"], ["c", "d"]]


def test_headings(spark):
    found = lambda line: one(spark, chunking.heading(F.col("a")), a=line)
    assert [found(x) for x in ("WORK EXPERIENCE:", "My technical skills", "INTERESTS", "plain line", "1. 2.")] == ["work_experience", "skills", "unknown_section", None, None]


def test_rrf_is_monotone_and_keeps_both_lists(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "doc long, score double")
    b = spark.createDataFrame([(2, 9.0), (4, 1.0)], "doc long, score double")
    got = {r.doc: r.score for r in retrieval.reciprocal_ranks(a, b).collect()}
    assert got == {1: round(0.5 / 61, 9), 2: round(0.5 / 62 + 0.5 / 61, 9), 3: round(0.5 / 63, 9), 4: round(0.5 / 62, 9)}


def test_cosine_bounds_and_zero(spark):
    assert one(spark, retrieval.cosine(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[0.0, 0.0]) == 0.0
    assert abs(one(spark, retrieval.cosine(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[-2.0, -4.0]) + 1) < 1e-12


def test_proximity(spark):
    score = lambda t: one(spark, retrieval.phrase_proximity(F.col("a"), ["red", "fox"]), a=t)
    assert score("nothing here") == 0.0
    assert score("a red thing") == 2.0
    assert abs(score("red x x fox red") - (4 + 1 / 2 + 1.5)) < 1e-12


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 5), ("g", 4, 1)], "g string, doc long, words long")
    got = retrieval.assembled(rows, "g", 10, [F.col("doc").alias("o")]).orderBy("citation").collect()
    assert [(r.doc, r.citation, r.total) for r in got] == [(1, 1, 10), (3, 2, 10)]


def test_skills_with_signs_at_their_end(spark):
    assert one(spark, C.skills(F.col("a")), a="C# and C++ services, Next.js") == ["C#", "C++", "Next.js"]


def test_year_month(spark):
    assert [one(spark, T.year_month(F.col("a")), a=x) for x in ("Jan 2023", "Present", "2019", "x")] == [2023 * 12 + 1, 9999 * 12, 2019 * 12 + 6, 0]


def test_upsert_and_jaccard(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, R.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert one(spark, R.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 1 / 3


def test_greedy_algorithms(spark):
    rows = spark.createDataFrame([(1, 1, "abcd"), (1, 2, "abce"), (1, 3, "zzzz")], "p long, i long, t string")
    assert {r.i: r.cluster for r in O.greedy_clusters(rows, "p", "i", "t", 0.7).collect()} == {1: 1, 2: 1, 3: 3}
    pairs = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.95), (1, "b", "y", 0.94), (1, "b", "x", 0.5)], "c long, l string, r string, s double")
    assert sorted((r.l, r.r) for r in O.greedy_matches(pairs, "c", "l", "r", "s", 0.4).collect()) == [("a", "y"), ("b", "x")]


def test_entry_works_without_the_subpackage(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20


def test_stream_chunks_each_document_once(spark, tmp_path):
    from attestry.streaming.intake import chunk_stream

    text = " ".join(["One two three four five."] * 5)
    for k in range(2):
        spark.createDataFrame([(k, text)], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/in")
        chunk_stream(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(*map(str, (tmp_path / "out").glob("epoch=*")))
    assert sorted(r[0] for r in got.groupBy("doc_id").count().filter("count = 2").collect()) == [0, 1]


def test_document_intake(spark, tmp_path):
    from attestry.sources import documents as D

    (tmp_path / "a b.txt").write_bytes(b"caf\xc3\xa9 \xff end")
    (tmp_path / "x.exe").write_bytes(b"no")
    got = D.read_texts(spark, str(tmp_path)).collect()
    assert [(r.name, r.media_type, r.text) for r in got] == [("a_b.txt", "text/plain", "café  end")]
    (tmp_path / "gold.csv").write_bytes(b'\xef\xbb\xbfid,skills\n1,"[""a"",\n""b""]"\n')
    gold = D.read_gold(spark, str(tmp_path / "gold.csv"))
    assert gold.columns == ["id", "skills"] and gold.first().skills == '["a",\n"b"]'


def test_docx_reports_and_jobs(spark, tmp_path):
    import zipfile

    from attestry.sources import documents as D

    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    files = tmp_path / "files"
    files.mkdir()
    with zipfile.ZipFile(files / "cv.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>Sample</w:t><w:tab/><w:t>Person</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Engineer</w:t></w:r></w:p></w:body></w:document>')
    (files / "broken.docx").write_bytes(b"no zip")
    (files / "job.txt").write_bytes(b"Wanted: \xff an engineer")
    (files / "blank.md").write_bytes(b" \n")
    (files / "scan.pdf").write_bytes(b"%PDF-1.4")
    (files / "page.html").write_bytes(b"<p>x</p>")
    got = {r.name: r.text for r in D.read_texts(spark, str(files)).collect()}
    assert got == {"cv.docx": "Sample\tPerson\n\nEngineer", "broken.docx": "", "job.txt": "Wanted:  an engineer", "blank.md": " \n"}
    assert {r.name for r in D.read_job(spark, str(files)).collect()} == {"cv.docx", "job.txt"}
    path = D.save_report(spark.createDataFrame([("r1", 0.5)], "case string, score double"), str(tmp_path / "reports"), "20240101T000000Z", "auto")
    assert D.load_report(spark, str(tmp_path / "reports")).first().asDict() == {"case": "r1", "score": 0.5, "saved_report_path": path}
