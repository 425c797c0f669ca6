"""Registered queries of search, contexts of its list, and the chunkers of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import chunking, search
from attestry.plans.catalog import register
from attestry.sources.tables import table

#: Literal rows, since the test tables hold no such words: id, document, profile, file, place, time, text.
CHUNKS = """(VALUES
 ('c01', 'd1', 'p1', 'a.txt', 0, TIMESTAMP '2024-01-01 00:00:00', 'Built ML pipelines with SQL and Python for 40 teams'),
 ('c02', 'd1', 'p1', 'a.txt', 1, TIMESTAMP '2024-01-01 00:00:00', 'Machine learning models were trained on structured query language dumps'),
 ('c03', 'd1', 'p1', 'a.txt', 2, TIMESTAMP '2024-01-01 00:00:00', 'Gardening, cooking and long walks by the sea'),
 ('c04', 'd2', 'p1', 'b.txt', 0, TIMESTAMP '2023-05-01 00:00:00', 'SQL, SQL and more SQL - a reporting tool'),
 ('c05', 'd2', 'p1', 'b.txt', 1, TIMESTAMP '2023-05-01 00:00:00', 'Designed an ML course; learning goals and a machine to grade it'),
 ('c06', 'd3', 'p2', 'c.txt', 0, TIMESTAMP '2024-03-01 00:00:00', 'The query planner of a database was optimized by 35 percent'),
 ('c07', 'd3', 'p2', 'c.txt', 1, TIMESTAMP '2024-03-01 00:00:00', 'Led a team that delivered ml features over plain sql views every week of the year'),
 ('c08', 'd4', 'p2', 'd.txt', 0, TIMESTAMP '2022-01-01 00:00:00', 'Structured notes, no code'),
 ('c09', 'd4', 'p2', 'd.txt', 1, TIMESTAMP '2022-01-01 00:00:00', 'sql ml sql ml'),
 ('c10', 'd5', 'p3', 'e.txt', 0, TIMESTAMP '2021-01-01 00:00:00', 'Learning Spanish')
) AS c(id, document_id, profile_id, filename, chunk_index, created_at, text)"""
VERBS = "['built','developed','implemented','designed','launched','optimized','created','automated','deployed','improved','managed','integrated','trained','fine-tuned','led','delivered']"


def _chunks(spark):
    return spark.sql(f"SELECT * FROM {CHUNKS}")


def _search_sql(variants: list[list[str]], a: str, b: str, k: int, where: str = "true", focus: str = "[]", cross: str = "") -> str:
    """Search without vectors for a query of the two tokens a and b."""
    listed = ", ".join(f"({n}, '{t}')" for n, v in enumerate(variants) for t in v)
    final = "SELECT *, 0 AS stage FROM blended"
    if cross:
        final = f"SELECT * REPLACE (CASE WHEN r <= {max(3 * k, 12)} THEN round(0.6::DOUBLE / (1 + exp(-({cross}))) + 0.4::DOUBLE * score, 6) ELSE score END AS score), CASE WHEN r <= {max(3 * k, 12)} THEN 0 ELSE 1 END AS stage FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM blended)"
    return f"""
    WITH corpus AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9+#._-]+') AS t FROM {CHUNKS} WHERE {where}),
    size AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(t)), 1) AS avgdl FROM corpus),
    term(variant, term) AS (VALUES {listed}),
    tf AS (SELECT variant, term, id, len(t)::DOUBLE AS dl, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM corpus, term),
    df AS (SELECT variant, term, count(*)::DOUBLE AS df FROM tf WHERE tf > 0 GROUP BY ALL),
    bm AS (SELECT variant, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS s FROM tf JOIN df USING (variant, term), size WHERE tf > 0 GROUP BY ALL),
    best AS (SELECT id, max(s) AS s FROM bm WHERE s > 0 GROUP BY id ORDER BY s DESC, id LIMIT 20),
    range AS (SELECT min(s) AS lo, greatest(max(s) - min(s), 1e-9) AS spread FROM best),
    cand AS (SELECT c.id, c.text, c.t, s AS score, round((s - lo) / spread, 4) AS lexical, round(s, 6) AS rrf FROM best JOIN corpus c USING (id), range ORDER BY s DESC, id LIMIT 16),
    pos AS (SELECT id, unnest(t) AS tk, generate_subscripts(t, 1) AS i FROM cand),
    span AS (SELECT x.id, min(abs(x.i - y.i)) AS span FROM pos x JOIN pos y ON x.id = y.id AND x.tk = '{a}' AND y.tk = '{b}' GROUP BY x.id),
    sig AS (SELECT cand.*, list_contains(t, '{a}')::INT + list_contains(t, '{b}')::INT AS m, span,
      round(5.0::DOUBLE * (list_contains(t, '{a}')::INT + list_contains(t, '{b}')::INT) / 2 + ln(1 + (length(text) - length(replace(lower(text), '{a}', ''))) / length('{a}') + (length(text) - length(replace(lower(text), '{b}', ''))) / length('{b}')), 6) AS keyword
      FROM cand LEFT JOIN span USING (id)),
    prox AS (SELECT *, round(CASE WHEN m = 0 THEN 0 WHEN m = 1 THEN 2.0 ELSE 4.0::DOUBLE + 1.0::DOUBLE / (1 + span) + CASE WHEN span <= 20 THEN 1.5 ELSE 0 END END, 6) AS proximity FROM sig),
    mm AS (SELECT min(keyword) AS k0, max(keyword) AS k1, min(proximity) AS p0, max(proximity) AS p1 FROM prox),
    blended AS (SELECT id, text, lexical, rrf, keyword, proximity,
      round(0.7::DOUBLE * (0.6::DOUBLE * CASE WHEN k1 - k0 < 1e-9 THEN CASE WHEN k1 < 1e-9 THEN 0 ELSE 1 END ELSE (keyword - k0) / (k1 - k0) END + 0.4::DOUBLE * CASE WHEN p1 - p0 < 1e-9 THEN CASE WHEN p1 < 1e-9 THEN 0 ELSE 1 END ELSE (proximity - p0) / (p1 - p0) END) + 0.3::DOUBLE * score, 6) AS score,
      CASE WHEN len({focus}) = 0 THEN 0.0 ELSE round(1.2::DOUBLE * len(list_filter({VERBS}, lambda v: contains(lower(text), v))) + 0.8::DOUBLE * regexp_matches(text, '[0-9]')::INT + 0.4::DOUBLE * (contains(text, '-') OR contains(text, '*'))::INT + 0.9::DOUBLE * len(list_filter({focus}, lambda f: list_contains(t, f))), 4) END AS structural
      FROM prox, mm)
    SELECT id, score, lexical, 0.5::DOUBLE AS semantic, structural::DOUBLE AS structural, rrf, keyword, proximity FROM ({final}) WHERE score > 0 ORDER BY stage, score DESC, id LIMIT {k}"""


@register("search_expanded", _search_sql([["sql", "ml"], ["structured", "query", "language", "machine", "learning"]], "sql", "ml", 6))
def search_expanded(spark, sf_dir):
    return search.search(_chunks(spark), "SQL ML", 6)


@register("search_scoped", _search_sql([["sql", "ml"]], "sql", "ml", 5, "profile_id = 'p2'"))
def search_scoped(spark, sf_dir):
    return search.search(_chunks(spark), "SQL ML", 5, expand=False, profile_id="p2", document_id=None)


@register("search_claim_context", _search_sql([["machine", "learning"]], "machine", "learning", 4, "document_id = 'd1'", "['machine','learning','learning']"))
def search_claim_context(spark, sf_dir):
    return search.claim_context(_chunks(spark), "d1", 4, ["machine", "learning", "learning"])


@register("cross_encoder_blend", _search_sql([["sql", "ml"]], "sql", "ml", 3, "profile_id IN ('p1', 'p2')", cross="length(text) / 20.0::DOUBLE - 2"))
def cross_encoder_blend(spark, sf_dir):
    return search.search(_chunks(spark).filter("profile_id IN ('p1', 'p2')"), "sql ml", 3, expand=False, cross=lambda query, text: F.length(text) / 20.0 - 2)


@register("cosine_unit", "SELECT vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) + 1) / 2)), 4) AS similarity FROM embeddings")
def cosine_unit(spark, sf_dir):
    from attestry.operators import retrieval

    v = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_scores(v, v.filter("vec_id = 0")).select(F.col("doc").alias("vec_id"), F.round(search.unit(F.col("score")), 4).alias("similarity"))


@register("structural_score", f"SELECT id, round(1.2::DOUBLE * len(list_filter({VERBS}, lambda v: contains(lower(text), v))) + 0.8::DOUBLE * regexp_matches(text, '[0-9]')::INT + 0.4::DOUBLE * regexp_matches(text, '[*-]')::INT + 0.9::DOUBLE * len(list_filter(['sql','team'], lambda f: list_contains(regexp_extract_all(lower(text), '[a-z0-9+#._-]+'), f))), 4) AS score FROM {CHUNKS}")
def structural_score(spark, sf_dir):
    return _chunks(spark).select("id", F.round(search.structural(F.col("text"), ["sql", "team"]), 4).alias("score"))


#: A retrieved list in which a chunk comes twice.
RESULTS = """(VALUES ('c01', 0.9::DOUBLE), ('c07', 0.8::DOUBLE), ('c01', 0.4::DOUBLE), ('c04', 0.7::DOUBLE), ('c06', 0.6::DOUBLE), ('c05', 0.5::DOUBLE), ('c03', 0.3::DOUBLE), ('c09', 0.2::DOUBLE)) AS r(id, score)"""


def _results(spark):
    listed = spark.sql("SELECT * FROM " + RESULTS.replace("::DOUBLE", "D"))
    return listed.join(_chunks(spark), "id").select("id", "score", "text", "filename", "chunk_index", "created_at")


def _context_sql(order: str, budget: int) -> str:
    return f"""
    WITH RECURSIVE once AS (SELECT id, max(score) AS score FROM {RESULTS} GROUP BY id),
    ranked AS (SELECT o.*, c.* EXCLUDE (id), len(regexp_extract_all(text, '\\S+'))::BIGINT AS w, row_number() OVER (ORDER BY score DESC, o.id) AS rk, count(*) OVER () AS n FROM once o JOIN {CHUNKS} ON c.id = o.id),
    placed AS (SELECT *, row_number() OVER (ORDER BY {order}) AS r FROM ranked),
    f AS (SELECT r, id, w <= {budget} AS kept, CASE WHEN w <= {budget} THEN w ELSE 0 END AS total FROM placed WHERE r = 1
      UNION ALL SELECT p.r, p.id, f.total + p.w <= {budget}, CASE WHEN f.total + p.w <= {budget} THEN f.total + p.w ELSE f.total END FROM f JOIN placed p ON p.r = f.r + 1),
    k AS (SELECT f.id, f.r, row_number() OVER (ORDER BY f.r) AS citation FROM f WHERE kept)
    SELECT citation, k.id AS id, repeat('─', 64) || chr(10) || '[' || citation || '] ' || filename || ' | chunk ' || chunk_index || ' | score ' || format('{{:.4f}}', score) || chr(10) || text AS block, (SELECT max(total) FROM f)::BIGINT AS total, (n - count(*) OVER ())::BIGINT AS dropped, n - count(*) OVER () > 0 AS truncated FROM k JOIN placed USING (id)"""


@register("assemble_context_mixed", _context_sql("CASE WHEN rk <= n // 2 THEN rk ELSE 1000 END, CASE WHEN rk <= n // 2 THEN NULL ELSE created_at END, chunk_index, id", 40))
def assemble_context_mixed(spark, sf_dir):
    return search.context(_results(spark), 40, "mixed")


@register("context_blocks", _context_sql("score DESC, id", 45))
def context_blocks(spark, sf_dir):
    return search.context(_results(spark), 45)


@register("context_by_document", _context_sql("created_at, chunk_index, id", 1000))
def context_by_document(spark, sf_dir):
    return search.context(_results(spark), 1000, "document")


#: Text of several paragraphs: the turns of a conversation, parted by blank lines.
_LONG = "(SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id)"


def _long(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return turns.select("conv_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("body"))


@register("paragraph_split", rf"SELECT conv_id, k - 1 AS at, sha256(p[k]) AS part FROM (SELECT conv_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(body, '\n\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM {_LONG}))")
def paragraph_split(spark, sf_dir):
    return _long(spark, sf_dir).select("conv_id", F.posexplode(chunking.paragraphs(F.col("body"))).alias("at", "part")).select("conv_id", F.col("at").cast("long").alias("at"), F.sha2(F.col("part").cast("binary"), 256).alias("part"))


_LINES = r"SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS line FROM documents"


@register(
    "sentence_units",
    rf"""WITH u AS (SELECT doc_id, unnest(CASE WHEN len(regexp_extract_all(line, '\S+')) <= 30 THEN [line] ELSE list_filter(regexp_split_to_array(regexp_replace(line, '([.!?])\s+([A-ZÀ-ɏḀ-ỿ"''(])', '\1' || chr(10) || '\2', 'g'), '\n'), lambda x: trim(x) <> '') END) AS unit FROM ({_LINES}))
    SELECT doc_id, count(*) AS n_units, sum(length(unit))::BIGINT AS n_signs, max(len(regexp_extract_all(unit, '\S+')))::BIGINT AS longest FROM u GROUP BY doc_id""",
)
def sentence_units(spark, sf_dir):
    """Sentences of one letter would be cut by the SQL once only; the tables hold none."""
    units = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.units(F.col("text"))).alias("unit"))
    return units.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(F.length("unit")).alias("n_signs"), F.max(T.word_count(F.col("unit"))).alias("longest"))


HEADINGS = """(VALUES (1, 'EXPERIENCE'), (2, 'My Technical Skills:'), (3, '  about  '), (4, 'Selected Projects & More'), (5, 'HELLO WORLD'), (6, 'HELLO. WORLD'), (7, 'just a line of text'), (8, '1234'), (9, 'Open Source'), (10, 'work'), (11, 'ONE TWO THREE FOUR FIVE SIX'), (12, 'Professional certifications and awards'), (13, 'Schooling'), (14, 'Tools and Technologies'), (15, 'Career'), (16, 'Publications')) AS h(id, line)"""


@register(
    "heading_classify",
    f"""SELECT id, CASE WHEN p IN ('about') THEN 'summary' WHEN contains(p, 'technical skills') OR contains(p, 'tools and technologies') THEN 'skills' WHEN p IN ('experience', 'work', 'career') THEN 'work_experience'
    WHEN p = 'schooling' THEN 'education' WHEN contains(p, 'selected projects') OR contains(p, 'open source') THEN 'projects' WHEN contains(p, 'professional certifications') THEN 'certifications' WHEN p = 'publications' THEN 'achievements'
    WHEN regexp_matches(line, '^[A-Z ]+$') AND len(string_split(line, ' ')) <= 5 THEN 'unknown_section' END AS section
    FROM (SELECT id, line, lower(trim(regexp_replace(regexp_replace(line, '[^a-zA-Z ]+', ' ', 'g'), ' +', ' ', 'g'))) AS p FROM {HEADINGS})""",
)
def heading_classify(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {HEADINGS}").select("id", chunking.heading(F.col("line")).alias("section"))


#: One text whose parts are known by their numbers of words: a preamble, a heading, a paragraph beyond the budget, and one within it.
_BODY = "concat('Intro line of five words.', chr(10), chr(10), 'EDUCATION', chr(10), chr(10), repeat('One two three four five. ', 30), chr(10), chr(10), 'A last short paragraph of seven words.')"


@register(
    "chunk_multi",
    """WITH p AS (SELECT 5 AS intro, 1 AS head, 150 AS long, 7 AS tail)
    -- 100 words a chunk: the intro and the heading; the heading is carried to the first 100 words of the long paragraph, those to its last 50, and those to the tail.
    SELECT 0::BIGINT AS chunk_index, (intro + head)::BIGINT AS n_words, 'paragraph' AS strategy, NULL::VARCHAR AS section FROM p
    UNION ALL SELECT 1, head + 100, 'paragraph', NULL FROM p
    UNION ALL SELECT 2, long, 'paragraph', NULL FROM p
    UNION ALL SELECT 3, long - 100 + tail, 'paragraph', NULL FROM p
    -- Windows of three units, two apart: the first has the intro, the heading and a sentence; of the equal ones of three sentences one stays; the last has the tail.
    UNION ALL SELECT 4, intro + head + 5, 'sentence_window', NULL FROM p
    UNION ALL SELECT 5, 3 * 5, 'sentence_window', NULL FROM p
    UNION ALL SELECT 6, 2 * 5 + tail, 'sentence_window', NULL FROM p
    UNION ALL SELECT 7, intro, 'section', 'preamble' FROM p
    UNION ALL SELECT 8, long + tail, 'section', 'education' FROM p""",
)
def chunk_multi(spark, sf_dir):
    rows = spark.sql(f"SELECT {_BODY.replace('chr(10)', 'char(10)')} AS body")
    found = chunking.document_chunks(rows, "body", chars=550, overlap=1)
    return found.select("chunk_index", T.word_count(F.col("chunk")).alias("n_words"), "strategy", "section")
