"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import chunking, retrieval
from attestry.plans.catalog import register
from attestry.sources.tables import table

TERMS = ["the", "that", "tion"]

_TOK = "regexp_extract_all(lower(text), '[a-z0-9+#._-]+')"


@register(
    "bm25_topk",
    f"""
    WITH tok AS (SELECT doc_id, {_TOK} AS t FROM documents),
    terms AS (SELECT unnest(['the','that','tion']) AS term),
    corpus AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(t)), 1) AS avgdl FROM tok),
    tf AS (SELECT doc_id, len(t)::DOUBLE AS dl, term, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM tok, terms),
    hit AS (SELECT * FROM tf WHERE tf > 0),
    df AS (SELECT term, count(*)::DOUBLE AS df FROM hit GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM hit JOIN df USING (term), corpus GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20
    """,
)
def bm25_topk(spark, sf_dir):
    return retrieval.top(retrieval.bm25_scores(table(spark, sf_dir, "documents"), TERMS), 20).withColumnRenamed("doc", "doc_id")

_COS = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
cos AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)"""


@register("cosine_topk", _COS + " SELECT doc_id, score FROM cos ORDER BY score DESC, doc_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.top(retrieval.cosine_scores(v, v.filter("vec_id = 0")), 20).withColumnRenamed("doc", "doc_id")


_BM25 = f"""tok AS (SELECT doc_id, {_TOK} AS t FROM documents), corpus AS (SELECT count(*)::DOUBLE AS n, greatest(avg(len(t)), 1) AS avgdl FROM tok),
hit AS (SELECT * FROM (SELECT doc_id, len(t)::DOUBLE AS dl, term, len(list_filter(t, lambda x: x = term))::DOUBLE AS tf FROM tok, (SELECT unnest(['the','that','tion']) AS term)) WHERE tf > 0),
df AS (SELECT term, count(*)::DOUBLE AS df FROM hit GROUP BY term),
bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM hit JOIN df USING (term), corpus GROUP BY doc_id)"""
_RRF = f"""{_COS}, {_BM25},
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 20), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM cos QUALIFY r <= 20),
rrf AS (SELECT doc_id, round(sum(0.5::DOUBLE / (60 + r)), 9) AS score FROM (FROM a UNION ALL FROM b) GROUP BY 1)"""


@register("rrf_fusion", _RRF + " SELECT doc_id, score FROM rrf")
def rrf_fusion(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    lexical = retrieval.top(retrieval.bm25_scores(table(spark, sf_dir, "documents"), TERMS), 20)
    return retrieval.reciprocal_ranks(lexical, retrieval.top(retrieval.cosine_scores(v, v.filter("vec_id = 0")), 20)).withColumnRenamed("doc", "doc_id")


_KW = f"""(5 * len(list_intersect(['the','that','tion'], {_TOK})) / 3.0::DOUBLE + ln(1 + (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'that', ''))) / 4 + (length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4))"""


@register("keyword_overlap", f"SELECT doc_id, round({_KW}, 6) AS score FROM documents")
def keyword_overlap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(retrieval.keyword_overlap(F.col("text"), TERMS), 6).alias("score"))


_PROX = f"""ptok AS (SELECT doc_id, unnest({_TOK}) AS tk, generate_subscripts({_TOK}, 1) AS i FROM documents),
pl AS (SELECT doc_id, tk, i FROM ptok WHERE tk IN ('the','that','tion')), nt AS (SELECT doc_id, count(DISTINCT tk) AS n FROM pl GROUP BY 1),
lasts AS (SELECT doc_id, i, max(i) FILTER (tk = 'the') OVER w AS l1, max(i) FILTER (tk = 'that') OVER w AS l2, max(i) FILTER (tk = 'tion') OVER w AS l3 FROM pl WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (SELECT doc_id, min(i - least(l1, l2, l3)) AS span FROM lasts JOIN nt USING (doc_id) WHERE (l1 IS NOT NULL)::INT + (l2 IS NOT NULL)::INT + (l3 IS NOT NULL)::INT = n GROUP BY 1),
prox AS (SELECT d.doc_id, round(CASE WHEN n IS NULL THEN 0 WHEN n = 1 THEN 4.0::DOUBLE / 3 ELSE 4.0::DOUBLE * n / 3 + 1.0::DOUBLE / (1 + span) + CASE WHEN span <= 20 THEN 1.5 ELSE 0 END END, 6) AS score FROM documents d LEFT JOIN nt USING (doc_id) LEFT JOIN span USING (doc_id))"""


@register("phrase_proximity", f"WITH {_PROX} SELECT doc_id, score FROM prox")
def phrase_proximity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(retrieval.phrase_proximity(F.col("text"), TERMS), 6).alias("score"))


@register(
    "hybrid_search",
    f"""{_RRF}, {_PROX},
    cand AS (SELECT doc_id, score FROM rrf ORDER BY score DESC, doc_id LIMIT 16),
    sig AS (SELECT c.doc_id, c.score, round({_KW}, 6) AS kw, p.score AS pr FROM cand c JOIN documents d USING (doc_id) JOIN prox p USING (doc_id)),
    mm AS (SELECT min(kw) AS k0, max(kw) AS k1, min(pr) AS p0, max(pr) AS p1 FROM sig)
    SELECT doc_id, round(0.7::DOUBLE * (0.6::DOUBLE * CASE WHEN k1 - k0 < 1e-9 THEN CASE WHEN k1 < 1e-9 THEN 0 ELSE 1 END ELSE (kw - k0) / (k1 - k0) END + 0.4::DOUBLE * CASE WHEN p1 - p0 < 1e-9 THEN CASE WHEN p1 < 1e-9 THEN 0 ELSE 1 END ELSE (pr - p0) / (p1 - p0) END) + 0.3::DOUBLE * score, 6) AS score
    FROM sig, mm ORDER BY score DESC, doc_id LIMIT 8""",
)
def hybrid_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return retrieval.hybrid(table(spark, sf_dir, "documents"), v, v.filter("vec_id = 0"), TERMS).select(F.col("doc").alias("doc_id"), "score")


#: Chunks that a context of a source is made of: the first ones by its order.
LISTED = 50


def _context(order_sql: str) -> str:
    """Greedy budget with skipping, as recursion over the order's ranks."""
    return f"""WITH RECURSIVE c AS (SELECT source, doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+'))::BIGINT AS w, row_number() OVER (PARTITION BY source ORDER BY {order_sql}) AS r FROM documents QUALIFY r <= 50),
    f AS (SELECT source, r, doc_id, w <= 800 AS kept, CASE WHEN w <= 800 THEN w ELSE 0 END AS total FROM c WHERE r = 1
      UNION ALL SELECT c.source, c.r, c.doc_id, f.total + c.w <= 800, CASE WHEN f.total + c.w <= 800 THEN f.total + c.w ELSE f.total END FROM f JOIN c ON c.source = f.source AND c.r = f.r + 1),
    t AS (SELECT source, max(total)::BIGINT AS total FROM f GROUP BY 1)
    SELECT source, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY r) AS citation, t.total FROM f JOIN t USING (source) WHERE kept"""


def _chunks(spark, sf_dir, *order):
    """Each source's list, cut to LISTED before its rows are gathered."""
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("doc"), T.word_count(F.col("text")).alias("words"), "n_chars")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(*order))).filter(F.col("rank") <= LISTED)


@register("assemble_context_document", _context("doc_id"))
def assemble_context_document(spark, sf_dir):
    return retrieval.assembled(_chunks(spark, sf_dir, "doc"), "source", 800, [F.col("doc").alias("o")])


@register("assemble_context_score", _context("n_chars DESC, doc_id"))
def assemble_context_score(spark, sf_dir):
    return retrieval.assembled(_chunks(spark, sf_dir, F.desc("n_chars"), "doc"), "source", 800, [(-F.col("n_chars")).alias("o")])


@register(
    "chunk_sentence_window",
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
    i AS (SELECT doc_id, s, unnest(range(0, ceil(len(s) / 2.0)::BIGINT)) AS k FROM s),
    w AS (SELECT doc_id, k AS chunk_index, array_to_string(s[2 * k + 1 : 2 * k + 3], ' ') AS chunk FROM i)
    SELECT doc_id, chunk_index, sha256(chunk) AS chunk FROM w WHERE len(regexp_extract_all(chunk, '[^ \t\n\r\f\x0b]+')) >= 8""",
)
def chunk_sentence_window(spark, sf_dir):
    c = chunking.sentence_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk"))


@register(
    "chunk_budget",
    r"""WITH RECURSIVE e AS (SELECT conv_id, text, len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+'))::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    last AS (SELECT conv_id, max(r) AS m FROM e GROUP BY 1),
    f AS (
      SELECT conv_id, r, CASE WHEN n > 120 THEN [] ELSE [text] END AS open, CASE WHEN n > 120 THEN 0 ELSE n END AS t, CASE WHEN n > 120 THEN [text] END AS done, n AS prev FROM e WHERE r = 1
      UNION ALL
      SELECT e.conv_id, e.r,
        CASE WHEN n > 120 AND len(open) = 0 THEN open WHEN t + n > 120 AND len(open) > 0 THEN [open[-1], text] ELSE list_append(open, text) END,
        CASE WHEN n > 120 AND len(open) = 0 THEN t WHEN t + n > 120 AND len(open) > 0 THEN len(regexp_extract_all(open[-1], '[^ \t\n\r\f\x0b]+')) + n ELSE t + n END,
        CASE WHEN n > 120 AND len(open) = 0 THEN [text] WHEN t + n > 120 AND len(open) > 0 THEN open END, n
      FROM f JOIN e ON e.conv_id = f.conv_id AND e.r = f.r + 1),
    g AS (SELECT conv_id, r::DOUBLE AS o, done AS g FROM f WHERE done IS NOT NULL UNION ALL SELECT conv_id, r + 0.5, open FROM f JOIN last USING (conv_id) WHERE r = m AND len(open) > 0)
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1)::BIGINT AS chunk_index, len(g)::BIGINT AS n_items, sha256(array_to_string(g, chr(10) || chr(10))) AS chunk FROM g""",
)
def chunk_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("items"))
    groups = turns.select("conv_id", F.posexplode(chunking.budget_groups(F.col("items"), 120)).alias("chunk_index", "g"))
    return groups.select("conv_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("g").cast("long").alias("n_items"), F.sha2(F.array_join("g", "\n\n").cast("binary"), 256).alias("chunk"))


RESUMES = r"""(VALUES (1, 'Sample User\nSUMMARY\nBuilds data tools for teams every day\nTechnical Skills:\nPython SQL Docker Kafka Redis\nEDUCATION\nshort one\nINTERESTS NOW\nchess and long walks by the sea'), (2, 'no heading in this text at all')) AS t(id, body)"""


@register(
    "chunk_section",
    f"""WITH l AS (SELECT id, unnest(string_split(replace(body, '\\n', chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(body, '\\n', chr(10)), chr(10)), 1) AS i FROM {RESUMES}),
    n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(line, '[^a-zA-Z ]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS p FROM l),
    h AS (SELECT *, CASE WHEN p = 'summary' THEN 'summary' WHEN p IN ('skills','technical skills') THEN 'skills' WHEN p = 'education' THEN 'education' WHEN line = 'INTERESTS NOW' THEN 'unknown_section' END AS head FROM n),
    s AS (SELECT *, count(head) OVER (PARTITION BY id ORDER BY i) AS part, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY id ORDER BY i), 'preamble') AS section FROM h)
    SELECT id, part, section, string_agg(line, chr(10) ORDER BY i) AS body FROM s WHERE head IS NULL GROUP BY 1, 2, 3 HAVING sum(len(regexp_extract_all(line, '[^ ]+'))) >= 5""",
)
def chunk_section(spark, sf_dir):
    rows = spark.sql(f"SELECT id, replace(body, '\\\\n', '\\n') AS body FROM {RESUMES}")
    return chunking.sections(rows, "id", "body")


@register(
    "embedding_cache",
    f"""WITH t AS (SELECT doc_id, sha256(text) AS checksum, {_TOK} AS t FROM documents), v AS (SELECT doc_id, checksum, list_transform(range(16), lambda k: len(list_filter(t, lambda x: strpos('0123456789abcdef', substr(md5(x), 1, 1)) - 1 = k))::DOUBLE) AS c FROM t),
    n AS (SELECT doc_id, checksum, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM v)
    SELECT doc_id, checksum, CASE WHEN doc_id % 3 = 0 THEN -1.0 ELSE round(CASE WHEN n > 0 THEN c[1] / n ELSE 0 END, 6) END::DOUBLE AS first FROM n""",
)
def embedding_cache(spark, sf_dir):
    """A third of the vectors are stored for the very text, a third for another text, and a third not at all."""
    from attestry.operators import embedding

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = F.sha2(F.col("text").cast("binary"), 256)
    stored = docs.filter("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, known).otherwise(F.lit("another")).alias("checksum"), F.array(F.lit(-1.0)).alias("vector"))
    found = embedding.ensured(stored, docs, key="doc_id")
    return found.select("doc_id", "checksum", F.round(F.get("vector", F.lit(0)), 6).alias("first"))
