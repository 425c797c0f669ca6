"""Search from a query's text to a short ranked list, and contexts made of that list.

A query has one or two variants (as given, and with abbreviations written out).
Every variant is scored by BM25 over the scope, a chunk keeps its best score,
and the list is fused by rank with the vectors' list where there is one. All
later signals see the fused list only, whose length is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import claims, profiles, retrieval

#: Of the fetched list, and of the reranked one.
FETCH, RERANK = 20, 8


def variants(query: str) -> list[str]:
    """The query, and its form with all abbreviations written out where that differs."""
    out = reduce(lambda q, e: re.sub(rf"\b{re.escape(e[0])}\b", e[1], q, flags=re.IGNORECASE), profiles.EXPANSIONS.items(), query)
    return [query] if out.strip().lower() == query.strip().lower() else [query, out]


def terms(query: str) -> list[str]:
    """The different tokens of a query."""
    return sorted(set(re.findall(T.TOKEN, query.lower())))


def scoped(chunks: DataFrame, **scope) -> DataFrame:
    """The chunks whose columns have the given values; a value of None doesn't restrict."""
    return reduce(lambda df, e: df if e[1] is None else df.filter(F.col(e[0]) == F.lit(e[1])), scope.items(), chunks)


def lexical(chunks: DataFrame, queries: list[str], fetch: int, doc: str = "id", body: str = "text") -> DataFrame:
    """(doc, score): the best BM25 score of any variant, of the ``fetch`` best chunks; each variant brings twice as many."""
    asked = [t for q in queries if (t := terms(q))]
    if not asked:
        return chunks.select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    scored = retrieval.bm25_by_variant(chunks, asked, doc, body).filter("score > 0")
    listed = scored.withColumn("rank", F.row_number().over(W.partitionBy("variant").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= 2 * fetch)
    return retrieval.top(listed.groupBy("doc").agg(F.max("score").alias("score")), fetch)


def structural(body: Column, focus: list[str]) -> Column:
    """1.2 for each verb of action that occurs, 0.8 for a digit, 0.4 for a list or several lines, 0.9 for each focus token; repeats in the focus count."""
    low, tok = F.lower(body), T.tokens(body)
    add = lambda condition, x: F.when(condition, x).otherwise(0.0)
    parts = [add(F.contains(low, F.lit(v)), 1.2) for v in claims.ACTIONS] + [add(F.regexp_like(body, F.lit("[0-9]")), 0.8), add(F.regexp_like(body, F.lit(r"[-*\n]")), 0.4)]
    return sum(parts, F.lit(0.0)) + 0.9 * F.size(F.filter(F.array(*[F.lit(t) for t in focus]).cast("array<string>"), lambda t: F.array_contains(tok, t)))


def unit(similarity: Column) -> Column:
    """A cosine from -1..1 on a scale of 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1.0) / 2.0))


def search(
    chunks: DataFrame,
    query: str,
    k: int = 5,
    vectors: DataFrame | None = None,
    query_vector: DataFrame | None = None,
    fetch: int = FETCH,
    rerank: int = RERANK,
    rrf_k: int = 60,
    alpha: float = 0.5,
    expand: bool = True,
    signals: bool = False,
    cross: Callable[[Column, Column], Column] | None = None,
    doc: str = "id",
    body: str = "text",
    **scope,
) -> DataFrame:
    """(id, score, lexical, semantic, structural, rrf, keyword, proximity) of the ``k`` best chunks of a scope.

    Without vectors the BM25 list passes as it is. ``cross`` makes a relevance
    logit of (query, text): the best max(3 k, 12) are scored with it, 60 % beside
    their old score, and stand before the others. Chunks with a score above zero
    are returned; where there are none, the best of the others. Ties go to the
    smaller id. A blank query finds nothing without vectors and is not reranked.
    """
    corpus = scoped(chunks, **scope)
    low = lexical(corpus, variants(query) if expand and query.strip() else [query], fetch, doc, body)
    if vectors is not None and query.strip():
        near = corpus.select(F.col(doc).alias("doc")).join(retrieval.cosine_scores(vectors, query_vector), "doc")
        semantic = retrieval.top(near, fetch)
        fused = retrieval.top(retrieval.reciprocal_ranks(low, semantic, rrf_k, alpha), fetch)
    else:
        semantic, fused = low.limit(0), low
    every = W.partitionBy()  # of short lists
    scaled = low.withColumn("part", F.round((F.col("score") - F.min("score").over(every)) / F.greatest(F.max("score").over(every) - F.min("score").over(every), F.lit(1e-9)), 4)).select("doc", F.col("part").alias("lexical"))
    floor = low.agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("least"), F.greatest(F.coalesce(F.max("score") - F.min("score"), F.lit(1.0)), F.lit(1e-9)).alias("spread"))
    found = fused.join(F.broadcast(scaled), "doc", "left").join(F.broadcast(semantic.select("doc", F.col("score").alias("cosine"))), "doc", "left").crossJoin(F.broadcast(floor))
    found = found.withColumns({"lexical": F.coalesce("lexical", F.round(-F.col("least") / F.col("spread"), 4)), "semantic": F.round(unit(F.coalesce("cosine", F.lit(0.0))), 4), "rrf": F.round("score", 6)}).drop("cosine", "least", "spread")
    listed = corpus.select(F.col(doc).alias("doc"), F.col(body).alias("body")).join(F.broadcast(found), "doc")
    asked = terms(query)
    focus = re.findall(T.TOKEN, query.lower()) if signals else []
    listed = listed.withColumn("structural", F.round(structural(F.col("body"), focus), 4) if focus else F.lit(0.0))
    best = retrieval.top(listed, max(2 * rerank, 2 * k)).withColumns({"keyword": F.lit(0.0), "proximity": F.lit(0.0)})
    if query.strip():
        seen = best.withColumns({"keyword": F.round(retrieval.keyword_overlap(F.col("body"), asked), 6) if asked else F.lit(0.0), "proximity": F.round(retrieval.phrase_proximity(F.col("body"), asked), 6) if asked else F.lit(0.0)})
        best = retrieval.blended(seen)
    best = best.withColumn("stage", F.lit(0))
    if cross is not None and query.strip():
        ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc")))
        chosen = F.col("rank") <= max(3 * k, 12)
        logit = 1 / (1 + F.exp(-cross(F.lit(query), F.col("body"))))
        best = ranked.withColumns({"score": F.when(chosen, F.round(0.6 * logit + 0.4 * F.col("score"), 6)).otherwise(F.col("score")), "stage": F.when(chosen, 0).otherwise(1)})
    kept = best.withColumn("top", F.max("score").over(every)).filter("score > 0 OR top <= 0")
    return kept.orderBy("stage", F.desc("score"), "doc").limit(k).select(F.col("doc").alias(doc), "score", "lexical", "semantic", "structural", "rrf", "keyword", "proximity")


def claim_context(chunks: DataFrame, document, k: int, focus: list[str] = (), **options) -> DataFrame:
    """The chunks of a document that stand nearest to the focus areas, with structural signals."""
    return search(chunks, " ".join(focus), k, signals=True, document_id=document, **options)


def context(results: DataFrame, budget: int = 3500, ordering: str = "score") -> DataFrame:
    """The context made of a retrieved list (id, score, text, filename, chunk_index, created_at): rows (citation, id, block), and in every row total, dropped and truncated.

    Of a chunk that was retrieved twice the better score counts. ``score`` puts
    the best first, ``document`` goes by time and place, ``mixed`` has the better
    half first and the rest by time and place. Chunks that don't fit the budget of
    words are dropped, and later ones are still tried.
    """
    once = results.groupBy("id").agg(F.max_by(F.struct("text", "filename", "chunk_index", "created_at"), "score").alias("c"), F.max("score").alias("score")).select("id", "score", "c.*")
    by_score = W.orderBy(F.desc("score"), "id")  # of a retrieved list, as long as its search allows
    ranked = once.withColumn("rank", F.row_number().over(by_score)).withColumn("n", F.count("*").over(W.partitionBy()))
    late = F.struct("created_at", "chunk_index", "id")
    first = {"score": F.lit(True), "document": F.lit(False), "mixed": F.col("rank") <= F.greatest(F.floor(F.col("n") / 2), F.lit(1))}[ordering]
    order = ranked.withColumn("at", F.row_number().over(W.orderBy(F.desc(first), F.when(first, F.col("rank")), late)))
    words = order.withColumn("words", T.word_count(F.col("text")))
    whole = words.withColumns({"all": F.lit(0), "doc": F.col("id")})
    kept = retrieval.assembled(whole, "all", budget, [F.col("at").alias("o")]).select(F.col("doc").alias("id"), "citation", "total")
    head = F.format_string("[%d] %s | chunk %d | score %.4f", "citation", "filename", "chunk_index", "score")
    line = F.lit("─" * 64)
    block = F.concat_ws("\n", line, head, F.regexp_replace("text", r"^\s+|\s+$", ""))
    joined = words.join(kept, "id")
    return joined.select("citation", "id", block.alias("block"), "total", (F.col("n") - F.count("*").over(W.partitionBy())).alias("dropped")).withColumn("truncated", F.col("dropped") > 0)
