"""Lexical, vector and hybrid retrieval as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T

K1, B = 1.5, 0.75


def bm25_by_variant(docs: DataFrame, variants: list[list[str]], doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(variant, doc, score): the score for each list of terms (by its place) of every document that holds one of them.

    A row's term counts and length are all that scoring needs of it, so there is
    no shuffle by document or term: one pass counts documents, lengths and
    document frequencies to a single row, another scores. Lengths average over all
    documents, floored at 1.
    """
    terms = sorted({t for v in variants for t in v})
    often = lambda tok, term: F.size(F.filter(tok, lambda x: x == F.lit(term))).cast("double")
    count = lambda tok: F.struct(F.size(tok).cast("double").alias("len"), F.array(*[often(tok, t) for t in terms]).alias("tf"))
    rows = docs.select(F.col(doc).alias("doc"), T.let(T.tokens(F.col(body)), count).alias("c")).select("doc", "c.len", "c.tf")
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avgdl"), *[F.count_if(F.get("tf", F.lit(k)) > 0).cast("double").alias(f"df{k}") for k in range(len(terms))])

    def part(k: int) -> Column:
        tf = F.get("tf", F.lit(k))
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))).otherwise(0.0)

    at = {t: k for k, t in enumerate(terms)}
    holds = lambda v: F.greatest(*[F.get("tf", F.lit(at[t])) for t in v], F.lit(0.0)) > 0
    scored = F.array(*[F.struct(F.lit(i).alias("variant"), holds(v).alias("holds"), F.round(sum((part(at[t]) for t in sorted(set(v))), F.lit(0.0)), 6).alias("score")) for i, v in enumerate(variants) if v])
    return rows.crossJoin(F.broadcast(stats)).select("doc", F.explode(scored).alias("s")).filter("s.holds").select("s.variant", "doc", "s.score")


def bm25_scores(docs: DataFrame, terms: list[str], doc: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, score) of every document that holds a query term."""
    return bm25_by_variant(docs, [terms], doc, body).drop("variant")


def top(scored: DataFrame, k: int, key: str = "doc") -> DataFrame:
    """The k best rows; ties go to the smaller key."""
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def cosine(a, b):
    """Cosine of two arrays in double precision; 0 for empty or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(F.lit(0.0))


def cosine_scores(vectors: DataFrame, query: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Score of every vector against the query's, a table of one row."""
    one = F.broadcast(query.select(F.col(vec).alias("query")).limit(1))
    return vectors.crossJoin(one).select(F.col(key).alias("doc"), F.round(cosine(F.col(vec), F.col("query")), 6).alias("score"))


def reciprocal_ranks(lexical: DataFrame, semantic: DataFrame, k: int = 60, alpha: float = 0.5) -> DataFrame:
    """Fused score of two short ranked lists (key, score): each rank counts 1 / (k + rank)."""
    part = lambda df, weight: df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc"))).select("doc", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
    return part(lexical, 1 - alpha).unionByName(part(semantic, alpha)).groupBy("doc").agg(F.round(F.sum("part"), 9).alias("score"))


def keyword_overlap(body, terms: list[str]):
    """5 x share of the terms among the tokens + ln(1 + occurrences as substrings)."""
    wanted = F.array(*[F.lit(t) for t in terms])
    low = F.lower(body)
    share = F.size(F.array_intersect(wanted, T.tokens(body))) / len(terms)
    often = sum((((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)) for t in terms), F.lit(0.0))
    return 5.0 * share + F.log1p(often)


def phrase_proximity(body, terms: list[str], window: int = 20):
    """4 x share of the terms that occur + 1 / (1 + span) + 1.5 for a span within the window; span: the least stretch that holds all terms that occur."""
    wanted = F.array(*[F.lit(t) for t in terms])

    def step(s, x):
        last = F.transform(s["last"], lambda p, i: F.when(i + 1 == x["term"], x["at"]).otherwise(p))
        low = F.array_min(last)
        return F.struct(last.alias("last"), F.when(low >= 0, F.least(s["span"], x["at"] - low)).otherwise(s["span"]).alias("span"))

    def scored(places, found):
        # Only places of terms enter the fold. It keeps the last place of each term that occurs; where all are known, a stretch ends here and begins at the least of them.
        start = F.struct(F.transform(found, lambda t: F.lit(-1)).alias("last"), F.lit(1 << 30).alias("span"))
        n = F.size(found)
        span = F.aggregate(places, start, step, lambda s: s["span"])
        share = 4.0 * n / len(terms)
        return F.when(n == 0, 0.0).when(n == 1, share).otherwise(T.let(span, lambda w: share + 1 / (1 + w) + F.when(w <= window, 1.5).otherwise(0.0)))

    def placed(tok):
        places = lambda found: F.filter(F.transform(tok, lambda x, i: F.struct(F.array_position(found, x).cast("int").alias("term"), i.alias("at"))), lambda x: x["term"] > 0)
        return T.let(F.array_intersect(wanted, tok), lambda found: T.let(places(found), lambda p: scored(p, found)))

    return T.let(T.tokens(body), placed)


def blended(scored: DataFrame) -> DataFrame:
    """Rerank a short list (doc, score, keyword, proximity): both signals scaled to 0..1, 60 % and 40 %; that counts 70 % beside the old score."""
    every = W.partitionBy()

    def scaled(c: str):
        low, high = F.min(c).over(every), F.max(c).over(every)
        return F.when(high - low < 1e-9, F.when(high < 1e-9, 0.0).otherwise(1.0)).otherwise((F.col(c) - low) / (high - low))

    both = 0.6 * scaled("keyword") + 0.4 * scaled("proximity")
    return scored.withColumn("score", F.round(0.7 * both + 0.3 * F.col("score"), 6))


def hybrid(docs: DataFrame, vectors: DataFrame, query: DataFrame, terms: list[str], fetch: int = 20, k: int = 8) -> DataFrame:
    """BM25 and cosine lists, fused by rank, reranked by keywords and proximity; the expensive signals see the fused list only."""
    lexical = top(bm25_scores(docs, terms), fetch)
    semantic = top(cosine_scores(vectors, query), fetch)
    fused = top(reciprocal_ranks(lexical, semantic), 2 * k)
    text = docs.join(F.broadcast(fused), docs["doc_id"] == fused["doc"]).select("doc", "score", F.round(keyword_overlap(F.col("text"), terms), 6).alias("keyword"), F.round(phrase_proximity(F.col("text"), terms), 6).alias("proximity"))
    return top(blended(text), k)


def assembled(chunks: DataFrame, group: str, budget: int, order: list) -> DataFrame:
    """(group, doc, citation, total): chunks in order while they fit the budget of words; one that doesn't is skipped and later ones are still tried.

    Skipping makes this no running sum; the state is folded over one group's
    (doc, words) pairs, without the texts.
    """
    ranked = chunks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("doc"), F.col("words")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{dict(chunks.dtypes)['doc']}>").alias("kept"))

    def step(s, x):
        fits = s["total"] + x["words"] <= budget
        return F.when(fits, F.struct((s["total"] + x["words"]).alias("total"), F.concat(s["kept"], F.array(x["doc"])).alias("kept"))).otherwise(s)

    folded = ranked.select(group, F.aggregate("l", start, step).alias("s"))
    return folded.select(group, F.col("s.total").alias("total"), F.posexplode("s.kept").alias("pos", "doc")).select(group, "doc", (F.col("pos") + 1).cast("long").alias("citation"), "total")
