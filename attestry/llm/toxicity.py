"""Toxic passages by maximum-scoring segment search.

Every token's score is its log-odds: how much likelier toxic than other
documents hold it, under Dirichlet priors that follow the token's document
frequency in the whole corpus and the sizes of the classes, so that a token
without evidence is at zero. The log-odds are drawn toward zero by ``ERRORS``
standard errors, and every token costs ``DRIFT`` besides, which makes sequences
without evidence fall. Tokens are words, and for words that fewer than two of
the sample's texts hold their first ``STEM`` bytes, which are learnt from such
words alone. In the sequence of all tokens a
linear-time scan finds all maximal scoring segments. A segment's score S is
calibrated as an extreme value: by chance, a text of n words holds
K n exp(-lambda S) segments as good, where lambda makes the scores of clean text
a martingale and K is fitted to clean documents. A document's segments are
aggregated (best, sum of the significant, number, total) and a logistic
regression turns that into a probability.

Fitting uses at most ``TRAIN_ROWS`` labelled rows that are not held out, and of
those for the calibration ``TRAIN_BYTES`` of text; the priors count all
documents. What is broadcast are the tokens that two of the sample's texts hold.
Scores are multiples of 2 ** -16: their sums are exact, so results don't depend
on partitions or batches.

Defined results: null and empty texts have no segments and score as the
regression scores none; whole texts are scanned; without labels, or with one
class, all documents get the (smoothed) share of the class; of several texts of
an id the least is learnt from; repeated rows score alike; further columns pass
through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import labelled, textbuf
from attestry.llm.shared import column, give_back, ship, text_map

TRAIN_ROWS, TRAIN_BYTES = 20_000, 256 << 20
STEM = 4
#: What every token costs: passages of interest hold a toxic token in twenty.
DRIFT = math.log(1 - 0.05)
#: Log-odds are drawn to zero by so many standard errors and by MARGIN (a factor of two, as ordinary words of a language or topic have that toxic texts prefer).
ERRORS, MARGIN = 2.0, math.log(2)
#: The weight of the prior in documents, and what every token has beside it.
PRIOR, FLOOR = 20.0, 1.0
SIGNIFICANT = 0.05
THRESHOLD = 0.5
INSIDE = textbuf.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
KIND = "struct<score:double,segments:array<struct<start:long,stop:long,score:double,p_value:double>>>"


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different words, of their stems (0 for shorter words), the word at each place, where each text's places begin)."""
    start, words = textbuf.word_values(raw, offsets, INSIDE, textbuf.ascii_lower())
    body, edges, at = textbuf.different(words)
    _, _, word, stem = textbuf.words(body, edges, np.ones(256, bool), None, STEM)
    return word, stem, at, np.searchsorted(start, offsets)


def _among(token: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each token is one of the sorted ``known``."""
    return known[np.searchsorted(known, token).clip(max=len(known) - 1)] == token if len(known) else np.zeros(len(token), bool)


def token_counts(texts: DataFrame, classes: list[str], words: np.ndarray | None = None, only: np.ndarray | None = None) -> DataFrame:
    """(token, one column for each class): in how many texts of the class a token occurs.

    Tokens are hashes of words; given the known ``words``, also the stems of the
    other words. With ``only`` no other tokens count. Token 0 has the number of
    texts.
    """
    ship(texts.sparkSession)
    held = texts.sparkSession.sparkContext.broadcast((words, only))
    kind = pa.schema([("token", pa.int64()), *[(c, pa.int64()) for c in classes]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, only = held.value
        for batch in batches:
            raw, offsets = textbuf.buffers(batch.column(0))
            weights = [batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(classes))]
            for i, j in textbuf.doc_groups(offsets):
                n = j - i
                word, stem, at, first = _tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rare = (stem != 0) & ~_among(word, words) if words is not None else np.zeros(len(word), bool)
                ids = np.unique(np.concatenate([word, stem[rare]])) if only is None else only
                # Of every text each word once, and of these the stems once.
                which, where = np.divmod(np.unique(at.astype(np.int64) * n + np.repeat(np.arange(n), np.diff(first))), n)
                known, less = _among(word, ids)[which], (rare & _among(stem, ids))[which]
                stems = np.unique(np.searchsorted(ids, stem)[which[less]] * n + where[less])
                at, where = np.concatenate([np.searchsorted(ids, word)[which[known]], stems // n]), np.concatenate([where[known], stems % n])
                sums = [np.bincount(at, w[i:j][where], len(ids)).astype(np.int64) for w in weights]
                on = np.flatnonzero(np.any(sums, axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[on].view(np.int64), 0)), *[pa.array(np.append(s[on], w[i:j].sum())) for s, w in zip(sums, weights, strict=True)]], schema=kind)

    return texts.mapInArrow(count, ", ".join(f"{x} long" for x in kind.names)).groupBy("token").agg(*[F.sum(c).alias(c) for c in classes])


def segments(places: list[int], left: list[float], right: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) of a sequence, in one pass.

    Given are the places of its positive scores, and the sums of all scores
    before and through each. ``lower`` says of every open candidate which earlier
    one is the last that begins lower; the search for it follows these links, and
    no link is followed twice, so the time is linear. Where none begins lower,
    the open candidates are final.
    """
    out: list[tuple[int, int, float]] = []
    begins: list[float] = []
    ends: list[float] = []
    spans: list[tuple[int, int]] = []
    lower: list[int] = []
    for place, low, high in zip(places, left, right, strict=True):
        start, k = place, len(begins) - 1
        while True:
            while k >= 0 and begins[k] >= low:
                k = lower[k]
            if k < 0 or ends[k] >= high:
                break
            # Together they are one candidate, and what lies between goes into it.
            low, start = begins[k], spans[k][0]
            del begins[k:], ends[k:], spans[k:]
            k = lower[k]
            del lower[len(begins) :]
        if k < 0:
            out += [(s, e, b - a) for a, b, (s, e) in zip(begins, ends, spans, strict=True)]
            begins, ends, spans, lower = [], [], [], []
        begins.append(low)
        ends.append(high)
        spans.append((start, place + 1))
        lower.append(k)
    return out + [(s, e, b - a) for a, b, (s, e) in zip(begins, ends, spans, strict=True)]


def log_odds(toxic: np.ndarray, other: np.ndarray, seen: np.ndarray, n_toxic: int, n_other: int, n_seen: int) -> np.ndarray:
    """Scores of tokens in so many texts of either class and so many of the corpus, out of so many texts."""
    share = n_toxic / (n_toxic + n_other)
    prior, whole = PRIOR * seen / max(1, n_seen) + FLOOR, PRIOR + 2 * FLOOR
    a, b = toxic + prior * share, other + prior * (1 - share)
    odds = np.log(a / (n_toxic + whole * share - a)) - np.log(b / (n_other + whole * (1 - share) - b))
    return labelled.grid(np.sign(odds) * np.maximum(0, np.abs(odds) - MARGIN - ERRORS * np.sqrt(1 / a + 1 / b)) + DRIFT)


@dataclass
class Model:
    #: Hashes of tokens in order, and their scores.
    token: np.ndarray
    score: np.ndarray
    decay: float
    scale: float
    weights: np.ndarray

    def values(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """The score of each word."""
        value = np.full(len(word), labelled.grid(DRIFT))
        if len(self.token):
            for tokens in (stem, word):
                at = np.searchsorted(self.token, tokens).clip(max=len(self.token) - 1)
                known = self.token[at] == tokens
                value[known] = self.score[at[known]]
        return value

    def found(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """For each text its words and its segments."""
        raw, offsets = textbuf.buffers(texts)
        out: list[tuple[int, list[tuple[int, int, float]]]] = []
        for i, j in textbuf.doc_groups(offsets):
            word, stem, at, first = _tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            value = self.values(word, stem)[at]
            total = np.concatenate([[0.0], np.cumsum(value)])
            place = np.flatnonzero(value > 0)
            edge = np.searchsorted(place, first)
            for d in range(j - i):
                here = place[edge[d] : edge[d + 1]]
                found = segments((here - first[d]).tolist(), total[here].tolist(), total[here + 1].tolist()) if len(here) else []
                out.append((int(first[d + 1] - first[d]), found))
        return out

    def p_value(self, words: int, score: float) -> float:
        return -math.expm1(-min(50.0, self.scale * words * math.exp(-self.decay * score)))

    def features(self, words: int, found: list[tuple[int, int, float]]) -> list[float]:
        """Best calibrated segment, sum over the significant ones, their number, and the total of all scores, most on a logarithmic scale."""
        surprise = [-math.log(max(self.p_value(words, x), 1e-12)) for *_, x in found]
        strong = [x for x in surprise if x >= -math.log(SIGNIFICANT)]
        return [max(surprise, default=0.0), math.log1p(sum(strong)), math.log1p(len(strong)), math.log1p(sum(x for *_, x in found))]

    def probability(self, words: int, found: list[tuple[int, int, float]]) -> float:
        z = float(np.dot(self.weights[:-1], self.features(words, found)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "toxic") -> Model:
    chosen = labelled.sample(docs, labels, label, TRAIN_ROWS, text, doc)
    marked = chosen.select("text", F.col("label").cast("long").alias("toxic"), (1 - F.col("label")).cast("long").alias("other"))
    words = token_counts(marked, ["toxic", "other"]).filter("token <> 0 AND toxic + other >= 2").select("token").toPandas()["token"].to_numpy(np.int64)
    words = np.sort(words.view(np.uint64))
    rows = token_counts(marked, ["toxic", "other"], words).filter("token = 0 OR toxic + other >= 2").toPandas()
    token, toxic, other = (rows[c].to_numpy(np.int64) for c in ("token", "toxic", "other"))
    n_toxic, n_other = int(toxic[token == 0].sum()), int(other[token == 0].sum())
    model = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, np.zeros(5))
    if n_toxic and n_other:
        by = np.argsort(token.view(np.uint64))
        by = by[token[by] != 0]
        model.token = token[by].view(np.uint64)
        corpus = token_counts(docs.select(F.coalesce(column(text).cast("string"), F.lit("")).alias("text"), F.lit(1).cast("long").alias("seen")), ["seen"], words, model.token).toPandas()
        held, seen = corpus["token"].to_numpy(np.int64), corpus["seen"].to_numpy(np.int64)
        of = np.zeros(len(by))
        of[np.searchsorted(model.token, held[held != 0].view(np.uint64))] = seen[held != 0]
        model.score = log_odds(toxic[by], other[by], of, n_toxic, n_other, int(seen[held == 0].sum()))
    sample = labelled.in_order(chosen, TRAIN_BYTES)
    found, classes, spread = [], [], {}
    while part := [row for row, _ in zip(sample, range(2000), strict=False)]:
        found += model.found(pa.array([t for t, _ in part], pa.large_string()))
        classes += [c for _, c in part]
        raw, offsets = textbuf.buffers(pa.array([t for t, c in part if not c], pa.large_string()))
        word, stem, at, _ = _tokens(raw, offsets)
        for x, n in zip(*np.unique(model.values(word, stem)[at], return_counts=True), strict=True):
            spread[x] = spread.get(x, 0) + int(n)
    model.decay = decay(np.array(list(spread)), np.array(list(spread.values()), float))
    # K by the mean of K n exp(-lambda S) over best segments of clean documents, which is 1 for extreme values of this kind.
    chance = [n * math.exp(-model.decay * max(x for *_, x in f)) for (n, f), c in zip(found, classes, strict=True) if f and not c]
    model.scale = 1 / max(1e-9, float(np.mean(chance))) if len(chance) >= 20 else 0.1
    model.weights = labelled.logistic(np.array([model.features(*f) for f in found]).reshape(-1, 4), np.array(classes, float))
    del found
    give_back()
    return model


def decay(score: np.ndarray, times: np.ndarray) -> float:
    """The positive lambda at which exp(lambda score) has mean 1 over tokens of clean text, by bisection."""
    if not len(score) or score.max() <= 0:
        return 1.0
    low, high = 0.05, 5.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (low, x) if float(np.dot(times, np.exp(x * score)) / times.sum()) > 1 else (x, high)
    return low


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds the struct ``out``: the probability, and the significant segments in words of the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # the tokens of at most TRAIN_ROWS texts

    def make():
        m = held.value

        def apply(batch: pa.Array) -> pa.Array:
            found = m.found(batch)
            spans = [[{"start": s, "stop": e, "score": x, "p_value": p} for s, e, x in f if (p := m.p_value(n, x)) <= SIGNIFICANT] for n, f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
            return pa.StructArray.from_arrays([pa.array([m.probability(*f) for f in found], pa.float64()), pa.array(spans, kind)], ["score", "segments"])

        return apply

    return docs.withColumn(out, text_map(make, KIND)(column(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns, and the number of significant segments."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(*labelled.predictions(scored, F.col("toxicity.score"), THRESHOLD), F.size("toxicity.segments").cast("long").alias("n_segments"))
