"""Quality classifier on supervised subword embeddings.

Words, and the character n-grams inside them between marks of their beginning
and end, are hashed to buckets, and so are word 2-grams, by their pattern alone:
a word that is said again is one feature, whatever the word, and other pairs
tell nothing that their words don't. Each bucket has a learned vector, a document is
the mean of its buckets' vectors, repeats included, and a softmax over two
classes reads it. Training is stochastic gradient descent in numpy on the
driver, over a sample of at most ``TRAIN_ROWS`` labelled documents, and of these
the first by a hash of the text up to ``TRAIN_BYTES`` of text; a longer single
text doesn't enter the sample.

The class score is linear in the mean, so for scoring every bucket's vector is
folded with the softmax weights into one number. That is the same score; the
buckets of each different word of a batch are looked up once. The numbers are
multiples of 2 ** -16, whose sums are exact, so scores don't depend on
partitions or batches.

Defined results: null and empty texts have no features and get the class prior
that the intercepts hold; whole texts count; without labels every score is 0.5,
and with one class alone it is that class's smoothed share; of several texts of
an id the least is learnt from; repeated rows score alike; further columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import labelled, textbuf
from attestry.llm.shared import column, free_name, give_back, text_map

TRAIN_ROWS, TRAIN_BYTES = 6000, 48 << 20
BITS, SIZE, GRAMS = 18, 8, (2, 3, 4, 5)
#: Passes over the sample, and the steps that a small sample is repeated for.
ROUNDS, LEAST_STEPS = 4, 12_000
INSIDE = ~textbuf.byte_set((0x00, 0x20), (0x7F, 0x7F))
#: Bytes of text that are split at a time (a longer text alone), and characters whose n-grams are hashed at a time: temporary arrays take some 100 bytes for each.
GROUP, CHARS = 1 << 20, 1 << 18
#: Bytes that stand before and behind a word; words never hold them.
BEGIN, END = 0x02, 0x03
THRESHOLD = 0.3
#: The bucket of a word that follows itself.
AGAIN = (0xA5A5A5A5A5A5A5A5 >> (64 - BITS))


def word_buckets(body: np.ndarray, at: np.ndarray):
    """Yields (bucket, word) arrays that together hold every feature of every word, given by bytes and offsets: itself, and the n-grams of its characters and marks."""
    n = len(at) - 1
    raw = np.full(len(body) + 2 * n, BEGIN, np.uint8)
    raw[np.arange(len(body)) + 2 * np.repeat(np.arange(n), np.diff(at)) + 1] = body
    edge = at + 2 * np.arange(n + 1)
    raw[edge[1:] - 1] = END
    shift = np.uint64(64 - BITS)
    # Where characters begin; continuation bytes of UTF-8 don't.
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    word = np.searchsorted(edge, chars, "right") - 1
    chars = np.append(chars, len(raw))
    with np.errstate(over="ignore"):
        for lo in range(0, len(word), CHARS):
            hi = min(len(word), lo + CHARS)
            part = raw[chars[lo] : chars[min(len(word), hi + max(GRAMS))]]
            up, down = textbuf.powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            for g in GRAMS:
                first = np.arange(lo, min(hi, len(word) - g + 1))
                first = first[word[first] == word[first + g - 1]]
                a, b = chars[first] - chars[lo], chars[first + g] - chars[lo]
                yield (textbuf.mix((total[b] - total[a]) * down[a] + np.uint64(g)) >> shift).astype(np.int64), word[first]
    offsets = np.append(edge[:-1], len(raw))
    inside = np.ones(256, bool)
    inside[[BEGIN, END]] = False
    _, _, h = textbuf.words(raw, offsets, inside)
    yield (h >> shift).astype(np.int64), np.arange(n)


def split_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(bytes and offsets of the different words, the word at each place, the text of each place, in each text the words that follow themselves)."""
    start, words = textbuf.word_values(raw, offsets, INSIDE)
    *words, at = textbuf.different(words)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return tuple(words), at, doc, np.bincount(doc[1:][(at[1:] == at[:-1]) & (doc[1:] == doc[:-1])], minlength=len(offsets) - 1)


@dataclass
class Model:
    #: What each bucket adds to the log-odds of class 1, and the difference of the intercepts.
    bucket: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw, offsets = textbuf.buffers(texts)
        out = []
        for i, j in textbuf.doc_groups(offsets, GROUP):
            words, at, doc, again = split_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = len(words[1]) - 1
            value, features = np.zeros(n), np.zeros(n)
            for b, w in word_buckets(*words):
                value += np.bincount(w, self.bucket[b], n)
                features += np.bincount(w, minlength=n)
            total, count = np.bincount(doc, value[at], j - i) + again * self.bucket[AGAIN], np.bincount(doc, features[at], j - i) + again
            out.append(total / np.maximum(count, 1))
        z = np.concatenate(out) + self.intercept if out else np.zeros(0)
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the share of each among its features."""
    words, at, _, again = split_words(*textbuf.buffers(pa.array([text], pa.large_string())))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    times = np.bincount(at)
    parts = [(b, times[w]) for b, w in word_buckets(*words)] + [(np.array([AGAIN]), again)]
    ids, which = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
    counts = np.bincount(which, np.concatenate([t for _, t in parts]))
    return ids, (counts / counts.sum()).astype(np.float32)


def bags(sample: Iterable[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bags of all texts one after another, where each begins, and the classes; texts are let go one by one, and large arrays leave no holes in the driver's memory."""
    ids, weights, sizes, classes = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0], []
    rows = iter(sample)
    while some := list(islice(rows, 128)):
        made = [bag(t) for t, _ in some]
        ids.append(np.concatenate([b for b, _ in made]).astype(np.int32))
        weights.append(np.concatenate([w for _, w in made]))
        sizes += [len(b) for b, _ in made]
        classes += [c for _, c in some]
    return np.concatenate(ids), np.concatenate(weights), np.cumsum(sizes), np.array(classes, np.int64)


def fit(sample: Iterable[tuple[str, int]], seed: int = 5, rate: float = 0.5) -> Model:
    """Stochastic gradient descent over shuffled documents (text, class) with a falling rate."""
    ids_of, weight_of, edge, classes = bags(sample)
    share = (classes.sum() + 1) / (len(classes) + 2)
    if not len(classes) or classes.min() == classes.max():
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    r = np.random.default_rng(seed)
    vectors = ((r.random((1 << BITS, SIZE), np.float32) - 0.5) / SIZE).astype(np.float32)
    out, bias = np.zeros((2, SIZE), np.float32), np.zeros(2, np.float32)
    rounds = max(ROUNDS, -(-LEAST_STEPS // len(classes)))
    steps, done = rounds * len(classes), 0
    for _ in range(rounds):
        for k in r.permutation(len(classes)):
            ids, weight = ids_of[edge[k] : edge[k + 1]], weight_of[edge[k] : edge[k + 1]]
            now = rate * (1 - done / steps)
            done += 1
            mean = weight @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[classes[k]] -= 1
            back = out.T @ p
            out -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            # A bag's vectors share its gradient; the step is scaled by 1 / |weights|^2 so that long texts learn as fast as short ones.
            if len(ids):
                vectors[ids] -= (now / float(weight @ weight) * min(1.0, float(weight @ weight) * 50)) * weight[:, None] * back
    return Model(labelled.grid(vectors @ (out[1] - out[0])), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality") -> Model:
    short = docs.filter(F.coalesce(F.octet_length(column(text)), F.lit(0)) <= TRAIN_BYTES // 48)
    model = fit(labelled.in_order(labelled.sample(short, labels, label, TRAIN_ROWS, text, doc), TRAIN_BYTES))
    give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of class 1 for the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def make():
        m = held.value
        return lambda batch: pa.array(m.scores(batch), pa.float64())

    return docs.withColumn(out, text_map(make, "double")(column(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(*labelled.predictions(scored, F.col("score"), THRESHOLD))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The documents that the classifier doesn't reject; columns as given."""
    name = free_name(docs, "score")
    return score(docs, train(docs, labels, text, doc), text, name).filter(column(name) >= THRESHOLD).drop(name)
