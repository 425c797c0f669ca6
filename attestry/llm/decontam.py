"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a batch of whole documents. Its words become integers by their bytes
(words that no test item holds become breaks), a suffix array is built over the
places from where a shortest window of known words follows, and the windows that
begin the suffixes of every test item are binary-searched in it; equal windows
are searched once. The range found for a window holds all its places, and as
windows of one size have ranges apart, all ranges together are no longer than
the shard times the number of window sizes (``WINDOW`` at most), however often
texts and items repeat themselves. A place's longest verbatim match follows
the items' windows on from the place's own. No shuffle is needed, no shard sees
another, and a lost task is simply run again.

The test set comes to the driver and into a broadcast in pieces of about
``PIECE_BYTES`` of text (a longer single item is a piece of its own), one at a
time: with several pieces the documents are read once for each, the hits are
written to shared storage and united by the row's place in the table, so
``docs`` must be a table that reads the same each time.

Defined results: null and empty texts have no words and no hits; texts are
searched whole; items that are null or have no words never occur; items of
fewer words than a window are one window; repeated items are found under each
of their ids, an id given twice counts once, a null id is listed as the empty
text; an empty test set leaves every document clean; further columns pass
through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import textbuf
from attestry.llm.shared import column, cut, free_name, text_map

WINDOW = 10
PIECE_BYTES = 4 << 20
#: Pairs of an item's place and a document's that are compared at a time.
COMPARED = 1 << 16
#: Fixed value: bytes of words; in UTF-8 all signs beyond ASCII are word signs.
INSIDE = textbuf.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
KIND = "struct<n_words:long,hits:array<struct<start:long,stop:long>>,item_ids:array<string>,matches:array<struct<item_id:string,item_start:long,start:long,n_words:long>>>"
HITS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64())]))


class TestSet:
    """Words and distinct windows of a piece of the test set; equal items are held once, with all their ids."""

    __test__ = False

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW):
        rows = sorted(((item or "", text or "") for item, text in rows))
        raw, offsets = textbuf.buffers(pa.array([t for _, t in rows], pa.large_string()))
        start, words = textbuf.word_values(raw, offsets, INSIDE, textbuf.ascii_lower())
        first = np.searchsorted(start, offsets)
        self.vocabulary = words.unique()
        known = self.tokens(words)
        ids: dict[bytes, set[str]] = {}
        for (item, _), a, b in zip(rows, first[:-1], first[1:], strict=True):
            if b > a:
                ids.setdefault(known[a:b].tobytes(), set()).add(item)
        self.window = window
        self.ids = [sorted(x) for x in ids.values()]
        items = [np.frombuffer(k, np.int32) for k in ids]
        flat = np.concatenate([*items, np.full(window, -1, np.int32)])
        length = np.array([len(x) for x in items], np.int64)
        counts = np.maximum(length - window, 0) + 1
        item = np.repeat(np.arange(len(items)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        size = np.minimum(length, window)[item]
        span = np.arange(window)
        # Every window of every item, shorter ones padded with -1.
        every = np.where(span < size[:, None], flat[(np.repeat(np.cumsum(length) - length, counts) + at)[:, None] + span], np.int32(-1))
        self.windows, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every.reshape(-1, window), np.zeros(0, np.int64))
        which = which.ravel()
        self.sizes = (self.windows >= 0).sum(axis=1)
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0
        # The windows of the items one after another with -1 behind each item, and the places in that line by window.
        line = np.arange(len(which)) + item
        self.line = np.full(len(which) + len(items) + 1, -1, np.int64)
        self.line[line] = which
        self.item_of, self.at_of = np.full(len(self.line), -1), np.full(len(self.line), -1)
        self.item_of[line], self.at_of[line] = item, at
        by = np.argsort(which, kind="stable")
        self.places = line[by]
        self.first = np.searchsorted(which[by], np.arange(len(self.windows) + 1))

    def tokens(self, words: pa.Array) -> np.ndarray:
        """1 + place in the vocabulary, 0 for unknown words; words are compared by their bytes."""
        coded = words.dictionary_encode()
        found = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        return found[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)

    def items_with(self, windows: np.ndarray) -> np.ndarray:
        """The items that hold any of the windows."""
        return np.unique(np.concatenate([self.item_of[self.places[self.first[w] : self.first[w + 1]]] for w in windows]))

    def longest(self, text: np.ndarray, at: int) -> tuple[int, int]:
        """(windows, place in the line) of the longest run of the items' windows that the document's windows ``text`` go through from ``at``; of equal ones the first."""
        open_, n = self.places[self.first[text[at]] : self.first[text[at] + 1]], 1
        while True:
            ahead = text[at + n : at + n + max(1, COMPARED // len(open_))]
            if not len(ahead):
                return n, int(open_[0])
            same = self.line[(open_[:, None] + n + np.arange(len(ahead))).clip(max=len(self.line) - 1)] == ahead
            run = np.where(same.all(axis=1), len(ahead), same.argmin(axis=1))
            open_, n = open_[run == run.max()], n + int(run.max())
            if run.max() < len(ahead):
                return n, int(open_[0])


def suffix_array(tokens: np.ndarray, stop: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` sorted by the words that follow, up to ``depth`` of them or the end of their run (prefix doubling)."""
    rank = tokens.astype(np.int64)
    width = 1
    while width < depth:
        at = np.arange(len(rank)) + width
        later = np.where(at < stop, rank[at.clip(max=len(rank) - 1)], 0)
        key = rank * (int(rank.max(initial=0)) + 1) + later
        rank = np.unique(key, return_inverse=True)[1] + 1
        width *= 2
    return places[np.argsort(rank[places], kind="stable")]


def search(tokens: np.ndarray, stop: np.ndarray, order: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window the range of ``order`` that begins with it, by binary search."""
    span = np.arange(windows.shape[1])
    used = span[None, :] < sizes[:, None]

    def bound(past: bool) -> np.ndarray:
        lo = np.zeros(len(windows), np.int64)
        hi = np.full(len(windows), len(order), np.int64)
        while (open_ := lo < hi).any():
            q = np.flatnonzero(open_)
            mid = (lo[q] + hi[q]) // 2
            at = order[mid][:, None] + span[None, :]
            mine = np.where(at < stop[order[mid]][:, None], tokens[at.clip(max=len(tokens) - 1)], 0)
            differ = (mine != windows[q]) & used[q]
            k = differ.argmax(axis=1)
            rows = np.arange(len(q))
            less = np.where(differ[rows, k], mine[rows, k] < windows[q][rows, k], past)
            lo[q] = np.where(less, mid + 1, lo[q])
            hi[q] = np.where(less, hi[q], mid)
        return lo

    return bound(False), bound(True)


def find(column_: pa.Array, test: TestSet) -> pa.Array:
    """KIND for each text: its words, the hit ranges of words, the items that occur, and longest verbatim matches from left to right, none of which begins in another of its window's size."""
    raw, offsets = textbuf.buffers(column_)
    n_words, hits, items, matches = [], [], [], []
    for i, j in textbuf.doc_groups(offsets):
        part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, words = textbuf.word_values(part, off, INSIDE, textbuf.ascii_lower())
        first = np.searchsorted(start, off)
        n_words.append(np.diff(first))
        found = _shard(test.tokens(words), first, test)
        for d in range(j - i):
            ranges, whose, spans = found.get(d, ((), (), ()))
            hits.append([{"start": a, "stop": b} for a, b in ranges])
            items.append([x for k in whose for x in test.ids[k]])
            matches.append([{"item_id": test.ids[k][0], "item_start": q, "start": p, "n_words": n} for k, q, p, n in spans])
    arrays = [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(hits, HITS), pa.array(items, pa.list_(pa.string())), pa.array(matches, MATCHES)]
    return pa.StructArray.from_arrays(arrays, ["n_words", "hits", "item_ids", "matches"])


def _shard(tokens: np.ndarray, first: np.ndarray, test: TestSet) -> dict[int, tuple[list, list, list]]:
    """Hit ranges, items and longest matches, by document of the shard, in words from the document's start."""
    if not len(tokens) or not test.shortest:
        return {}
    n = len(tokens)
    breaks = np.union1d(np.flatnonzero(tokens == 0), first[first < n])
    ends = np.append(breaks, n)
    stop = ends[np.searchsorted(ends, np.arange(n), "right").clip(max=len(ends) - 1)]
    stop[n - 1 :] = n
    places = np.flatnonzero((tokens > 0) & (stop - np.arange(n) >= test.shortest))
    if not len(places):
        return {}
    # Only the runs that hold such places are kept, so the arrays below are as long as the known passages.
    mark = np.bincount(places, minlength=n + 1) - np.bincount(stop[places], minlength=n + 1)
    keep = np.cumsum(mark[:n]) > 0
    old = np.flatnonzero(keep)
    new = np.cumsum(keep) - 1
    t, s, p = tokens[old], new[stop[old] - 1] + 1, new[places]
    here = np.zeros(len(test.vocabulary) + 1, bool)
    here[t] = True
    here[0] = True  # the padding of short windows (-1 + 1) stands for any word
    able = np.flatnonzero(here[np.maximum(test.windows, 0)].all(axis=1))
    if not len(able):
        return {}
    order = suffix_array(t, s, p, test.window)
    lo, hi = search(t, s, order, test.windows[able], test.sizes[able])
    count = hi - lo
    if not count.any():
        return {}
    which = np.repeat(able, count)
    place = old[order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]]
    size = test.sizes[which]
    cover = np.bincount(place, minlength=n + 1) - np.bincount(place + size, minlength=n + 1)
    hit = np.cumsum(cover[:n]) > 0
    doc = np.searchsorted(first, place, "right") - 1
    by = np.lexsort((place, size, doc))
    which, place, size, doc = which[by], place[by], size[by], doc[by]
    out = {}
    for d in np.unique(doc).tolist():
        a, b = np.searchsorted(doc, (d, d + 1))
        on = np.flatnonzero(np.diff(np.concatenate(([0], hit[first[d] : first[d + 1]].astype(np.int8), [0])))).tolist()
        spans = []
        for width in np.unique(size[a:b]).tolist():
            x, y = a + np.searchsorted(size[a:b], (width, width + 1))
            spans += _left_to_right(which[x:y], place[x:y] - first[d], width, test)
        out[d] = list(zip(on[::2], on[1::2], strict=True)), test.items_with(np.unique(which[a:b])).tolist(), sorted(spans, key=lambda m: (m[2], -m[3], m[:2]))
    return out


def _left_to_right(which: np.ndarray, place: np.ndarray, width: int, test: TestSet) -> list[tuple[int, int, int, int]]:
    """(item, place in the item, place in the document, words) of the longest match from the first place on, then from the first place behind it, and so on."""
    text = np.full(place[-1] + 1 - place[0], -2, np.int64)
    text[place - place[0]] = which
    out, k = [], 0
    while k < len(place):
        at = int(place[k])
        n, c = test.longest(text, at - int(place[0]))
        out.append((int(test.item_of[c]), int(test.at_of[c]), at, n - 1 + width))
        k = int(np.searchsorted(place, at + n - 1 + width))
    return out


def test_pieces(benchmark: DataFrame, item: str, text: str, window: int):
    """Yields the test set piece by piece, of PIECE_BYTES of text on average: what the driver holds and broadcasts at a time."""
    rows = benchmark.select(column(item).cast("string").alias("item"), F.coalesce(column(text).cast("string"), F.lit("")).alias("body"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // PIECE_BYTES))
    part = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    for k in range(n):
        yield n, TestSet([tuple(r) for r in (rows if n == 1 else rows.filter(part == k)).collect()], window)


test_pieces.__test__ = False


def search_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "found", window: int = WINDOW) -> DataFrame:
    """Adds the struct ``out``: n_words, hits (ranges of hit words; of several pieces, overlapping), item_ids (repeats possible) and matches (longest verbatim matches: an item, places in it and in the document, words)."""
    place = free_name(docs, "place")
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    parts = []
    for n, piece in test_pieces(benchmark, item, item_text, window):
        held = docs.sparkSession.sparkContext.broadcast(piece)

        def make(held=held):
            test = held.value
            return lambda batch: find(batch, test)

        searched = text_map(make, KIND)(column(text))
        if n == 1:
            return docs.withColumn(out, searched)
        found = placed.select(column(place).alias("place"), searched.alias("found"))
        # The words of every row come with the first piece.
        parts.append(cut(found if not parts else found.filter(F.size("found.hits") > 0)))
        held.destroy()
    lists = [F.flatten(F.collect_list(F.col("found")[f])).alias(f) for f in ("hits", "item_ids", "matches")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("place").agg(F.struct(F.max("found.n_words").alias("n_words"), *lists).alias("found")).select(F.col("place").alias(place), F.col("found").alias(out))
    return placed.join(merged, place).drop(place)


def hit_words(found: Column) -> Column:
    """Words in at least one hit range."""
    grow = lambda acc, r: F.struct(
        F.greatest(acc["upto"], r["stop"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("long"), r["stop"] - F.greatest(acc["upto"], r["start"]))).alias("n")
    )
    return F.aggregate(F.array_sort(found["hits"]), F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")), grow, lambda acc: acc["n"])


def item_ids(found: Column) -> Column:
    """Ids of the items that occur, sorted as strings."""
    return F.array_sort(F.array_distinct(found["item_ids"]))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns."""
    found = search_benchmark(docs.select("doc_id", "text"), benchmark.select("item_id", F.col("text")))
    ids, f = item_ids(F.col("found")), F.col("found")
    return found.select("doc_id", f["n_words"].alias("n_words"), hit_words(f).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size(f["hits"]) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of any item occurs; columns as given."""
    found = free_name(docs, "found")
    return search_benchmark(docs, benchmark, text, out=found).filter(F.size(column(found)["hits"]) == 0).drop(found)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Every window of every document against every window of every item.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, size, w[p : p + size - 1] AS x FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, w[p : p + size - 1] AS x FROM (SELECT doc_id, w, size, unnest(range(1, greatest(1, len(w) - size + 2))) AS p FROM d, sizes)),
hit AS (SELECT doc_id, p, size, item FROM dw JOIN iw USING (size, x)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS k FROM (SELECT DISTINCT doc_id, p, size FROM hit)) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN names USING (doc_id)
"""
