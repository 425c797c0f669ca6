"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified Hamming distances, components.

A fingerprint bit is set where over half of a text's word shingles (repeats
included) have it set in their hash. ``words`` 64-bit words of fingerprint come
from one XXH64 of each shingle (seed 42) and mixes of it.

Search is exact: of ``distance`` + 6 blocks of bits, all but ``distance`` are equal in a close pair,
so two close fingerprints share the bucket of some choice of blocks. Verified
pairs then differ in few known bits, and a bucket of distinct fingerprints can't
have more than two to the power of the bits left out.

``keep_one`` needs every pair of a similarity: buckets are shingles, of each set
so many that no such pair misses all its buckets, whatever the texts' lengths;
fingerprints of distinct shingles then reject the pairs that are far apart, and
within what is left and connected, the exact similarity of the sets decides.

Equal fingerprints are one class before any bucket is made, so copies, however
many, are compared once. Within buckets ``graph`` compares bounded pieces and
emits spanning edges only.

Defined results: null and empty texts have no shingle and the fingerprint zero,
linked like any other; texts of fewer words than a shingle are one shingle;
texts of any length count whole; repeated rows and ids are each returned; a
component without any id has a null component_id; further columns pass.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import graph, textbuf
from attestry.llm.shared import column, cut, free_name, text_map

SEED = 42
#: The pipeline's similarity, as a fraction: SHARED / PARTS.
SHARED, PARTS = 4, 5
#: One of so many texts is looked at for frequent shingles, those that so many of them hold, and so many shingles at most.
SAMPLED, OFTEN, FREQUENT = 50, 8, 20_000
#: Hashes whose pairs are counted out at a time.
COUNTED = 1 << 19
#: The pipeline's fingerprints: nine words, and as many differing bits as sets of similarity 0.8 have at worst (4 of 5 shingles, 108 on average), and six standard deviations more.
WIDE, WIDE_DISTANCE = 9, 165


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle: ``size`` words, or the whole text where it has fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - size + 1)


def fingerprints(hashes: list[np.ndarray], words: int) -> np.ndarray:
    """A row of ``words`` integers for each array of hashes.

    Bits are counted eight at a time in the bytes of 64-bit sums, over stretches
    of at most 255 hashes, which no byte overflows.
    """
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(hashes), words), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h = np.concatenate([hashes[k] for k in full])
    pieces = -(-sizes[full] // 255)
    first = np.cumsum(sizes[full]) - sizes[full]
    start = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    of_doc = np.cumsum(pieces) - pieces
    half = sizes[full]
    lanes, one = np.uint64(0x0101010101010101), np.uint64(1)
    with np.errstate(over="ignore"):
        for w in range(words):
            x = h if not w else textbuf.mix(h + np.uint64(w) * np.uint64(textbuf.BASE))
            for bit in range(8):
                sums = np.add.reduceat((x >> np.uint64(bit)) & lanes, start).view(np.uint8).reshape(-1, 8)
                count = np.add.reduceat(sums.astype(np.int64), of_doc, axis=0)
                for byte in range(8):
                    out[full, w] |= np.where(2 * count[:, byte] > half, one << np.uint64(8 * byte + bit), np.uint64(0))
    return out


def fingerprint(text: Column, size: int, words: int = 1) -> Column:
    """The whole text's fingerprint: a binary of ``words`` little-endian integers."""

    def make():
        def apply(batch: pa.Array) -> pa.Array:
            raw, offsets = textbuf.buffers(batch)
            rows = []
            for i, j in textbuf.doc_groups(offsets):
                found = fingerprints([shingle_hashes(raw[offsets[k] : offsets[k + 1]].tobytes(), size) for k in range(i, j)], words)
                rows += [x.tobytes() for x in found]
            return pa.array(rows, pa.binary())

        return apply

    return text_map(make, "binary")(text)


def sketch(text: Column, size: int, words: int, often: Broadcast) -> Column:
    """Of the set of the whole text's shingles: its fingerprint ``print``, 16 bytes ``same`` that only equal sets share, and ``keys``.

    Keys are the set's first hashes, those in ``often`` (sorted) counting as last
    and the others by their value, and so many that two sets of the similarity
    have their first common hash among both their keys.
    """

    def make():
        late = often.value

        def keys(h: np.ndarray) -> np.ndarray:
            if len(h) < SHARED:
                return np.zeros(0, np.int64)
            if len(late):
                last = late[np.searchsorted(late, h).clip(max=len(late) - 1)] == h
                h = np.concatenate([h[~last], h[last]])
            return h[: len(h) + 1 - -(-SHARED * len(h) // PARTS)].view(np.int64)

        def apply(batch: pa.Array) -> pa.Array:
            raw, offsets = textbuf.buffers(batch)
            prints, same, chosen = [], [], []
            for i, j in textbuf.doc_groups(offsets):
                sets = [np.unique(shingle_hashes(raw[offsets[k] : offsets[k + 1]].tobytes(), size)) for k in range(i, j)]
                prints += [x.tobytes() for x in fingerprints(sets, words)]
                same += [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
                chosen += map(keys, sets)
            return pa.StructArray.from_arrays([pa.array(prints, pa.binary()), pa.array(same, pa.binary()), lists(chosen)], ["print", "same", "keys"])

        return apply

    return text_map(make, "struct<print:binary,same:binary,keys:array<long>>")(text)


def frequent(placed: DataFrame, place: str, text: str, size: int) -> np.ndarray:
    """Hashes of shingles that many texts of a sample hold, sorted. They only order keys: results don't depend on the sample."""
    some = placed.filter(F.pmod(F.xxhash64(column(place)), F.lit(SAMPLED)) == 0).select(F.explode(shingle_set(column(text), size)).alias("hash"))
    found = some.groupBy("hash").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "hash").limit(FREQUENT).collect()
    return np.sort(np.array([r["hash"] for r in found], np.int64).view(np.uint64))


def shingle_set(text: Column, size: int) -> Column:
    """The hashes of the whole text's distinct shingles, as an array of longs."""

    def make():
        def apply(batch: pa.Array) -> pa.Array:
            raw, offsets = textbuf.buffers(batch)
            sets = [np.unique(shingle_hashes(raw[i:j].tobytes(), size)).view(np.int64) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            return lists(sets)

        return apply

    return text_map(make, "array<long>")(text)


def lists(rows: list[np.ndarray]) -> pa.Array:
    """An array of lists of longs."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), pa.int64()))


def alike(distance: int):
    """Verification by the exact Jaccard similarity of sets of shingles.

    Pairs beyond the Hamming distance are not counted out.
    """
    near = close(distance)

    def verify(c: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        values, offsets = c["shingles"]
        if "rank" not in c:
            c["rank"] = np.unique(values[offsets[0] : offsets[-1]], return_inverse=True)[1].astype(np.int64)
        sizes = np.diff(offsets)
        at = offsets[:-1].astype(np.int64) - offsets[0]
        good = PARTS * np.minimum(sizes[a], sizes[b]) >= SHARED * np.maximum(sizes[a], sizes[b])
        good[good] = near(c, a[good], b[good])
        todo = np.flatnonzero(good)
        total = np.cumsum((sizes[a[todo]] + sizes[b[todo]]).astype(np.int64))
        lo = 0
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + COUNTED, "right")))
            part = todo[lo:hi]
            rows = np.concatenate([a[part], b[part]])
            n = sizes[rows].astype(np.int64)
            pair = np.repeat(np.tile(np.arange(len(part)), 2), n)
            key = pair << 32 | c["rank"][np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            key.sort()
            both = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=len(part))
            good[part] = PARTS * both >= SHARED * (n[: len(part)] + n[len(part) :] - both)
            lo = hi
        return good

    return verify


def close(distance: int):
    """Verification by Hamming distance."""

    def verify(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for w in range(c["print"].shape[1]):
            out += np.bitwise_count(c["print"][a, w] ^ c["print"][b, w])
        return out <= distance

    return verify


def _long_at(binary: Column, k: int) -> Column:
    """A little-endian long from eight bytes, by hexadecimal digits."""
    digits = F.concat(*[F.substring(F.hex(binary), 16 * k + 2 * b + 1, 2) for b in range(7, -1, -1)])
    return F.conv(digits, 16, -10).cast("long")


def block_keys(print_: Column, distance: int) -> Column:
    """The bucket keys of a fingerprint, as an array of hashes."""
    n = distance + 6
    edges = [64 * k // n for k in range(n + 1)]
    masks = []
    for left_out in combinations(range(n), distance):
        bits = reduce(int.__or__, (((1 << edges[k + 1]) - (1 << edges[k])) for k in range(n) if k not in left_out))
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return F.array(*[F.xxhash64(F.lit(k), print_.bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(masks)])


def classes(prints: DataFrame, distance: int) -> DataFrame:
    """(print, class): the component of every distinct fingerprint, named by one of its fingerprints' ids."""
    distinct = cut(prints.select("print").distinct().withColumn("id", _long_at(F.col("print"), 0)))
    keyed = distinct.select(F.explode(block_keys(F.col("id"), distance)).alias("key"), "id", "print")
    found = graph.components(graph.links(keyed, close(distance)))
    return distinct.join(found, F.col("id") == F.col("node"), "left").select("print", F.coalesce("component", "id").alias("class"))


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, print, component_id) for every row: its fingerprint, and the smallest id of the documents that links reach."""
    prints = cut(docs.select(column(doc).alias("doc"), fingerprint(column(text), size).alias("print")))
    by_print = cut(classes(prints, distance))
    first = prints.groupBy("print").agg(F.min("doc").alias("doc")).join(by_print, "print")
    least = first.groupBy("class").agg(F.min("doc").alias("component_id"))
    named = cut(by_print.join(least, "class").select("print", "component_id"))
    return prints.join(named, "print")


def keep_one(docs: DataFrame, size: int = 5, words: int = WIDE, distance: int = WIDE_DISTANCE, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of equal ids the first in the table; columns as given.

    Texts are near-duplicates where their sets of shingles have a Jaccard
    similarity of SHARED / PARTS. Shared keys and fingerprints find candidates; an
    edge is what the exact similarity confirms.

    Rows are told apart by their place, so ``docs`` must be a table that reads
    the same each time (the pipeline hands each stage a written one).
    """
    place = free_name(docs, "place")
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    often = docs.sparkSession.sparkContext.broadcast(frequent(placed, place, text, size))
    sketched = placed.select(column(place).alias("place"), column(doc).alias("doc"), sketch(column(text), size, words, often).alias("sketch"))
    one = F.struct(F.col("doc").isNull().alias("none"), "doc", "place", F.col("sketch.print").alias("print"), F.col("sketch.keys").alias("keys"))
    best = cut(sketched.groupBy("sketch.same").agg(F.min(one).alias("best")).select(F.xxhash64("same").alias("id"), "best"))
    shared = cut(graph.in_company(best.select(F.explode("best.keys").alias("key"), "id")))
    near = graph.components(graph.links(shared.join(best.select("id", F.col("best.print").alias("print")), "id"), close(distance)))
    members = cut(best.join(near, F.col("id") == F.col("node")).select(F.col("component").alias("key"), "id", F.col("best.print").alias("print"), F.col("best.place").alias(place)))
    sets = placed.select(place, column(text).alias("text")).join(members, place).select("key", "id", "print", shingle_set(F.col("text"), size).alias("shingles"))
    found = graph.components(graph.links(sets, alike(distance)))
    kept = best.join(found, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("component", "id")).agg(F.min("best").alias("best")).select(F.col("best.place").alias(place))
    return placed.join(cut(kept), place, "left_semi").select(*[column(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex(_long_at(F.col("print"), 0))), 16, "0").alias("fingerprint"), "component_id")
