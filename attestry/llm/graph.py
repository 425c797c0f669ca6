"""Verified links within buckets, and connected components, without collecting or expanding groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.shared import cut, give_back, ship

#: Rows of a bucket that are compared in one piece; larger buckets are cut into pieces and each pair of pieces is a task's matter of its own.
PIECE = 1024
#: Edges that one task solves in arrays, some 100 bytes each.
FEW = 1 << 20
#: Oversize buckets that are broadcast by their key; beyond that many the join is shuffled.
BROADCAST_KEYS = 10_000


def cells(rows: DataFrame) -> DataFrame:
    """Adds (low, high, mine) to rows (key, id, ...): the pair of pieces of the bucket in which the row is compared, and its own piece.

    A bucket within PIECE rows is one cell. A larger one is dealt into pieces by
    a hash of the id, and a row goes once to each pair that its piece is in.
    """
    hot = cut(rows.groupBy("key").count().filter(F.col("count") > PIECE).select("key", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")))
    n = hot.count()
    if not n:
        return rows.withColumns({"low": F.lit(0), "high": F.lit(0), "mine": F.lit(0)})
    dealt = rows.join(F.broadcast(hot) if n <= BROADCAST_KEYS else hot, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id", F.lit("piece")), F.col("pieces")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("pieces", "other")


def in_company(keyed: DataFrame, broadcast_below: int = 100_000) -> DataFrame:
    """The rows (key, id, ...) whose key more than one id has."""
    keys = cut(keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key"))
    return keyed.join(F.broadcast(keys) if keys.count() <= broadcast_below else keys, "key", "left_semi")


class Forest:
    """What verified pairs connect, as edges to the least row of each tree. Pairs that are connected already aren't verified: a group of near copies costs little more than a comparison a row."""

    kind = "a long, b long"

    def __init__(self, c: dict[str, np.ndarray]):
        self.ids, self.label = c["id"], np.arange(len(c["id"]))

    def open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.label[a] != self.label[b]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.label = least_reached(len(self.label), self.label[a], self.label[b])[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        on = np.flatnonzero(self.label != np.arange(len(self.ids)))
        return self.ids[on], self.ids[self.label[on]]

    def rows(self) -> pa.RecordBatch:
        x, y = self.edges()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def compare(rows: DataFrame, verify: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray], found: type[Forest] = Forest, payload: DataFrame | None = None) -> DataFrame:
    """Compares the rows (key, id, ...) of each bucket with one another and returns what ``found`` makes of a batch and its verified pairs.

    ``payload`` (id, ...) is joined to the rows once they have their cells, so
    that what finds the cells moves without it.

    Whole cells are gathered from the sorted partition, a batch at a time; at
    most one cell, of some 2 PIECE rows, waits for its end. Pairs go to ``found``
    as they are verified and are never listed. verify gets the columns and two
    index arrays, all calls for a batch with the same columns. Binary columns
    arrive as rows of unsigned 64-bit integers, shorter values filled up with
    zeros; lists as (values, offsets).
    """
    ship(rows.sparkSession)
    placed = cells(rows)
    if payload is not None:
        placed = placed.join(payload, "id")
    names = placed.columns

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for name in names:
            c = table[name].combine_chunks()
            if pa.types.is_binary(c.type):
                values = c.to_pylist()
                width = -(-max(map(len, values), default=0) // 8) * 8
                raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in values), np.uint64)
                out[name] = raw.reshape(len(c), -1)
            elif pa.types.is_list(c.type):
                out[name] = c.values.to_numpy(), c.offsets.to_numpy()
            else:
                out[name] = c.to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            cell = np.column_stack([table[c].combine_chunks().to_numpy() for c in ("key", "low", "high")])
            changes = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1))
            last = int(changes[-1]) + 1 if len(changes) else 0
            if last:
                yield from pairs(table.slice(0, last))
            waiting = table.slice(last)
            give_back()
        if waiting is not None and len(waiting):
            yield from pairs(waiting)

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c = columns(table)
        n = len(table)
        new = np.ones(n, bool)
        new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["low"][1:] != c["low"][:-1]) | (c["high"][1:] != c["high"][:-1])
        group = np.cumsum(new) - 1
        end = np.append(np.flatnonzero(new)[1:], n)[group]
        seen = found(c)
        open_ = np.arange(n)
        step = 1
        while True:
            open_ = open_[open_ + step < end[open_]]
            if not len(open_):
                break
            a, b = open_, open_ + step
            # Cells of two pieces compare across them only.
            use = ((c["low"][a] == c["high"][a]) | (c["mine"][a] != c["mine"][b])) & seen.open(a, b)
            a, b = a[use], b[use]
            if len(a):
                good = verify(c, a, b)
                if good.any():
                    seen.add(a[good], b[good])
            step += 1
        yield seen.rows()

    return placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, found.kind)


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the rows that the pairs (a, b) connect with each of ``n`` rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def links(rows: DataFrame, verify: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Edges (a, b) between ids that connect what the verified pairs connect; at most one for each row of a cell."""
    return compare(rows, verify)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) together."""
    parts = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = ids[least_reached(len(ids), at[: len(u)], at[len(u) :])]
    for lo in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + (1 << 16)]), pa.array(root[lo : lo + (1 << 16)])], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; the component is its smallest node.

    Up to FEW edges, counted, one task holds them in arrays and solves them.
    Beyond that, alternating large and small stars: every round links each node
    to the least node that it knows, until all trees are stars. Rounds grow with
    the logarithm of the nodes. A node's neighbours are never gathered: the least
    one is an aggregate, written to shared storage, and joined back to the edges,
    a join whose large partitions can be split. Both ways give the same rows.
    """
    ship(edges.sparkSession)
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())

    if now.count() <= FEW:
        return cut(now.coalesce(1).mapInArrow(_solved, "node long, component long"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())

    def least(e: DataFrame) -> DataFrame:
        return cut(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))

    known = state(now)
    while known[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        near = large.join(least(large), "u")
        now = cut(near.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct())
        after = state(now)
        if after == known:
            break
        known = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
