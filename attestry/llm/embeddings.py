"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, distributed components.

A table hashes a vector to the signs of ``bits`` random projections. Vectors at
the threshold agree in a sign with probability p = 1 - acos(threshold) / pi, so
``tables`` is chosen such that a pair at the threshold shares a bucket of some
table with probability ``RECALL`` (closer pairs with more). ``bits`` grows with
the logarithm of the rows, which keeps chance company constant: one vector in
eight has any in a table; no pair is dropped by it, as the tables grow along.

Equal vectors are one class with a count before they are hashed. Keys and ids
alone find the buckets; a vector, in the type that it came in, and its codes
follow only where it has company. In a bucket, pairs get their exact cosine in
double precision; a pair is counted in the first
table where it meets, so that links are counted without being listed. Edges are
spanning edges of a bucket's linked pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths never link; repeated ids are returned as often as given and take part
as often; a null id has a null component of its own; further columns pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import graph, textbuf
from attestry.llm.shared import column, cut, ship

THRESHOLD, RECALL, LEAST_BITS, SEED = 0.95, 0.995, 10, 11
#: A table has two to this power more buckets than there are rows.
SPARSE = 3


def layout(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many rows."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, rows))) + SPARSE)
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-together))


def planes(size: int, bits: int, tables: int) -> np.ndarray:
    """Normal vectors of the hyperplanes, from a fixed seed."""
    return np.random.default_rng([SEED, size]).standard_normal((size, bits * tables))


def usable(vector) -> F.Column:
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _codes(distinct: DataFrame, bits: int, tables: int, single: bool) -> DataFrame:
    """(id, keys, size, vector, codes): the bucket key of every table, and the codes that it is made of; vector as bytes of floats or doubles."""
    ship(distinct.sparkSession)
    kind = "id long, keys array<long>, size int, vector binary, codes binary"
    width = np.uint32 if bits <= 32 else np.uint64

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            rows = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in rows])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                normal = planes(int(size), bits, tables)
                for part in np.array_split(at, max(1, len(at) * tables // 50_000)):
                    if not len(part):
                        continue
                    v = np.array([rows[k] for k in part], np.float64)
                    unit = v / np.abs(v).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    signs = (unit @ normal > 0).reshape(len(part), tables, bits)
                    code = (signs * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
                    key = textbuf.mix((code * np.uint64(tables) + np.arange(tables, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size))
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * tables, pa.int32()), pa.array(key.view(np.int64).ravel()))
                    vectors = [x.tobytes() for x in (v.astype(np.float32) if single else v)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), keys, pa.array(np.full(len(part), size, np.int32)), pa.array(vectors, pa.binary()), pa.array([x.tobytes() for x in code.astype(width)], pa.binary())], ["id", "keys", "size", "vector", "codes"])

    return distinct.select("id", "vector").mapInArrow(run, kind)


class Counted(graph.Forest):
    """Spanning edges, and beside them what each vector's links in these cells add to its count; so every pair is verified."""

    kind = "a long, b long, links long"

    def __init__(self, c: dict[str, np.ndarray]):
        super().__init__(c)
        self.times, self.count = c["n"], np.zeros(len(c["id"]), np.int64)

    def open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.ones(len(a), bool)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        # A step's pairs have each row once on either side.
        self.count[a] += self.times[b]
        self.count[b] += self.times[a]
        super().add(a, b)

    def rows(self) -> pa.RecordBatch:
        x, y = self.edges()
        on = np.flatnonzero(self.count)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, self.ids[on]])), pa.array(np.concatenate([y, self.ids[on]])), pa.array(np.concatenate([np.zeros(len(x), np.int64), self.count[on]]))], ["a", "b", "links"])


def near_duplicates(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    single = dict(vectors.dtypes)[vec] == "array<float>"
    given = vectors.select(column(key).cast("long").alias("id"), column(vec).cast("array<double>").alias("vector"))
    # -0.0 and 0.0 are one value.
    given = given.withColumn("vector", F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + F.lit(0.0))))
    sums = cut(given.filter("vector IS NOT NULL").groupBy("vector").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("id", F.monotonically_increasing_id()))
    bits, tables = layout(sums.count(), threshold)
    coded = cut(_codes(sums, bits, tables, single))
    met = cut(graph.in_company(coded.select(F.posexplode("keys").alias("table", "key"), "id")))
    payload = coded.drop("keys").join(sums.select("id", "n"), "id")

    def meets(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of this table that met in no earlier one and whose cosine reaches the threshold."""
        v, codes = c["vector"].view(np.float32 if single else np.float64), c["codes"].view(np.uint32 if bits <= 32 else np.uint64)[:, :tables]
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), 8192):
            x, y = a[lo : lo + 8192], b[lo : lo + 8192]
            p, q = v[x].astype(np.float64), v[y].astype(np.float64)
            p = p / np.abs(p).max(axis=1, keepdims=True)
            q = q / np.abs(q).max(axis=1, keepdims=True)
            cosine = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
            near = np.flatnonzero((cosine >= threshold) & (c["size"][x] == c["size"][y]))
            same = codes[x[near]] == codes[y[near]]
            out[lo + near[same.argmax(axis=1) == c["table"][x[near]]]] = True
        return out

    found = cut(graph.compare(met, meets, Counted, payload))
    counts = found.filter("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    group = graph.components(found.filter("links = 0"))
    classes = sums.join(counts, "id", "left").join(group, F.col("id") == F.col("node"), "left").select("vector", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("class"))
    classes = cut(classes)
    least = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    named = cut(classes.join(least, "class").select("vector", "n_links", "component_id"))
    linked = given.join(named, "vector", "left")
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return linked.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def digest(vectors: DataFrame) -> DataFrame:
    """The query's columns."""
    return near_duplicates(vectors.select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


#: All pairs, and components by recursion; for tables that allow it.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(node, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT node, l.b FROM reach JOIN l ON reach.other = l.a),
c AS (SELECT node AS vec_id, min(other) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
