"""Operator 8: approximate nearest neighbours by stable projections and kd-trees.

Largest inner product becomes nearest distance by one more coordinate,
sqrt(M^2 - |x|^2) for a vector and 0 for a query, M being the greatest norm.
Vectors are projected on PROJECTIONS directions drawn from the normal law,
which is 2-stable: the squared projected distance over the squared distance
follows chi-squared with PROJECTIONS degrees of freedom. Each block of vectors
has a kd-tree over the projections. A query takes the leaves of a tree in the
order of their projected distance, verifies their vectors on the originals,
and stops at the first leaf for which the chance that a vector nearer than its
current k-th would project so far is under MISS.

Vectors are dealt by hash into blocks, queries into groups; a pair of a block
and a group is one task's work and gives k rows a query, merged by rank. The
index holds every vector. Equal vectors are one entry of the index, which
carries its k + 1 smallest ids: no more can be among k neighbours.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, neither do those of another width than the most
common one (ties: the greater), nor null ids; fewer than k candidates are all
returned; ties go to the smaller id; of repeated ids each row counts once as a
candidate, and an id queries with its first vector; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import prepare, table

K = 20
QUERY_EVERY = 20
PROJECTIONS = 8
LEAF = 192
MISS = 0.05
SEED = 11
#: Distinct vectors of a block and queries of a group, about.
BLOCK, GROUP = 20_000, 2_000


def chi_square(x: np.ndarray, even: int = PROJECTIONS) -> np.ndarray:
    """Chance that chi-squared of an even number of degrees stays under x (closed form)."""
    h = np.minimum(x / 2, 700)
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, even // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


class Tree:
    """kd-tree of points: leaves of at most LEAF points with their boxes, split at the median of the widest side."""

    def __init__(self, points: np.ndarray):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                self.leaves.append(at)
                continue
            side = int(np.argmax(np.ptp(points[at], axis=0)))
            half = len(at) // 2
            order = np.argpartition(points[at, side], half)
            todo += [at[order[:half]], at[order[half:]]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from each query to each leaf's box."""
        out = np.zeros((len(q), len(self.leaves)))
        for j in range(q.shape[1]):
            gap = np.maximum(np.maximum(self.low[None, :, j] - q[:, None, j], q[:, None, j] - self.high[None, :, j]), 0)
            out += gap * gap
        return out


def search(vectors: np.ndarray, queries: np.ndarray, greatest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query place, vector place, inner product) that hold at least the k best found for each query, ties included."""
    directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
    rest = np.sqrt(np.maximum(greatest**2 - (vectors**2).sum(axis=1), 0))
    tree = Tree(np.hstack([vectors, rest[:, None]]) @ directions)
    norms = (queries**2).sum(axis=1)
    found_q, found_v, found_s = [], [], []
    far = tree.distances(queries @ directions[:-1])
    order = np.argsort(far, axis=1)
    best = np.full((len(queries), k), -np.inf)  # the first column is the k-th best
    live = np.arange(len(queries))
    for step in range(len(tree.leaves)):
        leaf, kth = order[live, step], best[live, 0]
        # Squared distance of the k-th best, as inner products give it.
        known = np.isfinite(kth)
        radius = np.maximum(greatest**2 + norms[live] - 2 * np.where(known, kth, 0), 1e-300)
        go = ~known | (1 - chi_square(far[live, leaf] / radius) >= MISS)
        live, leaf = live[go], leaf[go]
        if not len(live):
            break
        # Queries that stand at the same leaf verify it together.
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.append(True, leaf[by][1:] != leaf[by][:-1]))
        for i, j in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
            q, points = live[by[i:j]], tree.leaves[leaf[by[i]]]
            scores = queries[q] @ vectors[points].T
            qi, pi = np.nonzero(scores >= best[q, :1])
            found_q.append(q[qi])
            found_v.append(points[pi])
            found_s.append(scores[qi, pi])
            if len(pi):
                both = np.hstack([best[q], scores])
                top = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]  # its first is the least of the k
                best[q] = top
    if not found_q:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array([v.values.to_numpy(zero_copy_only=False) for v in column], np.float64).reshape(-1, width)


def _match(width: int, greatest: float, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def match(rows: pa.Table) -> pa.Table:
        is_query = np.array(rows.column("is_query").to_pylist(), bool)
        asked, held = rows.filter(pa.array(is_query)), rows.filter(pa.array(~is_query))
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        queries, vectors = _matrix(asked.column("vector"), width), _matrix(held.column("vector"), width)
        query_ids = np.array(asked.column("vec_id").to_pylist(), np.int64)
        ids = [np.array(x, np.int64) for x in held.column("ids").to_pylist()]
        # An entry may be the query itself alone, so one more distinct vector than k is sought.
        q, v, s = search(vectors, queries, greatest, k + 1)
        counts = np.array([len(x) for x in ids])
        each = counts[v]
        begin = np.cumsum(counts) - counts
        flat = np.concatenate(ids)
        at = np.repeat(begin[v] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        q, s, vec = np.repeat(q, each), np.repeat(s, each), flat[at]
        other = vec != query_ids[q]
        q, s, vec = q[other], s[other], vec[other]
        order = np.lexsort((vec, -s, q))
        q, s, vec = q[order], s[order], vec[order]
        first = np.searchsorted(q, np.arange(len(query_ids)))
        keep = np.arange(len(q)) - first[q] < k
        return pa.table([query_ids[q[keep]], vec[keep], s[keep]], schema=schema)

    return match


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """vectors: vec_id, embedding. The k largest inner products of each row whose id is divisible by every."""
    spark = vectors.sparkSession
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("width", F.size("vector"))
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width, greatest, n = widths["width"], float(np.sqrt(widths["square"])), widths["n"]
    rows = rows.where(F.col("width") == width).select("vec_id", "vector")
    blocks, groups = -(-n // BLOCK), -(-n // every // GROUP) or 1

    # The k + 1 smallest ids of each distinct vector; the rank limit is applied before rows are dealt out as well.
    key = F.xxhash64("vector")
    ranked = rows.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key", "vector").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    distinct = ranked.groupBy("_key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # A query's vectors go to each block, a block's to each group of queries.
    held = distinct.select(F.lit(False).alias("is_query"), F.lit(None).cast("bigint").alias("vec_id"), "vector", "ids", F.pmod("_key", F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.select(F.lit(True).alias("is_query"), "vec_id", "vector", F.array().cast("array<bigint>").alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"))
    found = held.unionByName(asked).groupBy("block", "group").applyInArrow(_match(width, greatest, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return nearest(table(spark, sf_dir, "embeddings"))


