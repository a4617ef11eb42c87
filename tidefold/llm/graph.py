"""Connected components by contraction in chunks and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import settled

ROUNDS = 60
#: Edges that a task contracts at a time, 16 bytes each.
EDGES = 1_000_000


def components(edges: DataFrame, chunk: int = EDGES) -> DataFrame:
    """edges: a, b (bigint, in any order). Returns node, root: the least node of its component, for each node but the roots.

    Each round a task contracts its edges, chunk at a time, to one edge a node,
    to the least node that the chunk reaches; edges are dealt to as many tasks
    as they fill chunks. If all are in one chunk, that is the result. Else large
    and small stars join the chunks: minima per node, aggregated before the
    shuffle. Each round is checkpointed and no neighbourhood is gathered. Ends
    when a round changes nothing, after about log rounds.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")))
    mark = _mark(now)
    for _ in range(ROUNDS):
        chunks = -(-mark[0] // chunk)
        forest = settled(now.coalesce(max(1, chunks)).mapInArrow(_contract(chunk), "v bigint, u bigint"))
        if chunks <= 1:
            now = forest
            break
        # Large star: every node sends its greater neighbours to the least node it knows.
        both = forest.select(F.col("v").alias("x"), F.col("u").alias("y")).union(forest.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # Small star: every node and its lesser neighbours go to the least of those.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
        now = settled(small.where("v <> u").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def roots(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node that each reaches, for those that reach a lesser one."""
    nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    x, y = at[: len(v)], at[len(v) :]
    root = np.arange(len(nodes))
    while len(x):
        p, q = root[x], root[y]
        open_ = p != q
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, further := root[root]):
            root = further
    low = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[low], nodes[root[low]]


def _contract(chunk: int):
    """Edges as stars, for each chunk of them."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, len(batch), chunk):
                part = batch.slice(i, chunk)
                if n + len(part) > chunk:
                    yield _stars(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if held:
            yield _stars(held)

    return contract


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    v, u = roots(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("v", "u")))
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], ["v", "u"])


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
