"""Operator 10: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). A flow routes whole tokens from patterns to the sources' quotas; the
k-th pass over a pattern costs k - 1 a token, so costs are convex and
repetition is spread before it is deepened. The graph (patterns and sources)
is solved on the driver and may hold at most MAX_PATTERNS patterns. Beyond that
no flow is needed if each pattern is one source, as in the query: a source
then gives its rounded target, and targets are found by rounds of sums over
the sources. Beyond it with overlapping sources the operator refuses. A pattern's flow then becomes whole passes over all
of its documents and a rest, filled by documents in a seeded order.

The rest is cut by bucketed prefix sums: sizes are summed by pattern and
bucket of the seeded hash, the bucket in which the rest ends is found from the
running sums, and only that bucket's rows are ordered one by one. So a hot
source never meets in one task.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, last; an empty table gives no rows; repeated rows are
treated row by row; source columns other than the named ones are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import WORD, packed, partitions, prepare, table, unpacked, written

#: Fixed by the contract: weights in turn, share of all sizes that the mix takes, greatest number of passes.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
PASSES = 2
SEED = 20240
MAX_PATTERNS = 20_000
#: Rows of a pattern that fall into one bucket, about.
BUCKET_ROWS = 2_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, total: int | None = None) -> list[float]:
    """Shares of the whole by weight, none above passes times its source's size; what is cut off is shared again."""
    out = [0.0] * len(sizes)
    rest, open_ = share * (sum(sizes) if total is None else total), [i for i, n in enumerate(sizes) if n > 0]
    weight = lambda i: weights[i % len(weights)]
    while open_ and rest > 1e-9:
        each, rest, still = rest / sum(map(weight, open_)), 0.0, []
        for i in open_:
            out[i] += each * weight(i)
            if out[i] >= (cap := passes * sizes[i]):
                rest += out[i] - cap
                out[i] = float(cap)
            else:
                still.append(i)
        open_ = still
    return out


class _Flow:
    """Min-cost flow by successive shortest paths with potentials; capacities and costs are whole numbers."""

    def __init__(self, nodes: int):
        self.at: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.left, self.cost = [], [], []

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, n, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.left.append(n)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        height = [0] * len(self.at)
        while True:
            best, by = {source: 0}, {}
            queue = [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > best[a]:
                    continue
                for e in self.at[a]:
                    b = self.to[e]
                    if self.left[e] and (n := d + self.cost[e] + height[a] - height[b]) < best.get(b, n + 1):
                        best[b], by[b] = n, e
                        heapq.heappush(queue, (n, b))
            if sink not in best:
                return
            far = max(best.values())
            height = [h + best.get(i, far) for i, h in enumerate(height)]
            path, b = [], sink
            while b != source:
                path.append(by[b])
                b = self.to[by[b] ^ 1]
            n = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= n
                self.left[e ^ 1] += n


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], passes: int = PASSES) -> list[int]:
    """Tokens that each pattern (sources, size) gives, at least cost of repetition."""
    source, sink, first = 0, 1, 2 + len(patterns)
    flow = _Flow(first + len(quotas))
    arcs = [[flow.arc(source, 2 + i, size, k) for k in range(passes)] for i, (_, size) in enumerate(patterns)]
    for i, (members, size) in enumerate(patterns):
        for s in members:
            flow.arc(2 + i, first + s, passes * size, 0)
    for s, quota in enumerate(quotas):
        flow.arc(first + s, sink, quota, 0)
    flow.solve(source, sink)
    return [sum(flow.left[e ^ 1] for e in x) for x in arcs]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """docs: doc_id, members (array of source names, null among them allowed), size (long), salt (long).

    Adds pattern, targets (array of struct source, source_size, target, for the
    document's own sources) and taken; a column named row is kept. docs is read several times, so pass a
    checkpointed or written table without texts.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_members", F.array_sort(F.array_distinct(F.transform("members", lambda s: F.struct(s.isNull().alias("none"), s.alias("name"))))))
    grouped = keyed.groupBy("_members").agg(F.sum("size").cast("bigint").alias("size"), F.count("*").alias("rows")).limit(MAX_PATTERNS + 1).collect()
    if len(grouped) > MAX_PATTERNS:
        facts, most = _alone(keyed, weights, share, passes)
        return _drawn(keyed, facts, most, seed, lambda frame: frame)
    names = sorted({(m["none"], m["name"]) for g in grouped for m in g["_members"]}, key=lambda m: (m[0], m[1] or ""))
    place = {m: i for i, m in enumerate(names)}
    patterns = [(tuple(sorted(place[m["none"], m["name"]] for m in g["_members"])), int(g["size"] or 0)) for g in grouped]
    sizes = [0] * len(names)
    for members, size in patterns:
        for s in members:
            sizes[s] += size
    target = targets(sizes, weights, share, passes, sum(n for _, n in patterns))
    given = route(patterns, [round(t) for t in target], passes)

    rows = []
    for i, (members, size) in enumerate(patterns):
        whole, rest = divmod(given[i], size) if size else (0, 0)
        rows.append((i, grouped[i]["_members"], [(names[s][1], sizes[s], target[s]) for s in members], whole, rest))
    kinds = "pattern int, _members array<struct<none:boolean,name:string>>, targets array<struct<source:string,source_size:bigint,target:double>>, whole bigint, rest bigint"
    facts = spark.createDataFrame(rows, kinds)  # MAX_PATTERNS rows at most
    return _drawn(keyed, facts, max((g["rows"] for g in grouped), default=1), seed, F.broadcast)


def _alone(keyed: DataFrame, weights: tuple[float, ...], share: float, passes: int) -> tuple[DataFrame, int]:
    """For patterns of one source each, however many: what each gives, as mix needs it, and the rows of the largest."""
    spark = keyed.sparkSession
    source = keyed.groupBy("_members").agg(F.coalesce(F.sum("size").cast("bigint"), F.lit(0)).alias("n"), F.count("*").alias("rows")).checkpoint()
    if source.where(F.size("_members") != 1).take(1):
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns, and not all are of one source")
    # Places in the order of names: by range, then within each.
    ranged = source.repartitionByRange(partitions(spark), "_members").withColumn("_p", F.spark_partition_id()).checkpoint()
    counts, before = sorted(map(tuple, ranged.groupBy("_p").count().collect())), {}  # a row a partition
    for p, n in counts:
        before[p] = sum(c for q, c in counts if q < p)
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_p"))
    ranged = ranged.withColumn("pattern", (offset + F.row_number().over(Window.partitionBy("_p").orderBy("_members")) - 1).cast("bigint"))
    ranged = ranged.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("pattern") % len(weights) + 1).cast("int")))
    ranged = ranged.withColumn("cap", (passes * F.col("n")).cast("double")).checkpoint()

    # Sources under the level give all their passes; the level rises until no more fall under it.
    level, closed = 0.0, 0
    total, most = (x or 0 for x in ranged.agg(F.sum("n"), F.max("rows")).first())
    while True:
        under = F.col("cap") <= F.lit(level) * F.col("w")
        capped, open_, count = ranged.agg(F.sum(F.when(under, F.col("cap"))), F.sum(F.when(~under, F.col("w"))), F.count(F.when(under, 1))).first()
        if not open_ or (level and count == closed):
            break
        level, closed = max(level, (share * total - (capped or 0.0)) / open_), count
    target = F.least(F.col("cap"), F.lit(level) * F.col("w"))
    given = F.rint(target).cast("bigint")
    whole = F.when(F.col("n") > 0, F.floor(given / F.col("n"))).otherwise(0).cast("bigint")
    name = F.col("_members")[0]["name"]
    facts = ranged.select("pattern", "_members", F.array(F.struct(name.alias("source"), F.col("n").alias("source_size"), target.alias("target"))).alias("targets"), whole.alias("whole"), (given - whole * F.col("n")).alias("rest"))
    return facts.checkpoint(), most


def _drawn(keyed: DataFrame, facts: DataFrame, most: int, seed: int, small) -> DataFrame:
    """The rows of keyed with what their pattern's facts take of them; most: rows of the largest pattern; small: broadcast, if facts are few."""
    bits = min(16, max(0, most // BUCKET_ROWS).bit_length())
    facts = small(facts)
    drawn = keyed.join(facts, "_members").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "salt"))
    drawn = drawn.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits).cast("int") if bits else F.lit(0))

    # At most patterns x buckets rows, each pattern at most 65,536.
    sums = drawn.where("rest > 0").groupBy("pattern", "rest", "_b").agg(F.sum("size").cast("bigint").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where("before < rest AND before + n >= rest").select("pattern", F.col("_b").alias("edge"), (F.col("rest") - F.col("before")).alias("need"))
    cut = drawn.join(small(edge), "pattern", "left")  # one row a pattern
    extra = F.coalesce((F.col("_b") < F.col("edge")).cast("bigint"), F.lit(0))
    out = ["doc_id", "size", "targets", "pattern", "taken", *(["row"] if "row" in keyed.columns else [])]
    plain = cut.where("edge IS NULL OR _b <> edge").withColumn("taken", (F.col("whole") + extra) * F.col("size")).select(out)
    order = Window.partitionBy("pattern").orderBy("_h", "doc_id", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    ordered = cut.where("_b = edge").withColumn("_sum", F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = (F.col("_sum") + F.col("size") / 2 <= F.col("need")).cast("bigint")
    return plain.unionByName(ordered.withColumn("taken", (F.col("whole") + fits) * F.col("size")).select(out))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, members (the row's own source), size in words, a salt from the text, and row, if there is one."""
    text = F.col("text").cast("string")
    return docs.select(
        "doc_id",
        F.array(F.col("source").cast("string")).alias("members"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint")).alias("size"),
        F.xxhash64(text).alias("salt"),
        *(["row"] if "row" in docs.columns else []),
    )


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    mixed = mix(sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).checkpoint())
    return mixed.select("doc_id", "size", F.col("targets")[0]["source_size"].alias("source_size"), F.col("targets")[0]["target"].alias("target"), "taken")


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of docs as often as the mix takes them: not at all, once or twice."""
    prepare(spark)
    # Rows are numbered and written, so that each of those alike in id and text has a verdict of its own.
    rows = written(packed(docs).withColumn("row", F.monotonically_increasing_id()))
    source = F.col("_rest").getField("source").alias("source")
    taken = mix(sized(rows.select("doc_id", "text", source, "row")).checkpoint())
    verdicts = taken.where("taken > 0").select("row", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return rows.join(verdicts.select("row"), "row").select(unpacked(docs.columns))
