"""Operator 6: document fingerprints by a randomised edit embedding.

A walk over the characters of a text copies, at step j, the character it
stands on and then moves on or stays, as a coin that all documents share for
(j, character) falls. Edit distance becomes Hamming distance between the
copies: after an edit two walks meet again. A fingerprint samples bits of the
copy: step j is sampled at level l if a shared hash of j ends in l zero bits,
and the level is the least at which about SAMPLES bits or fewer remain, so the
samples of one level hold those of the next. Likeness is the agreement of two
fingerprints over the coarser of their levels, rescaled so that chance is 0;
what only the longer one has counts as chance.

``similar`` finds pairs: bands of sampled bits are keys, and all members of a
band are compared with one another. A band of more than BLOCK documents is
dealt into blocks, and each two blocks meet in a task of their own, so no task
holds a hot band; the comparisons still grow with the square of a band, and
the pairs with the square of a group of near copies.

Documents are dealt into ranges of ids (approximate quantiles), so a text
crosses the network once; the first document of each range goes to its
neighbour range as well, for the last one there to see.

Defined cases: null text counts as empty; a null id comes after all others;
rows alike in id are ordered by text, descending; a table of one row is its
own next document; equal texts have equal fingerprints and two empty ones are
alike (1); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tidefold.llm.common import partitions, prepare, table

SAMPLES = 512
RANGE_BYTES = 24 << 20
#: Bits of a band of ``similar``, and the likeness that verifies a pair.
BAND, LIKE = 16, 0.7
#: Documents of a band that are compared at once, and rows of bands that one group holds, about.
BLOCK, SHARD_ROWS = 2_000, 50_000
_AHEAD = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 finaliser, constants fixed."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@cache
def _shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first size steps: level, coin multiplier and bit multiplier."""
    h = _mix(np.arange(size, dtype=np.uint64))
    low = h & (~h + np.uint64(1))
    level = np.log2(low.astype(np.float64)).astype(np.int8)
    h = _mix(h)
    return level, (h & np.uint64(0xFFFFFFFF) | np.uint64(1)).astype(np.uint32), (h >> np.uint64(32) | np.uint64(1)).astype(np.uint32)


def shared(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _shared(1 << max(12, int(n).bit_length()))


def level_of(n: int) -> int:
    """Twice as many steps as characters are expected."""
    return max(0, (2 * n - 1).bit_length() - SAMPLES.bit_length() + 1) if n else 0


def fingerprints(texts: list[str]) -> list[str]:
    """level:number of bits:bits in hexadecimal, of each text; texts of like length walk together."""
    out = [""] * len(texts)
    by: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        by.setdefault(level_of(len(t)), []).append(i)
    for level, group in by.items():
        group.sort(key=lambda i: len(texts[i]))
        for a in range(0, len(group), 8192):
            _walk(texts, level, group[a : a + 8192], out)
    return out


def _walk(texts: list[str], level: int, group: list[int], out: list[str]) -> None:
    lengths = np.array([len(texts[i]) for i in group], np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths + _AHEAD)))[:-1]
    flat = np.zeros(int((lengths + _AHEAD).sum()) + 1, np.uint8)
    for i, b, n in zip(group, begin.tolist(), lengths.tolist(), strict=True):
        flat[b : b + n] = (np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    at, end, live = begin.copy(), begin + lengths, np.arange(len(group))
    steps = np.zeros(len(group), np.int64)  # taken until the text was used up
    kept, rows, j = [], [], 0
    live, at_, end_ = live[lengths > 0], at[lengths > 0], end[lengths > 0]
    while len(live):
        levels, coins, bits = shared(j + _AHEAD)
        for j in range(j, j + _AHEAD):  # noqa: B020
            letter = flat[at_].astype(np.uint32) + np.uint32(1)
            if levels[j] >= level:
                kept.append((live, (letter * bits[j] >> np.uint32(31)).astype(np.uint8)))
                rows.append(j)
            at_ = at_ + (letter * coins[j] >> np.uint32(31))
            done = at_ >= end_
            if done.any():
                fresh = live[done & (steps[live] == 0)]
                steps[fresh] = j + 1
                if done.sum() * 4 > len(live) or j % 16 == 15:
                    stay = ~done
                    live, at_, end_ = live[stay], at_[stay], end_[stay]
                    if not len(live):
                        break
        j += 1
    grid = np.zeros((len(rows), len(group)), np.uint8)
    for r, (who, bit) in enumerate(kept):
        grid[r, who] = bit
    counts = np.searchsorted(np.array(rows, np.int64), steps)
    for g, i in enumerate(group):
        n = int(counts[g])
        out[i] = f"{level}:{n}:{np.packbits(grid[:n, g]).tobytes().hex()}"


def _bits(fingerprint: str, level: int) -> np.ndarray:
    """The fingerprint's bits at its own level or a coarser one."""
    own, n, text = fingerprint.split(":")
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(text), np.uint8), count=int(n))
    return bits if int(own) == level else bits[_sampled(int(own), int(n)) >= level]


@cache
def _sampled(level: int, n: int) -> np.ndarray:
    """Levels of the first n steps sampled at level."""
    size = max(1, n) << level
    while len(found := (levels := shared(size)[0])[levels >= level]) < n:
        size *= 2
    return found[:n]


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    level = max(int(x.split(":", 1)[0]) for x in (a, b))
    x, y = _bits(a, level), _bits(b, level)
    n, most = min(len(x), len(y)), max(len(x), len(y))
    return max(0.0, (2 * int((x[:n] == y[:n]).sum()) - n) / most) if n else 0.0


def bands(fingerprint: str) -> list[str]:
    """Keys of the fingerprint's bands at its level and at the next coarser one, so neighbours in length share keys."""
    level = int(fingerprint.split(":", 1)[0])
    out = []
    for x in (level, level + 1):
        bits = _bits(fingerprint, x)
        out += [f"{x}:{i}:{np.packbits(bits[i : i + BAND]).tobytes().hex()}" for i in range(0, len(bits) - BAND + 1, BAND)]
    return out


def _agreement(bits: list[np.ndarray]) -> np.ndarray:
    """Likeness of each two, all of one level."""
    n = np.array([len(x) for x in bits], np.int64)
    signs = np.zeros((len(bits), max(1, int(n.max()))), np.float32)
    for row, x in zip(signs, bits, strict=True):
        row[: len(x)] = x.astype(np.float32) * 2 - 1
    return np.maximum(0.0, (signs @ signs.T).astype(np.float64) / np.maximum(1, np.maximum(n[:, None], n[None, :])))  # sums of under 2**24 signs are exact


def _compare(least: float, schema: pa.Schema):
    """Of cells of bands (two blocks, or one with itself): the pairs that are alike."""

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("band", "ascending"), ("low", "ascending"), ("high", "ascending")])
        ids, prints, band, low, high, own = (rows.column(c).to_pylist() for c in ("doc_id", "fingerprint", "band", "low", "high", "own"))
        out, a, known = [], 0, {}

        def bits(i: int, level: int) -> np.ndarray:
            if (key := (prints[i], level)) not in known:
                known[key] = _bits(*key)
            return known[key]

        while a < len(ids):
            b = a + 1
            while b < len(ids) and (band[b], low[b], high[b]) == (band[a], low[a], high[a]):
                b += 1
            if b - a > 1:
                level = int(band[a].split(":", 1)[0])
                grid = _agreement([bits(i, level) for i in range(a, b)])
                finer = [i for i in range(a, b) if int(prints[i].split(":", 1)[0]) < level]
                if len(finer) > 1:  # two of the finer level are compared there
                    at = np.array(finer) - a
                    grid[np.ix_(at, at)] = _agreement([bits(i, level - 1) for i in finer])
                side = np.array(own[a:b])
                meet = np.triu(grid >= least, 1) & ((side[:, None] != side[None, :]) | (low[a] == high[a]))
                for i, j in zip(*np.nonzero(meet), strict=True):
                    x, y = ids[a + i], ids[a + j]
                    if x != y:
                        out.append((max(x, y), min(x, y), float(grid[i, j])))
            a = b
        return pa.table([pa.array([r[k] for r in out], schema.field(k).type) for k in range(3)], schema=schema)

    return compare


def similar(prints: DataFrame, least: float = LIKE) -> DataFrame:
    """prints: doc_id, fingerprint. Pairs (doc_id, other, likeness), other the lesser id, of all that share a band and are at least so alike; a null id has no pairs. Of documents alike in fingerprint the least id stands for all; the others are paired with it."""
    spark = prints.sparkSession
    prints = prints.where(F.col("doc_id").isNotNull())
    one = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    cut = F.udf(bands, "array<string>", useArrow=True)
    keys = one.select("doc_id", "fingerprint", F.explode(cut("fingerprint")).alias("band"))
    blocks = keys.groupBy("band").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = int(blocks.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0)
    dealt = keys.join(blocks.where("blocks > 1").select("band", "blocks"), "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc_id", "fingerprint"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("doc_id", "fingerprint", "band", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own")
    cells = cells.withColumn("shard", F.pmod(F.xxhash64("band", "low", "high"), F.lit(max(partitions(spark), -(-rows // SHARD_ROWS)))).cast("int"))
    kind = prints.schema["doc_id"].dataType
    pair = to_arrow_schema(StructType([StructField("doc_id", kind), StructField("other", kind), StructField("likeness", DoubleType())]))
    found = cells.groupBy("shard").applyInArrow(_compare(least, pair), f"doc_id {kind.simpleString()}, other {kind.simpleString()}, likeness double")
    verified = found.groupBy("doc_id", "other").agg(F.max("likeness").alias("likeness"))
    copies = prints.join(one.select("fingerprint", F.col("doc_id").alias("other")), "fingerprint").where("doc_id <> other")
    return verified.unionByName(copies.select("doc_id", "other", F.lit(1.0).alias("likeness")))


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _range(rows: pa.Table) -> pa.Table:
    """One range of ids with the document after it, in descending order."""
    rows = rows.sort_by([("guest", "ascending"), ("_key", "descending")])
    ids, keys, guest, texts = (rows.column(c).to_pylist() for c in ("doc_id", "_key", "guest", "text"))
    order = sorted(range(len(ids)), key=lambda i: (guest[i], -keys[i]))
    i = 0
    while i < len(order):  # rows alike in id go by text, descending
        j = i + 1
        while j < len(order) and (guest[order[j]], keys[order[j]]) == (guest[order[i]], keys[order[i]]):
            j += 1
        if j - i > 1:
            order[i:j] = sorted(order[i:j], key=lambda r: texts[r].encode(), reverse=True)
        i = j
    texts, n = [texts[i] for i in order], len(order) - 1  # the guest is last
    edited = []
    for t, after in zip(texts[:n], texts[1:], strict=True):
        m = len(t) // 3
        edited.append(t[: len(t) - m] + after[:m])
    prints, edits = fingerprints(texts), fingerprints(edited)
    columns = [
        [ids[i] for i in order[:n]],
        [len(t) for t in texts[:n]],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        prints[:n],
        edits,
        [likeness(a, b) for a, b in zip(prints, edits, strict=False)],
        [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)],
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and the fingerprints of each text and of the text with its last third replaced by the next document's beginning."""
    least = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(least)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return docs.sparkSession.createDataFrame([], _OUT)
    ranges = max(1, min(partitions(docs.sparkSession), size // (1 << 20)), -(-size // RANGE_BYTES))
    cuts = sorted(set(rows.approxQuantile("_key", [i / ranges for i in range(1, ranges)], 1 / (20 * ranges)))) if ranges > 1 else []
    cuts = [int(c) for c in cuts]
    # The number of cuts at or under the id; found by halving, so the expression stays shallow.
    def place(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("_key") >= F.lit(cuts[mid]), place(mid + 1, high)).otherwise(place(low, mid))

    rows = rows.withColumn("range", place(0, len(cuts)).cast("int"))
    heads = sorted((r["range"], r["k"]) for r in rows.groupBy("range").agg(F.max("_key").alias("k")).collect())  # a row a range
    to = {k: heads[(i + 1) % len(heads)][0] for i, (_, k) in enumerate(heads)}
    head = rows.where(F.col("_key").isin([k for _, k in heads])).groupBy("_key").agg(F.max("text").alias("text"))
    where = F.element_at(F.create_map(*(F.lit(x) for kv in to.items() for x in kv)), F.col("_key"))
    guests = head.select(F.lit(None).cast("bigint").alias("doc_id"), "text", "_key", where.cast("int").alias("range"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests).groupBy("range").applyInArrow(_range, _OUT)


def op6_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fingerprint_documents(table(spark, sf_dir, "documents"))
