"""Operator 4: best-fit packing of tokenised documents into sequences.

Method: bulk-synchronous best fit. Lengths and gaps are integers of at most
``capacity``, so the range-sorted documents and the range-sorted gaps are kept
run-length encoded: a class per length and a class per gap, the latter a list
of ranges of sequence numbers. A superstep takes the longest unplaced class
and sweeps the gap classes upwards from its length (the successor search).
Every sequence of a gap class gets as many documents as fit, in the order of
the documents' rank within their class, which settles conflicts; the gap
classes are updated, and the next superstep begins. This is exactly best-fit
decreasing, in time that depends on ``capacity`` and not on the row count.
Only the histogram (at most ``capacity`` rows) reaches the driver; ranks are
counted and placements applied on the executors.

Defined cases: null or empty text is a document of the separator alone;
repeated rows are packed once per row; an empty table gives no rows; other
columns of the input are ignored; lengths over ``capacity`` are cut into full
pieces with the shorter piece first.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import partitions, prepare, table

CAPACITY = 2048
SEPARATOR = 0
#: Words whose ids a Python worker remembers, a bound on memory alone.
REMEMBERED = 400_000
#: A class of one length is ranked in groups of about a task's share of all rows over this, in 256 groups at most.
SHARE = 4

_encoders: dict[str, _Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, with a memory of words.

    A single space between two visible characters always begins a token of the
    byte-level splitter, so a text falls into independent words there.
    """

    _cut = re.compile(r"(?<=\S) (?=\S)")
    _double = re.compile(r"\s\s")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary as merge ranks, where the file's merges are in the order of their ids; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"] and spec["model"].get("type", "BPE") == "BPE" and not spec["model"].get("ignore_merges")
        if not plain:
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [spec["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if made != sorted(made) or len(vocab) != 256 + len(made):
            return None
        # The published splitting pattern of byte-level BPE, a fixed value.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})

    def word(self, w: str) -> bytes:
        if self.fast is None or any(s in w for s in self.special):
            ids = self.slow.encode(w, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(w)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if self.fast is None:
            return self.word(text)
        words = self._cut.split(text) if self._double.search(text) else text.split(" ")
        known, out, first = self.known, [], True
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if not first:
                w = " " + w
            first = False
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) < 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise doc_id, text into pieces: doc_id, piece, start, length, ids_crc32 and, if asked, token_ids (binary)."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", token_ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = struct.pack("<I", SEPARATOR)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, take, k = 0, n % capacity or capacity, 0
                while start < n:
                    part = ids[4 * start : 4 * (start + take)]
                    rows.append((doc_id, k, start, take, zlib.crc32(part), *[part] * keep_ids))
                    start, take, k = start + take, capacity, k + 1
            columns = list(zip(*rows, strict=True)) or [()] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "token_ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[: len(columns)])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over classes.

    counts: documents by length. Returns runs (length, first rank, documents a
    sequence, first sequence, offset): the document of rank r in its class goes
    to the run with the last first rank <= r.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for gap in sorted(g for g in gaps if g >= length):
            if not left:
                break
            each, ranges, kept = gap // length, gaps.pop(gap), []
            for first, n in ranges:
                full, part = min(n, left // each), 0
                if full:
                    runs.append((length, rank, each, first, capacity - gap))
                    gaps.setdefault(gap - each * length, []).append((first, full))
                    rank, left = rank + full * each, left - full * each
                if full < n and left:
                    runs.append((length, rank, each, first + full, capacity - gap))
                    gaps.setdefault(gap - left * length, []).append((first + full, 1))
                    rank, left, part = rank + left, 0, 1
                if full + part < n:
                    kept.append((first + full + part, n - full - part))
            if kept:
                gaps.setdefault(gap, []).extend(kept)
        if left:
            each = capacity // length
            full, part = divmod(left, each)
            runs.append((length, rank, each, opened, 0))
            if full:
                gaps.setdefault(capacity - each * length, []).append((opened, full))
            if part:
                gaps.setdefault(capacity - part * length, []).append((opened + full, 1))
            opened += full + bool(part)
        gaps.pop(0, None)
    return runs


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to capacity.

    items is read three times, so pass a checkpointed or written table. order
    must settle every tie that matters; rows equal in it are interchangeable.
    """
    spark = items.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a length is outside 1 to capacity")
    group = max(1_000, sum(counts.values()) // (SHARE * partitions(spark)))
    buckets = max(1, min(256, max(counts.values(), default=0) // group + 1))
    bucketed = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    ranked = bucketed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1)
    if buckets == 1:
        at = {(x, 0): 0 for x in counts}
    else:
        at, total = {}, dict.fromkeys(counts, 0)
        for r in sorted(bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("n")).collect()):  # at most 256 * capacity rows
            at[r["length"], r["_bucket"]] = total[r["length"]]
            total[r["length"]] += r["n"]
    before = np.zeros((capacity + 1, buckets), np.int64)
    for (length, bucket), n in at.items():
        before[length, bucket] = n
    runs = np.array(sorted(plan(counts, capacity)) or np.zeros((0, 5)), np.int64)
    shared = spark.sparkContext.broadcast((before, runs))  # bounded by capacity, not by rows
    names = [f.name for f in items.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = shared.value
        # Runs are sorted by (length, first rank); both fit one 64-bit key.
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, bucket = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_bucket"))
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) + before[length, bucket]
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            step = rank - run[:, 1]
            sequence = run[:, 3] + step // run[:, 2]
            offset = run[:, 4] + step % run[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return pack(pieces(docs, str(public_tokenizers.path("byte_bpe_50k.json"))).checkpoint())
