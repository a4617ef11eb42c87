"""Operator 2: language-model scoring by prediction by partial matching.

The model is a byte-context trie of order ORDER with escape estimation by
method D and symbol exclusion, trained on the rows outside the held-out fold.
A text is its UTF-8 bytes and an end symbol; contexts before the first byte
are padded. Its score is the log10 probability of that string. A unigram model
of lower-cased words with add-one smoothing (the base) is scored beside it.

Distribution. Documents are dealt by hash into blocks of about BLOCK bytes.
A block sorts its own n-grams and words and sends, shard by shard, each
distinct n-gram and word once with its training count. A shard of n-grams is
all contexts that share their last two bytes, so every context of order 2 and
more meets its suffixes there; a shard holds at most 2 ** 40 keys and in text
far fewer. Orders 0 and 1 (at most 65,536 counts) are broadcast. The shard
computes the probability of each n-gram once, whatever number of times it
occurs, and answers each block in the block's own order; the block then adds
up its documents. With exclusion, what an n-gram costs depends only on counts
of its suffixes, because the symbols seen after a context were all seen after
its suffix. What is sent is sorted, differenced and compressed; logarithms
travel as 32-bit floats (a relative error of 1e-7) and are summed as doubles.

Defined cases: null text counts as empty and has the end alone; a table
without training rows gives uniform bytes and counts of 0; an empty table
gives no rows; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import id_fold, partitions, prepare, table

ORDER = 5
BLOCK = 12 << 20
FOLDS, HELD_OUT = 7, 2
#: Neither byte occurs in UTF-8. PAD is context only, END ends a text; so 255 symbols can be coded.
PAD, END, SYMBOLS = 0xFE, 0xFF, 255
_STEP = 1 << 21
#: Texts of a block whose windows are sorted together.
PIECE = 1 << 16

_SENT = "block int, shard int, kind int, keys binary, counts binary, n_train bigint, n_docs bigint"
_ANSWER = "block int, shard int, kind int, found bigint, answers binary"


class Block:
    """Distinct n-grams and words of a block of (text bytes, is training) documents.

    A window of ORDER + 1 bytes is its value, 48 bits, and the number of its
    text in PIECE texts, 16 bits. Sorted, the windows of one n-gram lie side by
    side, and so are counted and summed by text without a look-up.
    """

    def __init__(self, texts: list[bytes], train: list[bool]):
        pad, end = bytes([PAD]) * ORDER, bytes([END])
        data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
        self.lengths = np.array([len(t) + 1 for t in texts], np.int64)  # windows of each text
        self.first = np.concatenate(([0], np.cumsum(self.lengths + ORDER)))[:-1]
        n = max(0, len(data) - ORDER)
        self.valid = np.ones(n, bool)  # windows that do not begin in one text and end in the next
        for i in range(ORDER):
            over = self.first[1:] - 1 - i
            self.valid[over] = False
        taught = np.array(train, np.int64)
        self.pieces: list[tuple[int, np.ndarray, np.ndarray]] = []
        values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(texts), PIECE):
            high = min(low + PIECE, len(texts))
            a, b = int(self.first[low]), int(self.first[high - 1] + self.lengths[high - 1])
            key = np.zeros(b - a, np.uint64)
            for i in range(ORDER + 1):
                key <<= np.uint64(8)
                key |= data[a + i : b + i]
            key <<= np.uint64(16)
            key |= np.repeat(np.arange(high - low, dtype=np.uint16), self.lengths[low:high] + ORDER)[: b - a]
            key = key[self.valid[a:b]]
            key.sort()
            new = np.ones(len(key), bool)
            for x in range(1, len(key), _STEP):
                y = min(x + _STEP, len(key))
                new[x:y] = (key[x:y] ^ key[x - 1 : y - 1]) >> np.uint64(16) != 0
            begin = np.flatnonzero(new)
            del new
            self.pieces.append((low, key, begin))
            values.append((key[begin] >> np.uint64(16)).astype(np.int64))
            counts.append(np.zeros(len(begin), np.int64))
            for x, y, of in self._steps(key, begin):
                counts[-1][x:y] = np.add.reduceat(taught[low + of], begin[x:y] - begin[x])
        if len(self.pieces) == 1:
            self.values, self.counts = values[1], counts[1]
        else:
            self.values = np.unique(np.concatenate(values))
            self.counts = np.zeros(len(self.values), np.int64)
            for v, c in zip(values, counts, strict=True):
                self.counts[np.searchsorted(self.values, v)] += c

    @staticmethod
    def _steps(key: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Ranges of n-grams of a few million windows, and the texts of these."""
        x = 0
        while x < len(begin):
            y = max(x + 1, int(np.searchsorted(begin, begin[x] + _STEP)))
            yield x, y, (key[begin[x] : begin[y] if y < len(begin) else len(key)] & np.uint64(PIECE - 1)).astype(np.int64)
            x = y

    def sums(self, of_value: np.ndarray) -> np.ndarray:
        """Sum over each text's windows, a few million windows at a time."""
        out = np.zeros(len(self.lengths))
        for low, key, begin in self.pieces:
            own = of_value if len(self.pieces) == 1 else of_value[np.searchsorted(self.values, (key[begin] >> np.uint64(16)).astype(np.int64))]
            for x, y, of in self._steps(key, begin):
                found = np.bincount(of, np.repeat(own[x:y], np.diff(np.append(begin[x:y], begin[x] + len(of)))))
                out[low : low + len(found)] += found
        return out

    def order(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams, by shard and value, and where each shard begins."""
        shard = ((self.values >> 8 & 0xFFFF) * 40503 % 65521 % shards).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        return by, np.searchsorted(shard[by], np.arange(shards + 1))


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _zip().compress(data, asbytes=True)


def _spread(data: bytes) -> bytes:
    return _zip().decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _zip() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at the six ASCII white-space bytes."""
    return text.lower().split()


def _by_shard(words: set[bytes], shards: int) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in range(shards)]
    for w in sorted(words):
        out[zlib.crc32(w) % shards].append(w)
    return out


def _texts(rows: pa.Table) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in rows.column("text")]


def code_lengths(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each n-gram: keys (sorted, distinct, of ORDER context bytes and a symbol) hold every n-gram of the contexts they name; pairs: counts of order 1, 256 by 256."""
    ones = pairs.sum(axis=0)
    # Orders 0 and 1 whole; then, from the keys, orders 2 and up.
    low_c = [ones[None, :], pairs]
    total = [c.sum(axis=1) for c in low_c]
    kinds = [(c > 0).sum(axis=1) for c in low_c]
    chance = np.full(256, 1.0 / max(1, SYMBOLS - int(kinds[0][0])))  # order -1
    # g: probability of a symbol not seen in its context, given that context's exclusions.
    excluded = (low_c[0] * (pairs > 0)).sum(axis=1)
    g1 = _after(low_c[0], total[0][:, None], kinds[0][:, None], excluded[:, None], kinds[1][:, None], np.broadcast_to(chance, pairs.shape))
    levels = [(keys, counts)]
    up = []
    for k in range(ORDER - 1, 1, -1):
        low, place = np.unique(levels[-1][0] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        up.append(place)
        levels.append((low, np.bincount(place, levels[-1][1], len(low)).astype(np.int64)))
    w_c, w_total, w_kinds, g = pairs, total[1], kinds[1], g1
    w_c, w_total, w_kinds, g = (x[levels[-1][0] >> 8 & 0xFF, levels[-1][0] & 0xFF] if x.ndim == 2 else x[levels[-1][0] >> 8 & 0xFF] for x in (w_c, w_total, w_kinds, g))
    for level in range(len(levels) - 1, -1, -1):
        key, c = levels[level]
        context = key >> 8
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        each = np.diff(np.append(begin, len(key)))
        add = lambda x, begin=begin, each=each: np.repeat(np.add.reduceat(x, begin), each)
        v_total, v_kinds, v_excluded = add(c), add((c > 0).astype(np.int64)), add(np.where(c > 0, w_c, 0))
        g = _after(w_c, w_total, w_kinds, v_excluded, v_kinds, g)
        if level:
            place = up[level - 1]
            w_c, w_total, w_kinds, g = c[place], v_total[place], v_kinds[place], g[place]
    whole = np.maximum(2 * v_total, 1)
    return np.log10(np.where(c > 0, (2 * c - 1) / whole, np.where(v_total > 0, v_kinds / whole, 1.0) * g))


def _after(c, total, kinds, excluded, seen, lower):
    """Chance of a symbol in a context of the given counts once those seen after the longer context are excluded."""
    rest, new = total - excluded, kinds - seen
    safe = np.maximum(2 * rest, 1)
    return np.where(rest <= 0, lower, np.where(c > 0, (2 * c - 1) / safe, new / safe * lower))


def _send(shards: int):
    def send(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        texts, train = _texts(rows), rows.column("train").to_pylist()
        built = Block(texts, train)
        by, cuts = built.order(shards)
        seen: Counter = Counter()
        rest: set[bytes] = set()
        n_train = 0
        for t, taught in zip(texts, train, strict=True):
            words = _words(t)
            if taught:
                seen.update(words)
                n_train += len(words)
            else:
                rest.update(words)
        out = []
        for shard, words in enumerate(_by_shard(rest.union(seen), shards)):
            if words or shard == 0:
                totals = (n_train, sum(train)) if shard == 0 else (0, 0)
                out.append((block, shard, 0, _squeeze(b" ".join(words)), _squeeze(np.array([seen[w] for w in words], np.uint32).tobytes()), *totals))
            part = by[cuts[shard] : cuts[shard + 1]]
            if len(part):
                out.append((block, shard, 1, _squeeze(np.diff(built.values[part], prepend=0).tobytes()), _squeeze(built.counts[part].astype(np.uint32).tobytes()), 0, 0))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "shard", "kind", "keys", "counts", "n_train", "n_docs"])

    return send


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of order 1 of each batch."""
    for batch in batches:
        total = np.zeros(1 << 16, np.int64)
        for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
            pair = np.cumsum(np.frombuffer(_spread(keys.as_py()), np.int64)) & 0xFFFF
            total += np.bincount(pair, np.frombuffer(_spread(counts.as_py()), np.uint32), 1 << 16).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def _answer(shared):
    def answer(rows: pa.Table) -> pa.Table:
        kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
        blocks, sent = rows.column("block").to_pylist(), [_spread(c.as_py()) for c in rows.column("keys")]
        counts = [np.frombuffer(_spread(c.as_py()), np.uint32) for c in rows.column("counts")]
        answers, found = [], 0
        if kind == 0:
            lists = [k.split(b" ") if k else [] for k in sent]
            total: dict[bytes, int] = {}
            for words, n in zip(lists, counts, strict=True):
                for w, c in zip(words, n.tolist(), strict=True):
                    total[w] = total.get(w, 0) + c
            found = sum(c > 0 for c in total.values())
            answers = [_squeeze(np.array([total[w] for w in words], np.int64).tobytes()) for words in lists]
        else:
            parts = [np.cumsum(np.frombuffer(k, np.int64)) for k in sent]
            keys, place = np.unique(np.concatenate(parts), return_inverse=True)
            logs = code_lengths(keys, np.bincount(place, np.concatenate(counts), len(keys)).astype(np.int64), shared.value)[place]
            answers = [_squeeze(a.astype(np.float32).tobytes()) for a in np.split(logs, np.cumsum([len(p) for p in parts])[:-1])]
        n = len(blocks)
        return pa.table(
            [pa.array(blocks, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([found] + [0] * (n - 1), pa.int64()), pa.array(answers, pa.binary())],
            ["block", "shard", "kind", "found", "answers"],
        )

    return answer


def _add(shards: int, train_words: int, train_docs: int, distinct: int):
    below = np.log10(train_words + train_docs + distinct + 1)
    end = np.log10(train_docs + 1)

    def add(rows: pa.Table, back: pa.Table) -> pa.Table:
        texts = _texts(rows)
        answers: dict[tuple[int, int], bytes] = {(k, s): a.as_py() for k, s, a in zip(back.column("kind").to_pylist(), back.column("shard").to_pylist(), back.column("answers"), strict=True)}
        built = Block(texts, [False] * len(texts))
        by, cuts = built.order(shards)
        logs = np.zeros(len(built.values))
        for shard in range(shards):
            if cuts[shard] < cuts[shard + 1]:
                logs[by[cuts[shard] : cuts[shard + 1]]] = np.frombuffer(_spread(answers[1, shard]), np.float32)
        scores = built.sums(logs)
        del built
        words: set[bytes] = set()
        for t in texts:
            words.update(_words(t))
        value: dict[bytes, float] = {}
        for shard, own in enumerate(_by_shard(words, shards)):
            if own:
                value.update(zip(own, np.log10(np.frombuffer(_spread(answers[0, shard]), np.int64) + 1.0).tolist(), strict=True))
        n_tokens, n_known, base = [], [], []
        for t in texts:
            values = [value[w] for w in _words(t)]
            n = len(values) + 1
            n_tokens.append(n)
            n_known.append(n - 1 - values.count(0.0) + (train_docs > 0))
            base.append(sum(values) + end - n * below)
        return pa.table(
            [rows.column("doc_id"), rows.column("train"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())],
            ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"],
        )

    return add


def score(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text, train (boolean). Returns doc_id, train, n_tokens, n_known, base_score, score and train_tokens."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "train")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, min(partitions(spark), size // (1 << 20)), -(-size // block))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))
    sent = dealt.groupBy("block").applyInArrow(_send(blocks), _SENT).checkpoint()
    train_words, train_docs = (int(x or 0) for x in sent.where("kind = 0").agg(F.sum("n_train"), F.sum("n_docs")).first())
    pairs = np.zeros((256, 256), np.int64)
    for r in sent.where("kind = 1").select("keys", "counts").mapInArrow(_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[r["pair"] >> 8, r["pair"] & 0xFF] = r["n"]
    answers = sent.groupBy("kind", "shard").applyInArrow(_answer(spark.sparkContext.broadcast(pairs)), _ANSWER).checkpoint()
    distinct = int(answers.agg(F.sum("found")).first()[0] or 0) + (train_docs > 0)
    schema = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_add(blocks, train_words, train_docs, distinct), schema)
    return scored.withColumn("train_tokens", F.lit(train_words + train_docs).cast("bigint"))


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text", (id_fold(F.col("doc_id"), FOLDS) != HELD_OUT).alias("train")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
