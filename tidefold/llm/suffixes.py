"""Operator 7: repeated passages by suffix order and previous factors.

A byte goes if a LEAST-byte string that covers it also starts anywhere else.
Sorting all suffixes of a corpus is not needed for that: windows of LEAST bytes
choose, by content alone, an anchor (the GRAM-byte string of least hash inside,
the leftmost on ties), so equal windows have equal anchors. The windows of one
anchor in a text form a run, and the run's bytes its context.

1. Each text sends, for each run, the hashes of anchor and context. An anchor
   seen once has no copy. A context seen twice is wholly repeated.
2. Of anchors with several contexts each distinct context is sent once, as
   bytes, and the suffixes of an anchor's contexts are sorted (prefix doubling,
   cut at LEAST bytes). Neighbours in suffix order that agree on LEAST bytes
   give, by the positions before and after them in that order, each window's
   previous and next factor; a window with either is repeated.
3. Each text with such windows is read again and loses the bytes they cover.

An anchor with more than HOT contexts (the ends of a passage that very many
texts hold) is not sorted in one task: its windows are told apart by two
64-bit hashes, dealt by hash, and their answers are gathered by text, all as
packed arrays, so no task gets more than its share.

Natural passages are counted in words as well: 50 words have 290 to 850 bytes in
ordinary text, so nearly half of the passages of 50 to 70 words are shorter than
LEAST and lose nothing. ``shared_words`` counts the words in passages of PASSAGE
words or more that another row has too, whatever their bytes, in the same way:
anchors first, then the hashes of the windows whose anchors several texts have.

Windows that repeat inside one text are found there; only their first goes to
the corpus. ``previous_factors`` is the same computation for one text, with
exact lengths, and ``keep_first`` removes later copies alone.

Texts are one by their SHA-256, so copies of a text meet as one row; a text
with copies is wholly repeated. Runs meet by a shard of their anchor's hash as
packed arrays, 20 bytes a run, about one run for each 100 bytes of text.

Defined cases: null text counts as empty; texts shorter than LEAST lose
nothing unless longer texts repeat in them, which cannot be; rows alike in id
and text are copies of each other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import WORD, partitions, prepare, table

LEAST = 400
GRAM = 200
#: Contexts of an anchor that one task sorts; beyond, its windows are compared by hash.
HOT = 2_000
#: Words of a passage that documents share, however few bytes it has.
PASSAGE = 50
_SPAN = 1 << 20  # positions that are looked at together
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 finaliser, constants fixed."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


class Text:
    """Runs of one text's windows: low, high (window starts, both included), anchor and context (hashes); inner: starts of windows that the text itself repeats."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        n = len(self.data) - LEAST + 1
        parts: list[tuple[np.ndarray, ...]] = []
        self.inner = np.zeros(0, np.int64)
        if n > 0:
            step = _SPAN - LEAST
            for a in range(0, n, step):
                parts.append(self._span(a, min(a + step, n)))
            if len(np.unique(np.concatenate([p[2] for p in parts]))) < sum(len(p[2]) for p in parts):
                parts = self._inside(n, step)
        self.low, self.high, self.anchor, self.context = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate((np.int64, np.int64, np.uint64, np.uint64)))

    def _sums(self, a: int, b: int) -> np.ndarray:
        """Running sums of the polynomial hash over the bytes that windows a to b cover, from 0."""
        own = self.data[a : b + LEAST - 1]
        out = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_LETTERS[own] * _UP[: len(own)], out=out[1:])
        return out

    def windows(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each window that starts from low to high (included)."""
        sums, n = self._sums(low, high + 1), high - low + 1
        own = (sums[LEAST:] - sums[:n]) * _DOWN[:n]
        other = np.zeros(len(sums), np.uint64)
        np.cumsum(_mix(_LETTERS[self.data[low : high + LEAST]]) * _DOWN[: n + LEAST - 1], out=other[1:])
        return _mix(own), _mix((other[LEAST:] - other[:n]) * _UP[:n] ^ np.uint64(0x2545F4914F6CDD1D))

    def _span(self, a: int, b: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Runs of the windows that start from a up to b; keep: which of these count."""
        sums, n = self._sums(a, b), b - a
        grams = len(sums) - GRAM
        h = _mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:grams])
        # Least hash of each window, by minima from both ends of blocks; the place breaks ties to the left.
        width = LEAST - GRAM + 1
        key = h & ~np.uint64(_SPAN - 1) | np.arange(grams, dtype=np.uint64)
        padded = np.full(-(-grams // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:grams] = key
        blocks = padded.reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        best = np.minimum(right[:n], left[width - 1 : width - 1 + n])
        at = (best & np.uint64(_SPAN - 1)).astype(np.int64)
        starts = np.arange(n) if keep is None else np.flatnonzero(keep)
        at = at[starts]
        new = np.append(True, (at[1:] != at[:-1]) | (np.diff(starts) != 1))[: len(starts)]
        first = np.flatnonzero(new)
        low, high = starts[first], starts[np.append(first[1:], len(starts)) - 1] if len(first) else starts[:0]
        context = _mix((sums[high + LEAST] - sums[low]) * _DOWN[low] + _mix((high - low).astype(np.uint64) * np.uint64(512) + (at[first] - low).astype(np.uint64)))
        return low + a, high + a, h[at[first]], context

    def _inside(self, n: int, step: int) -> list[tuple[np.ndarray, ...]]:
        """Runs without the windows that an earlier one of this text equals."""
        whole = np.zeros(n, np.uint64)
        for a in range(0, n, step):
            b = min(a + step, n)
            sums = self._sums(a, b)
            whole[a:b] = _mix((sums[LEAST:] - sums[: b - a]) * _DOWN[: b - a])
        _, first, place, counts = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        self.inner = np.flatnonzero(counts[place] > 1)
        keep = np.zeros(n, bool)
        keep[first] = True
        return [self._span(a, min(a + step, n), keep[a : min(a + step, n)]) for a in range(0, n, step)]


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first depth bytes (8 or more); suffixes end in zeros. Equal prefixes have equal ranks."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : n + j]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
    length = 8
    while length < depth:
        step = min(length, depth - length)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        length += step
    return rank


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """Of each context: starts of LEAST-byte windows that start elsewhere in these contexts too."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts], np.int64)
    first = np.cumsum(lengths) - lengths
    n = lengths - LEAST + 1
    start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    rank = suffix_ranks(data, LEAST)[start]
    # In suffix order, ties by position: a window has a previous or next factor of LEAST bytes if a neighbour ranks the same.
    order = np.argsort(rank, kind="stable")
    same = rank[order][1:] == rank[order][:-1]
    found = np.zeros(len(start), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cuts = np.append(np.cumsum(n) - n, n.sum())
    return [np.flatnonzero(found[cuts[i] : cuts[i + 1]]) for i in range(len(contexts))]


def previous_factors(data: bytes) -> list[int]:
    """Longest previous factor at each position, from the previous and next smaller positions in suffix order."""
    order = sorted(range(len(data)), key=lambda i: data[i:])

    def common(i: int, j: int) -> int:
        n = 0
        while j + n < len(data) and i + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        return n

    out = [0] * len(data)
    for way in (order, order[::-1]):
        stack: list[int] = []
        for i in way:
            while stack and stack[-1] > i:
                stack.pop()
            if stack:
                out[i] = max(out[i], common(stack[-1], i))
            stack.append(i)
    return out


def keep_first(data: bytes, least: int = LEAST) -> bytes:
    """data without the bytes of later copies of passages of at least so many bytes."""
    gone = np.zeros(len(data) + 1, np.int64)
    for i, n in enumerate(previous_factors(data)):
        if n >= least:
            gone[i] += 1
            gone[i + n] -= 1
    return bytes(np.frombuffer(data, np.uint8)[np.cumsum(gone)[:-1] == 0])


def cover(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which bytes the windows that start from low to high (included) cover."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, low, 1)
    np.add.at(edges, high + LEAST, -1)
    return np.cumsum(edges)[:-1] > 0


def _bytes(cell: pa.Scalar) -> bytes:
    return (cell.as_py() or "").encode("utf-8", "surrogatepass")


def _send(shards: int):
    """Hashes of the runs of each text of a task, packed by shard; a row without runs marks a text that repeats itself."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held: list[tuple] = []
        inner: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            anchor, context, node, number = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.uint64) for i in range(4))
            shard = anchor % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for x in range(shards):
                own = order[cuts[x] : cuts[x + 1]]
                if len(own):
                    rows.append((x, *(c[own].tobytes() for c in (anchor, context, node, number))))
            rows += [(n % shards, b"", b"", np.array([n], np.int64).tobytes(), b"") for n in inner]
            kinds = [pa.int32(), *[pa.binary()] * 4]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "anchors", "contexts", "nodes", "numbers"])

        for batch in batches:
            for node, cell in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                if node in done:
                    continue
                done.add(node)
                t = Text(_bytes(cell))
                k = len(t.low)
                held.append((t.anchor, t.context, np.full(k, node, np.int64), np.arange(k, dtype=np.uint32)))
                if len(t.inner):
                    inner.append(node)
                size += k
                if size > 400_000:
                    yield flush()
                    held, inner, size = [], [], 0
        yield flush()

    return send


#: What is known of a run: every window repeats; its context goes to the suffix sort; its windows go by hash.
_WHOLE, _SORT, _HASH = 1, 2, 4


def _meet(rows: pa.Table, hot: int) -> pa.Table:
    """Of a shard: per text the numbers of its runs with their flags."""
    full = rows.filter(pa.array([len(x.as_py()) > 0 for x in rows.column("anchors")], pa.bool_()))
    alone = [np.frombuffer(x.as_py(), np.int64)[0] for x, y in zip(rows.column("nodes"), rows.column("anchors"), strict=True) if not y.as_py()]
    read = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in full.column(c)), t)
    anchor, context, node, number = read("anchors", np.uint64), read("contexts", np.uint64), read("nodes", np.int64), read("numbers", np.uint32)
    # Anchors that occur once need nothing more.
    order = np.argsort(anchor, kind="stable")
    some = np.zeros(len(anchor), bool)
    same = anchor[order][1:] == anchor[order][:-1]
    some[order[1:][same]] = some[order[:-1][same]] = True
    anchor, context, node, number = anchor[some], context[some], node[some], number[some]
    order = np.lexsort((number, node, context, anchor))
    anchor, context, node, number = anchor[order], context[order], node[order], number[order]
    once = np.append(True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]) | (node[1:] != node[:-1]) | (number[1:] != number[:-1]))[: len(anchor)]
    anchor, context, node, number = anchor[once], context[once], node[once], number[once]
    of = lambda new: np.cumsum(new) - 1
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]
    new_context = new_anchor | np.append(True, context[1:] != context[:-1])[: len(anchor)]
    copies = np.bincount(of(new_context))[of(new_context)] if len(anchor) else anchor
    contexts = np.bincount(of(new_anchor), new_context)[of(new_anchor)] if len(anchor) else anchor
    flag = (_WHOLE * (copies > 1) + np.where(contexts > hot, _HASH, _SORT) * (new_context & (contexts > 1))).astype(np.uint8)
    use = flag > 0
    node, number, flag = node[use], number[use], flag[use]
    order = np.lexsort((number, node))
    node, number, flag = node[order], number[order], flag[order]
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    ends = np.append(first[1:], len(node))[: len(first)]
    out = [(int(node[a]), number[a:b].tobytes(), flag[a:b].tobytes(), bool((flag[a:b] & (_SORT | _HASH)).any())) for a, b in zip(first, ends, strict=True)]
    out += [(int(n), b"", b"", False) for n in alone]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], ["node", "numbers", "flags", "sorts"])


def _contexts(shards: int):
    """Contexts of runs to sort, and, in rows without an anchor, packed hashes of the windows of runs to hash."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[tuple]:
            if held:
                columns = [np.concatenate([h[i] for h in held]) for i in range(4)]
                shard = columns[0] % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for x in range(shards):
                    own = order[cuts[x] : cuts[x + 1]]
                    if len(own):
                        yield x, None, None, None, b"".join(c[own].tobytes() for c in columns)
                held.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["shard", "anchor", "node", "low", "context"])

        for batch in batches:
            rows: list[tuple] = []
            for node, cell, numbers, flags in zip(batch.column("node").to_pylist(), batch.column("text"), batch.column("numbers").to_pylist(), batch.column("flags").to_pylist(), strict=True):
                data = _bytes(cell)
                t = Text(data)
                for number, flag in zip(*_joined(numbers, flags), strict=True):
                    low, high = int(t.low[number]), int(t.high[number])
                    if flag & _SORT:
                        rows.append((int(t.anchor[number] % np.uint64(shards)), int(t.anchor[number].view(np.int64)), node, low, data[low : high + LEAST]))
                    elif flag & _HASH:
                        n = high - low + 1
                        held.append((*t.windows(low, high), np.full(n, node, np.int64), np.arange(low, high + 1)))
            if sum(len(h[0]) for h in held) > 500_000:
                rows += flush()
            yield batch_of(rows)
        yield batch_of(list(flush()))

    return contexts


def _joined(numbers: list[bytes], flags: list[bytes]) -> tuple[list[int], list[int]]:
    return np.frombuffer(b"".join(numbers), np.uint32).tolist(), np.frombuffer(b"".join(flags), np.uint8).tolist()


_SORTED = "node bigint, low bigint, high bigint, home int, packed binary"


def _sort(shards: int):
    """Contexts in order of their anchors, sorted some megabytes (whole anchors) at a time: runs of repeated windows of each text. Of hashed windows, the repeated ones, packed by the home of their text."""

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["node", "low", "high", "home", "packed"])

    def sort(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows = []
        for (node, low, _), starts in zip(held, repeated_windows([h[2] for h in held]) if len(held) > 1 else [np.zeros(0, np.int64)] * len(held), strict=True):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) != 1)
                rows += [(node, low + int(a), low + int(b), None, None) for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]
        return answer(rows)

    def meet(packed: list[bytes]) -> pa.RecordBatch:
        parts = [np.frombuffer(p, np.uint64).reshape(4, -1) for p in packed]
        one, two, node, place = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        again = np.zeros(len(one), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        node, place = node[again].view(np.int64), place[again]
        home = node % shards
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(shards + 1))
        return answer([(None, None, None, x, node[own].tobytes() + place[own].tobytes()) for x in range(shards) if len(own := order[cuts[x] : cuts[x + 1]])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        packed: list[bytes] = []
        size, last = 0, None
        for batch in batches:
            for anchor, node, low, context in zip(*(batch.column(c).to_pylist() for c in ("anchor", "node", "low", "context")), strict=True):
                if node is None:
                    packed.append(context)
                    continue
                if anchor != last and size > 1_000_000:
                    yield sort(held)
                    held, size = [], 0
                last = anchor
                held.append((node, low, context))
                size += len(context)
        yield sort(held)
        if packed:
            yield meet(packed)

    return run


def _gather(rows: pa.Table) -> pa.Table:
    """Of the texts of one home: runs of repeated windows."""
    parts = [np.frombuffer(p.as_py(), np.int64).reshape(2, -1) for p in rows.column("packed")]
    node, place = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.lexsort((place, node))
    node, place = node[order], place[order]
    new = np.append(True, (node[1:] != node[:-1]) | (np.diff(place) != 1))[: len(node)]
    first = np.flatnonzero(new)
    low, high, own = place[first], place[np.append(first[1:], len(node)) - 1], node[first]
    return pa.table([own, low, high], ["node", "low", "high"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for node, cell, numbers, flags, found in zip(*(batch.column(c).to_pylist() if c != "text" else batch.column(c) for c in ("node", "text", "numbers", "flags", "found")), strict=True):
            data = _bytes(cell)
            t = Text(data)
            low, high = [t.inner], [t.inner]
            number, flag = (np.array(x, np.int64) for x in _joined(numbers or [], flags or []))
            whole = number[flag & _WHOLE > 0]
            low += [t.low[whole], np.array([f["low"] for f in found or []], np.int64)]
            high += [t.high[whole], np.array([f["high"] for f in found or []], np.int64)]
            gone = cover(len(data), np.concatenate(low), np.concatenate(high))
            kept = hashlib.sha256(t.data[~gone].tobytes()).hexdigest()
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            rows.append((node, int(gone.sum()), len(edge) // 2, kept, edge.tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["node", "n_removed", "n_spans", "kept_sha256", "edges"])


class Words:
    """Of each window of PASSAGE words of a text: its hash, and that of its anchor (the half as long string of words of least hash in it)."""

    def __init__(self, data: bytes):
        own = np.fromiter(map(_words.__getitem__, data.split()), np.uint64)
        self.windows, self.anchors = (np.zeros(0, np.uint64),) * 2
        n, gram = len(own) - PASSAGE + 1, PASSAGE // 2
        if n > 0:
            windows, anchors = [], []
            for a in range(0, n, _SPAN // 2):
                part = own[a : a + _SPAN // 2 + PASSAGE - 1]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * _UP[: len(part)], out=sums[1:])
                h = lambda w, sums=sums: _mix((sums[w:] - sums[:-w]) * _DOWN[: len(sums) - w])
                windows.append(h(PASSAGE))
                anchors.append(np.lib.stride_tricks.sliding_window_view(h(gram), PASSAGE - gram + 1).min(axis=1))
            self.windows, self.anchors = np.concatenate(windows), np.concatenate(anchors)


class _Hashes(dict):
    """Hashes of words, remembered up to a number that bounds memory alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Hashes()


_PACKED = "shard int, hashes binary, nodes binary, places binary"


def _packed(shards: int, windows: bool):
    """Anchors of each text, or its windows (and their places) whose anchors others have, packed by shard with the text's node."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, nodes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            asked = batch.column("hashes").to_pylist() if windows else [None] * len(batch)
            for node, cell, own in zip(batch.column("node").to_pylist(), batch.column("text"), asked, strict=True):
                w = Words(_bytes(cell))
                at = np.flatnonzero(np.isin(w.anchors, np.frombuffer(own, np.uint64))) if windows else None
                hashes.append(w.windows[at] if windows else np.unique(w.anchors))
                places.append(at if windows else np.zeros(len(hashes[-1]), np.int64))
                nodes.append(np.full(len(hashes[-1]), node, np.int64))
            h, n, p = np.concatenate(hashes), np.concatenate(nodes), np.concatenate(places).astype(np.uint32)
            shard = h % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            h, n, p, cuts = h[order], n[order], p[order], np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(x, h[a:b].tobytes(), n[a:b].tobytes(), p[a:b].tobytes() if windows else b"") for x, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), *[pa.binary()] * 3))], ["shard", "hashes", "nodes", "places"])

    return packed


_HOMES = "home int, nodes binary, found binary"


def _shared(windows: bool, homes: int):
    """Of a shard: the hashes that another text has too, or the places of these windows, packed by the home of their text."""

    def shared(rows: pa.Table) -> pa.Table:
        read = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), t)
        h, n = read("hashes", np.uint64), read("nodes", np.int64)
        what = read("places", np.uint32) if windows else h
        order = np.lexsort((n, h))
        h, n, what = h[order], n[order], what[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        begin = np.flatnonzero(new)
        several = n[begin] != n[np.append(begin[1:], len(n))[: len(begin)] - 1]  # nodes are in order within a hash
        again = several[np.cumsum(new) - 1]
        n, what = n[again], what[again]
        home = n % homes
        order = np.argsort(home, kind="stable")
        n, what, cuts = n[order], what[order], np.searchsorted(home[order], np.arange(homes + 1))
        out = [(x, n[a:b].tobytes(), what[a:b].tobytes()) for x, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), *[pa.binary()] * 2))], ["home", "nodes", "found"])

    return shared


def _own(rows: pa.Table, kind) -> Iterator[tuple[int, np.ndarray]]:
    """Of a home: each text's node and what was found of it, sorted, each once."""
    n, what = (np.frombuffer(b"".join(x.as_py() for x in rows.column(c)), t) for c, t in (("nodes", np.int64), ("found", kind)))
    order = np.lexsort((what, n))
    n, what = n[order], what[order]
    new = np.append(True, n[1:] != n[:-1])[: len(n)]
    once = new | np.append(True, what[1:] != what[:-1])[: len(n)]
    n, what, first = n[once], what[once], np.flatnonzero(new[once])
    for a, b in zip(first.tolist(), np.append(first[1:], len(n))[: len(first)].tolist(), strict=True):
        yield int(n[a]), what[a:b]


def _asked(rows: pa.Table) -> pa.Table:
    """Of a home: each text's hashes that others have."""
    out = [(n, h.tobytes()) for n, h in _own(rows, np.uint64)]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary()))], ["node", "hashes"])


def _covered(rows: pa.Table) -> pa.Table:
    """Of a home: the words of each text that windows at the places found cover."""
    out = [(n, int(np.minimum(np.diff(p.astype(np.int64)), PASSAGE).sum()) + PASSAGE) for n, p in _own(rows, np.uint32)]
    return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], ["node", "n_shared_words"])


def shared_words(texts: DataFrame) -> DataFrame:
    """texts: node, text; rows of one node have one text. node and n_shared_words, of those that share any with another node.

    What a shard answers is packed by home, so it makes a row a home at most,
    not a row for each text that it knows.
    """
    shards = partitions(texts.sparkSession)
    anchors = texts.mapInArrow(_packed(shards, False), _PACKED).groupBy("shard").applyInArrow(_shared(False, shards), _HOMES)
    asked = anchors.groupBy("home").applyInArrow(_asked, "node bigint, hashes binary").withColumnRenamed("node", "_n")
    again = texts.join(asked, texts["node"] == F.col("_n")).select("node", "text", "hashes")
    found = again.mapInArrow(_packed(shards, True), _PACKED).groupBy("shard").applyInArrow(_shared(True, shards), _HOMES)
    return found.groupBy("home").applyInArrow(_covered, "node bigint, n_shared_words bigint")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs: doc_id, text. Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, edges (begin and end of each removed span, bytes) and n_shared_words.

    An anchor with more than hot contexts is compared by hash. n_shared_words
    is the number of words of the whole text that lie in passages of PASSAGE
    words or more which another row has too.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    node = F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint")  # 60 bits name a text
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    facts = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), sha.alias("sha"), node.alias("node"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words")).checkpoint()
    long = rows.where(F.octet_length("text") >= LEAST).select("doc_id", node.alias("node"), "text")
    shards = partitions(spark)
    sent = long.select("node", "text").mapInArrow(_send(shards), "shard int, anchors binary, contexts binary, nodes binary, numbers binary")
    met = sent.groupBy("shard").applyInArrow(lambda rows: _meet(rows, hot), "node bigint, numbers binary, flags binary, sorts boolean")
    met = met.groupBy("node").agg(F.collect_list("numbers").alias("numbers"), F.collect_list("flags").alias("flags"), F.max("sorts").alias("sorts"))
    # Of each text one row is read again; texts with copies are settled without.
    texts = facts.groupBy("node").agg(F.min("doc_id").alias("_first"), F.count("*").alias("copies"))
    met = met.join(texts, "node").checkpoint()
    same = [long["node"] == F.col("_n"), long["doc_id"].eqNullSafe(F.col("_first"))]
    asked = met.where("sorts").select(F.col("node").alias("_n"), "_first", "numbers", "flags")
    # Rows alike in id and text may come twice here; such a text is settled already, and what others have in common with it is not changed.
    contexts = long.join(asked, same).select("node", "text", "numbers", "flags").mapInArrow(_contexts(shards), "shard int, anchor bigint, node bigint, low bigint, context binary")
    found = contexts.repartition(shards, "shard").sortWithinPartitions("shard", "anchor").select("anchor", "node", "low", "context").mapInArrow(_sort(shards), _SORTED).checkpoint()
    hashed = found.where("home IS NOT NULL").groupBy("home").applyInArrow(_gather, "node bigint, low bigint, high bigint")
    found = found.where("home IS NULL").select("node", "low", "high").unionByName(hashed)
    found = found.groupBy("node").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    work = met.where("copies = 1").join(found, "node", "left").select(F.col("node").alias("_n"), "_first", "numbers", "flags", "found")
    done = long.join(work, same).select("node", "text", "numbers", "flags", "found").mapInArrow(_strip, "node bigint, n_removed bigint, n_spans bigint, kept_sha256 string, edges array<bigint>")
    words = shared_words(rows.where(F.octet_length("text") >= 2 * PASSAGE - 1).select(node.alias("node"), "text"))
    out = facts.join(texts, "node").join(done, "node", "left").join(words, "node", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LEAST)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    pick = lambda gone, else_: F.when(all_gone, gone).otherwise(else_)
    return out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        pick(F.lit(1).cast("bigint"), F.coalesce("n_spans", F.lit(0).cast("bigint"))).alias("n_spans"),
        pick(nothing, F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        pick(F.array(F.lit(0).cast("bigint"), F.col("n_bytes")), F.coalesce("edges", F.array().cast("array<bigint>"))).alias("edges"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE), F.col("n_words")).otherwise(F.coalesce("n_shared_words", F.lit(0).cast("bigint"))).alias("n_shared_words"),
    )


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repeated_spans(table(spark, sf_dir, "documents")).drop("edges")
