"""Operator 5: n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles, as 64-bit hashes. Sizes
are cut into bands so that similar sets lie in one band or in neighbours; each
set signs for its own band and the next. Within a band, sets at least as
similar as the threshold differ in at most k shingles. The hash domain is
partitioned into G groups of 3 parts, G = ceil((k + 1) / 2) + E: some E + 1
groups then hold at most one difference each, so two of their parts are equal,
and each choice of two parts of a group is a signature. As up to E groups can
be spared, a set leaves out the signatures of fewer than w shingles, w as large
as at most E groups have such ones: of two similar sets the one with the larger
w has a good group without them, and the other signs for it too. So similar
sets share a signature without exception, and seldom one that says little.

Copies of a set are one vertex from the start. A bucket is first split by what
cannot link: the odd sketches of two sets (the parity of the shingles in each
of about as many cells as there are shingles) differ in no more places than the
sets do, so pairs whose sketches differ by more than the threshold allows are
apart for certain. Of each part the members are compared with one centre. Then
members that still lie outside a part's main component are compared with the
nearest member of another by sketches of FINE times the cells, and at last with
all members of others that these sketches allow, so no link between components
is lost, a group of copies costs about one comparison a member, and pairs are
compared one by one only if they lie within a hair of the threshold.

Nothing is sent once a pair. Pairs are dealt in blocks by the first text; a
block gets each text that its pairs name once, so the first texts travel once,
and the few centres once a block. Shards, parts and blocks are sized by their
contents. A bucket over SLICE members is dealt in slices, which share PIVOTS
members, so that they meet; what then lies outside the largest component is
compared with every slice. A shard holds whole buckets, 4 bytes a signature and
12 a member. Components are found by alternating stars. Texts travel only for
vertices in pairs, which a bit map of fixed size selects, one of each a task.

Defined cases: null text and text without words have an empty set and are
linked with nothing; fewer words than a shingle are one shingle; rows of one
id are one vertex of the graph, whatever their texts; each row with a null id
stands for itself and has its component's least id, or null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import WORD, packed, partitions, prepare, settled, table, unpacked
from tidefold.llm.graph import components

WORDS = 5
PERCENT = 80
#: Bits of the map that selects texts with candidates.
MAP_BITS = 1 << 24
#: Members of a bucket that are split together, and those that the slices of a larger one share.
SLICE, PIVOTS = 20_000, 16
#: Signatures of a shard, rows of a part and of a group of parts that are compared again, and shingles of a block, about.
SHARD, PART, GROUP, BLOCK = 8_000_000, 50_000, 300_000, 1_500_000
_CHUNK = 700_000
#: One group in so many is spared; cells of a fine sketch for each of a plain one.
SPARE, FINE = 8, 8
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 finaliser, constants fixed."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Words(dict):
    """Hashes of words, remembered up to a number that bounds memory alone."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, A-Z lower-cased, split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out += mix(h[i : len(h) - width + 1 + i] * _MULTIPLIERS[i % 8] + np.uint64(i))
    return np.unique(mix(out))


def vertex(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    return int(mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray, fine: int = 1) -> bytes:
    """Parity of the shingles in each cell, a bit a cell; cells are fine times the least power of two not below the number of shingles, 64 at least."""
    cells = fine << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ _MULTIPLIERS[6]) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all with the cells of the smallest. Rows differ in no more bits than the sets differ in shingles."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width // 8), np.uint64)
    for i, b in enumerate(sketches):
        w = np.frombuffer(b, np.uint64)
        while len(w) > width // 8:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def spread(rows: np.ndarray, n: np.ndarray, i: int, percent: int) -> np.ndarray:
    """By how many bits the sketches of sets of n shingles differ from row i's, less what the threshold allows: above 0 no link is possible."""
    out = np.bitwise_count(rows ^ rows[i]).sum(axis=1, dtype=np.int64) - (n + n[i]) * (100 - percent) // (100 + percent)
    out[100 * np.minimum(n, n[i]) < percent * np.maximum(n, n[i])] = 1 << 60
    return out


def near(rows: np.ndarray, n: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Which rows of sketches of sets of n shingles may be similar to row i."""
    return spread(rows, n, i, percent) <= 0


class Bands:
    """Bands of sizes for a threshold in per cent, and the greatest difference k within each."""

    def __init__(self, percent: int):
        low, self.last = [1], []
        while low[-1] < 1 << 34:
            self.last.append(low[-1] * 100 // percent)
            low.append(self.last[-1] + 1)
        self.low = np.array(low, np.int64)
        self.k = np.array([2 * r * (100 - percent) // (100 + percent) for r in self.last], np.int64)

    def __call__(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set and the place of the set they belong to, in order of the sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    value, owner = mix(flat + np.uint64(0x2545F4914F6CDD1D)), np.repeat(np.arange(len(sets)), sizes)
    signed, whose = [], []
    for step in (0, 1):
        tag = bands(sizes) + step
        k = bands.k[tag]
        spare = np.where(k > 0, (k + 2) // 2 // SPARE, 0)
        groups = (k + 2) // 2 + spare  # 2 * (groups - spare) > k
        first = np.cumsum(groups) - groups
        v = mix(flat ^ mix(tag.astype(np.uint64) * _MULTIPLIERS[1])[owner])
        group = (v % groups.astype(np.uint64)[owner]).astype(np.int64)
        part = ((v >> np.uint64(40)) % np.uint64(3)).astype(np.int64)
        at = 3 * (first[owner] + group) + part
        cells = np.zeros(3 * int(groups.sum()), np.uint64)
        np.add.at(cells, at, value)
        cells = cells.reshape(-1, 3)
        held = np.bincount(at, minlength=cells.size).reshape(-1, 3)
        whole = cells.sum(axis=1, dtype=np.uint64)[:, None]
        # Leave out one part of three; where k is 0 nothing is left out and one signature is enough.
        set_of = np.repeat(np.arange(len(sets)), groups)
        exact = (k[set_of] == 0)[:, None]
        number = (np.arange(len(set_of)) - first[set_of])[:, None] * 3 + np.arange(3)[None, :]
        place = mix(tag[set_of].astype(np.uint64)[:, None] * _MULTIPLIERS[2] + number.astype(np.uint64) * _MULTIPLIERS[3])
        sig = mix(np.where(exact, whole, whole - cells) + place)
        said = held.sum(axis=1)[:, None] - held  # shingles of a signature
        least = np.zeros(len(sets), np.int64)
        for w in (1, 2, 3):
            weak = np.bincount(set_of, said.min(axis=1) < w, len(sets))
            least[(weak <= spare) & (least == w - 1)] = w
        use = np.where(exact, np.arange(3)[None, :] == 0, said >= least[set_of][:, None])
        signed.append(sig[use])
        whose.append(np.broadcast_to(set_of[:, None], sig.shape)[use])
    sig, own = np.concatenate(signed), np.concatenate(whose)
    order = np.argsort(own, kind="stable")
    return sig[order], own[order]


def _read(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """Ids, keys and sets, some hundred thousand shingles at a time."""
    ids, keys, sets, total = [], [], [], 0
    for batch in batches:
        for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
            ids.append(doc_id)
            keys.append(key)
            sets.append(shingles(text.as_py(), n))
            total += len(sets[-1]) + 1
            if total > _CHUNK:
                yield ids, keys, sets
                ids, keys, sets, total = [], [], [], 0
    yield ids, keys, sets


_FACTS = "doc_id bigint, key bigint, n_shingles bigint, vertex bigint, sketch binary"


def _facts(n: int):
    """Of each row its number of shingles, vertex and sketch (null for an empty set)."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, sets in _read(batches, n):
            columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([vertex(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "vertex", "sketch"])

    return facts


_SENT = "shard int, sigs binary, names binary, counts binary"


def _send(n: int, percent: int, shards: int):
    """Signatures of each distinct set of a task, packed by shard: 32 bits of each, the vertices and how many signatures each has there."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, done = Bands(percent), set()
        for _, _, sets in _read(batches, n):
            fresh = {v: s for s in sets if len(s) and (v := vertex(s)) not in done}
            done.update(fresh)
            rows = []
            if fresh:
                names = np.array(list(fresh), np.int64)
                sig, own = signatures(list(fresh.values()), bands)
                shard = (sig >> np.uint64(32)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                sig, own, cuts = sig[order].astype(np.uint32), own[order], np.searchsorted(shard[order], np.arange(shards + 1))
                for x in range(shards):
                    a, b = cuts[x], cuts[x + 1]
                    if a < b:
                        who, counts = np.unique(own[a:b], return_counts=True)
                        rows.append((x, sig[a:b].tobytes(), names[who].tobytes(), counts.astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int32(), *[pa.binary()] * 3])], ["shard", "sigs", "names", "counts"])

    return send


_BUCKETS = "bucket bigint, slices int, slice int, members array<bigint>, centre bigint"


def _buckets(slice_: int):
    """Of a shard: buckets of two or more vertices, each list of members once, in slices, with the member that meets most others there."""

    def buckets(rows: pa.Table) -> pa.Table:
        sig = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows.column("sigs")])
        name = np.concatenate([np.repeat(np.frombuffer(x.as_py(), np.int64), np.frombuffer(c.as_py(), np.uint32)) for x, c in zip(rows.column("names"), rows.column("counts"), strict=True)])
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        same = np.flatnonzero(np.append(False, sig[1:] == sig[:-1])[: len(sig)])
        keep = np.unique(np.concatenate([same, same - 1]))
        sig, name = sig[keep], name[order][keep]
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        once = np.append(True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]))[: len(sig)]
        sig, name = sig[once], name[once]
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        ends = np.append(begin[1:], len(sig))[: len(begin)]
        who, place = np.unique(name, return_inverse=True)
        central = np.bincount(place, np.repeat(ends - begin - 1, ends - begin), len(who))[place]
        seen, out = set(), []
        for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
            if b - a > 1 and (key := xxhash.xxh64_intdigest(name[a:b].tobytes())) not in seen:
                seen.add(key)
                bucket, own = np.uint64(key).view(np.int64), name[a:b]
                centre = int(own[int(np.argmax(central[a:b]))])
                slices = -(-(b - a) // slice_)
                if slices == 1:
                    out.append((bucket, 1, 0, own, centre))
                else:
                    h = mix(own.view(np.uint64))
                    shared = np.append(own[np.argsort(h)[:PIVOTS]], centre)
                    out += [(bucket, slices, x, np.union1d(own[h % np.uint64(slices) == x], shared), centre) for x in range(slices)]
        schema = pa.schema([("bucket", pa.int64()), ("slices", pa.int32()), ("slice", pa.int32()), ("members", pa.list_(pa.int64())), ("centre", pa.int64())])
        return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return buckets


def _groups(rows: pa.Table, *by: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows alike in the columns named, with their sketches."""
    rows = rows.sort_by([*((c, "ascending") for c in by), ("vertex", "ascending")])
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in by:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(new)
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(rows)).tolist(), strict=True):
        own = rows.slice(a, b - a)
        yield own, folded([x.as_py() for x in own.column("sketch")])


_PARTS = "bucket bigint, slices int, slice int, members array<bigint>, centre bigint"


def _split(percent: int):
    """Buckets cut into parts between which no link is possible; each slice of a larger bucket once more as it is, without a centre."""

    def split(rows: pa.Table) -> pa.Table:
        out = []
        for own, cells in _groups(rows, "bucket", "slice"):
            name, n = own.column("vertex").to_numpy(), own.column("n").to_numpy()
            bucket, slices, slice_, centre = (own.column(c)[0].as_py() for c in ("bucket", "slices", "slice", "centre"))
            part = np.arange(len(n))

            def join(i: int, n=n, cells=cells, part=part) -> None:
                met = np.unique(part[near(cells, n, i, percent)])
                if len(met) > 1:
                    part[np.isin(part, met)] = met[0]

            middle = int(np.searchsorted(name, centre))
            join(middle)
            kinds, counts = np.unique(part, return_counts=True)
            if len(kinds) > 1:
                for i in np.flatnonzero(part != kinds[np.argmax(counts)]).tolist():
                    join(i)
            for k in np.unique(part):
                of = name[part == k]
                if len(of) > 1:
                    out.append((xxhash.xxh64_intdigest(of.tobytes()), 1, 0, of, int(centre) if part[middle] == k else int(of[0])))
            if slices > 1:
                out.append((bucket % (1 << 64), slices, slice_, name, None))
        schema = pa.schema([("bucket", pa.int64()), ("slices", pa.int32()), ("slice", pa.int32()), ("members", pa.list_(pa.int64())), ("centre", pa.int64())])
        columns = [[x[i] for x in out] for i in range(5)]
        columns[0] = np.array(columns[0], np.uint64).view(np.int64)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return split


def _cross(percent: int, nearest: bool):
    """Of parts that hold several components: pairs of a member outside the main one with the member of others whose sketch is nearest, or with all whose sketches allow a link."""

    def cross(texts: pa.Table, rows: pa.Table) -> pa.Table:
        at = {v: i for i, v in enumerate(texts.column("node").to_pylist())}
        sizes, sketches = texts.column("n").to_numpy(), texts.column("sketch")
        rows = rows.sort_by([("bucket", "ascending"), ("slice", "ascending")])
        bucket, slice_, vertices, roots, asides, guests = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "slice", "vertex", "root", "aside", "guest"))
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (slice_[1:] != slice_[:-1]))[: len(bucket)]
        begin = np.flatnonzero(new)
        found: set[tuple[int, int]] = set()
        for x, y in zip(begin.tolist(), np.append(begin[1:], len(bucket))[: len(begin)].tolist(), strict=True):
            name, root, aside, guest = vertices[x:y], roots[x:y], asides[x:y], guests[x:y]
            own = np.array([at[v] for v in name.tolist()])
            n, cells = sizes[own], folded([sketches[i].as_py() for i in own.tolist()])
            for i in np.flatnonzero(aside).tolist():
                a, far = int(name[i]), spread(cells, n, i, percent)
                far[(root == root[i]) | guest] = 1
                met = np.flatnonzero(far <= 0)
                if nearest and len(met):
                    met = met[[np.argmin(far[met])]]
                found.update((a, b) for b in name[met].tolist() if (b, a) not in found)
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return cross


def _sketched(n: int):
    """Of texts their vertex and FINE sketch."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), n) for t in batch.column("text")]
            use = [(v, sketch(s, FINE)) for v, s in zip(batch.column("vertex").to_pylist(), sets, strict=True) if vertex(s) == v]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in use], pa.int64()), pa.array([x for _, x in use], pa.binary())], ["vertex", "sketch"])

    return sketched


def _picked(shared):
    """Rows whose slot is in the bit map, one of each text a task."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            at = batch.column("slot").to_numpy()
            rows = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool))).select(["key", "text"])
            fresh = [k not in done and not done.add(k) for k in rows.column("key").to_pylist()]
            yield rows.filter(pa.array(fresh, pa.bool_()))

    return picked


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = np.sort(np.concatenate([s, t]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(s) + len(t) - same)


def _verify(n: int, percent: int):
    """Links among the pairs of a block, but for those that others of the block imply."""

    def verify(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for v, t in zip(texts.column("vertex").to_pylist(), texts.column("text"), strict=True):
            if v not in sets and vertex(s := shingles(t.as_py(), n)) == v:
                sets[v] = s
        parent = {v: v for v in sets}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y and similar(sets[a], sets[b], percent):
                parent[x] = y
                links.append((a, b))
        return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    return verify


def _map(ids: DataFrame) -> bytes:
    """Bit map of slots, MAP_BITS / 8 bytes whatever the number of ids; parts are merged on the executors."""
    width = 1 << 15

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(at // width, pa.int32()), pa.array(at % width, pa.int32())], ["page", "bit"])

    pages = ids.mapInArrow(paint, "page int, bit int").groupBy("page").agg(F.collect_set("bit").alias("bits"))
    out = np.zeros(MAP_BITS, np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"] * width + np.array(r["bits"], np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _texts(docs: DataFrame, facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """vertex, text (at most once a task that read one) of the vertices wanted."""
    spark = docs.sparkSession
    slot = F.pmod("key", F.lit(MAP_BITS)).alias("slot")
    asked = settled(facts.join(wanted, "vertex").select("vertex", "key"))
    shared = spark.sparkContext.broadcast(_map(asked.select(slot)))
    return docs.select("key", "text", slot).mapInArrow(_picked(shared), "key bigint, text string").join(asked, "key").select("vertex", "text")


def _links(docs: DataFrame, facts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) among pairs that make the same components as all of them. docs: key, text; facts: vertex, key, n."""
    lead = pairs.groupBy("a").agg(F.min(F.struct(F.xxhash64("b"), "b"))["b"].alias("lead"))
    lead = lead.join(facts.select(F.col("vertex").alias("a"), "n"), "a")
    weight = lead.groupBy("lead").agg(F.sum("n").alias("weight"))
    total = int(weight.agg(F.sum("weight")).first()[0] or 0)
    salt = F.pmod(F.xxhash64("a"), F.ceil(F.col("weight") / BLOCK))
    homes = lead.join(weight, "lead").select("a", F.pmod(F.xxhash64("lead", salt), F.lit(-(-total // BLOCK) or 1)).cast("int").alias("block"))
    dealt = settled(pairs.join(homes, "a").select("block", "a", "b"))
    needs = dealt.select("block", F.col("a").alias("vertex")).union(dealt.select("block", F.col("b").alias("vertex"))).distinct()

    texts = _texts(docs, facts, needs.select("vertex").distinct())
    left = texts.join(needs, "vertex").select(F.col("block").alias("home"), "vertex", "text")
    return settled(left.groupBy("home").cogroup(dealt.groupBy("block")).applyInArrow(_verify(words, percent), "a bigint, b bigint"))


def _several(rooted: DataFrame) -> DataFrame:
    return rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, slice_: int = SLICE) -> DataFrame:
    """docs: doc_id, text. Per row: doc_id, n_shingles and component_id (the least id reachable by links). Buckets over slice_ members are dealt in slices."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    rows = settled(docs.mapInArrow(_facts(words), _FACTS))
    facts = settled(rows.where("vertex IS NOT NULL").groupBy("vertex").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id")))
    total = int(facts.agg(F.sum("n")).first()[0] or 0)
    shards = max(partitions(spark), total // SHARD)
    buckets = docs.mapInArrow(_send(words, percent, shards), _SENT).groupBy("shard").applyInArrow(_buckets(slice_), _BUCKETS)
    buckets = settled(buckets.dropDuplicates(["bucket", "slice"]))

    # Buckets by sketches.
    cells = facts.select("vertex", "n", "sketch")
    parts = max(2 * partitions(spark), int(buckets.agg(F.sum(F.size("members"))).first()[0] or 0) // PART)
    part = F.pmod(F.xxhash64("bucket", "slice"), F.lit(parts)).alias("part")
    member = buckets.select("bucket", "slices", "slice", "centre", F.explode("members").alias("vertex")).join(cells, "vertex").select("*", part)
    groups = settled(member.groupBy("part").applyInArrow(_split(percent), _PARTS).dropDuplicates(["bucket", "slice"]))

    # Each member with its centre, then members of different components.
    held = facts.select("vertex", "key", "n")
    member = groups.select("bucket", "slices", "slice", "centre", F.explode("members").alias("vertex"))
    stars = member.where("vertex <> centre").select(F.col("vertex").alias("a"), F.col("centre").alias("b")).distinct()
    links = _links(docs, held, stars, words, percent)
    roots = components(links)
    rooted = member.join(roots.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex")).select("bucket", "slices", "slice", "vertex", "root")
    several = settled(_several(rooted))
    if several.take(1):
        open_ = member.join(several, "bucket").select("bucket", "slices", "slice", "vertex")
        texts = _texts(docs, held, open_.select("vertex").distinct())
        fine = settled(texts.mapInArrow(_sketched(words), "vertex bigint, sketch binary").groupBy("vertex").agg(F.first("sketch").alias("sketch")).join(held.select("vertex", "n"), "vertex"))
        for nearest in (True, False):
            rooted = open_.join(roots.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
            # The largest component of each bucket, and how many rows the buckets of one have: as many as make a group are compared in one task.
            main = settled(rooted.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.sum("count").alias("rows"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"))
            heavy = main.groupBy("main").agg(F.sum("rows").alias("weight"))
            total = int(main.agg(F.sum("rows")).first()[0] or 0)
            place = main.join(heavy, "main").select("bucket", "main", F.ceil(F.col("weight") / GROUP).alias("salts"))
            apart = rooted.join(place, "bucket").withColumn("aside", F.col("root") != F.col("main")).withColumn("guest", F.lit(False))
            visits = apart.where("slices > 1 AND aside").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).where("to <> slice").withColumn("slice", F.col("to")).withColumn("guest", F.lit(True))
            group = F.pmod(F.xxhash64("main", F.pmod(F.xxhash64("bucket", "slice"), F.col("salts"))), F.lit(max(2 * partitions(spark), total // GROUP))).cast("int").alias("group")
            rest = apart.unionByName(visits.drop("to")).select(group, "bucket", "slice", "vertex", "root", "aside", "guest")
            needs = rest.select(F.col("group").alias("home"), F.col("vertex").alias("node")).distinct().join(fine.withColumnRenamed("vertex", "node"), "node").select("home", "node", "n", "sketch")
            pairs = needs.groupBy("home").cogroup(rest.groupBy("group")).applyInArrow(_cross(percent, nearest), "a bigint, b bigint")
            pairs = settled(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
            if not pairs.take(1):
                break
            roots = components(_links(docs, held, pairs, words, percent).union(roots.select("node", "root")))

    # Vertices of one id are one vertex.
    named = rows.where("vertex IS NOT NULL AND doc_id IS NOT NULL")
    shared_ids = named.groupBy("doc_id").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b")).where("a <> b")
    alike = settled(named.join(shared_ids.select("doc_id", "a"), "doc_id").select("a", F.col("vertex").alias("b")).where("a <> b").distinct())
    if alike.take(1):
        roots = components(alike.union(roots.select("node", "root")))

    # Ids: the least of each vertex, then of each component.
    least = facts.select("vertex", "doc_id").join(roots.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    lowest = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least.join(lowest, "root").select("vertex", "component_id"), "vertex", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return link(table(spark, sf_dir, "documents"), words=4, percent=85)


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component, at the library's setting for near duplicates: the least id, null last, then the least hash of id and text.

    Rows are linked by their texts alone: a hash of id and text takes the id's
    place in ``link``, so null and repeated ids join nothing. Of rows alike in
    id and text the first by the other columns stays. Texts without words are
    linked with nothing and all stay.
    """
    prepare(spark)
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = packed(docs)
    full = rows.where(worded).withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    linked = link(full.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    names = full.select("_key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_key").alias("key")).alias("name"))
    least = names.distinct().join(linked.distinct(), "_key").groupBy("component_id").agg(F.min("name").alias("name")).select(F.col("name.key").alias("_key"))
    # Of rows alike in id and text one stays, the least as JSON; the least is found before rows meet.
    kept = full.join(least, "_key", "left_semi").groupBy("_key").agg(F.min_by(F.struct("text", "_rest"), F.to_json("_rest")).alias("one")).select("one.*")
    return kept.select(unpacked(docs.columns)).unionByName(rows.where(~worded).select(unpacked(docs.columns)))
