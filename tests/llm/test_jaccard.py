import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidefold.llm import graph, jaccard


def sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, n, percent):
    own = [sets(t, n) for _, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= percent * len(own[i] | own[j]):
                a, b = find(docs[i][0]), find(docs[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(docs, own))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randint(0, 3000))
    docs = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 14, 30, 60, 200, 700]))]
        for _ in range(rng.choice([1, 2, 12, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
            docs.append(rng.choice([text, text.upper(), text.replace(" ", " \n", 1)]))
    docs += [None, "", "  ", "x\x85y z", "one word"] + ["boiler plate text of every one " + f"end{i}" for i in range(6)]
    rng.shuffle(docs)
    return [(i * 7 % 1009, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,n,percent,block,slice_", [(1, 4, 85, 1 << 30, 1 << 30), (2, 5, 80, 1 << 30, 1 << 30), (3, 4, 85, 300, 1 << 30), (4, 5, 80, 300, 3), (5, 4, 85, 2000, 5)])
def test_link_equals_brute_force(spark, monkeypatch, seed, n, percent, block, slice_):
    """With a small BLOCK (read on the driver alone) pairs are dealt in many blocks, with a small slice_ larger buckets in slices."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, vertex string").repartition(3)
    assert sorted(map(tuple, jaccard.link(frame, n, percent, slice_).collect())) == brute(docs, n, percent)


def test_corpora_without_copies(spark):
    """No signature, or none that repeats in a shard: one row, unrelated rows, and a table of few rows over 200 shuffle partitions."""
    long = lambda c: " ".join(f"{c}{i}" for i in range(300))
    for docs in ([(1, long("a"))], [(1, long("a")), (2, long("b"))], [(1, "x"), (2, None)], [(None, None)]):
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        assert sorted(map(tuple, jaccard.link(frame).collect()), key=str) == sorted(((i, len(sets(t, 5)), i) for i, t in docs), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        docs = [(1, long("a")), (2, long("b")), (3, long("a") + " more")]
        assert sorted(map(tuple, jaccard.link(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == [(1, 296, 1), (2, 296, 2), (3, 297, 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.choice([1, 2, 40, 64, 65, 130, 500, 1500]))
        base = np.unique(rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64))
        a, b = np.sort(rng.permutation(base)[:n]), np.sort(rng.permutation(base)[: max(1, n - int(rng.integers(0, n // 4 + 1)))])
        rows = jaccard.folded([jaccard.sketch(a), jaccard.sketch(b)])
        assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(np.setxor1d(a, b))
        if jaccard.similar(a, b, 80):
            assert jaccard.near(rows, np.array([len(a), len(b)]), 0, 80)[1]


def test_similar_sets_always_share_a_signature():
    rng = np.random.default_rng(1)
    bands = jaccard.Bands(85)
    for _ in range(400):
        n = int(rng.choice([1, 3, 5, 6, 7, 8, 10, 12, 20, 33, 80, 300]))
        base = rng.integers(0, 1 << 63, n * 2, dtype=np.uint64)
        a = base[:n]
        drop, add = (int(x) for x in rng.integers(0, n // 6 + 1, 2))
        b = np.concatenate([a[: n - drop], base[n : n + add]])
        a, b = np.unique(a), np.unique(b)
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        sig, own = jaccard.signatures([a, b], bands)
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert set(sig[own == 0]) & set(sig[own == 1])


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    docs = [(5, long), (5, other), (3, long), (9, other), (None, other), (None, "alone here"), (2, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.link(frame, 4, 85).collect()), key=str)
    assert got == sorted([(5, 47, 3), (5, 47, 3), (3, 47, 3), (9, 47, 3), (None, 47, 3), (None, 1, None), (2, 0, 2)], key=str)


def test_null_ids_stand_for_themselves(spark):
    """Rows without an id join nothing but what they link with, and the largest id is an id."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(100))
    docs = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), ((1 << 63) - 1, text("c")), (None, text("c"))]
    got = sorted(map(tuple, jaccard.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 96, None), (None, 96, None), (None, 97, None), ((1 << 63) - 1, 96, (1 << 63) - 1), (None, 96, (1 << 63) - 1)], key=str)


def test_empty_and_one_of_each(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(4, text, "en", "a", 1), (2, text + " more", "en", "b", 1), (8, "clean text", None, None, 1), (9, None, "en", "a", None), (10, "", "en", "a", 0)], schema)
    out = jaccard.one_of_each(spark, docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 8, 9, 10]
    assert jaccard.one_of_each(spark, docs.limit(0)).collect() == []


def test_one_of_each_with_null_and_repeated_ids(spark):
    """Unique texts stay whatever their ids, near copies go also among null ids and rows of one id."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(200))
    stay = [(3, text("a"), "x"), (5, text("b"), "x"), (9, text("c"), "x"), (None, text("d"), "x"), (None, text("e"), "x"), (7, text("f"), "x"), (None, None, "x"), (None, "", "y"), (4, " ", "x"), (4, " ", "x")]
    go = [(5, text("a"), "x"), (None, text("c") + " more", "x"), (None, text("d"), "y"), (7, text("f"), "y"), (7, text("f"), "y"), (8, text("f") + " more", "x")]
    near = [(None, text("g"), "x"), (None, text("g") + " more", "x")]
    out = list(map(tuple, jaccard.one_of_each(spark, spark.createDataFrame(go + near + stay, "doc_id long, text string, source string").repartition(3)).collect()))
    left = [r for r in out if r in near]
    assert len(left) == 1
    out.remove(left[0])
    assert sorted(out, key=str) == sorted(stay, key=str)


def test_one_of_each_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 4, 5, 6), (3, "", 7, 8, 9)], "doc_id long, text string, _key int, component_id int, vertex int")
    out = jaccard.one_of_each(spark, docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, text, 1, 2, 3), (3, "", 7, 8, 9)]


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(1, 60)]
    parent = defaultdict(lambda: None)
    find = lambda x: x if parent[x] in (None, x) else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


@pytest.mark.parametrize("chunk", [1, 3, 40, 1000])
def test_components_by_chunks(spark, chunk):
    """Chains, a hub, repeated edges, loops and negative ids, contracted in one chunk or many."""
    rng = random.Random(chunk)
    chain = [(i * 37 % 101 - 50, (i + 1) * 37 % 101 - 50) for i in range(60)]
    edges = chain + [(1000, 1001 + i) for i in range(30)] + [(5, 5), (2000, 2001), (2001, 2000), (2000, 2001)] + [(rng.randint(3000, 3060), rng.randint(3000, 3060)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), chunk)
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in parent if find(x) != x)
    assert graph.components(spark.createDataFrame([], "a long, b long"), chunk).count() == 0
