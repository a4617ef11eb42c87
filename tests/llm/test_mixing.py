import itertools
import random
import re
from collections import defaultdict

import pytest

from tidefold.llm import mixing


def water(sizes, share=1.5, passes=2):
    """Targets by bisection on the level, another way than sharing again."""
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(passes * n, mid * x) for n, x in zip(sizes, w)) < share * sum(sizes) else (low, mid)
    return [min(passes * n, low * x) for n, x in zip(sizes, w)]


@pytest.mark.parametrize("sizes", [[], [0], [10], [5, 0, 7], [100, 1, 1, 1], [1000, 10, 300, 20, 4, 0, 9], [3] * 20])
def test_targets(sizes):
    assert mixing.targets(sizes) == pytest.approx(water(sizes), rel=1e-9, abs=1e-6)


def test_route_is_least_cost():
    rng = random.Random(4)
    for _ in range(30):
        patterns = [(m, rng.randint(1, 3)) for m in [(0,), (1,), (0, 1)]]
        quotas = [rng.randint(0, 6), rng.randint(0, 6)]
        given = mixing.route(patterns, quotas)
        cost = lambda g: sum(max(0, x - n) for x, (_, n) in zip(g, patterns))
        feasible = []
        for a, b, c0, c1 in itertools.product(*(range(2 * n + 1) for n in (patterns[0][1], patterns[1][1], patterns[2][1], patterns[2][1]))):
            if c0 + c1 <= 2 * patterns[2][1] and a + c0 <= quotas[0] and b + c1 <= quotas[1]:
                feasible.append((-(a + b + c0 + c1), cost((a, b, c0 + c1))))
        assert (-sum(given), cost(given)) == min(feasible)


def run(spark, docs, path):
    spark.createDataFrame(docs, "doc_id long, text string, source string, size string").write.parquet(f"{path}/documents.parquet")
    return mixing.op10_source_mix(spark, str(path)).collect()


def test_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rng = random.Random(6)
    docs = [(i, rng.choice([None, "", "a  b c\nd " * rng.randint(1, 40)]), rng.choice(["a", "a", "a", "b", "Z", "é", None]), "x") for i in range(2000)]
    docs += [(7, "same row", "b", "x")] * 3
    got = run(spark, docs, tmp_path / "a")
    assert len(got) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, t, s, _ in docs:
        by[s] += size(t)
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    target = dict(zip(names, water([by[s] for s in names])))
    source = {i: s for i, _, s, _ in docs if i != 7}
    taken, most = defaultdict(int), max(size(t) for _, t, *_ in docs)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        if r.doc_id != 7:
            s = source[r.doc_id]
            assert r.source_size == by[s] and r.target == pytest.approx(target[s])
        taken[r.target] += r.taken
    for t, n in taken.items():
        assert abs(n - t) <= most
    again = mixing.op10_source_mix(spark, str(tmp_path / "a")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    order = {r.taken // r.size for r in got if r.size}
    assert order == {0, 1, 2} or order == {1, 2} or order == {0, 1}


def test_small_tables(spark, tmp_path):
    assert run(spark, [], tmp_path / "a") == []
    assert [tuple(r) for r in run(spark, [(1, None, None, "x")], tmp_path / "b")] == [(1, 0, 0, 0.0, 0)]


def test_mix_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], "en", 20) for i in range(100)], "doc_id long, text string, source string, lang string, n_chars long")
    out = mixing.mix_documents(spark, docs)
    assert out.columns == docs.columns
    assert out.count() == 150


def test_rows_alike_have_their_own_verdicts(spark):
    """Six equal rows of 4 words: 150 % are 36 words, nine rows; columns named as the operator's own pass through."""
    docs = spark.createDataFrame([(1, "a b c d", "s", "x", 5)] * 6 + [(None, None, None, "y", 6)], "doc_id long, text string, source string, _id string, row int")
    out = mixing.mix_documents(spark, docs)
    assert out.columns == docs.columns
    assert list(map(tuple, out.collect())) == [(1, "a b c d", "s", "x", 5)] * 9


def test_many_sources(spark, tmp_path, monkeypatch):
    """More sources than the flow may hold give the same rows without it."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rng = random.Random(11)
    docs = [(i, "w " * rng.randint(0, 60), rng.choice(["big", "big", None, *(f"site{k}" for k in range(70))]), "x") for i in range(900)] + [(900, "", "none", "x")]
    by_flow = sorted(map(tuple, run(spark, docs, tmp_path)))
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 10)
    alone = sorted(map(tuple, mixing.op10_source_mix(spark, str(tmp_path)).collect()))
    assert [(*r[:3], r[4]) for r in alone] == [(*r[:3], r[4]) for r in by_flow]
    assert [r[3] for r in alone] == pytest.approx([r[3] for r in by_flow])
