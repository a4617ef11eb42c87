import numpy as np
import pytest

from tidefold.llm import neighbours


def brute(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.all(np.isfinite(v)) and any(v) and len(v) == 8]
    out = []
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-float(x @ y), i) for i, y in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, path):
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, neighbours.op8_nearest_neighbours(spark, str(path)).collect()))


def test_exact_with_ties_and_bad_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "MISS", 0.0)
    monkeypatch.setattr(neighbours, "BLOCK", 120)
    monkeypatch.setattr(neighbours, "GROUP", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 480)]
    rows += [(500, None), (501, [0.0] * 8), (502, [None] + [1.0] * 7), (503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7), (505, [1.0] * 3), (None, [1.0] * 8), (520, [])]
    got, expect = run(spark, rows, tmp_path), brute(rows)
    assert [g[:3] for g in got] == [e[:3] for e in expect]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expect])


def test_few_candidates_and_empty(spark, tmp_path):
    rows = [(0, [1.0] * 8), (1, [2.0] * 8), (20, [0.5] * 8)]
    assert [g[:3] for g in run(spark, rows, tmp_path / "a")] == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert run(spark, [], tmp_path / "b") == []
    assert run(spark, [(0, None)], tmp_path / "c") == []


def test_recall_and_early_stop():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 3
    x = np.vstack([c + 0.1 * rng.standard_normal((100, 16)) for c in centres])
    greatest = float(np.sqrt((x**2).sum(axis=1).max()))
    q = x[::20]
    qi, vi, s = neighbours.search(x, q, greatest, 20)
    hit = 0
    for i in range(len(q)):
        own = qi == i
        mine = vi[own][np.argsort(-s[own])][:20]
        hit += len(set(mine) & set(np.argsort(-(x @ q[i]))[:20]))
    assert hit / (20 * len(q)) >= 0.9
    assert neighbours.chi_square(np.array([7.344]))[0] == pytest.approx(0.5, abs=1e-3)
