import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidefold.llm import ppm


class Plain:
    """The same model, one symbol at a time from dictionaries."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for t in texts:
            s = bytes([ppm.PAD]) * ppm.ORDER + t + bytes([ppm.END])
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.after[s[i - k : i]][s[i]] += 1

    def chance(self, context, symbol):
        p, out = 1.0, set()
        for k in range(ppm.ORDER, -1, -1):
            seen = {s: n for s, n in self.after.get(context[ppm.ORDER - k :], {}).items() if s not in out}
            if not seen:
                continue
            total = 2 * sum(seen.values())
            if symbol in seen:
                return p * (2 * seen[symbol] - 1) / total
            p *= len(seen) / total
            out |= set(seen)
        return p / (ppm.SYMBOLS - len(out))

    def score(self, t):
        s = bytes([ppm.PAD]) * ppm.ORDER + t + bytes([ppm.END])
        return sum(math.log10(self.chance(s[i - ppm.ORDER : i], s[i])) for i in range(ppm.ORDER, len(s)))


def test_plain_model_sums_to_one():
    m = Plain([b"abracadabra", b"abba"])
    for context in (b"xabra", b"zzzzz", bytes([ppm.PAD]) * 5):
        assert sum(m.chance(context, s) for s in range(256) if s != ppm.PAD) == pytest.approx(1)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(ppm, "BLOCK", block)
    rng = random.Random(8)
    words = ["the", "The", "tion", "é", "x\x85y", "a.", "漢字", "zq"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\x0b"]) for _ in range(rng.randint(0, 30))), "x") for i in range(60)]
    docs += [(100, None, "x"), (101, "", "x"), (102, "long text " * 3000, "x"), (3, docs[3][1], "x"), (103, "never?! seen-before", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, block string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ppm, "partitions", lambda s: 3 if block < 1000 else 1)
    if block < 1000:
        old = ppm.score
        monkeypatch.setattr(ppm, "score", lambda d: old(d, 20_000))
    got = ppm.op2_ppm_score(spark, str(tmp_path)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [(t or "").encode() for i, t, _ in docs if not held(i)]
    counts = Counter(w for t in train for w in [*t.lower().split(), b""])
    n, v, model = sum(counts.values()), len(counts), Plain(train)
    expect = []
    for i, t, _ in docs:
        b = (t or "").encode()
        tokens = [*b.lower().split(), b""]
        expect.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), model.score(b)))
    assert len(got) == len(expect)
    for r, e in zip(sorted(map(tuple, got)), sorted(expect), strict=True):
        assert r[:5] == e[:5]
        assert r[5] == pytest.approx(e[5], rel=1e-12)
        assert r[6] == pytest.approx(e[6], rel=2e-7)


def test_block_counts_windows():
    b = ppm.Block([b"aaaa", b"", b"ab"], [True, False, True])
    assert b.lengths.tolist() == [5, 1, 3]
    assert b.counts.sum() == 8 and b.valid.sum() == 9
    assert np.all(np.diff(b.values) > 0)


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_sorted_windows_equal_brute_force(monkeypatch, piece):
    """Windows are sorted with the number of their text, some texts and some n-grams at a time."""
    monkeypatch.setattr(ppm, "PIECE", piece)
    monkeypatch.setattr(ppm, "_STEP", 7)
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(0, 30))) for _ in range(23)]
    train = [rng.random() < 0.5 for _ in texts]
    windows = [[int.from_bytes((bytes([ppm.PAD]) * 5 + t + bytes([ppm.END]))[k : k + 6]) for k in range(len(t) + 1)] for t in texts]
    b = ppm.Block(texts, train)
    assert len(b.pieces) == (6 if piece == 4 else 1)
    assert b.values.tolist() == sorted({v for w in windows for v in w})
    taught = Counter(v for w, yes in zip(windows, train) if yes for v in w)
    assert b.counts.tolist() == [taught[v] for v in b.values.tolist()]
    assert b.sums(b.values % 1000.0).tolist() == [sum(v % 1000 for v in w) for w in windows]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ppm.op2_ppm_score(spark, str(tmp_path)).collect() == []
