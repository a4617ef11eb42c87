import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from tidefold.llm import suffixes as S


def brute(docs):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + S.LEAST] for _, b in data for k in range(len(b) - S.LEAST + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - S.LEAST + 1):
            if seen[b[k : k + S.LEAST]] > 1:
                gone[k : k + S.LEAST] = b"\1" * S.LEAST
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest(), shared_words(data, len(out))))
    return sorted(out, key=str)


def shared_words(data, at):
    """Words of a row in windows of 50 words that another row has too."""
    windows = lambda b: [tuple(b.split()[k : k + S.PASSAGE]) for k in range(len(b.split()) - S.PASSAGE + 1)]
    others = {w for k, (_, b) in enumerate(data) if k != at for w in windows(b)}
    return len({k + j for k, w in enumerate(windows(data[at][1])) if w in others for j in range(S.PASSAGE)})


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [make(rng.choice([395, 399, 400, 401, 450, 900, 2500])) for _ in range(10)]
    docs = []
    for i in range(70):
        text = make(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randint(0, len(p) // 2)])
            text += p[a : a + rng.choice([len(p), rng.randint(200, 1500)])] + make(rng.choice([0, 1, 50, 700]))
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, docs[9][1]), (103, docs[9][1]), (104, "a" * 3000), (105, "xyz" * 900 + make(5)), (106, "a" * 401), (107, make(30) + passages[0] * 3), (1, docs[1][1]), (None, docs[5][1]), (2, "other " + passages[4])]
    return docs


def test_query_equals_brute_force(spark, tmp_path):
    for seed in (1, 2):
        docs = corpus(seed)
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, node long").repartition(3).write.parquet(f"{tmp_path}/{seed}/documents.parquet")
        got = sorted(map(tuple, S.op7_repeated_passages(spark, f"{tmp_path}/{seed}").collect()), key=str)
        assert got == brute(docs)


@pytest.mark.parametrize("hot", [1, 3])
def test_windows_of_common_anchors_equal_brute_force(spark, hot):
    """With a small hot the windows of common anchors are compared by hash, in the workers."""
    docs = corpus(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, S.repeated_spans(frame, hot).drop("edges").collect()), key=str) == brute(docs)
    anchors, contexts = np.array([5] * 5, np.uint64).tobytes(), np.arange(5, dtype=np.uint64).tobytes()
    rows = pa.table({"shard": [0], "anchors": [anchors], "contexts": [contexts], "nodes": [np.arange(5).tobytes()], "numbers": [np.zeros(5, np.uint32).tobytes()]})
    flags = lambda h: {x[0] for x in S._meet(rows, h).column("flags").to_pylist()}
    assert flags(hot) == {S._HASH} and flags(5) == {S._SORT}


def test_short_passages_of_many_words(spark):
    """A passage of 55 words has fewer than 400 bytes here: no byte goes, but its words are counted."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(100, 999)}" for _ in range(n))
    p, q = say(55), say(49)
    docs = [(1, f"{say(20)} {p} {say(30)}"), (2, f"{say(5)}\n{p.replace(' ', '  ', 1)} {say(60)}"), (3, f"{say(60)} {q}"), (4, f"{q} {say(60)}"), (5, say(70)), (6, f"{p} {p} {say(3)}")]
    got = {r.doc_id: (r.n_removed, r.n_shared_words) for r in S.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: n for i, (_, n) in got.items()} == {1: 55, 2: 55, 3: 0, 4: 0, 5: 0, 6: 110}
    assert all(n == 0 for n, _ in got.values())


def test_answers_about_shared_words_are_packed():
    """A shard makes a row a home, however many texts it knows; homes together give each text what is shared, once."""
    rng = np.random.default_rng(3)
    hashes, nodes = rng.integers(0, 400, 3000).astype(np.uint64), rng.integers(0, 700, 3000)
    places = rng.integers(0, 50, 3000).astype(np.uint32)
    rows = pa.table({"shard": [0, 0], **{c: [x[:1000].tobytes(), x[1000:].tobytes()] for c, x in (("hashes", hashes), ("nodes", nodes), ("places", places))}})
    who = {h: set(nodes[hashes == h].tolist()) for h in set(hashes.tolist())}
    again = [(n, h, p) for n, h, p in zip(nodes.tolist(), hashes.tolist(), places.tolist()) if len(who[h]) > 1]
    for windows, kind in ((False, np.uint64), (True, np.uint32)):
        out = S._shared(windows, 5)(rows)
        assert sorted(out.column("home").to_pylist()) == [0, 1, 2, 3, 4]
        got = {n: x.tolist() for k in range(5) for n, x in S._own(out.filter(pa.compute.equal(out.column("home"), k)), kind)}
        assert got == {n: sorted({p if windows else h for m, h, p in again if m == n}) for n in {n for n, _, _ in again}}


def test_words_in_spans(monkeypatch):
    rng = random.Random(5)
    data = " ".join(str(rng.randint(0, 50)) for _ in range(3000)).encode()
    whole = S.Words(data)
    monkeypatch.setattr(S, "_SPAN", 512)
    cut = S.Words(data)
    assert whole.windows.tolist() == cut.windows.tolist() and whole.anchors.tolist() == cut.anchors.tolist()
    assert len(whole.windows) == 2951


def test_long_text_is_looked_at_in_spans(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 250, 30_000).astype(np.uint8).tobytes()
    data = data + data[5000:6000]
    whole = S.Text(data)
    monkeypatch.setattr(S, "_SPAN", 1 << 12)
    cut = S.Text(data)
    assert whole.inner.tolist() == cut.inner.tolist() == [*range(5000, 5601), *range(30000, 30601)]
    windows = lambda t: {i for a, b in zip(t.low, t.high) for i in range(a, b + 1)}
    assert windows(whole) == windows(cut) == set(range(30_601)) - set(range(30000, 30601))


def test_suffix_ranks_and_windows():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 900).astype(np.uint8)
    data[500:800] = data[100:400]
    rank = S.suffix_ranks(data, 40)
    key = [bytes(data[i : i + 40]).ljust(40, b"\0") for i in range(len(data))]
    assert [sorted(set(key)).index(k) + 1 for k in key] == rank.tolist()


def test_previous_factors():
    rng = random.Random(3)
    for _ in range(60):
        d = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40)))
        expect = [max([0, *(n for j in range(i) for n in range(1, len(d) - i + 1) if d[j : j + n] == d[i : i + n])]) for i in range(len(d))]
        assert S.previous_factors(d) == expect
    assert S.keep_first(b"0123456789-0123456789", 10) == b"0123456789-"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op7_repeated_passages(spark, str(tmp_path)).collect() == []
