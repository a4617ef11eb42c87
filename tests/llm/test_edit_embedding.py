import hashlib
import random

import numpy as np

from tidefold.llm import edit_embedding as E


def plain(text):
    """The walk, a character at a time."""
    level, out, i, j = E.level_of(len(text)), [], 0, 0
    levels, coins, bits = E.shared(4 * len(text) + 200)
    while i < len(text):
        letter = ((ord(text[i]) * 0x9E3779B1 & 0xFFFFFFFF) >> 24) + 1
        if levels[j] >= level:
            out.append((letter * int(bits[j]) & 0xFFFFFFFF) >> 31)
        i += (letter * int(coins[j]) & 0xFFFFFFFF) >> 31
        j += 1
    return f"{level}:{len(out)}:{np.packbits(np.array(out, np.uint8)).tobytes().hex()}"


def text(rng, n):
    return "".join(rng.choice("abcdefghij é漢😀\n") for _ in range(n))


def test_walk_equals_plain():
    rng = random.Random(1)
    texts = [text(rng, n) for n in [0, 1, 2, 50, 255, 256, 257, 600, 5000, 30000] + [rng.randint(0, 900) for _ in range(40)]]
    assert E.fingerprints(texts) == [plain(t) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(2)
    for n in (200, 2000, 20000):
        t = text(rng, n)
        few = list(t)
        for _ in range(n // 400 + 1):
            k = rng.randrange(len(few))
            few[k : k + 1] = rng.choice([[], ["z"], ["q", "z"]])
        a, b, c = E.fingerprints([t, "".join(few), text(rng, n)])
        assert E.likeness(a, b) > 0.4 > 0.25 > E.likeness(a, c)
    assert E.likeness(*E.fingerprints(["", ""])) == 1 and E.likeness(*E.fingerprints(["", "abc"])) == 0
    long, half = E.fingerprints([t, t[: len(t) // 2]])
    assert 0.3 < E.likeness(long, half) < 0.7


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "RANGE_BYTES", 3000)
    monkeypatch.setattr(E, "partitions", lambda s: 5)
    rng = random.Random(3)
    docs = [(i * 3, rng.choice([None, "", text(rng, rng.randint(0, 400))]), "x") for i in range(120)] + [(3, "twice", "x"), (None, "last", "x"), (7, text(rng, 20000), "x"), (-5, "low", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, guest string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in E.op6_edit_fingerprint(spark, str(tmp_path)).collect()]
    rows = sorted(((i, t or "") for i, t, _ in docs), key=lambda r: (r[0] if r[0] is not None else -1e9, r[1].encode()), reverse=True)
    expect = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        a, b, c = plain(t), plain(edited), plain(after)
        expect.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, E.likeness(a, b), E.likeness(a, c)))
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(got, key=key) == sorted(expect, key=key)


def test_one_row_and_empty(spark, tmp_path):
    for name, rows in (("a", [(1, "abcdef")]), ("b", [])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    (r,) = E.op6_edit_fingerprint(spark, f"{tmp_path}/a").collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1
    assert E.op6_edit_fingerprint(spark, f"{tmp_path}/b").collect() == []


def test_similar(spark):
    rng = random.Random(4)
    base = [text(rng, 800) for _ in range(20)]
    texts = base + [b[:700] + "z" + b[700:] for b in base] + base[:3]
    prints = spark.createDataFrame(list(enumerate(E.fingerprints(texts))), "doc_id long, fingerprint string")
    got = {(r.doc_id, r.other) for r in E.similar(prints).collect()}
    assert {(20 + i, i) for i in range(20)} | {(40 + i, i) for i in range(3)} == got


def printed(bits):
    return f"0:{len(bits)}:{np.packbits(bits).tobytes().hex()}"


def flipped(bits, share, rng):
    return bits ^ (rng.random(len(bits)) < share)


def test_similar_compares_all_members_of_a_band(spark, monkeypatch):
    """Ids 1 and 2 are near copies whose only common band has an unrelated document as its least id; bands of over 7 are dealt in blocks."""
    monkeypatch.setattr(E, "BLOCK", 7)
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2, 512).astype(bool)
    b = a.copy()
    own = E._sampled(0, 512) == 0  # bits that the coarser level does not have
    for i in range(E.BAND, 512, E.BAND):
        b[i + int(np.flatnonzero(own[i : i + E.BAND])[0])] ^= True
    coarse = np.flatnonzero(~own)
    for i in range(0, len(coarse) - E.BAND + 1, E.BAND):
        b[coarse[i + E.BAND - 1]] ^= True
    b[: E.BAND] = a[: E.BAND]
    if (a[coarse[: E.BAND]] == b[coarse[: E.BAND]]).all():
        b[coarse[E.BAND - 1]] ^= True
    head = rng.integers(0, 2, 512).astype(bool)
    head[: E.BAND] = a[: E.BAND]
    assert len(set(E.bands(printed(a))) & set(E.bands(printed(b)))) == 1 and E.likeness(printed(a), printed(b)) >= E.LIKE
    texts = [head, a, b]
    for _ in range(6):  # groups with hot bands
        base = rng.integers(0, 2, 480).astype(bool)
        texts += [flipped(base, 0.04, rng) for _ in range(20)]
    prints = [printed(x) for x in texts]
    keys = [set(E.bands(x)) for x in prints]
    expect = {(j, i): E.likeness(prints[i], prints[j]) for j in range(len(prints)) for i in range(j) if keys[i] & keys[j]}
    got = {(r.doc_id, r.other): r.likeness for r in E.similar(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()}
    assert (2, 1) in got and got == {p: x for p, x in expect.items() if x >= E.LIKE}


def test_similar_of_neighbouring_levels_and_empty(spark):
    rng = random.Random(8)
    base = [text(rng, n) for n in (250, 255, 500, 510) for _ in range(4)]
    texts = base + [b + text(rng, 14) for b in base] + [""]
    prints = E.fingerprints(texts)
    keys = [set(E.bands(x)) for x in prints]
    expect = {(j, i): E.likeness(prints[i], prints[j]) for j in range(len(prints)) for i in range(j) if keys[i] & keys[j]}
    expect = {p: x for p, x in expect.items() if x >= E.LIKE}
    frame = spark.createDataFrame([*enumerate(prints), (None, prints[0])], "doc_id long, fingerprint string")
    assert {(r.doc_id, r.other): r.likeness for r in E.similar(frame).collect()} == expect
    assert any(prints[i][0] != prints[j][0] for i, j in expect) and E.similar(frame.limit(0)).collect() == []
