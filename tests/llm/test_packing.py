import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidefold.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit(lengths, capacity):
    """Best-fit decreasing, one document at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(g := min(fits))
        else:
            g = capacity
        gaps.append(g - n)
    return len(gaps), sorted(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.choice([rng.randint(1, capacity), 3]) for _ in range(rng.choice([0, 1, 50, 400]))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    runs = sorted(packing.plan(counts, capacity))
    used = defaultdict(list)
    for n, total in counts.items():
        for rank in range(total):
            _, first, each, seq, offset = [r for r in runs if r[0] == n and r[1] <= rank][-1]
            used[seq + (rank - first) // each].append((offset + (rank - first) % each * n, n))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert (len(used), sorted(capacity - sum(n for _, n in p) for p in used.values())) == best_fit(lengths, capacity)


def test_encoder_equals_tokenizer():
    slow = Tokenizer.from_file(PATH)
    encode = packing.encoder(PATH)
    rng = random.Random(1)
    texts = ["", " ", "  a", "a ", "a\n b  c\t", "it's we'll", "<|endoftext|> x<|endoftext|>", "x" * 300 + " y", "été ñ 漢字 😀  b c", "\x85 a"]
    texts += ["".join(rng.choice("ab1 é\n\t'.,  ") for _ in range(80)) for _ in range(300)]
    for t in texts:
        ids = slow.encode(t, add_special_tokens=False).ids
        assert encode(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


def test_pack_documents(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice([None, "", "word " * rng.randint(1, 30), "long text here " * 2000]), "x") for i in range(40)] + [(3, "same", "y")] * 2
    rows = packing.pack_documents(spark, spark.createDataFrame(docs, "doc_id long, text string, length string")).collect()
    slow = Tokenizer.from_file(PATH)
    expect = defaultdict(list)
    for i, t, _ in docs:
        expect[i].append([*slow.encode(t or "", add_special_tokens=False).ids, 0])
    sequences = defaultdict(list)
    got = defaultdict(int)
    for r in rows:
        assert any(zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32 for ids in expect[r.doc_id] if len(ids) >= r.start + r.length)
        assert r.length == 2048 or r.piece == 0
        sequences[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id] += r.length
    assert got == {i: sum(map(len, x)) for i, x in expect.items()}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) == best_fit([r.length for r in rows], 2048)[0]


def test_classes_ranked_in_groups(spark, monkeypatch):
    rows = [(i, 0, 7 if i % 3 else 5, i) for i in range(9000)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")
    packed = packing.pack(items, 64).collect()
    used = defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    assert len(packed) == 9000 and len(used) == best_fit([r[2] for r in rows], 64)[0]


def test_empty_table(spark):
    assert packing.pack_documents(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
