import hashlib
import random
import re
import time

import xxhash

from tidefold.llm import lines


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def h64(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def chunks(text):
    rows, out, start = text.split("\n"), [], 0
    hashes = [h64(r.encode()) for r in rows]
    mark = [signed(h64(hashes[i].to_bytes(8, "little"), h64((hashes[i - 1] if i else 0).to_bytes(8, "little")))) % lines.CUT == 0 for i in range(len(rows))]
    for i in range(len(rows)):
        if i == len(rows) - 1 or 0 < i < len(rows) - 2 and mark[i] and not mark[i - 1]:
            out.append(rows[start : i + 1])
            start = i + 1
    return out


def brute(docs):
    """Kept text of each distinct (id, text)."""
    seen = {}
    cut = {(i, t): chunks(t) for i, t in docs if t is not None}
    for (i, t), cs in cut.items():
        for k, c in enumerate(cs):
            if sum(bool(x.strip(" ")) for x in c) >= 2:
                where = (i is not None, i or 0, signed(h64(t.encode())), k)
                seen.setdefault("\n".join(c), []).append((where, (i, t, k)))
    gone = {w for found in seen.values() for _, w in sorted(found)[1:]}
    return {d: "\n".join("\n".join(c) for k, c in enumerate(cs) if (*d, k) not in gone) for d, cs in cut.items()}


def corpus():
    rng = random.Random(9)
    pool = [f"line {k} é" for k in range(30)] + ["", " ", "x"]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(2, 9))] for _ in range(12)]
    docs = [(i, "\n".join(x for _ in range(rng.randint(0, 4)) for x in (rng.choice(blocks) if rng.random() < 0.7 else [f"own {rng.random()}"] * 3))) for i in range(150)]
    return docs + [(3, docs[3][1]), (4, "other text\nof id 4"), (None, docs[5][1]), (900, None), (901, ""), (902, "\n".join(f"long {k % 700}" for k in range(3000)))]


def test_equals_brute_force(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, hash int").write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute(docs)
    got = sorted(((r.doc_id, r.kept_sha256, r.n_lines - r.n_lines_removed) for r in lines.op9_line_dedup(spark, str(tmp_path)).collect()), key=str)
    expect = []
    for i, t in docs:
        text = kept.get((i, t), "")
        left = sum(map(len, chunks(t))) - (len(t.split("\n")) - (len(text.split("\n")) if text or t == "" else 0)) if t is not None else 0
        expect.append((i, hashlib.sha256(text.encode()).hexdigest(), left))
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expect, key=str)]
    assert any(kept[d] != d[1] for d in kept) and any(kept[d] == d[1] for d in kept)


def test_pipeline_form_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    same = "\n".join(f"shared line {k}" for k in range(12))
    docs = spark.createDataFrame([(1, same, "en", "a", len(same)), (2, same, "en", "b", len(same)), (3, "clean\ntext", None, None, 10), (4, None, "en", "a", None)], schema)
    out = lines.strip_documents(spark, docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, same), (3, "clean\ntext")]
    assert {r.doc_id for r in out.collect()} == {1, 3, 4}
    assert lines.strip_documents(spark, docs.limit(0)).collect() == []
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def windows(text):
    rows = text.split("\n")
    full = [i for i, x in enumerate(rows) if x.strip(" ")]
    return [(a, b, "\n".join(rows[a : b + 1])) for a, b in zip(full, full[1:])]


def brute_passages(docs):
    first, out = {}, {}
    for d in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, signed(h64(d[1].encode())))):
        for k, (_, _, w) in enumerate(windows(d[1])):
            first.setdefault(w, []).append((d, k))
    for d in {d for d in docs if d[1] is not None}:
        cover = {True: set(), False: set()}
        for k, (a, b, w) in enumerate(windows(d[1])):
            if len(first[w]) > 1:
                cover[first[w][0] == (d, k)].update(range(a, b + 1))
        gone = cover[False] - cover[True]
        out[d] = "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone)
    return out


def test_passages_equal_brute_force(spark):
    docs = corpus() + [(910, "same\n" * 5), (911, "a b\n\n \nc d\nown 911"), (912, "own 912\na b\n\n \nc d")]
    kept = brute_passages(docs)
    got = sorted(((r.doc_id, r.text, r.n_lines_removed) for r in lines.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    expect = [(i, kept.get((i, t)), 0 if t is None or kept[i, t] == t else len(t.split("\n")) - (len(kept[i, t].split("\n")) if kept[i, t] else 0)) for i, t in docs]
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expect, key=str)]
    assert kept[910, "same\n" * 5] == "same\nsame\n" and kept[912, docs[-1][1]] == "own 912"


def planted(rng, n=240):
    """Passages of 2 to 6 lines between differing neighbours, each in two documents, and the lines that must go."""
    own = lambda tag, k: [f"{tag} line {j} {rng.random()}" for j in range(k)]
    docs, gone = [], {}
    for p in range(n):
        passage = own(f"passage {p}", 2 + p % 5)
        for i in (p, n + p):
            docs.append((i, "\n".join(own(f"before {i}", rng.randint(1, 8)) + passage + own(f"after {i}", rng.randint(1, 8)))))
        gone[n + p] = passage
    return docs, gone


def test_planted_passages_go(spark):
    docs, gone = planted(random.Random(12))
    out = {r.doc_id: r.text for r in lines.strip_passages(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert out[i].split("\n") == [x for x in t.split("\n") if x not in gone.get(i, [])]


def test_clashing_columns_pass_through(spark):
    same = "\n".join(f"shared line {k}" for k in range(12))
    schema = "doc_id long, text string, _id int, n_lines int, _gone int, `a.b` int, _rest int"
    docs = spark.createDataFrame([(1, same, 1, 2, 3, 4, 5), (2, same + "\nown\nlines", 6, 7, 8, 9, 10), (None, None, 1, 1, 1, 1, 1)], schema)
    for strip in (lines.strip_documents, lines.strip_passages):
        out = strip(spark, docs)
        assert out.columns == docs.columns
        assert sorted((r[0], *r[2:]) for r in out.collect() if r[0]) == [(1, 2 - 1, 2, 3, 4, 5), (2, 6, 7, 8, 9, 10)]
    out = lines.dedup_lines(docs)
    assert [c for c in out.columns if c != "n_lines"] == ["doc_id", "text", "_id", "_gone", "a.b", "_rest", "n_lines_removed", "n_chunks_removed"]
    assert sorted(r.n_lines for r in out.collect()) == [0, 12, 14]


def test_long_text_of_repeated_lines(spark):
    """Two texts of 20,000 lines that share all but some: in time only if pieces are computed once a row."""
    own = "\n".join(f"line {k}" for k in range(20_000))
    other = "\n".join(f"line {k}" if k % 50 else f"other {k}" for k in range(20_000))
    docs = spark.createDataFrame([(1, own), (2, other)], "doc_id long, text string")
    out = {r.doc_id: r.text.split("\n") for r in lines.strip_passages(spark, docs).collect()}
    assert out[1] == own.split("\n") and out[2] == [f"other {k}" for k in range(0, 20_000, 50)]
    assert all(r.text for r in lines.strip_documents(spark, docs).collect())


def test_texts_sent_are_dropped_before_the_next(spark, monkeypatch):
    """What made the rows that strip_passages writes is gone when passages are sought, and what that sent when its frame is returned."""
    sc = spark.sparkContext._jsc.sc()
    known = sc.env().mapOutputTracker().shuffleStatuses()

    def left(before, limit=5):
        """Shuffles on disk besides those before, once the cleaner, which works beside, has had its time."""
        end = time.time() + limit
        while (found := set(map(int, known.keys().mkString(",").split(",") if known.size() else [])) - before) and time.time() < end:
            time.sleep(0.1)
        return found

    docs, gone = planted(random.Random(5), 20)
    before, seen, dedup = left(set(), 0), [], lines.dedup_passages

    def watched(docs):
        seen.append(left(before))
        return dedup(docs)

    monkeypatch.setattr(lines, "dedup_passages", watched)
    frame = lambda: spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    out = lines.strip_passages(spark, frame())
    assert seen == [set()] and left(before) == set()
    assert {r.doc_id: r.text for r in out.collect()} == {i: "\n".join(x for x in t.split("\n") if x not in gone.get(i, [])) for i, t in docs}
    assert len(left(before, 0)) <= 2  # the result sends texts and marks alone
