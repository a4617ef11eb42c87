import random

import corpus_pipeline
from tidefold.llm import queries

GOOD = [a + b + c for a in ("ta", "le", "mo", "si", "ru") for b in ("rin", "fol", "da", "ket") for c in ("", "s", "ning", "er")]


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(GOOD) for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = "\n".join(say(9) + "." for _ in range(6)) + (f"\n{say(2)} grobble snarf!" if toxic else "")
        docs.append((i, text, "en", "ab"[i % 2], len(text)))
        labels.append((i, 1, int(toxic)))
    shared = "\n".join(say(12) for _ in range(8))
    copy = docs[1][1]
    docs += [(1000, copy + " extra", "en", "a", 1), (1001, shared, "en", "a", 1), (1002, say(30) + "\n" + shared, "en", "b", 1), (1003, None, None, None, None), (1004, "", "en", "a", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frame.columns
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(frame)
    ids = lambda k: {r.doc_id for r in kept[k].collect()}
    clean = {i for i in range(400) if i % 5} | {1000, 1001, 1002, 1003, 1004}
    assert ids(0) == clean
    assert ids(1) <= clean and {1, 1003, 1004} <= ids(1)
    assert not {1000, 1} <= ids(2) and {1003, 1004} <= ids(2)
    assert ids(3) <= ids(2)
    words = sum(len((r.text or "").split()) for r in kept[2].collect())
    assert abs(sum(len((r.text or "").split()) for r in kept[3].collect()) - 1.5 * words) < 200
    assert {r.doc_id for r in kept[4].collect()} == ids(3)
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == kept[4].columns


def test_registry():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_short_passages_go(spark):
    """Two lines between differing neighbours go in the stages for lines and near copies."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(GOOD) for _ in range(n))
    shared, copy = f"{say(9)}\n{say(9)}", say(400)
    docs = [(i, f"{say(20)}\n{say(20)}\n{shared}\n{say(20)}\n{say(20)}", "en", "a", 1) for i in range(6)] + [(6, copy, "en", "a", 1), (7, copy + " more", "en", "a", 1)]
    out = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_copies):
        out = stage(spark, out, "")
    assert sorted(r.doc_id for r in out.collect() if shared in r.text) == [0] and sorted(r.doc_id for r in out.collect()) == list(range(7))
