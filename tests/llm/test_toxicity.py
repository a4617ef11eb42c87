import random

import numpy as np
import pytest

from tidefold.llm import toxicity

BAD = ["grobble", "snarf", "wimbly"]
GOOD = [a + b + c for a in ("ta", "le", "mo", "si") for b in ("rin", "fol", "da") for c in ("", "s", "ning")]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(GOOD) for _ in range(8)) + "." for _ in range(rng.randint(1, 12))]
        y = rng.random() < 0.2
        if y:
            sentences.insert(rng.randrange(len(sentences)), "É " + " ".join([rng.choice(GOOD), rng.choice(BAD) + rng.choice(["", "s", "ish"]), rng.choice(BAD)]) + "!")
        rows.append((i, " ".join(sentences), int(y)))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(t, y) for _, t, y in corpus(1, 1500)])


def test_held_out_accuracy_and_place(model):
    for _, text, y in corpus(2, 400):
        parts = model.sentences(text)
        assert (1 - np.prod([1 - p for _, _, p in parts]) >= 0.5) == bool(y)
        assert [text[a:b].strip()[0] for a, b, p in parts if p >= 0.5] == ["É"] * y


def test_one_class_scores_zero():
    assert toxicity.fit([("a b", 0)] * 5).sentences("a b.")[0][2] < 1e-9
    assert toxicity.fit([]).weights == {}


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, text string").write.parquet(f"{path}/labels.parquet")


def test_query(spark, tmp_path):
    rows = corpus(3, 1500)
    docs = [(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (9002, "grobble snarf! " * 4000, "x"), (5, rows[5][1], "x"), (None, "talerin", "x")]
    write(spark, tmp_path, docs, [(i, y, "x") for i, _, y in rows] + [(1, None, "x"), (None, 1, "x")])
    got = toxicity.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 200 < len(held) < 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score == 0 and by[9002].predicted == 1


def test_labels_of_the_held_out_fold_do_not_matter(spark, tmp_path):
    import zlib

    rows = corpus(4, 600)
    docs = [(i, t, "x") for i, t, _ in rows]
    write(spark, tmp_path / "a", docs, [(i, y, "x") for i, _, y in rows])
    write(spark, tmp_path / "b", docs, [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y, "x") for i, _, y in rows])
    a, b = ({r.doc_id: r.score for r in toxicity.op3_toxicity(spark, str(tmp_path / x)).collect()} for x in "ab")
    assert a == b


def test_clean_and_empty(spark):
    rows = corpus(5, 800)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(7777, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = toxicity.clean(spark, docs, labels)
    assert out.schema == docs.schema
    assert {r.doc_id for r in out.collect()} == {i for i, _, y in rows if not y} | {7777}
    assert toxicity.clean(spark, docs.limit(0), labels.limit(0)).collect() == []


def test_documents_stay_off_the_driver(spark, monkeypatch):
    """The model is fitted in a task: the driver's own fit is never called, and the result is the same."""
    rows = [(i, t, y) for i, t, y in corpus(6, 400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    known = labels.where(toxicity.id_fold(labels["doc_id"], toxicity.FOLDS) != 0).orderBy(toxicity.F.xxhash64("doc_id", toxicity.F.lit(7)), "doc_id")
    by = {i: t for i, t, _ in rows}
    expect = toxicity.fit([(by[r.doc_id], r.toxic) for r in known.collect()])
    toxicity.prepare(spark)
    monkeypatch.setattr(toxicity, "fit", None)
    got = toxicity.train(docs, labels)
    assert got.weights == pytest.approx(expect.weights) and got.bias == pytest.approx(expect.bias) and got.weights
    assert toxicity.train(docs, labels.limit(0)).weights == {} and toxicity.train(docs, labels.limit(0)).bias == -30.0


def test_remembered_words_are_bounded(model, monkeypatch):
    text = " ".join(f"{a}{b}" for a in GOOD for b in ("x", "y")) + " grobble snarf."
    expect = model.sentences(text)
    monkeypatch.setattr(toxicity, "KNOWN", 10)
    small = toxicity.Model(model.weights, model.bias)
    assert [p for _, _, p in small.sentences(text)] == pytest.approx([p for _, _, p in expect]) and len(small.known) <= 10
