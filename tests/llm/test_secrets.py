import hashlib
import random
import re

from pyspark.sql import functions as F

from tidefold.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def name(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def run(spark, docs, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    return secrets.op1_secret_scan(spark, str(tmp_path)).collect()


def test_base_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    bits = ["token", "Secret", "api_key", "APIKEY", "=", ": ", "'", '"', " ", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "x.y/z=", "é", "😀", "\n", "k", "password:", "abcdefgh"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), "s") for i in range(400)]
    docs += [(1000, None, "s"), (1001, "", "s"), (1002, "token==abcdefg token=secret: abcdefghij", "s"), (1003, "é token='abcdefgh1' " * 500, "s"), (1003, "AKIA" + "A" * 12, "s")]
    got = run(spark, docs, tmp_path)
    assert len(got) == len(docs)
    expect = sorted((i, hashlib.sha256(name(base(t or "")).encode()).hexdigest(), *(sum(k == kind for _, k, _ in base(t or "")) for kind in range(3))) for i, t, _ in docs)
    assert sorted((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == expect
    texts = {i: t for i, t, _ in docs}
    for r in got:
        if r.doc_id != 1003:
            assert set(name(base(texts[r.doc_id] or "")).split(",")) - {""} <= set(r.spans.split(","))


def test_random_runs_are_found_and_words_are_not(spark, tmp_path):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    docs = []
    for i in range(200):
        secret = "".join(rng.choice(alphabet) for _ in range(48))
        docs.append((i, f"the key is {secret} keep it", "s"))
    for i in range(200, 600):
        docs.append((i, "a" * 50 + " " + "".join(rng.choice(["the", "tion", "Ing", "data", "Value", "For", "get", "set"]) for _ in range(12)) + " " + "abcdefghijklmnopqrstuvwxyz" * 2, "s"))
    got = {r.doc_id: r for r in run(spark, docs, tmp_path)}
    found = [got[i].spans for i in range(200)]
    assert sum(s == "random:11:59" for s in found) >= 180
    assert sum(got[i].n_random for i in range(200, 600)) == 0


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_no_python_in_plan(spark, tmp_path):
    run(spark, [(1, "x", "s")], tmp_path)
    plan = secrets.find_secrets(spark.read.parquet(f"{tmp_path}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_running_sums(spark):
    rows = [([1] * n,) for n in (0, 1, 63, 64, 65, 300)]
    for r in spark.createDataFrame(rows, "a array<bigint>").select("a", secrets.running(F.col("a")).alias("r")).collect():
        assert r.r == list(range(len(r.a)))
