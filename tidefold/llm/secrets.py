"""Operator 1 (native): secrets found by patterns and by a battery of randomness tests.

Base kinds are patterns; ``random`` is the method's own. A candidate is a
whole run of encoding characters. Its encoding is inferred from the characters
it uses, and three tests ask whether its symbols look drawn at random from
that alphabet: chi-squared uniformity, the number of runs above and below the
middle, and the correlation of neighbours. A candidate that fails any of them
(Bonferroni over the three) is not random. For the others the chance that
ordinary text of that length and alphabet would look as uniform is found from
the non-central chi-squared law of text, and Benjamini-Hochberg over the whole
corpus, by encoding and length band, keeps the share of false discoveries
under FALSE_SHARE. Bands differ in power, so a short run needs far stronger
evidence than a long one.

Runs of decimal digits alone are never reported as random, whatever their
length, and those that pass the battery count as no test: numbers, times and ids use digits
evenly too, so text has no law for them (their share of 1 in ENCODINGS is a
placeholder). A random string of digits outside base spans is not found.

Everything is DataFrame functions. Only the histogram of chances (bands by
bins, whatever the input) reaches the driver. The texts are read once; what
is derived from each is checkpointed.

Defined cases: null text counts as empty; an empty table gives no rows;
repeated rows give a row each; offsets are code points, ends exclusive; a
random run that overlaps a base span is not repeated.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import prepare, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"

FALSE_SHARE = 0.01
#: A candidate whose battery gives less than this is not random.
NOT_RANDOM = 0.001
#: Upper ends of the length bands.
BANDS = (24, 32, 40, 48, 64, 96, 128, 1 << 30)
#: Bins of -log10 of the chance, of a tenth each.
BINS = 160

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order tried: pattern of a member, alphabet, sum of squared symbol shares in text of that kind.
ENCODINGS = (
    ("[0-9]+", DIGITS, 1.0),
    ("[0-9a-f]+", DIGITS + "abcdef", 0.09),
    ("[0-9A-F]+", DIGITS + "ABCDEF", 0.09),
    ("[a-z]+", LOWER, 0.067),
    ("[A-Z2-7]+", UPPER + "234567", 0.065),
    ("[a-z0-9]+", LOWER + DIGITS, 0.06),
    ("[A-Z0-9]+", UPPER + DIGITS, 0.06),
    ("[A-Za-z]+", UPPER + LOWER, 0.06),
    ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS, 0.055),
    (".*", UPPER + LOWER + DIGITS + "+/-_", 0.055),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)


def running(values: Column) -> Column:
    """Sums of all that stands before each element, by blocks of 64, so long arrays don't cost their square."""
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) + 63) / 64).cast("int")), lambda b: F.slice(v, b * 64 + 1, 64))

    def within(pair: Column) -> Column:
        sums = F.transform(pair, total)
        return let(
            F.struct(pair.alias("b"), sums.alias("s")),
            lambda x: F.flatten(F.transform(x["b"], lambda block, i: let(total(F.slice(x["s"], 1, i)), lambda base: F.transform(block, lambda _, j: base + total(F.slice(block, 1, j)))))),
        )

    return let(values, lambda v: let(blocks(v), within))


def spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs start, kind, end; least: characters that group 2 needs."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    lengths = F.transform(hits, F.length)
    value = F.transform(F.regexp_extract_all(text, p, F.lit(2)), F.length) if least else lengths
    found = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), lengths.alias("hit"), value.alias("value"))

    def placed(x: Column) -> Column:
        steps = F.transform(x["hit"], lambda h, i: (x["gap"][i] + F.when(i == 0, 0).otherwise(x["hit"][F.greatest(i - 1, F.lit(0))])).cast("bigint"))
        return let(
            let(steps, running),
            lambda before: F.filter(
                F.transform(
                    x["hit"],
                    lambda h, i: let(
                        (before[i] + x["gap"][i] + F.when(i == 0, 0).otherwise(x["hit"][F.greatest(i - 1, F.lit(0))])).cast("bigint"),
                        lambda at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + h).alias("end"), x["value"][i].alias("value")),
                    ),
                ),
                lambda s: s["value"] >= least,
            ),
        )

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:int>>")
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal law, by the published rational approximation with five terms (fixed values)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-a * a / 2) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(run: Column) -> Column:
    out = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        out = F.when(run.rlike(f"^{ENCODINGS[i][0]}$"), F.lit(i)).otherwise(out)
    return out


def battery(run: Column) -> Column:
    """Of a run without padding: struct of encoding, length, p (of randomness, over the three tests) and chance (of text looking so uniform)."""
    code = encoding(run)

    def looked(x: Column) -> Column:
        n = F.length(x["run"]).cast("double")
        pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), x["code"] + 1)
        k = pick([float(len(a)) for _, a, _ in ENCODINGS])
        delta = pick([max(0.0, len(a) * s - 1) for _, a, s in ENCODINGS])
        alphabet = pick([a for _, a, _ in ENCODINGS])
        chars = F.split(x["run"], "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(x["run"], c, F.lit(""))), F.lit(2.0)))
        chi = k / n * squares - n
        values = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - 1)

        def tests(y: Column) -> Column:
            n, k, chi, v = y["n"], y["k"], y["chi"], y["v"]
            high = F.transform(v, lambda u: (u >= k / 2).cast("double"))
            mean = F.aggregate(v, F.lit(0.0), lambda a, u: a + u) / n
            pairs = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("a"), F.slice(v, 2, F.size(v) - 1).alias("b"))

            def weighed(m: Column) -> Column:
                spread = F.aggregate(v, F.lit(0.0), lambda a, u: a + (u - m["mean"]) * (u - m["mean"]))
                lag = F.aggregate(pairs, F.lit(0.0), lambda a, u: a + (u["a"] - m["mean"]) * (u["b"] - m["mean"]))
                runs = F.aggregate(pairs, F.lit(1.0), lambda a, u: a + ((u["a"] >= k / 2) != (u["b"] >= k / 2)).cast("double"))
                up = m["up"]
                expect = 2 * up * (n - up) / n + 1
                variance = (expect - 1) * (expect - 2) / (n - 1)
                z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
                z_runs = F.when(variance > 0, F.abs(runs - expect) / F.sqrt(F.greatest(variance, F.lit(1e-9)))).otherwise(F.lit(9.0))
                z_lag = F.when(spread > 0, F.abs(lag / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
                p = F.least(F.lit(1.0), 3 * F.least(_normal_tail(z_chi), 2 * _normal_tail(z_runs), 2 * _normal_tail(z_lag)))
                text_mean = k - 1 + n * y["delta"]
                chance = _normal_tail((text_mean - chi) / F.sqrt(2 * (k - 1) + 4 * n * y["delta"]))
                return F.struct(y["code"].alias("code"), n.cast("int").alias("length"), p.alias("p"), chance.alias("chance"))

            return let(F.struct(mean.alias("mean"), F.aggregate(high, F.lit(0.0), lambda a, u: a + u).alias("up")), weighed)

        return let(F.struct(n.alias("n"), k.alias("k"), chi.alias("chi"), delta.alias("delta"), x["code"].alias("code"), values.alias("v")), tests)

    return let(F.struct(run.alias("run"), code.alias("code")), looked)


def _stratum(code: Column, length: Column) -> Column:
    band = F.lit(len(BANDS) - 1)
    for i in reversed(range(len(BANDS) - 1)):
        band = F.when(length <= BANDS[i], F.lit(i)).otherwise(band)
    return code * len(BANDS) + band


def thresholds(histogram: list[tuple[int, int, int]]) -> dict[int, int]:
    """Benjamini-Hochberg by stratum on (stratum, bin, count): the least bin that counts as a discovery.

    Bin b holds chances of at most 10 ** (-b / 10), so bounds err on the safe side.
    """
    by = defaultdict(dict)
    for stratum, b, n in histogram:
        by[stratum][b] = n
    out = {}
    for stratum, bins in by.items():
        m, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if m * 10 ** (-b / 10) <= FALSE_SHARE * seen:
                out[stratum] = b
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): base and random, arrays of structs start, kind (place in KINDS) and end."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id"), text.alias("text"), F.length(text).alias("n_chars"))
    found = found.select(
        "doc_id",
        spans(F.col("text"), ASSIGN, 0, 8).alias("assign"),
        spans(F.col("text"), ACCESS, 1).alias("access"),
        spans(F.col("text"), HEX, 2).alias("hex"),
        spans(F.col("text"), RUN, 3).alias("run"),
        F.when(F.col("text").rlike(RUN), F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("cut"),
    )
    base = F.concat("assign", "access", "hex")
    clear = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    weighed = F.transform(
        F.filter(F.arrays_zip(F.col("run").alias("at"), F.col("cut").alias("cut")), lambda r: clear(r["at"])),
        lambda r: F.struct(r["at"].alias("at"), battery(F.regexp_replace(r["cut"], "=+$", "")).alias("t")),
    )
    kept = (
        found.withColumn("base", base)
        .select("doc_id", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))).alias("base"), weighed.alias("w"))
        .select(
            "doc_id",
            "base",
            F.transform(
                F.filter("w", lambda w: (w["t"]["p"] >= NOT_RANDOM) & (w["t"]["code"] > 0)),
                lambda w: F.struct(
                    w["at"]["start"].alias("start"),
                    F.lit(3).alias("kind"),
                    w["at"]["end"].alias("end"),
                    _stratum(w["t"]["code"], w["t"]["length"]).alias("stratum"),
                    F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(w["t"]["chance"], F.lit(1e-30))))).cast("int").alias("bin"),
                ),
            ).alias("random"),
            # Every candidate counts as a test, also those that the battery rejects.
            F.transform(F.filter("w", lambda w: w["t"]["p"] < NOT_RANDOM), lambda w: _stratum(w["t"]["code"], w["t"]["length"])).alias("rejected"),
        )
        .checkpoint()
    )
    passed = kept.select(F.explode("random").alias("r")).select("r.stratum", "r.bin")
    rejected = kept.select(F.explode("rejected").alias("stratum")).withColumn("bin", F.lit(0))
    counts = [tuple(r) for r in passed.union(rejected).groupBy("stratum", "bin").count().collect()]  # strata x bins at most
    least = thresholds(counts)
    bound = F.array(*(F.lit(least.get(s, BINS + 1)) for s in range(len(ENCODINGS) * len(BANDS))))
    keep = lambda r: r["bin"] >= F.element_at(bound, r["stratum"] + 1)
    return kept.select("doc_id", "base", F.transform(F.filter("random", keep), lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"))).alias("random"))


def _text(found: Column) -> Column:
    ordered = F.array_sort(found)
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text(F.concat("base", "random")).alias("spans"),
        F.size("random").cast("bigint").alias("n_random"),
    )
