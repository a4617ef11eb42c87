"""Operator 9 (native): line dedup by content-defined chunks of lines.

Each line is hashed; a line is a mark if its hash, rolled together with that
of the line before, is divisible by CUT, and a chunk ends after a mark that
follows no mark, unless a single line would be left at either end. So a
boundary depends on three lines only, lines put in or taken out elsewhere do
not shift it, and only a text of one line is a chunk of one line. A
chunk of two or more lines with text that occurs again anywhere is removed,
but for its first occurrence (least id, then place). Chunks meet by a 64-bit
hash; before one is removed its bytes are compared with the first's.

Light rows (ids and hashes) are counted first; only chunks whose hash repeats
carry their text to the comparison. Counts and firsts are aggregated before
the shuffle, so a line that a third of all documents hold costs one row a
task. Everything is DataFrame functions.

Chunks are long, so a short passage between differing neighbours seldom holds
a whole one. ``dedup_passages`` finds every repeated passage of two lines or
more instead: its pieces are all windows from one line that is not blank to
the next that is not, found and compared in the same way. A line goes if a
window that stands earlier elsewhere covers it, unless it belongs to the first
place of a window that repeats, so each repeated window stays whole once.

Each expression over a text's pieces computes them once for the row, by a
lambda over an array of one: a column that is used inside a lambda would be
computed for each of its elements once the optimiser has put it there, which
takes the square of the pieces of a very long text.

Defined cases: null text stays null; a text without a repeated chunk stays as
it is, byte for byte; chunks with fewer than two lines that are not blank are
kept; rows alike in id and text are one document and keep the same chunks; an
empty table gives no rows; other columns pass through whatever their names, but
for the counts that an operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import forget, packed, prepare, settled, table, unpacked, written

#: One line in so many is a mark.
CUT = 4
LEAST_LINES = 2
_ADDED = ("n_lines", "n_lines_removed", "n_chunks_removed")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column) -> Column:
    """Array of structs lines (array), hash, multi (whether it may be removed), in order."""

    def cut(x: Column) -> Column:
        rolled = lambda i: F.pmod(F.xxhash64(F.coalesce(F.get(x["hashes"], i - 2), F.lit(0).cast("bigint")), F.get(x["hashes"], i - 1)), F.lit(CUT)) == 0
        n = F.size(x["lines"])
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i > 1) & (i < n - 1) & rolled(i) & ~rolled(i - 1)))
        return _let(
            ends,
            lambda e: F.transform(
                e,
                lambda end, i: _let(
                    F.slice(x["lines"], F.coalesce(F.get(e, i - 1), F.lit(0)) + 1, end - F.coalesce(F.get(e, i - 1), F.lit(0))),
                    lambda own: F.struct(
                        own.alias("lines"),
                        F.xxhash64(F.array_join(own, "\n")).alias("hash"),
                        (F.size(F.filter(own, lambda s: F.length(F.trim(s)) > 0)) >= LEAST_LINES).alias("multi"),
                    ),
                ),
            ),
        )

    lines = F.split(text, "\n", -1)
    return _let(lines, lambda v: _let(F.struct(v.alias("lines"), F.transform(v, lambda s: F.xxhash64(s)).alias("hashes")), cut))


def _full(lines: Column) -> Column:
    """Places of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda s, i: F.when(F.length(F.trim(s)) > 0, i)), lambda i: i.isNotNull())


def passages(text: Column) -> Column:
    """Array of structs lines (array), hash, multi (true), low and high (places of the first and last line): each line that is not blank with the next that is not."""

    def windows(x: Column) -> Column:
        def window(low: Column, i: Column) -> Column:
            high = F.get(x["full"], i + 1)
            return _let(
                F.slice(x["lines"], low + 1, high - low + 1),
                lambda own: F.struct(own.alias("lines"), F.xxhash64(F.array_join(own, "\n")).alias("hash"), F.lit(True).alias("multi"), low.alias("low"), high.alias("high")),
            )

        return F.transform(F.slice(x["full"], 1, F.greatest(F.size(x["full"]) - 1, F.lit(0))), window)

    return _let(F.split(text, "\n", -1), lambda v: _let(F.struct(v.alias("lines"), _full(v).alias("full")), windows))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["_t"] == b["_text"])


def _repeats(keyed: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """Of the pieces that cut makes of keyed (doc_id, text, _t): those whose hash repeats (doc_id, _t, _i, hash, is_first), and the copies that equal the first by bytes (doc_id, _t, i)."""
    light = keyed.select("doc_id", "_t", F.posexplode(F.transform(cut(F.col("text")), lambda c: F.struct(c["hash"].alias("hash"), c["multi"].alias("multi")))).alias("_i", "_c"))
    light = light.where("_c.multi").select("doc_id", "_t", "_i", F.col("_c.hash").alias("hash"))
    firsts = light.groupBy("hash").agg(F.min(F.struct("doc_id", "_t", "_i")).alias("first"), F.max(F.struct("doc_id", "_t", "_i")).alias("last")).where("first <> last")

    # Which pieces of each document are first, or copies to compare, by hash.
    held = light.join(firsts, "hash").select("doc_id", "_t", "_i", "hash", (F.struct("doc_id", "_t", "_i") == F.col("first")).alias("is_first")).distinct()
    lists = held.groupBy(F.col("doc_id").alias("_id"), F.col("_t").alias("_text")).agg(F.collect_list(F.struct("_i", "hash", "is_first")).alias("_held"))
    joined = keyed.join(lists, _same(keyed, lists)).select("doc_id", "_t", "_held", "text")
    piece = lambda c: F.transform("_held", lambda h: F.struct(h["_i"].alias("i"), h["hash"].alias("hash"), h["is_first"].alias("is_first"), F.array_join(F.get(c, h["_i"])["lines"], "\n").alias("chunk")))
    texts = joined.select("doc_id", "_t", F.explode(_let(cut(F.col("text")), piece)).alias("h")).select("doc_id", "_t", "h.*")
    kept = texts.where("is_first").groupBy("hash").agg(F.min("chunk").alias("_first"))
    copies = texts.where("NOT is_first").join(kept, "hash").where("chunk = _first")
    return held, copies


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with text shortened and the columns n_lines, n_lines_removed and n_chunks_removed added, in place of any of these names."""
    full = packed(docs).withColumn("_t", F.xxhash64("text"))
    keyed = full.where("text IS NOT NULL").select("doc_id", "text", "_t")
    _, copies = _repeats(keyed, chunks)
    gone = copies.groupBy(F.col("doc_id").alias("_id"), F.col("_t").alias("_text")).agg(F.collect_set("i").alias("_gone"))

    left = lambda c: _let(
        F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.col("_gone")),
        lambda keep: _let(F.flatten(F.transform(keep, lambda k: F.get(c, k)["lines"])), lambda v: F.struct(F.array_join(v, "\n").alias("text"), F.size(v).alias("n"))),
    )
    out = full.join(gone, _same(full, gone), "left").withColumn("_done", F.when(F.col("_gone").isNotNull(), _let(chunks(F.col("text")), left)))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    return out.select(
        *unpacked([c for c in docs.columns if c not in _ADDED], text=F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.col("_done.text"))),
        F.when(F.col("text").isNull(), 0).otherwise(lines).cast("bigint").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(lines - F.col("_done.n")).cast("bigint").alias("n_lines_removed"),
        F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("bigint").alias("n_chunks_removed"),
    )


def dedup_passages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with every repeated passage of two lines or more taken out of text, and the columns n_lines and n_lines_removed added, in place of any of these names."""
    prepare(docs.sparkSession)
    full = packed(docs).withColumn("_t", F.xxhash64("text"))
    keyed = full.where("text IS NOT NULL").select("doc_id", "text", "_t")
    held, copies = _repeats(keyed, passages)
    marks = copies.select("doc_id", "_t", "i", F.lit(False).alias("stays")).unionByName(held.where("is_first").select("doc_id", "_t", F.col("_i").alias("i"), F.lit(True).alias("stays")))
    # What was sent to compare pieces holds texts too; it goes before texts are sent again.
    marks = settled(marks.groupBy(F.col("doc_id").alias("_id"), F.col("_t").alias("_text")).agg(F.collect_set(F.when(~F.col("stays"), F.col("i"))).alias("_gone"), F.collect_set(F.when(F.col("stays"), F.col("i"))).alias("_kept")).where(F.size("_gone") > 0))
    forget(docs.sparkSession)

    def left(v: Column) -> Column:
        covered = lambda full, name: F.flatten(F.transform(F.col(name), lambda i: F.sequence(F.get(full, i), F.get(full, i + 1))))
        drop = lambda full: F.array_except(covered(full, "_gone"), covered(full, "_kept"))
        keep = lambda full: F.array_except(F.sequence(F.lit(0), F.size(v) - 1), drop(full))
        return _let(_full(v), lambda full: _let(keep(full), lambda k: F.struct(F.array_join(F.transform(k, lambda j: F.get(v, j)), "\n").alias("text"), F.size(k).alias("n"))))

    out = full.join(marks, _same(full, marks), "left").withColumn("_done", F.when(F.col("_gone").isNotNull(), _let(F.split("text", "\n", -1), left)))
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    return out.select(
        *unpacked([c for c in docs.columns if c not in _ADDED[:2]], text=F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.col("_done.text"))),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(n_lines - F.col("_done.n")).cast("bigint").alias("n_lines_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_lines_removed", "n_chunks_removed", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def strip_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with repeated chunks taken out and n_chars counted again; a document that consisted of nothing else goes."""
    prepare(spark)
    return _stripped(docs, dedup_lines, "n_chunks_removed")


def strip_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every repeated passage of two lines or more taken out, otherwise as strip_documents. docs is written first, as it is read several times."""
    prepare(spark)
    given = [docs]
    del docs  # else what was sent to make it stays on the disk
    return _stripped(written(given.pop()), dedup_passages, "n_lines_removed")


def _stripped(docs: DataFrame, dedup, removed: str) -> DataFrame:
    done = dedup(packed(docs))
    done = done.where((F.col("text") != "") | F.col("text").isNull() | (F.col(removed) == 0))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("_rest").getField("n_chars"))
    return done.select(unpacked(docs.columns, **changed))
