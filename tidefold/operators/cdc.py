"""Change-data capture on DataFrames: normalise, assemble, order, and apply.

An event has operation, source_schema, source_table, before and after
(map<string,string>), position_type, position_value and source_ts_ms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def _error(text: str) -> Column:
    return F.raise_error(F.lit(text)).cast("string")


def fields(m: Column) -> Column:
    """Column values in order of their names, each with a null mark and its encoding."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias("column"), e["value"].isNull().alias("null"), F.coalesce(e["value"], F.lit("")).alias("value"), F.lit("text").alias("encoding")))


def debezium(raw: DataFrame, value: str = "value") -> DataFrame:
    """Events of Debezium envelopes, wrapped in a payload or bare; ill-formed ones raise."""
    body = F.coalesce(F.get_json_object(value, "$.payload"), F.col(value))
    get = lambda p: F.get_json_object("_b", f"$.{p}")
    source = lambda n: get(f"source.{n}")
    op = get("op")
    operation = F.when(get("ddl").isNotNull(), "DDL").when(op.isin("c", "r"), "INSERT").when(op == "u", "UPDATE").when(op == "d", "DELETE").otherwise(_error("no such operation"))
    image = lambda n: F.from_json(get(n), _MAP)
    lacks = (F.col("operation").isin("UPDATE", "DELETE") & F.col("before").isNull()) | (F.col("operation").isin("INSERT", "UPDATE") & F.col("after").isNull())
    file = F.when(source("file").isNotNull() & source("pos").isNotNull(), F.concat_ws(":", source("file"), source("pos")))
    # In order of precedence.
    positions = [("GTID", source("gtid")), ("FILE", file), ("LSN", source("lsn")), ("LSN", F.coalesce(source("change_lsn"), source("commit_lsn"))), ("SCN", F.coalesce(source("scn"), source("commit_scn")))]
    kind, place = F.lit(None).cast("string"), F.coalesce(*(p for _, p in positions))
    for name, p in reversed(positions):
        kind = F.when(p.isNotNull(), name).otherwise(kind)
    number = lambda n: F.coalesce(source(n), get(n)).cast("bigint")
    millis = F.coalesce(number("ts_ms"), F.floor(number("ts_us") / 1000), F.floor(number("ts_ns") / 1000000)).cast("bigint")
    out = raw.withColumn("_b", body).withColumns({"operation": operation, "source_schema": F.coalesce(source("db"), source("schema")), "source_table": source("table"), "before": image("before"), "after": image("after"), "position_type": kind, "position_value": F.coalesce(place, _error("no position")), "source_ts_ms": millis})
    return out.withColumn("operation", F.when(lacks, _error("an image is missing")).otherwise(F.col("operation"))).drop("_b", value)


def overlay(data: Column, old: Column) -> Column:
    """data with the entries of old in place of its own: the row before the change."""
    keys = F.coalesce(F.map_keys(old), F.array().cast("array<string>"))
    return F.map_concat(F.map_filter(data, lambda k, v: ~F.array_contains(keys, k)), F.coalesce(old, F.create_map().cast(_MAP)))


def canal(raw: DataFrame, value: str = "value") -> DataFrame:
    """Events of Canal messages, one a row of data; only the last row of a message carries its position."""
    schema = f"id bigint, database string, `table` string, type string, es bigint, isDdl boolean, sql string, data array<{_MAP}>, old array<{_MAP}>"
    m = raw.withColumn("_m", F.from_json(value, schema)).drop(value)
    rows = m.select("*", F.posexplode_outer("_m.data").alias("_i", "_d"))
    kind, is_ddl = F.upper("_m.type"), F.coalesce(F.col("_m.isDdl"), F.lit(False))
    last = F.col("_i").isNull() | (F.col("_i") == F.size("_m.data") - 1)
    before = F.when(kind == "UPDATE", overlay(F.col("_d"), F.get("_m.old", F.col("_i")))).when(kind == "DELETE", F.col("_d"))
    return rows.withColumns({
        "operation": F.when(is_ddl, "DDL").when(kind.isin("INSERT", "UPDATE", "DELETE"), kind).otherwise(_error("no such operation")),
        "source_schema": F.col("_m.database"), "source_table": F.col("_m.table"), "sql": F.col("_m.sql"), "before": before,
        "after": F.when(kind.isin("INSERT", "UPDATE"), F.col("_d")), "position_value": F.when(last, F.concat_ws("@", "_m.id", "_m.es")),
        "source_ts_ms": F.col("_m.es"), "row": F.col("_i"),
    }).drop("_m", "_i", "_d")


def ticdc(raw: DataFrame, value: str = "value") -> DataFrame:
    """Rows and watermarks of TiCDC messages: tso, whether it is a watermark, operation and images; binary columns as base64."""
    schema = f"database string, `table` string, type string, es bigint, mysqlType {_MAP}, data array<{_MAP}>, old array<{_MAP}>, _tidb struct<commitTs: bigint, watermarkTs: bigint>"
    m = raw.withColumn("_m", F.from_json(value, schema)).drop(value)
    mark = F.col("_m.type") == "TIDB_WATERMARK"
    tso = F.coalesce(F.when(mark, F.col("_m._tidb.watermarkTs")).otherwise(F.col("_m._tidb.commitTs")), _error("no commit time").cast("bigint"))
    binary = lambda k: F.lower(F.coalesce(F.element_at(F.col("_m.mysqlType"), k), F.lit(""))).rlike("blob|binary")
    coded = lambda d: F.transform_values(d, lambda k, v: F.when(binary(k), F.base64(F.encode(v, "ISO-8859-1"))).otherwise(v))
    row, old = F.get("_m.data", F.lit(0)), F.get("_m.old", F.lit(0))
    kind = F.upper("_m.type")
    return m.withColumns({
        "tso": tso, "is_watermark": mark, "operation": F.when(mark, "CHECKPOINT").otherwise(kind), "source_schema": F.col("_m.database"), "source_table": F.col("_m.table"),
        "before": F.when(kind == "UPDATE", coded(overlay(row, old))).when(kind == "DELETE", coded(row)), "after": F.when(kind.isin("INSERT", "UPDATE"), coded(row)),
        "source_ts_ms": F.when(F.col("_m.es") > 0, F.col("_m.es")).otherwise(F.shiftright(tso, 18)),
    }).drop("_m")


# --- assembly


def transactions(log: DataFrame, stream: str, order: str, kind: str = "kind") -> DataFrame:
    """Rows of BEGIN .. COMMIT groups with tx (number in the stream) and the commit's order; rolled-back and unfinished groups are left out."""
    w = Window.partitionBy(stream).orderBy(order)
    numbered = log.withColumn("tx", F.sum((F.col(kind) == "BEGIN").cast("bigint")).over(w))
    g = Window.partitionBy(stream, "tx")
    ended = numbered.withColumns({"commit_order": F.max(F.when(F.col(kind) == "COMMIT", F.col(order))).over(g), "_r": F.max(F.when(F.col(kind) == "ROLLBACK", F.col(order))).over(g)})
    return ended.where((F.col(kind) == "ROW") & F.col("commit_order").isNotNull() & F.col("_r").isNull() & (F.col(order) < F.col("commit_order"))).drop("_r")


def coalesce_rows(rows: DataFrame, keys: Sequence[str], order: str, text: str, more: str) -> DataFrame:
    """Joins continuation rows: a row whose flag `more` is set goes on in the next of its keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.coalesce(F.sum((~F.col(more)).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.withColumn("_g", island).groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_p"))
    return parts.select(*keys, F.col("_p")[0][order].alias(order), F.array_join(F.transform("_p", lambda p: p[text]), "").alias(text))


def pair_updates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change-table rows to events: op 1 deletes, 2 inserts, 3 with 4 update; an update without its other half raises."""
    sides = rows.where("op IN (3, 4)").groupBy(*keys).agg(F.max(F.when(F.col("op") == 3, F.col("row"))).alias("before"), F.max(F.when(F.col("op") == 4, F.col("row"))).alias("after"))
    lost = F.col("before").isNull() | F.col("after").isNull()
    updates = sides.select(*keys, F.when(lost, _error("half an update")).otherwise("UPDATE").alias("operation"), "before", "after")
    single = rows.where("op IN (1, 2)").select(*keys, F.when(F.col("op") == 1, "DELETE").otherwise("INSERT").alias("operation"), F.when(F.col("op") == 1, F.col("row")).alias("before"), F.when(F.col("op") == 2, F.col("row")).alias("after"))
    return updates.unionByName(single)


def merge_ddl(binary: DataFrame, ddl: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transactions matched one to one with their DDL side stream; a leftover on either side raises."""
    both = binary.withColumn("_a", F.lit(True)).join(ddl.withColumn("_b", F.lit(True)), list(keys), "full")
    return both.withColumn("matched", F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a transaction lacks its other part")).cast("boolean")).otherwise(True)).drop("_a", "_b")


def merge_intervals(sets: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of each key with overlapping and adjacent ones merged (GTID sets)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)).over(w)
    return sets.withColumn("_r", reach).withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


# --- order


def ordered_merge(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows (stream, ord) up to the least resolved order of all streams, that order included; a stream without one raises."""
    bound = resolved.agg(F.min("resolved").alias("_bound"), F.count_if(F.col("resolved").isNull()).alias("_open"))  # one row
    limit = F.when(F.col("_open") > 0, F.raise_error(F.lit("a stream is not resolved")).cast("bigint")).otherwise(F.col("_bound"))
    return rows.crossJoin(F.broadcast(bound)).where((F.col("ord") > 0) & (F.col("ord") <= limit)).drop("_bound", "_open")


def resolved_release(rows: DataFrame, resolved: DataFrame, acked: int = 0) -> DataFrame:
    """Rows (part, tso) that every partition has resolved beyond (strictly), later than the acknowledged one."""
    bound = resolved.agg(F.min("resolved").alias("_bound"))  # one row
    return rows.where(F.col("tso") > acked).crossJoin(F.broadcast(bound)).where("tso < _bound").drop("_bound")


# --- apply


def key_operations(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events (ord, operation, before, after) to operations on keys: key (map), row (null for a delete), ord, step. An update that changes a key deletes the old one first."""
    pick = lambda m: F.map_filter(m, lambda k, v: k.isin(*keys))
    after, before = pick(F.col("after")), pick(F.col("before"))
    side = lambda k, row, step: F.struct(k.alias("key"), row.alias("row"), F.lit(step).alias("step"))
    none = F.lit(None).cast(_MAP)
    moved = (F.col("operation") == "UPDATE") & F.col("before").isNotNull() & (F.size(before) == len(keys)) & (F.to_json(before) != F.to_json(after))
    steps = F.when(F.col("operation") == "DELETE", F.array(side(F.coalesce(before, after), none, 0))).when(moved, F.array(side(before, none, 0), side(after, F.col("after"), 1))).otherwise(F.array(side(after, F.col("after"), 1)))
    return events.where(F.col("operation").isin("INSERT", "UPDATE", "DELETE")).select("ord", F.explode(steps).alias("_s")).select("ord", "_s.*")


def after_truncate(events: DataFrame) -> DataFrame:
    """Events after the last TRUNCATE, with whether there was one."""
    last = events.agg(F.max(F.when(F.col("operation") == "TRUNCATE", F.col("ord"))).alias("_t"))  # one row
    return events.crossJoin(F.broadcast(last)).where("_t IS NULL OR ord > _t").withColumn("truncated", F.col("_t").isNotNull()).drop("_t")


def source_wins(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """target after changes (its columns, operation and order): the last change of a key counts."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("operation", *[c for c in target.columns if c not in keys]), order).alias("_v"))
    kept = target.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last.where("_v.operation <> 'DELETE'").select(*keys, "_v.*").drop("operation").select(target.columns))


def last_write_wins(target: DataFrame, changes: DataFrame, key: str, order: str, version: str, value: str) -> DataFrame:
    """target (key, version, value) after changes in order: a write counts if the key is absent, its version null, or older; ties keep the target; deletes always count. Also n_lost, the writes that lost."""
    each = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("operation").alias("op"), F.col(version).alias("ver"), F.col(value).alias("val")))).alias("_c"))
    state = F.struct(F.col("_t").isNotNull().alias("here"), F.col(version).alias("ver"), F.col(value).alias("val"), F.lit(0).cast("bigint").alias("lost"))

    def step(s: Column, c: Column) -> Column:
        wins = ~s["here"] | s["ver"].isNull() | (c["ver"] > s["ver"])
        empty = F.struct(F.lit(False).alias("here"), F.lit(None).cast("bigint").alias("ver"), F.lit(None).cast("double").alias("val"), s["lost"].alias("lost"))
        put = F.struct(F.lit(True).alias("here"), c["ver"].alias("ver"), c["val"].alias("val"), s["lost"].alias("lost"))
        keep = F.struct(s["here"].alias("here"), s["ver"].alias("ver"), s["val"].alias("val"), (s["lost"] + 1).alias("lost"))
        return F.when(c["op"] == "DELETE", empty).when(wins, put).otherwise(keep)

    joined = target.withColumn("_t", F.lit(True)).join(each, key, "full").withColumn("_s", F.when(F.col("_c").isNull(), state).otherwise(F.aggregate("_c", state, step)))
    return joined.where("_s.here").select(key, F.col("_s.ver").alias(version), F.col("_s.val").alias(value), F.col("_s.lost").alias("n_lost"))


def unapplied(events: DataFrame, acked: DataFrame, stream: str, position: str) -> DataFrame:
    """Events after the newest position that their stream has acknowledged (acked: stream, position), each position once; a stream without one starts at the beginning."""
    newest = acked.groupBy(stream).agg(F.max(position).alias("_newest"))
    after = events.join(newest, stream, "left").where(F.col("_newest").isNull() | (F.col(position) > F.col("_newest"))).drop("_newest")
    return after.dropDuplicates([stream, position])


def distinct_ddl(statements: DataFrame, group: Sequence[str], names: Sequence[str], others: Sequence[str], order: str) -> DataFrame:
    """Statements of a group once each, names compared (and given) in lower case, at the least order."""
    lowered = statements.withColumns({n: F.lower(n) for n in names})
    return lowered.groupBy(*group, *names, *others).agg(F.min(order).alias(order))


def drained(log: DataFrame, stream: str, order: str, fails: str) -> DataFrame:
    """Rows (stream, order) that are applied in order before the first that fails; the rest waits."""
    stop = log.where(F.col(fails)).groupBy(stream).agg(F.min(order).alias("_stop"))
    return log.join(stop, stream, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).select(stream, order)


def routed(transactions: DataFrame, stream: str, order: str, tx_limit: int, pending_limit: int) -> DataFrame:
    """transactions (stream, order, bytes, ready) with route: APPLY, STAGE if the target is not ready or earlier ones wait, or REFUSE if one or all that wait are too large."""
    before = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    waits = F.when(~F.col("ready"), F.col("bytes")).otherwise(0)
    held = transactions.withColumn("_before", F.coalesce(F.sum(waits).over(before), F.lit(0)))
    over = (F.col("bytes") > tx_limit) | (~F.col("ready") & (F.col("_before") + F.col("bytes") > pending_limit))
    return held.withColumn("route", F.when(over, "REFUSE").when(~F.col("ready") | (F.col("_before") > 0), "STAGE").otherwise("APPLY")).drop("_before")


def refusals(events: DataFrame, mapped: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """events with refusal: why one cannot be applied, or null. Inserts and updates need every mapped column in the after image, deletes each key in the before image or else the after image."""
    has = lambda m, c: F.coalesce(F.map_contains_key(m, c), F.lit(False))
    whole = F.lit(True)
    for c in mapped:
        whole = whole & has("after", c)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & (has("before", k) | has("after", k))
    kind = F.col("operation")
    return events.withColumn("refusal", F.when(kind.isin("INSERT", "UPDATE") & ~whole, "incomplete after image").when((kind == "DELETE") & ~keyed, "no key"))
