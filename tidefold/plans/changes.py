"""Queries over change streams, which are derived from events: keys are users modulo 50, event_id is the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.operators import cdc
from tidefold.plans.registry import query
from tidefold.sources import folders
from tidefold.sources.scan import table
from tidefold.streaming import apply


_OP = "CASE event_type WHEN 'click' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"


def _op():
    return F.when(F.col("event_type") == "click", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")


@query(
    "cdc_debezium",
    f"""SELECT event_id, op AS operation, 'app' AS source_schema, 'users' AS source_table, CASE WHEN op = 'INSERT' THEN NULL ELSE (user_id - 1)::VARCHAR END AS before_id,
 CASE WHEN op = 'DELETE' THEN NULL ELSE user_id::VARCHAR END AS after_id, CASE WHEN event_id % 2 = 0 THEN 'GTID' ELSE 'FILE' END AS position_type,
 CASE WHEN event_id % 2 = 0 THEN 'u:1-' || event_id ELSE 'bin.1:' || event_id END AS position_value, event_id * 10 AS source_ts_ms FROM (SELECT *, {_OP} AS op FROM events)""",
)
def _(spark, d):
    op = F.when(F.col("event_type") == "click", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    image = lambda u: F.struct(u.alias("id"), F.lit("x").alias("name"))
    source = F.struct(F.lit("app").alias("db"), F.lit("users").alias("table"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u:1-"), F.col("event_id").cast("string"))).alias("gtid"), F.lit("bin.1").alias("file"), F.col("event_id").alias("pos"))
    body = F.struct(F.when(op != "c", image(F.col("user_id") - 1)).alias("before"), F.when(op != "d", image(F.col("user_id"))).alias("after"), source.alias("source"), op.alias("op"), (F.col("event_id") * 10).alias("ts_ms"))
    value = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(body.alias("payload")))).otherwise(F.to_json(body))
    e = cdc.debezium(table(spark, d, "events").select("event_id", value.alias("value")))
    return e.select("event_id", "operation", "source_schema", "source_table", F.element_at("before", "id").alias("before_id"), F.element_at("after", "id").alias("after_id"), "position_type", "position_value", "source_ts_ms")


@query(
    "cdc_canal",
    """SELECT event_id, row, 'UPDATE' AS operation, 'n' || row::VARCHAR AS after_name, CASE WHEN row = 0 THEN 'was' ELSE 'n1' END AS before_name,
 CASE WHEN row = 1 THEN event_id || '@' || event_id * 10 END AS position_value FROM (SELECT event_id, unnest([0, 1]) AS row FROM events)""",
)
def _(spark, d):
    row = lambda n: F.struct(F.col("user_id").cast("string").alias("id"), F.lit(n).alias("name"))
    old = F.array(F.create_map(F.lit("name"), F.lit("was")), F.create_map(F.lit("id"), F.lit("0")))
    message = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("app").alias("database"), F.lit("t").alias("table"), F.lit("UPDATE").alias("type"), (F.col("event_id") * 10).alias("es"), F.lit(False).alias("isDdl"), F.array(row("n0"), row("n1")).alias("data"), old.alias("old")))
    e = cdc.canal(table(spark, d, "events").select("event_id", message.alias("value")))
    return e.select("event_id", "row", "operation", F.element_at("after", "name").alias("after_name"), F.element_at("before", "name").alias("before_name"), "position_value")


@query(
    "cdc_ticdc",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'CHECKPOINT' ELSE 'INSERT' END AS operation, event_id * 262144 AS tso, event_type = 'view' AS is_watermark,
 CASE WHEN event_type = 'view' THEN NULL ELSE 'AP8=' END AS blob, event_id AS source_ts_ms FROM events""",
)
def _(spark, d):
    mark = F.col("event_type") == "view"
    tso = F.col("event_id") * 262144
    data = F.when(~mark, F.array(F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("b"), F.decode(F.unhex(F.lit("00C3BF")), "UTF-8"))))
    tidb = F.struct(F.when(~mark, tso).alias("commitTs"), F.when(mark, tso).alias("watermarkTs"))
    message = F.to_json(F.struct(F.lit("app").alias("database"), F.lit("t").alias("table"), F.when(mark, "TIDB_WATERMARK").otherwise("INSERT").alias("type"), F.lit(0).alias("es"), F.create_map(F.lit("id"), F.lit("bigint"), F.lit("b"), F.lit("blob")).alias("mysqlType"), data.alias("data"), tidb.alias("_tidb")))
    return cdc.ticdc(table(spark, d, "events").select("event_id", message.alias("value"))).select("event_id", "operation", "tso", "is_watermark", F.element_at("after", "b").alias("blob"), "source_ts_ms")


@query(
    "cdc_transactions",
    """WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'BEGIN' WHEN 'error' THEN 'ROLLBACK' WHEN 'view' THEN 'COMMIT' ELSE 'ROW' END AS kind FROM events),
 n AS (SELECT *, sum((kind = 'BEGIN')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS tx FROM l),
 g AS (SELECT user_id, tx, max(event_id) FILTER (WHERE kind = 'COMMIT') AS commit_order, max(event_id) FILTER (WHERE kind = 'ROLLBACK') AS r FROM n GROUP BY ALL)
 SELECT user_id, event_id, tx, commit_order FROM n JOIN g USING (user_id, tx) WHERE kind = 'ROW' AND commit_order IS NOT NULL AND r IS NULL AND event_id < commit_order""",
)
def _(spark, d):
    kind = F.when(F.col("event_type") == "click", "BEGIN").when(F.col("event_type") == "error", "ROLLBACK").when(F.col("event_type") == "view", "COMMIT").otherwise("ROW")
    log = table(spark, d, "events").select("user_id", "event_id", kind.alias("kind"))
    return cdc.transactions(log, "user_id", "event_id").select("user_id", "event_id", "tx", "commit_order")


@query(
    "cdc_coalesce",
    """WITH r AS (SELECT user_id, event_id, event_type = 'view' AS more, event_type AS sql FROM events),
 g AS (SELECT *, coalesce(sum((NOT more)::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM r)
 SELECT user_id, min(event_id) AS event_id, string_agg(sql, '' ORDER BY event_id) AS sql FROM g GROUP BY user_id, i""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("more"), F.col("event_type").alias("sql"))
    return cdc.coalesce_rows(rows, ["user_id"], "event_id", "sql", "more")


@query(
    "cdc_pair_updates",
    """SELECT event_id AS lsn, CASE event_id % 3 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'DELETE' ELSE 'INSERT' END AS operation,
 CASE event_id % 3 WHEN 0 THEN 'old' WHEN 1 THEN 'row' END AS before, CASE event_id % 3 WHEN 0 THEN 'new' WHEN 2 THEN 'row' END AS after FROM events""",
)
def _(spark, d):
    pair = lambda op, row: F.struct(F.lit(op).alias("op"), F.lit(row).alias("row"))
    m = F.col("event_id") % 3
    rows = F.when(m == 0, F.array(pair(4, "new"), pair(3, "old"))).when(m == 1, F.array(pair(1, "row"))).otherwise(F.array(pair(2, "row")))
    return cdc.pair_updates(table(spark, d, "events").select(F.col("event_id").alias("lsn"), F.inline(rows)), ["lsn"])


@query("cdc_ddl_merge", "SELECT event_id AS xid, user_id * 10 AS lsn, event_type AS rows, 'ALTER ' || event_id AS ddl, true AS matched FROM events WHERE event_type = 'signup'")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("xid"), (F.col("user_id") * 10).alias("lsn"), "event_type")
    return cdc.merge_ddl(e.withColumnRenamed("event_type", "rows"), e.select("xid", "lsn", F.concat(F.lit("ALTER "), F.col("xid").cast("string")).alias("ddl")), ["xid", "lsn"])


@query(
    "gtid_merge",
    """WITH s AS (SELECT user_id, event_id // 2 AS a, event_id // 2 + event_id % 40 AS b FROM events),
 r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
 i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS g FROM r)
 SELECT user_id, min(a) AS start, max(b) AS "end" FROM i GROUP BY user_id, g""",
)
def _(spark, d):
    start = F.floor(F.col("event_id") / 2)
    return cdc.merge_intervals(table(spark, d, "events").select("user_id", start.alias("start"), (start + F.col("event_id") % 40).alias("end")), ["user_id"])


_RESOLVED = "(SELECT user_id % 4 AS stream, max(event_id) - (user_id % 4) * 20 AS resolved FROM events GROUP BY ALL)"


def _resolved(spark, d):
    s = (F.col("user_id") % 4).alias("stream")
    return table(spark, d, "events").groupBy(s).agg(F.max("event_id").alias("m")).select("stream", (F.col("m") - F.col("stream") * 20).alias("resolved"))


@query("cdc_ordered_merge", "SELECT user_id % 4 AS stream, event_id AS ord FROM events WHERE event_id > 0 AND event_id <= (SELECT min(resolved) FROM (SELECT s, max(event_id) - s * 20 AS resolved FROM (SELECT event_id, user_id % 4 AS s FROM events) GROUP BY s))")
def _(spark, d):
    return cdc.ordered_merge(table(spark, d, "events").select((F.col("user_id") % 4).alias("stream"), F.col("event_id").alias("ord")), _resolved(spark, d))


@query("cdc_resolved_release", "SELECT user_id % 4 AS part, event_id AS tso FROM events WHERE event_id > 50 AND event_id < (SELECT min(resolved) FROM (SELECT s, max(event_id) - s * 20 AS resolved FROM (SELECT event_id, user_id % 4 AS s FROM events) GROUP BY s))")
def _(spark, d):
    return cdc.resolved_release(table(spark, d, "events").select((F.col("user_id") % 4).alias("part"), F.col("event_id").alias("tso")), _resolved(spark, d), acked=50)


_STATE = "SELECT k, value FROM (SELECT user_id % 50 AS k, value, event_type, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id DESC) AS n FROM events {}) WHERE n = 1 AND event_type <> 'error'"


def _changes(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("k"), "value", F.col("event_id").alias("ord"), _op().alias("operation"))


@query("cdc_apply_source_wins", _STATE.format("") + " UNION ALL SELECT 1000 + r, 0.5 FROM range(5) t(r)")
def _(spark, d):
    target = spark.range(5).select((F.col("id") + 1000).alias("k"), F.lit(0.5).cast("double").alias("value")).union(spark.range(50).select("id", F.lit(9.0)))
    changes = _changes(spark, d)
    present = changes.select("k").distinct()
    return cdc.source_wins(target.join(present.union(spark.range(1000, 1005)), "k", "left_semi"), changes, ["k"], "ord")


@query("cdc_truncate", _STATE.format("WHERE event_id > 500"))
def _(spark, d):
    events = _changes(spark, d).withColumn("operation", F.when(F.col("ord").isin(300, 500), "TRUNCATE").otherwise(F.col("operation")))
    return cdc.source_wins(spark.createDataFrame([], "k long, value double"), cdc.after_truncate(events).drop("truncated"), ["k"], "ord")


@query(
    "cdc_pk_change",
    """SELECT event_id AS ord, step, CASE WHEN step = 0 THEN user_id ELSE user_id + 1 END::VARCHAR AS id, step = 0 AS is_delete FROM (SELECT *, unnest([0, 1]) AS step FROM events WHERE event_type = 'purchase')
 UNION ALL SELECT event_id, 1, user_id::VARCHAR, false FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 0, user_id::VARCHAR, true FROM events WHERE event_type = 'error'""",
)
def _(spark, d):
    image = lambda u: F.create_map(F.lit("id"), u.cast("string"), F.lit("v"), F.lit("x"))
    kind = F.col("event_type")
    e = table(spark, d, "events").where("event_type IN ('click', 'purchase', 'error')").select(F.col("event_id").alias("ord"), F.when(kind == "click", "INSERT").when(kind == "error", "DELETE").otherwise("UPDATE").alias("operation"), F.when(kind != "click", image(F.col("user_id"))).alias("before"), F.when(kind == "purchase", image(F.col("user_id") + 1)).when(kind == "click", image(F.col("user_id"))).alias("after"))
    return cdc.key_operations(e, ["id"]).select("ord", "step", F.element_at("key", "id").alias("id"), F.col("row").isNull().alias("is_delete"))


@query(
    "cdc_apply_lww",
    f"""WITH RECURSIVE c AS (SELECT user_id % 50 AS k, {_OP} AS op, event_id * 31 % 200 AS ver, value AS val, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM events),
 f AS (SELECT k, 0::BIGINT AS n, true AS here, CASE WHEN k % 3 = 0 THEN NULL ELSE 100 END::BIGINT AS ver, 0.25::DOUBLE AS val, 0::BIGINT AS lost FROM (SELECT DISTINCT k FROM c)
 UNION ALL SELECT c.k, c.n, CASE WHEN c.op = 'DELETE' THEN false ELSE true END, CASE WHEN c.op = 'DELETE' THEN NULL WHEN NOT f.here OR f.ver IS NULL OR c.ver > f.ver THEN c.ver ELSE f.ver END,
 CASE WHEN c.op = 'DELETE' THEN NULL WHEN NOT f.here OR f.ver IS NULL OR c.ver > f.ver THEN c.val ELSE f.val END,
 CASE WHEN c.op = 'DELETE' OR NOT f.here OR f.ver IS NULL OR c.ver > f.ver THEN f.lost ELSE f.lost + 1 END FROM f JOIN c ON c.k = f.k AND c.n = f.n + 1)
 SELECT k, ver, val, lost AS n_lost FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM f) WHERE r = 1 AND here""",
)
def _(spark, d):
    changes = _changes(spark, d).select("k", "ord", "operation", (F.col("ord") * 31 % 200).alias("ver"), F.col("value").alias("val"))
    target = changes.select("k").distinct().select("k", F.when(F.col("k") % 3 != 0, F.lit(100)).cast("bigint").alias("ver"), F.lit(0.25).cast("double").alias("val"))
    return cdc.last_write_wins(target, changes, "k", "ord", "ver", "val")


@query(
    "cdc_duplicates",
    """SELECT user_id % 4 AS stream, event_id AS tso FROM events LEFT JOIN (SELECT user_id % 4 AS s, max(event_id) AS newest FROM events WHERE event_type = 'signup' GROUP BY 1) ON s = user_id % 4
 WHERE newest IS NULL OR event_id > newest""",
)
def _(spark, d):
    """A source that sends a third of its rows twice, after a restart from each stream's newest checkpoint."""
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("stream"), F.col("event_id").alias("tso"), "event_type")
    acked = e.where("event_type = 'signup'").select("stream", "tso")
    sent = e.select("stream", "tso")
    return cdc.unapplied(sent.union(sent.where("tso % 3 = 0")), acked, "stream", "tso")


@query("cdc_ddl_distinct", "SELECT tx, min(ord) AS ord, lower(name) AS name, stmt FROM (SELECT event_id // 50 AS tx, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS name, 'ALTER ' || event_type AS stmt FROM events) GROUP BY tx, lower(name), stmt")
def _(spark, d):
    """Statements that a transaction repeats for names in other cases count once, at their first place."""
    e = table(spark, d, "events")
    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    ddl = e.select(F.floor(F.col("event_id") / 50).alias("tx"), F.col("event_id").alias("ord"), name.alias("name"), F.concat(F.lit("ALTER "), "event_type").alias("stmt"))
    return cdc.distinct_ddl(ddl, ["tx"], ["name"], ["stmt"], "ord")


@query(
    "spool_drain",
    """SELECT user_id % 8 AS stream, event_id AS seq FROM events LEFT JOIN (SELECT user_id % 8 AS s, min(event_id) AS stop FROM events WHERE event_type = 'error' GROUP BY 1) ON s = user_id % 8
 WHERE stop IS NULL OR event_id < stop""",
)
def _(spark, d):
    """What a drain of the spool in order applies before each stream's first error."""
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("stream"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("fails"))
    return cdc.drained(e, "stream", "seq", "fails")


@query(
    "spool_route",
    """SELECT tx, bytes, CASE WHEN bytes > 6000 THEN 'REFUSE' WHEN tx % 7 = 0 AND before + bytes > 200000 THEN 'REFUSE' WHEN tx % 7 = 0 OR before > 0 THEN 'STAGE' ELSE 'APPLY' END AS route
 FROM (SELECT *, coalesce(sum(CASE WHEN tx % 7 = 0 THEN bytes ELSE 0 END) OVER (PARTITION BY stream ORDER BY tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT user_id % 8 AS stream, event_id AS tx, length(props) * 100 AS bytes FROM events))""",
)
def _(spark, d):
    """Transactions that find the target not ready wait, and so does what comes after them; what passes a limit is refused."""
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("stream"), F.col("event_id").alias("tx"), (F.length("props") * 100).cast("bigint").alias("bytes"), (F.col("event_id") % 7 != 0).alias("ready"))
    return cdc.routed(e, "stream", "tx", tx_limit=6000, pending_limit=200_000).select("tx", "bytes", "route")


@query(
    "cdc_refused",
    """SELECT event_id AS ord, CASE WHEN event_type <> 'error' AND event_id % 11 = 0 THEN 'incomplete after image' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'no key' END AS refusal FROM events""",
)
def _(spark, d):
    """Changes whose after image lacks a mapped column, and deletes without a key in either image."""
    e = table(spark, d, "events")
    full = F.create_map(F.lit("k"), F.col("user_id").cast("string"), F.lit("v"), F.col("value").cast("string"))
    short = F.create_map(F.lit("k"), F.col("user_id").cast("string"))
    other = F.create_map(F.lit("v"), F.col("value").cast("string"))
    delete = F.col("event_type") == "error"
    events = e.select(
        F.col("event_id").alias("ord"),
        F.when(delete, "DELETE").otherwise("UPDATE").alias("operation"),
        F.when(delete & (F.col("event_id") % 3 != 0), short).when(delete, other).alias("before"),
        F.when(~delete, F.when(F.col("event_id") % 11 == 0, other).otherwise(full)).alias("after"),
    )
    return cdc.refusals(events, ["k", "v"], ["k"]).select("ord", "refusal")


@query("event_mapping", "SELECT e.event_id, m.name FROM events e JOIN (VALUES ('click', 'clicks'), ('view', 'views'), ('purchase', 'sales'), ('signup', 'users'), ('error', 'faults')) m(event_type, name) USING (event_type)")
def _(spark, d):
    mapping = spark.createDataFrame([("click", "clicks"), ("view", "views"), ("purchase", "sales"), ("signup", "users"), ("error", "faults")], "event_type string, name string")
    joined = table(spark, d, "events").join(F.broadcast(mapping), "event_type", "left")  # a row a table of the task
    return joined.select("event_id", F.coalesce("name", F.raise_error(F.lit("an event has no mapping")).cast("string")).alias("name"))


@query("stream_apply", _STATE.format(""))
def _(spark, d):
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    changes = events.select((F.col("user_id") % 50).alias("k"), "value", F.col("event_id").alias("ord"), _op().alias("operation"))
    return apply.apply_stream(spark, changes, folders.shared(spark), "k bigint, value double", ["k"], "ord")


@query("stream_resolved_merge", "SELECT user_id % 4 AS part, event_id AS tso FROM events WHERE event_id < (SELECT min(m) FROM (SELECT max(event_id) AS m FROM events GROUP BY user_id % 4))")
def _(spark, d):
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").select((F.col("user_id") % 4).alias("part"), F.col("event_id").alias("tso"))
    return apply.resolved_stream(spark, rows, folders.shared(spark), "part bigint, tso bigint", range(4))


@query("stream_window_counts", "SELECT event_type, epoch_us(date_trunc('day', ts))::BIGINT AS day_us, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    """An extension: tumbling windows by event time."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = folders.shared(spark)
    counted = apply.counts_by_window(events, "ts", "1 day", "1 day")

    def each(batch, n):
        batch.select("event_type", F.unix_micros("window.start").alias("day_us"), "n").write.mode("overwrite").parquet(f"{folder}/out")

    query_ = counted.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
