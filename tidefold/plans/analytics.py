"""Queries over control-plane history, which is derived from events: a chunk per event, a table per user modulo 10, a task per user modulo 3."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidefold.operators import assess, control, perfmodel
from tidefold.plans.registry import query
from tidefold.sources.scan import table

_CHUNKS = """(SELECT event_id AS chunk_id, user_id % 10 AS table_id, user_id % 3 AS task_id, event_id % 400 AS slot, event_id AS seq,
 CASE event_type WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'PENDING' WHEN 'signup' THEN 'FAILED' ELSE 'PAUSED' END AS status,
 event_id * 37 % 1000 AS row_count, event_id * 91 % 5000 AS bytes, event_id % 50 AS read_ms, 'zone' || (user_id % 4)::VARCHAR AS topology, event_id % 4 AS rank FROM events)"""


def chunks(spark, d):
    names = {"click": "SUCCESS", "view": "RUNNING", "purchase": "PENDING", "signup": "FAILED"}
    status = F.lit("PAUSED")
    for k, v in names.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select(
        e.alias("chunk_id"), (u % 10).alias("table_id"), (u % 3).alias("task_id"), (e % 400).alias("slot"), e.alias("seq"), status.alias("status"), (e * 37 % 1000).alias("row_count"),
        (e * 91 % 5000).alias("bytes"), (e % 50).alias("read_ms"), F.concat(F.lit("zone"), (u % 4).cast("string")).alias("topology"), (e % 4).alias("rank"),
    )


_DONE = "coalesce(sum({0}) FILTER (WHERE status = 'SUCCESS'), 0)::BIGINT AS {0}"


@query(
    "chunk_summary",
    f"""SELECT table_id, count(*) AS chunks, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running,
 count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'FAILED') AS failed, {_DONE.format("row_count")}, {_DONE.format("bytes")},
 sum(read_ms)::BIGINT AS read_ms, count(*) FILTER (WHERE read_ms > 0) AS samples FROM {_CHUNKS} GROUP BY ROLLUP (table_id)""",
)
def _(spark, d):
    return control.chunk_summary(chunks(spark, d), "table_id")


@query("runnable_counts", f"SELECT task_id, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running FROM {_CHUNKS} GROUP BY 1")
def _(spark, d):
    return chunks(spark, d).groupBy("task_id").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "RUNNING").alias("running"))


@query("spool_stats", f"SELECT task_id, count(*) AS n, min_by(chunk_id, seq) AS first_chunk_id, max_by(chunk_id, seq) AS last_chunk_id FROM {_CHUNKS} WHERE status = 'PENDING' GROUP BY 1")
def _(spark, d):
    return control.first_and_last(chunks(spark, d).where("status = 'PENDING'"), ["task_id"], "chunk_id", "seq")


_ATTEMPTS = f"(SELECT table_id, slot, seq, CASE status WHEN 'SUCCESS' THEN 'SUCCESS' WHEN 'FAILED' THEN 'MISMATCH' ELSE 'ERROR' END AS status FROM {_CHUNKS} WHERE status <> 'PENDING')"


def attempts(spark, d):
    c = F.col("status")
    return chunks(spark, d).where("status <> 'PENDING'").select("table_id", "slot", "seq", F.when(c == "SUCCESS", "SUCCESS").when(c == "FAILED", "MISMATCH").otherwise("ERROR").alias("status"))


@query(
    "latest_status_counts",
    f"""WITH e AS (SELECT DISTINCT table_id, slot FROM {_CHUNKS}), l AS (SELECT DISTINCT ON (table_id, slot) table_id, slot, status FROM {_ATTEMPTS} ORDER BY table_id, slot, seq DESC)
 SELECT table_id, count(*) AS eligible, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'MISMATCH') AS mismatch,
 count(*) FILTER (WHERE status = 'ERROR') AS error, count(*) FILTER (WHERE status IS NULL) AS missing FROM e LEFT JOIN l USING (table_id, slot) GROUP BY 1""",
)
def _(spark, d):
    return control.status_counts(chunks(spark, d).select("table_id", "slot").distinct(), attempts(spark, d), ["table_id", "slot"], "table_id", [F.desc("seq")])


@query("latest_attempt", f"SELECT DISTINCT ON (table_id, slot) table_id, slot, seq, status FROM {_ATTEMPTS} ORDER BY table_id, slot, seq DESC")
def _(spark, d):
    return control.latest(attempts(spark, d), ["table_id", "slot"], [F.desc("seq")])


@query("evidence_page", f"SELECT e.table_id, e.slot, l.seq, l.status FROM (SELECT DISTINCT table_id, slot FROM {_CHUNKS} WHERE slot > 100) e LEFT JOIN (SELECT DISTINCT ON (table_id, slot) * FROM {_ATTEMPTS} ORDER BY table_id, slot, seq DESC) l USING (table_id, slot) ORDER BY e.slot, e.table_id LIMIT 120")
def _(spark, d):
    page = chunks(spark, d).where("slot > 100").select("table_id", "slot").distinct()
    return page.join(control.latest(attempts(spark, d), ["table_id", "slot"], [F.desc("seq")]), ["table_id", "slot"], "left").orderBy("slot", "table_id").limit(120)


@query("first_invalid", f"SELECT * FROM (SELECT DISTINCT ON (table_id, slot) table_id, slot, seq, status FROM {_ATTEMPTS} ORDER BY table_id, slot, seq DESC) WHERE status <> 'SUCCESS' ORDER BY table_id, slot LIMIT 1")
def _(spark, d):
    return control.latest(attempts(spark, d), ["table_id", "slot"], [F.desc("seq")]).where("status <> 'SUCCESS'").orderBy("table_id", "slot").limit(1)


@query("archive_gap", f"SELECT DISTINCT table_id, slot FROM {_CHUNKS} c WHERE status = 'SUCCESS' AND NOT EXISTS (SELECT 1 FROM {_CHUNKS} a WHERE a.status = 'PAUSED' AND a.table_id = c.table_id AND a.slot = c.slot)")
def _(spark, d):
    c = chunks(spark, d)
    return c.where("status = 'SUCCESS'").join(c.where("status = 'PAUSED'"), ["table_id", "slot"], "left_anti").select("table_id", "slot").distinct()


@query(
    "claim_rank",
    f"""WITH c AS {_CHUNKS}, l AS (SELECT task_id, count(*) AS load FROM c WHERE status = 'RUNNING' GROUP BY 1)
 SELECT task_id, chunk_id, row_number() OVER (PARTITION BY task_id ORDER BY coalesce(load, 0), rank DESC, chunk_id)::INTEGER AS claim_rank FROM c LEFT JOIN l USING (task_id)
 WHERE status = 'PENDING' AND coalesce(load, 0) < 100000 * (task_id + 1) AND task_id <> 2""",
)
def _(spark, d):
    c = chunks(spark, d)
    caps = spark.sql("SELECT * FROM VALUES (0L, 100000L), (1L, 200000L) AS v(task_id, cap)")
    return control.claim_order(c.where("status = 'PENDING'").withColumn("priority", F.col("rank")), c.where("status = 'RUNNING'"), caps).select("task_id", "chunk_id", "claim_rank")


@query(
    "peer_risk",
    f"""WITH c AS {_CHUNKS}, p AS (SELECT DISTINCT table_id, topology FROM c)
 SELECT chunk_id, (SELECT count(DISTINCT topology) FROM c b WHERE b.table_id = c.table_id AND b.topology <> c.topology) AS peers,
 coalesce((SELECT max(rank) FROM c b WHERE b.table_id = c.table_id AND b.topology <> c.topology), 0) AS worst_peer FROM c""",
)
def _(spark, d):
    return control.peer_risk(chunks(spark, d)).select("chunk_id", "peers", "worst_peer")


@query(
    "profile_lookup",
    f"""WITH p AS (SELECT table_id, row_count, seq FROM {_CHUNKS} WHERE status = 'SUCCESS' AND read_ms > 0)
 SELECT t.table_id, max_by(p.row_count, p.seq) AS row_count, max(p.seq) AS seq FROM (SELECT DISTINCT table_id FROM {_CHUNKS}) t LEFT JOIN p USING (table_id) GROUP BY 1""",
)
def _(spark, d):
    c = chunks(spark, d)
    p = c.where("status = 'SUCCESS' AND read_ms > 0").groupBy("table_id").agg(F.max_by("row_count", "seq").alias("row_count"), F.max("seq").alias("seq"))
    return c.select("table_id").distinct().join(p, "table_id", "left")


@query("key_unnest", "SELECT chunk_id, i - 1 AS ordinal, CASE i WHEN 1 THEN 'a' || (chunk_id % 7)::VARCHAR ELSE 'b' END AS name, CASE i WHEN 1 THEN 'x' ELSE 'y' END AS ref FROM (SELECT chunk_id, unnest([1, 2]) AS i FROM " + _CHUNKS + ")")
def _(spark, d):
    zipped = F.arrays_zip(F.array(F.concat(F.lit("a"), (F.col("chunk_id") % 7).cast("string")), F.lit("b")).alias("name"), F.array(F.lit("x"), F.lit("y")).alias("ref"))
    return chunks(spark, d).select("chunk_id", F.posexplode(zipped).alias("ordinal", "k")).select("chunk_id", "ordinal", "k.name", "k.ref")


@query(
    "table_evidence",
    f"""SELECT table_id, sha256(string_agg(sha256(slot::VARCHAR || '|' || seq::VARCHAR || '|' || status), '' ORDER BY seq)) AS digest, count(*) AS n,
 count(*) FILTER (WHERE status = 'SUCCESS') AS success FROM {_ATTEMPTS} GROUP BY 1""",
)
def _(spark, d):
    return control.evidence_digest(attempts(spark, d), "table_id", ["seq"], ["slot", "seq", "status"])


@query("dashboard_totals", f"SELECT count(*) AS tasks, count(*) FILTER (WHERE status NOT IN ('SUCCESS', 'FAILED')) AS running, sum(bytes)::BIGINT AS bytes FROM {_CHUNKS}")
def _(spark, d):
    return chunks(spark, d).agg(F.count("*").alias("tasks"), F.count_if(~F.col("status").isin("SUCCESS", "FAILED")).alias("running"), F.sum("bytes").alias("bytes"))


@query("metrics_text", f"SELECT 'chunks{{status=\"' || status || '\"}} ' || count(*)::VARCHAR AS line FROM {_CHUNKS} GROUP BY status")
def _(spark, d):
    return chunks(spark, d).groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit('chunks{status="'), "status", F.lit('"} '), F.col("n").cast("string")).alias("line"))


@query("distinct_zones", f"SELECT table_id, count(DISTINCT coalesce(nullif(topology, 'zone0'), 'none')) AS zones FROM {_CHUNKS} GROUP BY 1")
def _(spark, d):
    return chunks(spark, d).groupBy("table_id").agg(F.countDistinct(F.coalesce(F.nullif("topology", F.lit("zone0")), F.lit("none"))).alias("zones"))


@query("storage_stats", f"SELECT table_id, coalesce(sum(bytes), 0)::BIGINT AS bytes, coalesce(sum(CASE WHEN status = 'FAILED' THEN bytes END), 0)::BIGINT AS dead FROM {_CHUNKS} GROUP BY 1")
def _(spark, d):
    dead = F.sum(F.when(F.col("status") == "FAILED", F.col("bytes")))
    return chunks(spark, d).groupBy("table_id").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(dead, F.lit(0)).alias("dead"))


# --- windows and retention


@query("retention_positions", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def _(spark, d):
    return control.keep_newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query("retention_attempts", f"SELECT table_id, slot, seq FROM (SELECT *, row_number() OVER (PARTITION BY table_id, slot ORDER BY seq DESC) AS n FROM {_ATTEMPTS}) WHERE n = 1 OR (n <= 2 AND seq >= 200)")
def _(spark, d):
    return control.retained_attempts(attempts(spark, d), ["table_id", "slot"], "seq", "seq", 2, 200).select("table_id", "slot", "seq")


@query("keep_newest", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 100")
def _(spark, d):
    return control.keep_newest(table(spark, d, "events"), [], [F.desc("event_id")], 100).select("event_id", "user_id")


@query("retention_removed", "SELECT event_id FROM events ORDER BY event_id DESC OFFSET 100")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("event_id")).offset(100).select("event_id")


@query("latest_position", "SELECT event_type AS direction, max_by(event_id, (ts, event_id)) AS position FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("direction")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("position"))


@query(
    "backlog_growth",
    """SELECT event_id, CASE WHEN b > p AND (t - q) / 1e6 >= 0.5 THEN floor((b - p) / ((t - q) / 1e6)) ELSE 0 END::BIGINT AS growth FROM
 (SELECT event_id, t, b, lag(t) OVER w AS q, lag(b) OVER w AS p FROM (SELECT event_id, user_id, epoch_us(ts) AS t, event_id * 911 % 100000 AS b FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, b))""",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("t"), (F.col("event_id") * 911 % 100000).alias("b"))
    return control.backlog_growth(e, ["user_id"], "t", "b").select("event_id", "growth")


@query("union_logs", "SELECT user_id, event_type FROM events WHERE event_id < 300 UNION SELECT user_id, event_type FROM events WHERE event_id >= 200")
def _(spark, d):
    e = table(spark, d, "events")
    return e.where("event_id < 300").union(e.where("event_id >= 200")).select("user_id", "event_type").distinct()


@query("ordered_page", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, nullif(o_custkey % 3, 0) NULLS LAST, o_orderkey LIMIT 40 OFFSET 10")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.orderBy(F.desc("o_orderpriority"), F.nullif(F.col("o_custkey") % 3, F.lit(0)).asc_nulls_last(), "o_orderkey").offset(10).limit(40).select("o_orderkey", "o_orderpriority")


# --- performance model


@query("percentile_nearest_rank", "SELECT user_id, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95 FROM (SELECT user_id, event_id * 7 % 1009 AS v FROM events) GROUP BY 1")
def _(spark, d):
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY event_id * 7 % 1009)").cast("bigint")
    return table(spark, d, "events").groupBy("user_id").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(
    "ewma_rate",
    """WITH RECURSIVE e AS (SELECT user_id, event_id * 7 % 1009 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 f AS (SELECT user_id, n, v AS a FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.v <= 0 THEN f.a WHEN f.a <= 0 THEN e.v ELSE (f.a * 70 + e.v * 30) // 100 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
 SELECT user_id, max_by(a, n) AS rate FROM f GROUP BY 1""",
)
def _(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") * 7 % 1009).alias("v")))), lambda s: s["v"])
    return table(spark, d, "events").groupBy("user_id").agg(ordered.alias("v")).select("user_id", perfmodel.ewma(F.col("v"), 30).alias("rate"))


@query("sample_ring", "SELECT user_id, len(v)::INTEGER AS n, list_sum(v)::BIGINT AS total FROM (SELECT user_id, (list(event_id ORDER BY event_id) FILTER (WHERE event_id % 5 > 0))[-8:] AS v FROM events GROUP BY 1) WHERE v IS NOT NULL")
def _(spark, d):
    newest = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    last = table(spark, d, "events").where("event_id % 5 > 0").select("user_id", "event_id", F.row_number().over(newest).alias("n")).where("n <= 8")
    ring = last.groupBy("user_id").agg(F.collect_list("event_id").alias("v"))
    return ring.where(F.size("v") > 0).select("user_id", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(
    "chunk_recommendation",
    """SELECT event_id, r, CASE WHEN r <= 0 THEN 40000 ELSE greatest(10000, least(160000, r)) END::BIGINT AS bounded, CASE WHEN event_id <= 0 OR r <= 0 THEN 1 ELSE least(greatest(1, ceil(event_id * 1000 / nullif(r, 0))), 16) END::BIGINT AS pieces FROM
 (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE least(greatest(event_id * 30, 1000), 500000) END AS r FROM events)""",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id")
    r = perfmodel.recommended_rows(F.when(F.col("event_id") % 7 == 0, 0).otherwise(F.col("event_id")), 30, 1000, 500000)
    e = e.withColumn("r", r)
    return e.select("event_id", "r", perfmodel.bounded_rows(F.col("r"), F.lit(40000), 0.25, 4.0).alias("bounded"), perfmodel.pieces(F.col("event_id") * 1000, F.col("r"), 16).alias("pieces"))


@query(
    "health_state",
    """SELECT event_id, h, CASE h WHEN 'DEGRADED' THEN 50 WHEN 'CIRCUIT_OPEN' THEN 0 ELSE 100 END::INTEGER AS weight, CASE h WHEN 'DEGRADED' THEN 1 WHEN 'CIRCUIT_OPEN' THEN 3 ELSE 0 END::INTEGER AS rank FROM
 (SELECT event_id, CASE WHEN event_id % 11 < 3 THEN 'HEALTHY' WHEN (event_id % 100) * 100 < 80 * 55 OR event_id * 13 % 120000 >= 90000 THEN CASE WHEN event_id % 8 >= 5 THEN 'CIRCUIT_OPEN' WHEN event_id % 8 >= 2 THEN 'DEGRADED' ELSE 'HEALTHY' END ELSE 'HEALTHY' END AS h FROM events)""",
)
def _(spark, d):
    e = F.col("event_id")
    h = table(spark, d, "events").select("event_id", perfmodel.health(e % 100, F.lit(80), e * 13 % 120000, e % 8, e % 11).alias("h"))
    return h.select("event_id", "h", perfmodel.weight(F.col("h")).alias("weight"), perfmodel.health_rank(F.col("h")).alias("rank"))


@query("tail_eta", "SELECT event_id, CASE WHEN b <= 0 THEN 0 WHEN p <= 30000 THEN b ELSE b * (100 + ((p - 30000) * 100 // 30000) * 60 // 100) // 100 END AS eta FROM (SELECT event_id, event_id % 500 AS b, event_id * 131 % 100000 AS p FROM events)")
def _(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", perfmodel.tail_eta(e % 500, 30000, e * 131 % 100000, 60).alias("eta"))


@query(
    "backpressure_level",
    """SELECT event_id, l, CASE l WHEN 'CRITICAL' THEN greatest(50, b // 2) WHEN 'WARN' THEN greatest(100, b * 3 // 4) ELSE 0 END AS most,
 greatest(50, least(5000, CASE WHEN w > 2400 THEN b // 2 WHEN w < 1200 THEN b * 5 // 4 ELSE b END)) AS next FROM
 (SELECT event_id, b, w, CASE WHEN greatest(r, w) >= 8000 THEN 'CRITICAL' WHEN greatest(r, w) >= 3000 THEN 'WARN' ELSE 'NORMAL' END AS l FROM
 (SELECT event_id, event_id * 17 % 9000 AS r, event_id * 29 % 10000 AS w, event_id % 4000 + 1 AS b FROM events))""",
)
def _(spark, d):
    e = F.col("event_id")
    x = table(spark, d, "events").select("event_id", (e * 29 % 10000).alias("w"), (e % 4000 + 1).alias("b"), perfmodel.backpressure(e * 17 % 9000, e * 29 % 10000).alias("l"))
    return x.select("event_id", "l", perfmodel.capped_batch(F.col("l"), F.col("b")).alias("most"), perfmodel.next_batch(F.col("b"), F.col("w")).alias("next"))


@query("worker_score", "SELECT user_id, round(sum(event_id % 100 * 0.45 + user_id % 100 * 0.25 + event_id % 7 * 0.20 + user_id % 9 * 0.10), 4)::DOUBLE AS score FROM events GROUP BY 1")
def _(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    score = perfmodel.worker_score(e % 100, u % 100, e % 7, u % 9)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(score), 4).cast("double").alias("score"))


# --- assessment


@query("compatibility", "SELECT * FROM (VALUES (1, 2, 1, false)) v(warnings, unsupported, notes, can_start)")
def _(spark, d):
    rows = [("t", "a", "STRING", True, False), ("t", "b", "UNKNOWN", True, True), ("u", "c", "BIGINT", False, False), ("u", "d", "DATE", False, False)]
    return assess.verdict(assess.findings(spark.createDataFrame(rows, "table_name string, column_name string, universal string, has_key boolean, generated boolean")))


@query("view_order", "SELECT * FROM (VALUES (0, 'base', true), (1, 'a', true), (2, 'c', true), (3, 'b', true), (4, 'x', false), (5, 'y', false)) v(place, name, ordered)")
def _(spark, d):
    order, cyclic = assess.dependency_order(["a", "b", "c", "base", "x", "y"], [("b", "c"), ("a", "base"), ("c", "a"), ("x", "y"), ("y", "x")])
    return spark.createDataFrame([(i, n, i < len(order)) for i, n in enumerate(order + cyclic)], "place int, name string, ordered boolean")
