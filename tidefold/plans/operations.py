"""Queries over running tasks: health, progress, gates, placement, dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.functions import jsondiff, rules
from tidefold.operators import health, mapping, perfmodel
from tidefold.plans.analytics import _CHUNKS, chunks
from tidefold.plans.registry import query
from tidefold.sources import sinks
from tidefold.sources.scan import table


@query("fault_domain", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'eu/z' || event_id % 4 WHEN 1 THEN 'z' || event_id % 4 || '/r1' ELSE NULL END AS domain FROM events")
def _(spark, d):
    zone = F.concat(F.lit("z"), (F.col("event_id") % 4).cast("string"))
    m = F.col("user_id") % 3
    labels = F.when(m == 0, F.create_map(F.lit("region"), F.lit("eu"), F.lit("topology.kubernetes.io/zone"), zone)).when(m == 1, F.create_map(F.lit("az"), zone, F.lit("rack"), F.lit("r1"))).otherwise(F.create_map(F.lit("zone"), F.lit(" ")))
    return table(spark, d, "events").select("event_id", rules.fault_domain(labels).alias("domain"))


@query("topology_hints", "SELECT chunk_id, CASE WHEN topology IN ('zone1', 'zone2') THEN topology ELSE ['zone1', 'zone2', 'far'][chunk_id % 3 + 1] END AS place FROM " + _CHUNKS)
def _(spark, d):
    return health.topology_hints(chunks(spark, d), ["zone1", "zone2", "far"], "chunk_id", "topology").select("chunk_id", "place")


@query("fk_remap", "SELECT * FROM (VALUES ('sales', 'client_id', 'clients', 'id'), ('items', 'o_id', 'sales', 'o_id')) v(t, c, ref_t, ref_c)")
def _(spark, d):
    keys = spark.createDataFrame([("orders", "cust", "cust", "key"), ("items", "o_id", "orders", "o_id")], "t string, c string, ref_t string, ref_c string")
    names = spark.createDataFrame([("orders", "cust", "sales", "client_id"), ("cust", "key", "clients", "id"), ("orders", "o_id", "sales", "o_id")], "t string, c string, new_t string, new_c string")
    return health.remap_keys(keys, names)


@query(
    "health_machine",
    """WITH RECURSIVE e AS (SELECT user_id, event_type IN ('error', 'view', 'click') AS bad, event_id % 9 = 0 AS probe, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'HEALTHY' AS h, 0 AS slow, 0 AS good FROM e UNION ALL
 SELECT user_id, n, CASE now WHEN 'CIRCUIT_OPEN' THEN 'CIRCUIT_OPEN' WHEN 'HALF_OPEN' THEN CASE WHEN bad THEN 'CIRCUIT_OPEN' ELSE 'DEGRADED' END
  WHEN 'DEGRADED' THEN CASE WHEN bad AND s >= 5 THEN 'CIRCUIT_OPEN' WHEN g >= 3 THEN 'HEALTHY' ELSE 'DEGRADED' END ELSE CASE WHEN bad AND s >= 5 THEN 'CIRCUIT_OPEN' WHEN bad AND s >= 2 THEN 'DEGRADED' ELSE 'HEALTHY' END END,
  CASE now WHEN 'HALF_OPEN' THEN CASE WHEN bad THEN greatest(5, s) ELSE least(1, s) END WHEN 'DEGRADED' THEN CASE WHEN NOT (bad AND s >= 5) AND g >= 3 THEN 0 ELSE s END ELSE s END,
  CASE now WHEN 'HALF_OPEN' THEN CASE WHEN bad THEN 0 ELSE 1 END WHEN 'DEGRADED' THEN CASE WHEN NOT (bad AND s >= 5) AND g >= 3 THEN 0 ELSE g END ELSE 0 END FROM
 (SELECT e.user_id, e.n, e.bad, CASE WHEN f.h = 'CIRCUIT_OPEN' AND e.probe THEN 'HALF_OPEN' ELSE f.h END AS now, CASE WHEN e.bad THEN f.slow + 1 ELSE greatest(0, f.slow - 1) END AS s, CASE WHEN e.bad THEN 0 ELSE f.good + 1 END AS g
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
 SELECT user_id, max_by(h, n) AS health FROM f GROUP BY 1""",
)
def _(spark, d):
    sample = F.struct("event_id", F.col("event_type").isin("error", "view", "click").alias("bad"), (F.col("event_id") % 9 == 0).alias("probe"))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(sample)).alias("s")).select("user_id", health.health_fold(F.col("s")).alias("health"))


@query(
    "progress_eta",
    """SELECT event_id, CASE WHEN br > 0 AND 100000 > b THEN (100000 - b) // br WHEN rr > 0 AND 5000 > r THEN (5000 - r) // rr ELSE 0 END AS eta FROM
 (SELECT event_id, event_id * 91 % 120000 AS b, event_id % 5 AS br, event_id * 7 % 6000 AS r, event_id % 3 AS rr FROM events)""",
)
def _(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", health.progress_eta(F.lit(100000), e * 91 % 120000, e % 5, F.lit(5000), e * 7 % 6000, e % 3).alias("eta"))


@query(
    "sla_risk",
    """SELECT event_id, CASE WHEN e99 > greatest(0, l) THEN 'CRITICAL' WHEN e95 > greatest(0, l) THEN 'WARN' ELSE 'NORMAL' END AS risk FROM (SELECT event_id, 300 - event_id % 350 AS l,
 CASE WHEN b <= 0 THEN 0 WHEN p <= 30000 THEN b ELSE b * (100 + ((p - 30000) * 100 // 30000) * 25 // 100) // 100 END AS e95,
 CASE WHEN b <= 0 THEN 0 WHEN p <= 30000 THEN b ELSE b * (100 + ((p - 30000) * 100 // 30000) * 50 // 100) // 100 END AS e99 FROM (SELECT event_id, event_id % 200 AS b, event_id * 131 % 100000 AS p FROM events))""",
)
def _(spark, d):
    e = F.col("event_id")
    base, p = e % 200, e * 131 % 100000
    return table(spark, d, "events").select("event_id", health.sla_risk(300 - e % 350, perfmodel.tail_eta(base, 30000, p, 25), perfmodel.tail_eta(base, 30000, p, 50)).alias("risk"))


@query(
    "cutover_gate",
    f"""SELECT task_id, concat_ws(',', CASE WHEN pending > 0 THEN 'PENDING' END, CASE WHEN lag > 5000 THEN 'LAG' END, CASE WHEN task_id = 1 THEN 'SEQUENCES' END) AS blocked_by, pending = 0 AND lag <= 5000 AND task_id <> 1 AS ready FROM
 (SELECT task_id, CASE WHEN task_id = 0 THEN 0 ELSE count(*) FILTER (WHERE status = 'PENDING') END AS pending, max(bytes) + task_id * 2 AS lag FROM {_CHUNKS} GROUP BY 1)""",
)
def _(spark, d):
    t = F.col("task_id")
    tasks = chunks(spark, d).groupBy("task_id").agg(F.count_if(F.col("status") == "PENDING").alias("p"), (F.max("bytes")).alias("m"))
    tasks = tasks.select("task_id", F.when(t == 0, 0).otherwise(F.col("p")).alias("pending"), F.lit(0).alias("spooled"), (F.col("m") + t * 2).alias("lag_ms"), F.lit(True).alias("validated"), (t != 1).alias("sequences_fresh"))
    return health.cutover_gate(tasks).select("task_id", "blocked_by", "ready")


@query("profile_merge", "SELECT k, CASE WHEN k % 3 = 0 THEN 'old' WHEN k < 20 OR k >= 30 THEN CASE WHEN k < 20 THEN 'old' ELSE 'new' END ELSE 'new' END AS src, CASE WHEN k < 30 AND (k % 3 = 0 OR k < 20) THEN 10 ELSE k % 3 * 10 END AS samples FROM range(40) t(k) WHERE k < 30 OR k % 3 > 0")
def _(spark, d):
    current = spark.range(30).select(F.col("id").alias("k"), F.lit("old").alias("src"), F.lit(10).cast("bigint").alias("samples"))
    incoming = spark.range(20, 40).where("id % 3 > 0").select(F.col("id").alias("k"), F.lit("new").alias("src"), (F.col("id") % 3 * 10).alias("samples"))
    return health.merge_profiles(current, incoming, ["k"])


@query("cdc_lag", "SELECT event_id, greatest(0, 500 - event_id) AS lag FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0), 500 - F.col("event_id")).alias("lag"))


@query("dead_letters", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'NO_AFTER' ELSE 'NO_KEY' END AS reason FROM events WHERE event_type = 'view' OR (event_type = 'error' AND user_id % 2 = 0)")
def _(spark, d):
    kind = F.col("event_type")
    key, after = F.when(~((kind == "error") & (F.col("user_id") % 2 == 0)), F.col("user_id")), F.when(~kind.isin("view", "error"), F.col("value"))
    reason = F.when(key.isNull(), "NO_KEY").when((kind != "error") & after.isNull(), "NO_AFTER")
    return table(spark, d, "events").select("event_id", reason.alias("reason")).where("reason IS NOT NULL")


@query("retention_spool", "SELECT event_id FROM events WHERE NOT (event_type = 'click' AND event_id < 600)")
def _(spark, d):
    return table(spark, d, "events").where(~((F.col("event_type") == "click") & (F.col("event_id") < 600))).select("event_id")


@query("reverse_mapping", "SELECT name AS user_id, id AS event_id FROM (SELECT event_id AS id, user_id AS name FROM events)")
def _(spark, d):
    mapping = {"event_id": "id", "user_id": "name"}
    forward = table(spark, d, "events").select(*(F.col(a).alias(b) for a, b in mapping.items()))
    return forward.select(*(F.col(b).alias(a) for a, b in mapping.items()))


@query("json_patch", """SELECT event_id, '{"k":' || (props->>'$.k') || ',"a":[0,1],"n":"é"}' AS j FROM events""")
def _(spark, d):
    edits = [("INSERT", "$.a", "[1,2]"), ("INSERT", "$.a[0]", "0"), ("REMOVE", "$.a[2]", None), ("INSERT", '$."n"', '"x"'), ("REPLACE", "$.n", '"é"')]
    array = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("action", "path", "value"), e, strict=True))) for e in edits))
    return table(spark, d, "events").select("event_id", jsondiff.apply_patch(F.col("props"), array).alias("j"))


@query(
    "sink_statements",
    """SELECT * FROM (VALUES ('mysql', 'INSERT INTO `t` (`a`, `b`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `a` = VALUES(`a`), `b` = VALUES(`b`)'),
 ('postgres', 'INSERT INTO "t" ("a", "b") VALUES (?, ?) ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"'),
 ('oracle', 'MERGE INTO "t" t USING (SELECT ? AS "a", ? AS "b" FROM DUAL) s ON (t."a" = s."a") WHEN MATCHED THEN UPDATE SET t."b" = s."b" WHEN NOT MATCHED THEN INSERT ("a", "b") VALUES (s."a", s."b")'),
 ('sqlserver', 'MERGE INTO [t] WITH (HOLDLOCK) AS t USING (SELECT ? AS [a], ? AS [b]) AS s ON (t.[a] = s.[a]) WHEN MATCHED THEN UPDATE SET t.[b] = s.[b] WHEN NOT MATCHED THEN INSERT ([a], [b]) VALUES (s.[a], s.[b]);')) v(dialect, sql)""",
)
def _(spark, d):
    rows = [(x, sinks.upsert_statement(x, "t", ["a", "b"], ["a"])) for x in ("mysql", "postgres", "oracle", "sqlserver")]
    return spark.createDataFrame(rows, "dialect string, sql string")


@query("create_table", """SELECT 'CREATE TABLE "nation" ("n_nationkey" number(10) NOT NULL, "n_name" clob, "n_regionkey" number(10), PRIMARY KEY ("n_nationkey"))' AS sql""")
def _(spark, d):
    return spark.createDataFrame([(sinks.create_table("oracle", "nation", table(spark, d, "nation").schema, ["n_nationkey"]),)], "sql string")


@query("align_target", "SELECT c_name AS name, c_custkey::INTEGER AS id, c_nationkey::VARCHAR AS balance FROM customer")
def _(spark, d):
    renamed = mapping.rename(table(spark, d, "customer"), {"C_CUSTKEY": "id", "c_name": "name", "c_nationkey": "balance"}, generated=["c_acctbal"])
    return mapping.align(renamed, {"name": "string", "id": "int", "balance": "string"})


@query("spool_scan", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND event_id > 100 ORDER BY event_id LIMIT 64")
def _(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase' AND event_id > 100").orderBy("event_id").limit(64).select("event_id", "user_id")


@query("report_rows", f"""SELECT '{{"table_id":' || table_id || ',"chunks":' || count(*) || ',"done":' || count(*) FILTER (WHERE status = 'SUCCESS') || '}}' AS line FROM {_CHUNKS} GROUP BY table_id""")
def _(spark, d):
    counted = chunks(spark, d).groupBy("table_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "SUCCESS").alias("done"))
    return counted.select(F.to_json(F.struct("table_id", "chunks", "done")).alias("line"))


@query("rate_budgets", "SELECT user_id, least(sum(bytes), 40000)::BIGINT AS granted, greatest(sum(bytes) - 40000, 0)::BIGINT AS held FROM (SELECT user_id, event_id * 91 % 5000 AS bytes FROM events) GROUP BY 1")
def _(spark, d):
    asked = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.col("event_id") * 91 % 5000).alias("b"))
    return asked.select("user_id", F.least("b", F.lit(40000)).cast("bigint").alias("granted"), F.greatest(F.col("b") - 40000, F.lit(0)).cast("bigint").alias("held"))
