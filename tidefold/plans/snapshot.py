"""Queries over snapshots: scans, splits, rules, types, checksums, keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.functions import rules, types
from tidefold.functions.rules import Rule, apply_rules
from tidefold.operators import checksum, split, upsert
from tidefold.plans.registry import query
from tidefold.sources import folders, scan
from tidefold.sources.scan import table

# --- scans


@query("scan_pk_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_orderkey > 250 ORDER BY o_orderkey LIMIT 200")
def _(spark, d):
    return scan.range_scan(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 900, after=250, limit=200)


@query("scan_keyset_page", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 5 OR (conv_id = 5 AND turn > 1)) AND conv_id < 60 ORDER BY conv_id, turn LIMIT 50")
def _(spark, d):
    return scan.keyset_scan(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], cursor=[5, 1], lower=[0, 0], upper=[60, 0], limit=50)


@query("scan_keyset_bounds", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 1)) AND (conv_id < 40 OR (conv_id = 40 AND turn < 2))")
def _(spark, d):
    return scan.keyset_scan(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], lower=[3, 1], upper=[40, 2])


@query("scan_lexicographic", "SELECT l_orderkey, l_partkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_orderkey > 500 OR (l_orderkey = 500 AND (l_partkey > 20 OR (l_partkey = 20 AND l_linenumber >= 3)))) AND (l_orderkey < 900 OR (l_orderkey = 900 AND (l_partkey < 10 OR (l_partkey = 10 AND l_linenumber <= 1)))) GROUP BY ALL")
def _(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    rows = table(spark, d, "lineitem").where(scan.lexicographic(keys, [500, 20, 3], ">=") & scan.lexicographic(keys, [900, 10, 1], "<="))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


_BUCKET = "(('0x' || substr(md5({}), 1, 8))::BIGINT % {})"


@query("scan_hash_bucket", f"SELECT o_orderkey FROM orders WHERE {_BUCKET.format('o_orderkey::VARCHAR', 8)} = 3")
def _(spark, d):
    return table(spark, d, "orders").where(scan.hash_bucket(["o_orderkey"], 8) == 3).select("o_orderkey")


@query("split_hash", f"SELECT {_BUCKET.format("conv_id::VARCHAR || '#' || turn::VARCHAR", 8)} AS bucket, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    return split.hash_splits(table(spark, d, "conversations"), ["conv_id", "turn"], 4).groupBy("bucket").agg(F.count("*").alias("n"))


@query("scan_partition", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    return scan.partition_scan(table(spark, d, "events"), "event_type", "purchase").select("event_id", "user_id")


@query("scan_custom_where", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 250000 OR o_orderpriority LIKE '1%')")
def _(spark, d):
    return scan.custom_scan(table(spark, d, "orders"), "o_orderstatus = 'F' AND (o_totalprice > 250000 OR o_orderpriority LIKE '1%')").select("o_orderkey")


@query(
    "scan_as_of",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
    FROM events WHERE event_id <= 400) WHERE n = 1 AND event_type <> 'error'""",
)
def _(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE").alias("operation"))
    return scan.as_of(log, ["user_id"], "event_id", 400).select("user_id", "event_id", "value")


@query("point_lookup", "SELECT k.o_orderkey, o.o_totalprice FROM (SELECT DISTINCT event_id * 7 AS o_orderkey FROM events WHERE event_type = 'click') k LEFT JOIN orders o USING (o_orderkey)")
def _(spark, d):
    batch = table(spark, d, "events").where("event_type = 'click'").select((F.col("event_id") * 7).alias("o_orderkey")).distinct()
    return scan.point_lookup(batch, table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("catalog_columns", "SELECT v.ordinal::INTEGER AS ordinal, v.column_name, v.data_type, s.min_key, s.max_key, s.n_rows FROM (VALUES (0,'r_regionkey','int'),(1,'r_name','string')) v(ordinal, column_name, data_type), (SELECT min(r_regionkey)::BIGINT AS min_key, max(r_regionkey)::BIGINT AS max_key, count(*) AS n_rows FROM region) s")
def _(spark, d):
    return scan.catalog(table(spark, d, "region"), "r_regionkey")


# --- split planning

_RANGES = """SELECT chunk_no, low + chunk_no * span AS range_start, least(low + (chunk_no + 1) * span - 1, high) AS range_end FROM
 (SELECT low, high, greatest(1, ceil((high - low + 1) / greatest(1, ceil(n / 500.0)))::BIGINT) AS span FROM
 (SELECT min(o_orderkey)::BIGINT AS low, max(o_orderkey)::BIGINT AS high, count(*) AS n FROM orders)),
 range(100000) r(chunk_no) WHERE low + chunk_no * span <= high"""


@query("plan_row_ranges", _RANGES)
def _(spark, d):
    return split.row_ranges(table(spark, d, "orders"), "o_orderkey", 500)


@query("plan_integer_ranges", "SELECT r AS chunk_no, -10 + r * 7 AS range_start, least(-10 + r * 7 + 6, 25) AS range_end FROM range(6) t(r)")
def _(spark, d):
    return split.integer_ranges(spark.sql("SELECT -10L AS low, 25L AS high, 7L AS span"))


_NTILE = """SELECT piece, (m).conv_id AS conv_id, (m).turn AS turn FROM (SELECT piece, min({'conv_id': conv_id, 'turn': turn}) AS m FROM
 (SELECT conv_id, turn, ntile(6) OVER (ORDER BY conv_id, turn)::INTEGER AS piece FROM conversations) GROUP BY piece) WHERE piece > 1"""


@query("plan_keyset_bounds", _NTILE)
def _(spark, d):
    return split.keyset_bounds(table(spark, d, "conversations"), ["conv_id", "turn"], 6)


@query(
    "plan_bounded_keysets",
    """WITH b AS (SELECT min(o_orderkey) AS k FROM (SELECT o_orderkey, ntile(5) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p > 1 GROUP BY p),
 a AS (SELECT NULL AS k UNION ALL SELECT k FROM b)
 SELECT row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS chunk_no, k::BIGINT AS lower_key, lead(k::BIGINT) OVER (ORDER BY k NULLS FIRST) AS upper_key FROM a""",
)
def _(spark, d):
    return split.bounded_keysets(split.keyset_bounds(table(spark, d, "orders"), ["o_orderkey"], 5), "o_orderkey")


@query("plan_partition_count", "SELECT n_rows, greatest(1, least(ceil(n_rows / 100.0), least(4 * 8, 128)))::BIGINT AS pieces FROM (SELECT count(*) AS n_rows FROM orders)")
def _(spark, d):
    rows = table(spark, d, "orders").agg(F.count("*").alias("n_rows"))
    return rows.withColumn("pieces", F.greatest(F.lit(1), F.least(F.ceil(F.col("n_rows") / 100), F.lit(min(4 * 8, 128)))).cast("bigint"))


@query(
    "stable_key_check",
    """SELECT 'orders' AS t, count(*) = count(DISTINCT o_orderkey) AS is_key FROM orders UNION ALL
 SELECT 'conversations', count(*) = count(DISTINCT (conv_id, turn)) FROM conversations UNION ALL
 SELECT 'lineitem', count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""",
)
def _(spark, d):
    def one(name, keys):
        grouped = table(spark, d, name).groupBy(*keys).agg(F.count("*").alias("n"))
        return grouped.agg(F.lit(name).alias("t"), (F.max("n") == 1).alias("is_key"))

    return one("orders", ["o_orderkey"]).union(one("conversations", ["conv_id", "turn"])).union(one("lineitem", ["l_orderkey", "l_linenumber"]))


# --- rules and types


@query("project_rename", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query(
    "rule_text",
    """SELECT o_orderkey, lower(regexp_replace(' ' || chr(9) || o_orderpriority || chr(160), '^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$', '', 'g')) AS p,
 replace(upper(o_orderstatus), 'F', 'done') AS s FROM orders""",
)
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" \t"), "o_orderpriority", F.lit(" ")).alias("p"), F.col("o_orderstatus").alias("s"))
    return apply_rules(df, [Rule("p", "TRIM"), Rule("P", "LOWER", table="Orders"), Rule("s", "UPPER"), Rule("s", "REPLACE_LITERAL", match="F", value="done"), Rule("s", "LOWER", table="other")], "app", "orders")


@query(
    "rule_nulls",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS emptied, CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS filled,
 CASE WHEN event_type = 'click' THEN NULL ELSE '2024-01-02' END AS day, CASE WHEN event_type = 'click' THEN '1970-01-01' ELSE '2024-01-02' END AS day2 FROM events""",
)
def _(spark, d):
    kind = F.col("event_type")
    day = F.when(kind == "click", " 0000-00-00 00:00:00").otherwise("2024-01-02")
    df = table(spark, d, "events").select("event_id", F.when(kind == "error", "").otherwise(kind).alias("emptied"), F.when(kind != "view", kind).alias("filled"), day.alias("day"), day.alias("day2"))
    return apply_rules(df, [Rule("emptied", "EMPTY_TO_NULL"), Rule("filled", "NULL_TO_VALUE", value="none"), Rule("day", "ZERO_DATE_TO_NULL"), Rule("day2", "ZERO_DATE_TO_VALUE", value="1970-01-01")])


@query(
    "coerce_boolean",
    "SELECT event_id, event_type IN ('click', 'view') AS b, (event_type IN ('click', 'view'))::INTEGER AS i, user_id % 2 = 1 AS j FROM events",
)
def _(spark, d):
    text = F.when(F.col("event_type") == "click", "Yes").when(F.col("event_type") == "view", " 1").when(F.col("event_type") == "error", "off").otherwise("F")
    return table(spark, d, "events").select("event_id", rules.to_boolean(text).alias("b"), rules.boolean_to_integer(text).alias("i"), rules.integer_to_boolean((F.col("user_id") % 2).cast("string")).alias("j"))


@query("json_validate", "SELECT event_id, json_valid(props) AS ok, json_valid(props || '}') AS bad FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", rules.is_json(F.col("props")).alias("ok"), rules.is_json(F.concat("props", F.lit("}"))).alias("bad"))


@query("json_compact", """SELECT event_id, '{"z":[1,"a b"],"p":' || replace(props, ' ', '') || '}' AS j FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", rules.json_compact(F.concat(F.lit('{ "z" : [1,\n "a b"] , "p" : '), "props", F.lit(" }"))).alias("j"))


#: Type spellings of the sample and what they become, fixed values.
_TYPES = [
    ("varchar(20)", "STRING", "varchar(20)", "varchar2(20)", "nvarchar(20)", "string"),
    ("varchar(9000)", "STRING", "varchar(9000)", "clob", "nvarchar(max)", "string"),
    ("int unsigned", "INTEGER", "integer", "number(10)", "int", "int"),
    ("bigint", "BIGINT", "bigint", "number(19)", "bigint", "bigint"),
    ("number(10)", "BIGINT", "bigint", "number(19)", "bigint", "bigint"),
    ("number(12,2)", "DECIMAL", "numeric(12,2)", "number(12,2)", "decimal(12,2)", "decimal(12,2)"),
    ("decimal(60,4)", "DECIMAL", "numeric(60,4)", "number(38,4)", "decimal(38,4)", "decimal(38,4)"),
    ("numeric", "DECIMAL", "numeric", "number(38,0)", "decimal(38,0)", "decimal(38,0)"),
    ("double precision", "DOUBLE", "double precision", "binary_double", "float(53)", "double"),
    ("timestamp(6) with time zone", "TIMESTAMP", "timestamp", "timestamp(6)", "datetime2(7)", "timestamp_ntz"),
    ("bit", "BOOLEAN", "boolean", "number(1)", "bit", "boolean"),
    ("longblob", "BINARY", "bytea", "blob", "varbinary(max)", "binary"),
    ("jsonb", "JSON", "jsonb", "clob", "nvarchar(max)", "string"),
    ("uniqueidentifier", "UUID", "uuid", "varchar2(36)", "uniqueidentifier", "string"),
    ("geometry", "UNKNOWN", "text", "clob", "nvarchar(max)", "string"),
]


@query("type_mapping", "SELECT * FROM (VALUES " + ", ".join(str(t) for t in _TYPES) + ") v(source, universal, postgres, oracle, sqlserver, spark)")
def _(spark, d):
    rows = [(s, u.kind, types.target_type(u, "postgres"), types.target_type(u, "oracle"), types.target_type(u, "sqlserver"), types.spark_type(u)) for s, *_ in _TYPES for u in [types.normalise(s)]]
    return spark.createDataFrame(rows, "source string, universal string, postgres string, oracle string, sqlserver string, spark string")


@query(
    "position_codecs",
    """SELECT event_id, printf('%X/%X', (event_id * 5000000001) >> 32, (event_id * 5000000001) & 4294967295) AS lsn, event_id * 5000000001 AS parsed,
 (event_id * 300000000) >> 18 AS millis, 'tso=' || event_id || ';kafka=' || user_id AS position, event_id AS tso, user_id AS kafka FROM events""",
)
def _(spark, d):
    lsn = F.col("event_id") * F.lit(5000000001)
    text = rules.kafka_position(F.col("event_id"), F.col("user_id"))
    back = rules.parse_kafka_position(text)
    return table(spark, d, "events").select("event_id", rules.format_lsn(lsn).alias("lsn"), rules.parse_lsn(rules.format_lsn(lsn)).alias("parsed"), rules.tso_millis(F.col("event_id") * 300000000).alias("millis"), text.alias("position"), back["tso"].alias("tso"), back["kafka"].alias("kafka"))


@query("key_fingerprint", "SELECT conv_id, turn, substr(sha256(unhex('00' || hex(conv_id::VARCHAR) || 'FF00' || hex(turn::VARCHAR) || 'FF')), 1, 24) AS f FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rules.key_fingerprint([F.col("conv_id"), F.col("turn")]).alias("f"))


@query("rate_window", "SELECT event_id, m >= 1320 OR m < 360 AS night, m >= 540 AND m < 1020 AS day FROM (SELECT event_id, (hour(ts) * 60 + minute(ts)) AS m FROM events)")
def _(spark, d):
    m = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, d, "events").select("event_id", rules.in_window(m, "22:00", "06:00").alias("night"), rules.in_window(m, "09:00", "17:00").alias("day"))


@query(
    "version_compare",
    "SELECT event_id, user_id > event_id % 97 AS newer FROM events",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", rules.newer(F.concat(F.col("user_id").cast("string"), F.lit(".0")), (F.col("event_id") % 97).cast("string")).alias("newer"))


# --- checksums and validation

_LIMBS = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::BIGINT AS limb{i}" for i in range(8))
_ORDER_HASH = "sha256(" + " || ".join(f"(CASE WHEN {c} IS NULL THEN 'N|' ELSE strlen({c}) || ':' || {c} || '|' END)" for c in ("o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "o_orderpriority")) + ")"
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _values(columns):
    return [F.col(c).cast("string") for c in columns]


@query("checksum_unordered", f"SELECT count(*) AS n_rows, {_LIMBS} FROM (SELECT {_ORDER_HASH} AS h FROM orders)")
def _(spark, d):
    return checksum.checksum(table(spark, d, "orders"), _values(_ORDER_COLUMNS))


@query("checksum_by_chunk", f"SELECT o_orderkey // 500 AS chunk_no, count(*) AS n_rows, {_LIMBS} FROM (SELECT o_orderkey, {_ORDER_HASH} AS h FROM orders) GROUP BY 1")
def _(spark, d):
    return checksum.checksum(table(spark, d, "orders"), _values(_ORDER_COLUMNS), [F.floor(F.col("o_orderkey") / 500).alias("chunk_no")])


@query(
    "canonical_values",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN '1' ELSE '0' END AS b, (event_id * 10)::VARCHAR AS n, '{"a":1,"k":' || (props->>'$.k') || '}' AS j, lower(substr(md5(event_id::VARCHAR), 1, 8)) AS u FROM events""",
)
def _(spark, d):
    flag = F.when(F.col("event_type") == "click", "T").otherwise("no")
    number = F.concat(F.lit("00"), (F.col("event_id") * 10).cast("string"), F.lit(".00"))
    text = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(', "a" : 1}'))
    uid = F.upper(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8))
    return table(spark, d, "events").select("event_id", checksum.canonical(flag, "tinyint(1)").alias("b"), checksum.canonical(number, "decimal(10,2)").alias("n"), checksum.canonical(text, "json").alias("j"), checksum.canonical(F.concat(F.lit(" "), uid), "uuid").alias("u"))


def _sides(spark, d):
    """orders and a copy with one row changed, one lost and one more."""
    source = table(spark, d, "orders").select(*_ORDER_COLUMNS)
    target = source.where("o_orderkey <> 1200").withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 77, "X").otherwise(F.col("o_orderstatus")))
    extra = spark.sql("SELECT -5L AS o_orderkey, 1L AS o_custkey, 'O' AS o_orderstatus, '5-LOW' AS o_orderpriority")
    return source, target.unionByName(extra)


@query(
    "validate_chunks",
    """SELECT coalesce(s.c, t.c) AS chunk_no, coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows,
 CASE WHEN s.c IS NULL OR t.c IS NULL THEN 'MISSING' WHEN s.c IN (77 // 250, 1200 // 250) THEN 'MISMATCH' ELSE 'SUCCESS' END AS status
 FROM (SELECT o_orderkey // 250 AS c, count(*) AS n FROM orders GROUP BY 1) s FULL JOIN
 (SELECT k // 250 AS c, count(*) AS n FROM (SELECT CASE WHEN o_orderkey = -5 THEN -250 ELSE o_orderkey END AS k FROM orders WHERE o_orderkey <> 1200 UNION ALL SELECT -250) GROUP BY 1) t ON s.c = t.c""",
)
def _(spark, d):
    chunk = F.floor(F.col("o_orderkey") / 250).alias("chunk_no")
    s, t = (checksum.checksum(x, _values(_ORDER_COLUMNS), [chunk]) for x in _sides(spark, d))
    return checksum.compare(s, t, ["chunk_no"])


@query("validate_union", "SELECT 0 AS part, count(*) AS source_rows, count(*) AS target_rows, 'MISMATCH' AS status FROM orders")
def _(spark, d):
    s, t = (checksum.checksum(x, _values(_ORDER_COLUMNS), [F.lit(0).alias("part")]) for x in _sides(spark, d))
    return checksum.compare(s, t, ["part"])


@query("row_difference", "SELECT * FROM (VALUES (77::BIGINT, 'CHANGED'), (1200::BIGINT, 'MISSING'), (-5::BIGINT, 'EXTRA')) v(o_orderkey, difference)")
def _(spark, d):
    return checksum.row_difference(*_sides(spark, d), ["o_orderkey"])


@query("repair_list", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey // 250 IN (77 // 250, 1200 // 250)")
def _(spark, d):
    source, target = _sides(spark, d)
    chunk = F.floor(F.col("o_orderkey") / 250)
    s, t = (checksum.checksum(x, _values(_ORDER_COLUMNS), [chunk.alias("chunk_no")]) for x in (source, target))
    bad = checksum.compare(s, t, ["chunk_no"]).where("status = 'MISMATCH'").select("chunk_no")
    return source.withColumn("chunk_no", chunk).join(bad, "chunk_no", "left_semi").select(*_ORDER_COLUMNS)


@query(
    "copy_and_validate",
    f"""SELECT r.chunk_no, r.range_start, r.range_end, count(o.o_orderkey) AS source_rows, count(o.o_orderkey) AS target_rows, 'SUCCESS' AS status
 FROM ({_RANGES}) r LEFT JOIN orders o ON o.o_orderkey BETWEEN r.range_start AND r.range_end GROUP BY ALL""",
)
def _(spark, d):
    """Ranges of about 500 orders, copied with a rename and two rules; the copy is written, read again and compared range by range."""
    return _copied(spark, d, lambda rows: rows)


@query(
    "copy_damaged",
    f"""SELECT r.chunk_no, r.range_start, r.range_end, count(o.o_orderkey) AS source_rows, count(o.o_orderkey) FILTER (WHERE o.o_orderkey <> 1200) AS target_rows,
 CASE WHEN bool_or(o.o_orderkey IN (77, 1200)) THEN 'MISMATCH' ELSE 'SUCCESS' END AS status
 FROM ({_RANGES}) r LEFT JOIN orders o ON o.o_orderkey BETWEEN r.range_start AND r.range_end GROUP BY ALL""",
)
def _(spark, d):
    """As copy_and_validate, where the target got one row changed and lost one."""
    return _copied(spark, d, lambda rows: rows.where("o_orderkey <> 1200").withColumn("o_custkey", F.when(F.col("o_orderkey") == 77, -1).otherwise(F.col("o_custkey"))))


def _copied(spark, d, damage):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"))
    fixed = [Rule("priority", "TRIM"), Rule("priority", "LOWER")]
    source, folder = apply_rules(orders, fixed), folders.shared(spark)
    damage(source).write.parquet(folder)
    target = spark.read.parquet(folder)
    ranges = split.row_ranges(orders, "o_orderkey", 500)
    first = F.broadcast(ranges.agg(F.min("range_start").alias("low"), F.max(F.col("range_end") - F.col("range_start") + 1).alias("span")))  # one row
    sums = []
    for side in (source, target):
        numbered = side.crossJoin(first).withColumn("chunk_no", F.floor((F.col("o_orderkey") - F.col("low")) / F.col("span")))
        sums.append(checksum.checksum(numbered, _values(["o_orderkey", "o_custkey", "priority"]), [F.col("chunk_no")]))
    return ranges.join(checksum.compare(*sums, ["chunk_no"]), "chunk_no").select("chunk_no", "range_start", "range_end", "source_rows", "target_rows", "status")


# --- keyed writes

_CHANGES = "SELECT o_orderkey * 2 AS o_orderkey, o_custkey, 'U' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0"


def _batch(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return orders, orders.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"), "o_custkey", F.lit("U").alias("o_orderstatus"))


@query("upsert_orders", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_CHANGES})) UNION ALL {_CHANGES}")
def _(spark, d):
    return upsert.upsert(*_batch(spark, d), ["o_orderkey"])


@query("insert_missing", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT * FROM ({_CHANGES}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    return upsert.insert_missing(*_batch(spark, d), ["o_orderkey"])


@query("update_present", f"SELECT o.o_orderkey, coalesce(c.o_custkey, o.o_custkey) AS o_custkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM orders o LEFT JOIN ({_CHANGES}) c USING (o_orderkey)")
def _(spark, d):
    return upsert.update_present(*_batch(spark, d), ["o_orderkey"])


@query("delete_by_key", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_CHANGES}))")
def _(spark, d):
    return upsert.delete(*_batch(spark, d), ["o_orderkey"])


@query("truncate_table", "SELECT o_orderkey FROM orders WHERE false")
def _(spark, d):
    return upsert.truncate(table(spark, d, "orders").select("o_orderkey"))


@query(
    "spool_append",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id < 100) WHERE n = 1
 UNION ALL SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id >= 100 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id < 100)) WHERE n = 1""",
)
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id")
    log = upsert.append_once(events.limit(0), events.where("event_id < 100"), "user_id", "event_id")
    return upsert.append_once(log, events.where("event_id >= 100"), "user_id", "event_id")


@query("sequence_sync", "SELECT max(o_orderkey) + 1 AS next_value FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg((F.max("o_orderkey") + 1).alias("next_value"))
