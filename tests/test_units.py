"""Properties and refusals that no SQL shows."""

import random
from itertools import pairwise

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidefold.functions import rules, types
from tidefold.functions.rules import Rule, apply_rules
from tidefold.operators import assess, cdc, checksum, split, upsert
from tidefold.sources import scan


@given(st.integers(-1000, 1000), st.integers(0, 3000), st.integers(1, 40))
def test_resplit_has_no_gap(start, width, pieces):
    parts = split.resplit(start, start + width, pieces)
    assert parts[0][0] == start and parts[-1][1] == start + width
    assert all(b[0] == a[1] + 1 for a, b in pairwise(parts))
    assert max(b - a for a, b in parts) - min(b - a for a, b in parts) <= 1


def test_remainder_after_the_cursor():
    assert split.split_remainder(10, 19, 2) == [(11, 15), (16, 19)]
    assert split.split_remainder(19, 19, 2) == []


def test_span_and_pieces():
    assert split.span_for(250, 1, 250, 100) == 84
    assert split.span_for(0, 1, 1000, 100) == 100
    assert split.pieces_for(10_000_000, 4) == 16 and split.pieces_for(0, 4) == 1 and split.pieces_for(1 << 40, 100) == 128


def test_strategy():
    assert split.strategy("AUTO", [("id", "BIGINT")]) == "PRIMARY_KEY_RANGE"
    assert split.strategy("AUTO", [("a", "STRING"), ("b", "BIGINT")]) == "UNIQUE_KEY_RANGE"
    for bad in (("PRIMARY_KEY_RANGE", [("a", "STRING")]), ("PARTITION_RANGE", [("a", "BIGINT")]), ("NONE", [("a", "BIGINT")])):
        with pytest.raises(ValueError):
            split.strategy(*bad)


@pytest.mark.parametrize("bad", ["", "1 = 1; DROP TABLE t", "a -- b", "a IN (SELECT 1)", "/* x */ true"])
def test_custom_predicates_are_refused(spark, bad):
    with pytest.raises(ValueError):
        scan.custom_scan(spark.range(1), bad)


def test_custom_predicate_may_hold_words_in_text(spark):
    assert scan.custom_scan(spark.range(3).withColumn("t", F.lit("drop; --")), "t = 'drop; --' AND id > 0").count() == 2


def test_pushdown_of_keyset_scan(spark):
    df = scan.keyset_scan(scan.table(spark, "/root/testdata/sf0.001", "orders").select("o_orderkey"), ["o_orderkey"], lower=[5], upper=[9])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def fails(df):
    with pytest.raises(PySparkException):
        df.collect()


def test_conversions_that_fail(spark):
    one = lambda v: spark.createDataFrame([(v,)], "v string")
    fails(one("maybe").select(rules.to_boolean(F.col("v"))))
    fails(one("2").select(rules.integer_to_boolean(F.col("v"))))
    fails(one("0000-00-00").select(rules.guarded_date(F.col("v"))))
    fails(one("漢").select(rules.latin1_bytes(F.col("v"))))
    fails(one('{"a":1}}').select(rules.checked_json(F.col("v"))))
    fails(one(None).select(F.col("v").alias("k")).transform(lambda d: scan.point_lookup(d, d, ["k"])))
    assert one(None).select(rules.to_boolean(F.col("v")), rules.checked_json(F.col("v")), rules.latin1_bytes(F.col("v"))).collect() == [(None, None, None)]


def test_json_compact_keeps_order_and_text(spark):
    text = '{ "b" : 1.50, "a" : "x  \\" y" ,\n"c":[ ] }'
    (row,) = spark.createDataFrame([(text,)], "v string").select(rules.json_compact(F.col("v")).alias("v")).collect()
    assert row.v == '{"b":1.50,"a":"x  \\" y","c":[]}'


def test_unicode_trim_and_rule_errors(spark):
    df = spark.createDataFrame([("　\u0085 a b \t", None)], "v string, w string")
    assert apply_rules(df, [Rule("V", "TRIM"), Rule("w", "LOWER")]).collect() == [("a b", None)]
    for bad in (Rule("v", "NONE"), Rule("z", "TRIM"), Rule("v", "REPLACE_LITERAL"), Rule("v", "NULL_TO_VALUE")):
        with pytest.raises(ValueError):
            apply_rules(df, [bad])


def test_types_within_limits():
    assert types.target_type(types.normalise("decimal(70,40)"), "mysql") == "decimal(65,30)"
    assert types.target_type(types.normalise("varchar(5000)"), "oracle") == "clob"
    assert types.spark_type(types.normalise("decimal(60,4)")) == "decimal(38,4)"
    assert types.normalise("tinyint(1)").kind == "INTEGER"


def test_checksum_is_free_of_order_and_splits(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "a", "N|"])) for i in range(300)] + [(5, "twice")] * 2
    values = [F.col("a").cast("string"), F.col("b")]
    whole = checksum.checksum(spark.createDataFrame(rows, "a long, b string"), values).first()
    rng.shuffle(rows)
    halves = [checksum.checksum(spark.createDataFrame(part, "a long, b string").repartition(3), values).first() for part in (rows[:100], rows[100:])]
    total = lambda rs: checksum.checksum_value([sum(r[f"limb{i}"] for r in rs) for i in range(8)])
    assert total([whole]) == total(halves)
    assert total([whole]) != total(halves[:1])


def test_canonical_pairs(spark):
    pairs = [("1", "true", "tinyint(1)"), ("1.00", "1", "decimal"), ('{"b":2,"a":1}', '{"a":1,"b":2}', "json"), ("AB-CD", "ab-cd ", "uuid"), ("-0.0", "0", "decimal"), ("007.50", "7.5", "decimal")]
    for a, b, kind in pairs:
        x, y = spark.createDataFrame([(a,), (b,)], "v string").select(checksum.canonical(F.col("v"), kind)).collect()
        assert x == y, (a, b)


def test_publish_replaces_a_version(spark, tmp_path):
    assert spark.read.parquet(upsert.publish(spark.range(3), str(tmp_path), 1)).count() == 3
    assert spark.read.parquet(upsert.publish(spark.range(5), str(tmp_path), 1)).count() == 5


def test_cdc_refusals(spark):
    read = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    fails(cdc.debezium(read('{"before":null,"after":{"id":1},"op":"u","source":{"lsn":1}}')))
    fails(cdc.debezium(read('{"after":{"id":1},"op":"c","source":{}}')))
    fails(cdc.debezium(read('{"after":{"id":1},"op":"x","source":{"lsn":1}}')))
    fails(cdc.pair_updates(spark.createDataFrame([(1, 3, "a")], "lsn int, op int, row string"), ["lsn"]))
    streams = spark.createDataFrame([("a", 5), ("b", None)], "stream string, resolved long")
    fails(cdc.ordered_merge(spark.createDataFrame([("a", 3)], "stream string, ord long"), streams))
    one, none = spark.createDataFrame([(1, "x")], "xid long, rows string"), spark.createDataFrame([], "xid long, ddl string")
    fails(cdc.merge_ddl(one, none, ["xid"]))


def test_debezium_microseconds(spark):
    (r,) = cdc.debezium(spark.createDataFrame([('{"before":null,"after":{"id":1,"payload":{"a":1}},"source":{"schema":"public","table":"o","lsn":7,"ts_us":1720000000123456},"op":"c","ts_us":1}',)], "value string")).collect()
    assert (r.source_ts_ms, r.position_type, r.position_value, r.after["payload"]) == (1720000000123, "LSN", "7", '{"a":1}')


def test_ordered_merge_uses_the_final_minimum(spark):
    rows = spark.createDataFrame([("a", 10), ("a", 12), ("b", 10), ("b", 11)], "stream string, ord long")
    resolved = spark.createDataFrame([("a", 12), ("b", 11)], "stream string, resolved long")
    assert sorted(map(tuple, cdc.ordered_merge(rows, resolved).collect())) == [("a", 10), ("b", 10), ("b", 11)]


def test_lww_tie_keeps_the_target(spark):
    target = spark.createDataFrame([(1, 10, 0.5)], "k long, ver long, val double")
    changes = spark.createDataFrame([(1, 1, "UPDATE", 10, 9.0), (2, 1, "INSERT", 1, 2.0)], "k long, ord long, operation string, ver long, val double")
    assert sorted(map(tuple, cdc.last_write_wins(target, changes, "k", "ord", "ver", "val").collect())) == [(1, 10, 0.5, 1), (2, 1, 2.0, 0)]


def test_dependency_order_with_cycle():
    assert assess.dependency_order("abcd", [("a", "b"), ("c", "d"), ("d", "c")]) == (["b", "a"], ["c", "d"])


def test_registry_is_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 90


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) >= 3 and {r.status for r in rows} == {"SUCCESS"}


def test_json_patch_refusals():
    from tidefold.functions.jsondiff import patch

    for edit in (("REPLACE", "$.b", "1"), ("REMOVE", "$.b", None), ("INSERT", "$.a", "1"), ("MOVE", "$.a", None), ("REPLACE", "a", "1")):
        with pytest.raises(ValueError):
            patch('{"a":1}', [edit])
    assert patch('{"a":{"b c":[1]}}', [("REPLACE", '$.a."b c"[0]', "null")]) == '{"a":{"b c":[null]}}'


def test_jdbc_predicates_and_sinks():
    from tidefold.sources import jdbc, sinks

    assert jdbc.range_predicates("id", [(1, 5), (6, 9)]) == ["id >= 1 AND id <= 5", "id >= 6 AND id <= 9"]
    assert len(jdbc.bucket_predicates("postgres", ["a", "b"], 4)) == 4 and jdbc.bucket_predicates("oracle", ["a"], 4)[3].endswith(", 3) = 3")
    assert sinks.upsert_statement("postgres", "t", ["a"], ["a"]).endswith("DO NOTHING")
    assert sinks.upsert_statement("mysql", "t", ["a"], []) == "INSERT INTO `t` (`a`) VALUES (?)"
    assert sinks.delete_statement("oracle", "t", ["a", "b"]) == 'DELETE FROM "t" WHERE "a" = ? AND "b" = ?'
    with pytest.raises(ValueError):
        jdbc.quoted("mysql", "a`b")


def test_sink_is_idempotent(spark, tmp_path):
    import sqlite3

    from tidefold.sources import sinks

    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "t" ("a" INTEGER PRIMARY KEY, "b" TEXT)')
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").coalesce(1)
    for _ in range(2):
        sinks.write(df, lambda: sqlite3.connect(path), sinks.upsert_statement("postgres", "t", ["a", "b"], ["a"]))
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT a, b FROM t ORDER BY a").fetchall() == [(1, "x"), (2, "y")]


def test_drop_folder(spark, tmp_path):
    from tidefold.sources.streams import drop_folder
    from tidefold.streaming.apply import run_batches

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"before":null,"after":{"id":1},"op":"c","source":{"lsn":1}}\n')
    seen = []
    run_batches(cdc.debezium(drop_folder(spark, str(tmp_path / "in"))), lambda b, n: seen.extend(b.collect()), str(tmp_path / "c"))
    assert [r.operation for r in seen] == ["INSERT"]


def test_mapping():
    from tidefold.operators.mapping import Column, Table, TableMapping, resolve, stable_key

    a = Table("app", "a", (Column("x"), Column("y", nullable=False), Column("z", False, True)), (), (("x",), ("y", "z"), ("Y",)))
    b = Table("app", "b", primary_key=("id",))
    assert stable_key(a) == ("Y",) and stable_key(b) == ("id",)
    with pytest.raises(ValueError):
        stable_key(Table("app", "c", (Column("x"),), (), (("x",),)))
    assert [t.name for t, *_ in resolve([a, b, Table("s", "c")], [], "app")] == ["a", "b"]
    assert resolve([a, b], [TableMapping("b", target_table="bb")], "app") == [(b, "app", "bb")]
    with pytest.raises(ValueError):
        resolve([a], [TableMapping("q")], "app")


def test_rename_refusals(spark):
    from tidefold.operators.mapping import align, rename

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for bad in ({"c": "d"}, {"a": "B"}):
        with pytest.raises(ValueError):
            rename(df, bad)
    with pytest.raises(ValueError):
        align(df, {"z": "int"})


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """A start with nothing new returns the state, one with more rows goes on from it."""
    from tidefold.streaming import apply

    schema = "k long, value double, ord long, operation string"
    run = lambda: sorted(map(tuple, apply.apply_stream(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), "k long, value double", ["k"], "ord").collect()))
    spark.createDataFrame([(1, 1.0, 1, "INSERT"), (2, 2.0, 2, "INSERT")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == run() == [(1, 1.0), (2, 2.0)]
    spark.createDataFrame([(1, 1.5, 3, "UPDATE"), (2, 2.0, 4, "DELETE")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == run() == [(1, 1.5)]


def test_nothing_is_released_before_every_partition_is_seen(spark, tmp_path):
    from tidefold.streaming import apply

    schema = "part long, tso long"
    rows = lambda x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: sorted(map(tuple, apply.resolved_stream(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), schema, [0, 1]).collect()))
    rows([(0, 5), (0, 9)])
    assert run() == []
    rows([(1, 7), (1, 3)])
    assert run() == [(0, 5), (1, 3)]


def test_refusals(spark):
    from tidefold.operators import cdc

    events = [(1, "INSERT", None, {"k": "1", "v": None}), (2, "UPDATE", {"k": "1"}, {"v": "2"}), (3, "DELETE", {"k": "1"}, None), (4, "DELETE", {"v": "1"}, {"k": "1"}), (5, "DELETE", None, None), (6, "INSERT", None, None)]
    got = {r.ord: r.refusal for r in cdc.refusals(spark.createDataFrame(events, "ord int, operation string, before map<string,string>, after map<string,string>"), ["k", "v"], ["k"]).collect()}
    assert got == {1: None, 2: "incomplete after image", 3: None, 4: None, 5: "no key", 6: "incomplete after image"}
