import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbrule import KeySpec, RuleSpec
from plumbrule.functions import ordered
from plumbrule.functions.grouping import HOT_KEYS, join_small, keep_matching, lookup
from plumbrule.functions.ordered import latest_as_of, number_in_group
from plumbrule.operators import lineage, reports
from plumbrule.sources import catalog, sinks, tables
from plumbrule.spec import SpecError
from plumbrule.streaming.local_rules import validate_stream


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_sampling(spark):
    df = spark.range(1000)
    full = tables.sample_rows(df, 2000, 1000, ["id"])
    assert full.is_full_scan and full.rows.count() == 1000
    some = tables.sample_rows(df, 300, 1000, ["id"])
    assert not some.is_full_scan and 240 < some.rows.count() < 360
    again = tables.sample_rows(df.repartition(7), 300, 1000, ["id"]).rows
    assert {r["id"] for r in some.rows.collect()} == {r["id"] for r in again.collect()}


def test_sample_size():
    assert tables.resolve_sample_size(None, None) == 30000
    assert tables.resolve_sample_size(7, None) == 7
    assert tables.resolve_sample_size(None, 40, full_scan=True) == 40
    assert tables.resolve_sample_size(10**9, None) == 10**9
    assert tables.resolve_sample_size(None, 10**12, full_scan=True) == 10**12
    for bad in ((0, None, False), (None, None, True)):
        with pytest.raises(SpecError):
            tables.resolve_sample_size(*bad)


def test_preview(spark):
    df = spark.createDataFrame([(i, "x" * 300) for i in range(200)], "i int, s string")
    p = tables.preview(df, 500)
    assert (p.capped, p.returned_limit, p.rows.count(), len(p.rows.first()["s"])) == (True, 100, 100, 100)
    assert tables.preview(df).rows.count() == 20


def test_keyed_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    keys = spark.createDataFrame([("1",), (None,), ("nope",)], "k string")
    assert sorted(r["v"] for r in tables.fetch_by_keys(df, keys, KeySpec(("k",))).collect()) == ["a", "c"]
    assert [r["v"] for r in tables.fetch_by_keys(df, keys.where("k = '1'"), KeySpec(("k",)), null_safe=False).collect()] == ["a"]


def test_row_index_is_a_dense_order(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id"))
    rows = tables.with_row_index(df, ["g", "id"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(5000))
    assert [(r["g"], r["id"]) for r in rows] == sorted((i % 3, i) for i in range(5000))


def test_jdbc_options():
    source = tables.JdbcSource("MYSQL", "db", "shop")
    assert source.jdbc_options()["url"] == "jdbc:mysql://db:3306/shop"
    assert tables.quoted_name("SQL_SERVER", "a]b", "t") == "[a]]b].[t]"
    with pytest.raises(SpecError):
        tables.JdbcSource("DB2", "h", "d")
    for code in tables.VENDORS:
        asked = catalog.catalog_queries(code, "s'x", "t")
        assert set(asked) == {"schemas", "tables", "columns", "primary_keys", "foreign_keys", "row_estimate"}
        assert "referenced_schema" in asked["foreign_keys"]
        assert "s''x" in asked["columns"]


def test_catalog(spark):
    good = spark.createDataFrame([], "a int, b decimal(5,2)")

    def broken():
        raise OSError("gone")

    found, errors = catalog.column_metadata(spark, {"good": good, "bad": broken})
    assert [(r["column_name"], r["normalized_data_type"]) for r in found.orderBy("ordinal_position").collect()] == [
        ("a", "INTEGER"), ("b", "DECIMAL")]
    assert list(errors) == ["bad"]
    good.createOrReplaceTempView("good_view")
    assert "default" in catalog.list_schemas(spark)
    assert ("good_view", "VIEW") in [(r["table_name"], r["object_type"]) for r in catalog.list_tables(spark, "default").collect()]


def test_snapshot_diff(spark):
    key = "schema_name string, table_name string, column_name string, normalized_data_type string"
    old = spark.createDataFrame([("s", "t", c, "STRING", a, "then") for c, a in (("keep", True), ("gone", True), ("back", False))]
                                + [("s", "down", "x", "STRING", True, "then")], key + ", is_active boolean, discovered_at string")
    new = spark.createDataFrame([("s", "t", c, "TEXT") for c in ("keep", "back", "fresh")], key)
    out = {r["column_name"]: (r["is_active"], r["change"]) for r in catalog.snapshot_diff(old, new, F.lit("now"), ["down"]).collect()}
    assert out == {"keep": (True, "SEEN"), "gone": (False, "DEACTIVATED"), "back": (True, "REACTIVATED"),
                   "fresh": (True, "ADDED"), "x": (True, "KEPT")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "b int, a string")
    path = str(tmp_path / "out")
    assert sinks.export_jsonl(df, path) == 2
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ['{"a":"x","b":2}', '{"a":null,"b":1}']
    with pytest.raises(sinks.SinkError):
        sinks.export_jsonl(df, path)
    assert sinks.export_jsonl(df.limit(1), path, overwrite=True) == 1
    for bad in ("", " ", "/abs", "../x", "a/../../x", "s3://x"):
        with pytest.raises(sinks.SinkError):
            sinks.resolve_target(bad, "/base")
    assert sinks.resolve_target("a/b.json", "/base") == "/base/a/b.json"


def test_names():
    run = "12345678-90ab-cdef-1234-567890abcdef"
    assert sinks.staging_table_name("Sales Orders!", run) == "sales_orders__1234567890ab"
    assert sinks.staging_table_name("2024", run) == "t_2024__1234567890ab"
    assert sinks.staging_table_name("§", run) == "dataset__1234567890ab"
    assert len(sinks.staging_table_name("x" * 200, run)) <= 63


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    for action in ("validation.started", "validation.completed"):
        sinks.append_log(sinks.audit_events(spark, "bob", action, "DATASET", "1", metadata={"rows": "3"}), path)
    assert spark.read.parquet(path).count() == 2


def test_group_helpers_beyond_the_hot_set(spark):
    n = HOT_KEYS + 500
    df = spark.range(n * 2).select("id", (F.col("id") % n).alias("k")).unionByName(
        spark.range(3000).select((F.col("id") + 10**6).alias("id"), F.lit(5).cast("bigint").alias("k"))).unionByName(
        spark.range(50).select((F.col("id") + 10**7).alias("id"), F.lit(None).cast("bigint").alias("k")))
    right = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    joined = lookup(df, right, "k", "id")
    assert joined.count() == n * 2 + 3050 and joined.where("v = k * 10").count() == n * 2 + 3000
    for limit in (10, 10**6):
        small = join_small(df.withColumnRenamed("k", "key"), right.withColumnRenamed("k", "key"), ["key"], "left", limit)
        assert small.count() == n * 2 + 3050 and small.where("v IS NULL").count() == 50
        assert join_small(df, right.where("k < 7"), ["k"], "inner", 3 if limit == 10 else limit).count() == 3014
        kept = keep_matching(df, right.where("k < 7"), "k", True, 3 if limit == 10 else limit)
        gone = keep_matching(df, right.where("k < 7"), "k", False, 3 if limit == 10 else limit)
        assert kept.count() == 3014 and gone.count() == n * 2 + 3050 - 3014


def test_numbering(spark):
    rows = [("a", day(i % 4, i % 3), f"t{i:02d}") for i in range(30)] + [("b", day(1), "t")]
    df = spark.createDataFrame(rows, "g string, at timestamp_ntz, tie string")
    got = {(r["g"], r["tie"]): (r["n"], r["all"]) for r in number_in_group(df, "g", "at", "tie", "n", "all").collect()}
    want = {("a", t): (i + 1, 30) for i, (_, t) in enumerate(sorted((a, t) for g, a, t in rows if g == "a"))}
    assert got == {**want, ("b", "t"): (1, 1)}


def test_as_of(spark):
    import random

    rng = random.Random(2)
    left = [(f"s{i}", rng.choice("abc"), day(rng.randint(0, 9), rng.randint(0, 23))) for i in range(60)] + [("n", None, day(1))]
    right = [(f"q{i:02d}", rng.choice("abc"), "APPROVED" if i % 3 else "REJECTED", day(rng.randint(0, 9), rng.randint(0, 23)))
             for i in range(40)]
    staged = spark.createDataFrame(left, "staging_run_id string, review_run_id string, created_at timestamp_ntz")
    asked = spark.createDataFrame(right, "request_id string, review_run_id string, status string, created_at timestamp_ntz")
    got = {r["staging_run_id"]: r["request_id"] for r in lineage.approvals_of_staging(staged, asked).collect()}
    for s, review, at in left:
        fits = [(t, q) for q, r, status, t in right if r == review and status == "APPROVED" and t <= at]
        assert got[s] == (max(fits)[1] if fits else None)


def test_edges(spark):
    df = spark.createDataFrame([("d1", "r1"), ("d1", "r2")], "dataset_id string, run_id string")
    made = lineage.edges(df, "DATASET", "dataset_id", "RUN", "run_id", "VALIDATED_BY")
    once = lineage.record_edges(made.limit(0), made)
    assert lineage.record_edges(once, made).count() == 2 and lineage.new_edges(once, made).count() == 0
    assert lineage.edges_of(once, "DATASET", "d1", "down").count() == 2
    assert lineage.edges_of(once, "DATASET", "d1", "up").count() == 0
    assert lineage.nodes_of(lineage.edges_of(once, "RUN", "r1", "up")).count() == 2
    with pytest.raises(lineage.UnknownEntity):
        lineage.edges_of(once, "RUN", "r9")


RUNS = "run_id string, dataset_id string, created_at timestamp_ntz, status string, quality_score double"


def test_reports(spark):
    runs = spark.createDataFrame([("r1", "d1", day(1), "COMPLETED", 80.0), ("r2", "d1", day(3), "COMPLETED", 90.0),
                                  ("r3", "d1", day(4), "COMPLETED", None), ("r4", "d2", day(2), "FAILED", None)], RUNS)
    start, end = F.lit(day(1)), F.lit(day(3))
    assert [r["run_id"] for r in reports.quality_trend(runs, start, end).collect()] == ["r1", "r2"]
    assert [(r["dataset_id"], r["latest_run_id"]) for r in reports.latest_scores(runs).collect()] == [("d1", "r2")]
    assert [r["run_id"] for r in reports.latest_completed_runs(runs).collect()] == ["r3"]
    with pytest.raises(ValueError):
        reports.check_range(day(2), day(1))
    empty = spark.createDataFrame([], "request_id string, status string, requested_at timestamp_ntz, decided_at timestamp_ntz")
    metrics = reports.approval_metrics(empty, start, end).first()
    assert (metrics["total_requests"], metrics["approval_rate"], metrics["avg_decision_latency_seconds"]) == (0, None, None)
    failures = spark.createDataFrame([("r1", "a1", "HIGH")] * 3 + [("r1", "a2", "LOW")], "run_id string, assignment_id string, severity string")
    rules = spark.createDataFrame([("a1", "x", "X", "RANGE"), ("a2", "x", "X", "RANGE")], "assignment_id string, rule_id string, rule_name string, rule_type string")
    found = reports.rule_effectiveness(failures, runs, rules, start, end).first()
    assert (found["failure_count"], found["severity_breakdown"], found["failure_rate"]) == (4, {"HIGH": 3, "LOW": 1}, 1.0)
    assert reports.rule_effectiveness(failures, runs, rules, F.lit(day(7)), F.lit(day(8))).count() == 0


@pytest.mark.parametrize("limit", [0, 1, 250_000])
def test_edges_are_distinct_however_many_repeat(spark, monkeypatch, limit):
    """F8: all edges were shuffled with their texts to find the few that repeat, and corrections were joined three times."""
    monkeypatch.setattr(lineage, "BROADCAST_KEYS", limit, raising=False)
    rows = [("r1", "i1"), ("r1", "i1"), ("r1", "i2"), ("r2", "i2"), (None, "i3"), (None, "i3"), ("r4", "i4"), ("r4", "i4")]
    issues = spark.createDataFrame(rows, "review_run_id string, issue_id string")
    got = lineage.backfill({"issues": issues}, repeating=("issues",)).select("parent_id", "child_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, set(rows)))
    fixes = spark.createDataFrame([("i1", "x", "EDITED", day(1)), ("i4", "y", "ACCEPTED", day(9))],
                                  "issue_id string, final_value string, status string, decided_at timestamp_ntz")
    asked = spark.createDataFrame([("q1", "r1", day(2)), ("q2", "r1", day(3))], "request_id string, review_run_id string, requested_at timestamp_ntz")
    pairs = lineage.corrections_of_requests(fixes, issues, asked)
    assert set(map(tuple, pairs.collect())) == {("i1", "q1")}
    assert "Join Inner, (issue_id" not in pairs._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("small", [100, 0])
def test_a_trace_with_many_prompts(spark, monkeypatch, small):
    """prompts beyond a broadcast went through a join whose helper column the caller had as well."""
    monkeypatch.setattr(reports, "join_small", lambda *a, **kw: join_small(*a, **kw, max_rows=small))
    made = spark.createDataFrame([("s1", "AI", 1), ("s2", "AI", 2), ("s3", "AI", 9), ("s4", "RULE_BASED", None)],
                                 "suggestion_id string, source string, ai_suggestion_id int")
    calls = spark.createDataFrame([(1, "p", "m", "v1"), (2, "p", "m", None)], "ai_suggestion_id int, provider string, model string, prompt_version_id string")
    prompts = spark.createDataFrame([("v1", "key", 3)], "prompt_version_id string, prompt_key string, version_number int")
    usage = spark.createDataFrame([(1, 5, 6), (1, None, None)], "ai_suggestion_id int, input_tokens int, output_tokens int")
    found = reports.suggestion_trace(made, calls, prompts, usage).orderBy("suggestion_id").select(
        "linkage_status", "prompt_key", "calls", "total_tokens")
    assert list(map(tuple, found.collect())) == [
        ("OK", "key", 2, 11), ("OK", None, 0, None), ("BROKEN_LINKAGE", None, 0, None), ("NO_AI_CALL", None, 0, None)]


def test_listings(spark):
    data = spark.createDataFrame([("1", "Orders_A", "s", True), ("2", "ordersXa", "s", True), ("3", "items", "s", False)],
                                 "dataset_id string, dataset_name string, schema_id string, is_active boolean")
    assert [r["dataset_id"] for r in reports.list_datasets(data, search="orders_").collect()] == ["1"]
    gone = spark.createDataFrame([(1, True, None), (2, False, day(5)), (3, False, day(1)), (4, False, None)],
                                 "id int, is_active boolean, deactivated_at timestamp_ntz")
    assert [r["id"] for r in reports.visible(gone, F.lit(day(3))).orderBy("id").collect()] == [1, 2]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 5.0), (2, 500.0)], "id int, v double").write.parquet(src)
    stream = spark.readStream.schema("id int, v double").parquet(src)
    run = validate_stream(stream, [RuleSpec("r", "RANGE", ("v",), {"max": 100}, "HIGH")], KeySpec(("id",)))
    query = run.results().writeStream.format("memory").queryName("checked").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r["record_ref"]: r["status"] for r in spark.table("checked").collect()} == {"1": "PASSED", "2": "FAILED"}
    with pytest.raises(SpecError):
        validate_stream(stream, [RuleSpec("u", "UNIQUENESS", ("v",))], KeySpec(("id",)))


@pytest.mark.parametrize("split", [5, 100_000])
def test_order_within_one_day_of_one_key(spark, monkeypatch, split):
    """Almost all rows belong to one key and one day, and many to one instant; ranges do not change the result."""
    import random
    from datetime import datetime, timedelta

    monkeypatch.setattr(ordered, "SPLIT_ROWS", split)
    monkeypatch.setattr(ordered, "HOT_KEYS", 2)
    rng, day = random.Random(9), datetime(2024, 5, 1)
    rows = [(i, rng.choice(["a"] * 9 + ["b", "c", None]), day + timedelta(microseconds=rng.choice([0, rng.randrange(86_400_000_000)])))
            for i in range(700)]
    df = spark.createDataFrame(rows, "id int, k string, at timestamp_ntz").repartition(5)
    got = {r["id"]: (r["n"], r["total"]) for r in number_in_group(df, "k", "at", "id", "n", "total").collect()}
    for key in ("a", "b", "c", None):
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in mine] == [(i + 1, len(mine)) for i in range(len(mine))]
    asked = [(i, rng.choice(["a", "a", "b", "x", None]), rng.choice([None, rows[i][2], day + timedelta(seconds=rng.randrange(-9, 86_409))]))
             for i in range(300)]
    left = spark.createDataFrame(asked, "q int, k string, t timestamp_ntz").repartition(4)
    found = {r["q"]: r["matched_id"] for r in latest_as_of(left, df, "k", "t", "at", "id").collect()}
    for q, key, t in asked:
        before = [(r[2], r[0]) for r in rows if key is not None and t is not None and r[1] == key and r[2] <= t]
        assert found[q] == (max(before)[1] if before else None)
    assert len(found) == len(asked)


def test_key_ranges_of_a_source(spark):
    """Ranges follow where the keys lie; every row, with or without a key, is read once."""
    from plumbrule.sources.database import Catalog, key_ranges, normalized_source_type, scan_by_ranges

    source = tables.JdbcSource("DERBY", "", "memory:ranges")
    with Catalog(spark, tables.JdbcSource("DERBY", "", "memory:ranges;create=true")) as catalog:
        made = catalog._connection.createStatement()
        made.execute('CREATE TABLE APP."odd ""name" (K BIGINT, V VARCHAR(20), BIG LONG VARCHAR)')
        made.close()
    keys = [*range(200), *[10**12 + i for i in range(200)], *[7] * 150, *[None] * 5]
    url, options = source.jdbc_options()["url"], {"driver": source.jdbc_options()["driver"]}
    rows = spark.createDataFrame([(k, f"v{i}", "x") for i, k in enumerate(keys)], "K long, V string, BIG string")
    rows.coalesce(1).write.jdbc(url, 'APP."odd ""name"', mode="append", properties=options)
    cut = key_ranges(spark, source, "APP", 'odd "name', "K", 5)
    got = scan_by_ranges(spark, source, "APP", 'odd "name', "K", 5)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == len(keys) and got.select("V").distinct().count() == len(keys)
    # One key holds 151 rows; no range holds more than it and a share of the rest.
    assert len(cut) >= 5 and max(sizes) <= 151 + len(keys) // 5
    assert got.schema["BIG"].metadata["normalized_type"] == "TEXT" and got.where("K > 500").count() == 200
    assert key_ranges(spark, source, "APP", 'odd "name', "K", 1)[-1] == '"K" IS NULL'
    assert [normalized_source_type(12, n) for n in ("VARCHAR", "text", "CLOB(10)")] == ["STRING", "TEXT", "TEXT"]
    with Catalog(spark, source) as catalog:
        assert catalog.primary_key("APP", 'odd "name') == [] and ("APP", 'odd "name', "TABLE") in catalog.tables("APP")
    with pytest.raises(SpecError):
        scan_by_ranges(spark, source, "APP", 'odd "name', "K", 0)


def test_a_run_is_committed_once(spark, tmp_path):
    """Nothing of a failing write is left, a second write changes nothing, and readers see committed runs only."""
    base = str(tmp_path / "t")
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    held = sinks.RunTable(spark, base)
    assert held.write(rows, "a/1") == sinks.Commit(10, True)
    assert held.write(rows.limit(2), "a/1") == sinks.Commit(10, False)
    broken = rows.withColumn("v", F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="no"):
        held.write(broken, "b")
    assert held.write(rows.limit(0), "empty") == sinks.Commit(0, True)
    assert held.write(rows.limit(3), "b") == sinks.Commit(3, True)
    got = held.read(rows.schema)
    assert {r["run_id"]: r["count"] for r in got.groupBy("run_id").count().collect()} == {"a/1": 10, "b": 3}
    assert [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("_pending")] == []
    with pytest.raises(sinks.SinkError):
        held.write(rows, "")
    path, first = sinks.write_staging_table(spark.createDataFrame([(1, 1.5)], "a int, b float"), base, "D", "r")
    assert spark.read.parquet(path).dtypes == [("a", "bigint"), ("b", "double")] and first.is_new
    lines = str(tmp_path / "lines")
    assert sinks.export_jsonl(rows, lines) == 10
    with pytest.raises(sinks.SinkError):
        sinks.export_jsonl(rows, lines)
    with pytest.raises(Exception, match="no"):
        sinks.export_jsonl(broken, lines, overwrite=True)
    assert spark.read.json(lines).count() == 10 and sinks.export_jsonl(rows.limit(4), lines, overwrite=True) == 4
