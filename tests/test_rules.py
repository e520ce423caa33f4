import pytest
from pyspark.sql import functions as F

from plumbrule import KeySpec, RuleSpec
from plumbrule.functions import repeats, text
from plumbrule.operators.stage import revalidate
from plumbrule.operators.validate import validate
from plumbrule.sources.tables import with_row_index
from plumbrule.spec import SpecError, check_rules, declare_key, disable, effective_key

ID = KeySpec(("id",))


def failed(df, rule, key=ID):
    return sorted(r["record_ref"] for r in validate(df, [rule], key).failures().collect())


def test_completeness(spark):
    df = spark.createDataFrame([(0, "a@x"), (1, None), (2, "b@x")], "id int, email string")
    assert failed(df, RuleSpec("r", "COMPLETENESS", ("email",))) == ["1"]
    assert failed(df, RuleSpec("r", "COMPLETENESS", ("email",), {"max_null_percentage": 40})) == []
    assert failed(df, RuleSpec("r", "COMPLETENESS", ("email",), {"max_null_percentage": 20})) == ["1"]


def test_uniqueness_flags_all_members_but_not_nulls(spark):
    df = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A"), (3, None), (4, None)], "id int, v string")
    assert failed(df, RuleSpec("r", "UNIQUENESS", ("v",))) == ["0", "2"]
    assert failed(df, RuleSpec("r", "UNIQUENESS", ("v",), {"max_duplicate_percentage": 20})) == []


def test_uniqueness_with_a_hot_value(spark):
    df = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    run = validate(df, [RuleSpec("r", "UNIQUENESS", ("v",))], ID)
    assert run.failures().count() == 10000
    assert run.results().count() == 30000


def test_duplicate_counts_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, None), (2, None)], "a int, b string")
    indexed = with_row_index(df, ["a", "b"])
    run = validate(indexed, [RuleSpec("r", "DUPLICATE")], KeySpec(), row_index="row_index")
    assert sorted(r["record_ref"] for r in run.failures().collect()) == ["ROWIDX:0", "ROWIDX:1", "ROWIDX:3", "ROWIDX:4"]


def test_range_skips_what_is_not_a_number(spark):
    df = spark.createDataFrame([(0, "5"), (1, "200"), (2, None), (3, "not-a-number"), (4, "NaN")], "id int, v string")
    assert failed(df, RuleSpec("r", "RANGE", ("v",), {"min": 0, "max": 120})) == ["1"]
    dated = spark.sql("SELECT 0 AS id, DATE'2024-01-01' AS v")
    assert failed(dated, RuleSpec("r", "RANGE", ("v",), {"max": 1})) == []


def test_pattern_is_anchored_at_the_start_only(spark):
    df = spark.createDataFrame([(0, "AB-123"), (1, "bad"), (2, "AB-123tail"), (3, "xAB-123")], "id int, v string")
    assert failed(df, RuleSpec("r", "PATTERN", ("v",), {"regex": r"^[A-Z]{2}-\d{3}$"})) == ["1", "2", "3"]
    assert failed(df, RuleSpec("r", "PATTERN", ("v",), {"regex": r"[A-Z]{2}-\d{3}"})) == ["1", "3"]
    assert failed(df, RuleSpec("r", "PATTERN", ("v",), {})) == []


def test_cross_column(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 1, 2), (2, None, None), (3, 1, None)], "id int, a int, b int")
    assert failed(df, RuleSpec("r", "CROSS_COLUMN", ("a", "b"))) == ["1", "3"]
    assert failed(df, RuleSpec("r", "CROSS_COLUMN", ("a", "b"), {"check": "other"})) == []


def test_score_statuses_and_metrics(spark):
    df = spark.createDataFrame(
        [(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0), (4, "d", 999.0)], "id int, val string, score double")
    rules = [RuleSpec("range", "RANGE", ("score",), {"max": 100}, "HIGH"),
             RuleSpec("letters", "PATTERN", ("val",), {"regex": "[abd]"}, "LOW"), RuleSpec("new", "SOMETHING", ("val",))]
    run = validate(df, rules, ID)
    assert {r["record_ref"]: r["status"] for r in run.results().collect()} == {
        "1": "PASSED", "2": "PASSED", "3": "WARNING", "4": "FAILED"}
    summary = run.summary().first()
    assert summary["quality_score"] == 50.0 and summary["rules_evaluated_count"] == 3
    metrics = {(m["metric_name"], m["metric_group"]): m["metric_value"] for m in run.metrics().collect()}
    assert metrics[("unsupported_rule_type_skipped", "SOMETHING")] == 1
    assert metrics[("rule_evaluated", "range")] == 1 and metrics[("total_rows", None)] == 4
    assert {m["metric_name"]: m["metric_value"] for m in run.metrics(cap=2).collect()}["failure_storage_truncated"] == 1


def test_stored_failures_are_capped_and_counts_are_not(spark):
    df = spark.createDataFrame([(i, None if i else "x", 1.0) for i in range(5)], "id int, val string, score double")
    run = validate(df, [RuleSpec("r", "COMPLETENESS", ("val",))], ID)
    assert run.stored_failures(cap=2).count() == 2
    assert run.summary().first()["failure_count"] == 4


def test_empty_table_has_no_score(spark):
    run = validate(spark.createDataFrame([], "id int, v string"), [RuleSpec("r", "COMPLETENESS", ("v",))], ID)
    assert run.summary().first()["quality_score"] is None
    assert {m["metric_name"] for m in run.metrics().collect()} == {"total_rows", "failure_storage_truncated"}


def test_stored_run_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    run = validate(df, [RuleSpec("r", "COMPLETENESS", ("v",))], ID).stored(str(tmp_path / "run"))
    assert [r["record_ref"] for r in run.failures().collect()] == ["2"]


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 250).alias("b"))
    rules = [RuleSpec("u", "UNIQUENESS", ("b",)), RuleSpec("r", "RANGE", ("a",), {"max": 4}, "HIGH")]
    seen = [sorted(map(tuple, validate(df.repartition(n), rules, ID).results().collect())) for n in (1, 5, 13)]
    assert seen[0] == seen[1] == seen[2]


def test_rule_shapes(spark):
    schema = spark.createDataFrame([], "a int, b int").schema
    for bad in (RuleSpec("r", "RANGE"), RuleSpec("r", "DUPLICATE", ("a",)), RuleSpec("r", "CROSS_COLUMN", ("a",)),
                RuleSpec("r", "RANGE", ("z",)), RuleSpec("r", "COMPLETENESS")):
        with pytest.raises(SpecError):
            check_rules(schema, [bad])
    one = RuleSpec("r1", "CROSS_COLUMN", ("a", "b"), rule_id="x")
    with pytest.raises(SpecError):
        check_rules(schema, [one, RuleSpec("r2", "CROSS_COLUMN", ("b", "a"), rule_id="x")])
    assert check_rules(schema, [disable(one)]) == []


def test_keys(spark):
    schema = spark.createDataFrame([], "a int, b int").schema
    assert declare_key(schema, [(2, "a"), (1, "b")]).columns == ("b", "a")
    assert declare_key(schema, [(1, "a")]).strategy == "SINGLE_COLUMN"
    for bad in ([(1, "a"), (1, "b")], [(1, "a"), (2, "a")], [(1, "z")], []):
        with pytest.raises(SpecError):
            declare_key(schema, bad)
    assert effective_key(KeySpec(("a", "b")), ["b"]).columns == ("b",)
    assert effective_key(KeySpec(("a",)), []).strategy == "ROW_INDEX_FALLBACK"


def test_record_refs(spark):
    df = spark.createDataFrame([(5, "1002"), (5, None), (5, "")], "a int, b string")
    key = KeySpec(("a", "b"))
    refs = [r[0] for r in df.select(text.record_ref(df.schema, key)).collect()]
    assert refs == ["5\x1f1002", "5\x1f\x00NULL\x00", "5\x1f"]
    made = df.select(text.record_ref(df.schema, key).alias("ref"))
    parts = [tuple(r) for r in made.select(*text.key_parts(F.col("ref"), key)).collect()]
    assert parts == [("5", "1002"), ("5", None), ("5", "")]


def test_digests_cannot_be_confused_by_separators(spark):
    df = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc")], "a string, b string")
    assert df.select(text.row_digest(df.schema).alias("d")).distinct().count() == 2


def test_revalidation(spark):
    df = spark.createDataFrame([(1, None), (2, "7")], "id int, v string")
    rules = [RuleSpec("c", "COMPLETENESS", ("v",), {"max_null_percentage": 90}), RuleSpec("u", "UNIQUENESS", ("v",)),
             RuleSpec("r", "RANGE", ("v",), {"max": 5})]
    found = {(r["record_ref"], r["assignment_id"]): r["status"] for r in revalidate(df, ID, rules).collect()}
    assert found[("1", "c")] == "REVALIDATED_FAIL" and found[("2", "c")] == "REVALIDATED_PASS"
    assert found[("2", "r")] == "REVALIDATED_FAIL" and found[("1", "r")] == "REVALIDATED_PASS"
    assert found[("1", "u")] == "REQUIRES_DATASET_REVALIDATION"


@pytest.mark.parametrize("limit", [0, 3, 250_000])
def test_group_rules_share_one_count(spark, monkeypatch, limit):
    """Few repeated keys are broadcast, many are found by one exchange: the same failures."""
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(repeats, "HOT_KEYS", 2)
    rows = [(i, i % 7 if i % 5 else None, f"t{i // 3}", float(i % 2)) for i in range(60)] + [(59, 3, "t19", 1.0)] * 40 + [(900, None, None, None)] * 2
    df = spark.createDataFrame(rows, "id int, a int, b string, c double").repartition(4)
    rules = [RuleSpec("a", "UNIQUENESS", ("a",)), RuleSpec("b", "UNIQUENESS", ("b",)), RuleSpec("row", "DUPLICATE"),
             RuleSpec("id", "UNIQUENESS", ("id",), {"max_duplicate_percentage": 60}), RuleSpec("id2", "UNIQUENESS", ("id",), {"max_duplicate_percentage": 1})]
    run = validate(df, rules, KeySpec(("id",)))
    got = [(r["record_ref"], r["assignment_id"], r["failed_value"]) for r in run.failures().collect()]
    want = []
    for r in rows:
        for name, key, shown in (("a", r[1], r[1]), ("b", r[2], r[2]), ("row", r, None), ("id2", r[0], r[0])):
            at = {"a": 1, "b": 2, "id2": 0}.get(name)
            same = sum((x if at is None else x[at]) == key for x in rows)
            if key is not None and same > 1:
                want.append((str(r[0]), name, None if shown is None else str(shown)))
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("words", [1, 1 << 19])
def test_one_rule_with_many_repeated_keys(spark, monkeypatch, words):
    """rows went through five shuffles; now those that hold a repeated key go through one."""
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 3)
    monkeypatch.setattr(repeats, "HOT_KEYS", 2)
    monkeypatch.setattr(repeats, "FILTER_WORDS", words, raising=False)
    rows = [(i, None if i % 10 == 0 else i // 2 if i % 3 else i + 1000) for i in range(200)] + [(500 + i, 7777) for i in range(50)]
    df = spark.createDataFrame(rows + rows[:30], "id int, a int").repartition(4)
    for rule, at in ((RuleSpec("r", "UNIQUENESS", ("a",)), 1), (RuleSpec("r", "DUPLICATE"), None)):
        run = validate(df, [rule], KeySpec(("id",)))
        keys = [x if at is None else x[at] for x in rows + rows[:30]]
        want = sorted(str(x[0]) for x, k in zip(rows + rows[:30], keys, strict=True) if k is not None and keys.count(k) > 1)
        assert sorted(r["record_ref"] for r in run.failures().collect()) == want
        assert run.evaluated.count() == 280 and "_row" not in run.evaluated._jdf.queryExecution().optimizedPlan().toString().replace("_row_", "")


@pytest.mark.parametrize("single", [0, 1, 40])
def test_rows_stay_where_nearly_all_keys_repeat(spark, monkeypatch, single):
    """all rows with a repeated key were shuffled; now only those whose key looks like a single one."""
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 3)
    df = spark.range(0, 20_001, 1, 4).selectExpr(
        "id", f"IF(id < {single}, -id - 1.5D, IF(id % 100 = 99, NULL, CAST(id DIV 3 AS DOUBLE) / 8)) AS a")
    counts = {r["a"]: r["count"] for r in df.groupBy("a").count().collect()}
    want = {r["id"] for r in df.collect() if r["a"] is not None and counts[r["a"]] > 1}
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = validate(df, [RuleSpec("r", "UNIQUENESS", ("a",))], KeySpec(("id",)))
        plan = run.evaluated._jdf.queryExecution().optimizedPlan().toString()
        store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        before = store.stageList(None, False, False, none, None).size()
        got = [int(r["record_ref"]) for r in run.failures().collect()]
        stages = store.stageList(None, False, False, none, None)
        moved = sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size() - before))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted(got) == sorted(want)
    assert moved == 0 and "Join" not in plan if single == 0 else moved <= 2_000
    assert run.evaluated.count() == 20_001


def test_one_hash_is_enough_for_short_values(spark):
    """keys of at most 8 bytes travel as one hash; equal and unlike values stay so."""
    rows = [(float("nan"),), (float("nan"),), (0.0,), (-0.0,), (1e-300,), (-1e-300,), (float("inf"),), (float("-inf"),), (None,), (None,)]
    df = spark.createDataFrame(rows, "a double").withColumn("id", F.monotonically_increasing_id())
    run = validate(df, [RuleSpec("r", "UNIQUENESS", ("a",))], KeySpec(("id",)))
    assert sorted(r["failed_value"] for r in run.failures().collect()) == sorted(
        r["v"] for r in df.where("a = 0 OR isnan(a)").select(text.canonical_of(df.schema, "a").alias("v")).collect())
    for kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"):
        values = spark.range(-100, 100).selectExpr(
            f"CAST({'timestamp_seconds(id)' if kind == 'timestamp' else 'date_add(current_date(), INT(id))' if kind == 'date' else 'id'} AS {kind}) AS a")
        counted = repeats.key_counts(values, {0: ("a",)}).agg(F.count("k1"), F.max("k2"), F.min("k2"), F.sum("n")).first()
        assert tuple(counted) == (values.distinct().count(), 0, 0, 200)


def test_hashes_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 1), (None, None), (1, 1)], "a int, b int")
    run = validate(df.withColumn("id", F.monotonically_increasing_id()), [RuleSpec("r", "DUPLICATE")], KeySpec(("id",)))
    assert run.failures().count() == 0
    assert {r["n"] for r in repeats.repeated_keys(df, {0: ("a", "b")}).collect()} == {2}
    assert repeats.repeated_keys(df, {0: ("a", "b"), 1: ("b",)}).count() == 2


def test_a_sample_is_refused_where_rows_are_compared(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(SpecError):
        validate(df, [RuleSpec("r", "UNIQUENESS", ("id",))], KeySpec(("id",)), is_full_scan=False)
    assert validate(df, [RuleSpec("r", "RANGE", ("id",), {"min": 5})], KeySpec(("id",)), is_full_scan=False).failures().count() == 2


def test_references_cannot_be_confused(spark):
    """Separators, escapes and the word for NULL inside key parts stay what they are, there and back."""
    odd = ["a\x1fb", "c", "a", "b\x1fc", "\x00NULL\x00", None, "\x1b", "\x1bu", "\x1be", "e", "\x1f", "\x00", "", "\x1b\x1f0"]
    df = spark.createDataFrame([(x, y) for x in odd for y in odd], "x string, y string")
    key = KeySpec(("x", "y"))
    refs = df.select("x", "y", text.record_ref(df.schema, key).alias("ref"))
    assert refs.select("ref").distinct().count() == len(odd) ** 2
    back = [p.alias(f"_{n}") for p, n in zip(text.key_parts(F.col("ref"), key), key.columns)]
    assert refs.select("x", "y", *back).where("x <=> _x AND y <=> _y").count() == len(odd) ** 2
    one = KeySpec(("x",))
    single = df.select("x", text.record_ref(df.schema, one).alias("ref")).distinct()
    assert single.count() == len(odd) and single.select("x", text.key_parts(F.col("ref"), one)[0].alias("_x")).where("x <=> _x").count() == len(odd)


def test_rows_by_keys_with_null_parts(spark):
    from plumbrule.functions import grouping
    from plumbrule.sources.tables import fetch_by_keys

    df = spark.createDataFrame([(i, i % 3 or None, "k" if i % 2 else None) for i in range(60)], "id int, a int, b string")
    keys = spark.createDataFrame([("1", "k"), (None, None), ("2", "no"), ("x", "k")], "a string, b string")
    want = {i for i in range(60) if (i % 3 == 1 and i % 2) or (i % 3 == 0 and not i % 2)}
    for limit in (0, 100_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(grouping, "SMALL_BYTES", limit)
            assert {r["id"] for r in fetch_by_keys(df, keys, KeySpec(("a", "b"))).collect()} == want
            assert {r["id"] for r in fetch_by_keys(df, keys, KeySpec(("a", "b")), null_safe=False).collect()} == {
                i for i in range(60) if i % 3 == 1 and i % 2}
