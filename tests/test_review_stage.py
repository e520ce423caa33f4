import datetime as dt
import json

import pytest
from pyspark.sql import functions as F, types as T

from plumbrule import KeySpec, RuleSpec
from plumbrule.operators import decide, generate, stage
from plumbrule.operators.profile import profile
from plumbrule.operators.validate import validate
from plumbrule.plans.review import assignment_table, gather_evidence, open_review

ID = KeySpec(("id",))


def now():
    return F.lit("2024-01-01").cast("timestamp_ntz")


def at(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)


def run_table(spark, status="COMPLETED"):
    return spark.createDataFrame([("run", status)], "run_id string, status string")


def mixed(spark):
    return spark.createDataFrame(
        [(1, "A", "AB-123", 10.0), (2, "A", "AB-124", 20.0), (3, None, "  AB-125  ", 500.0), (4, "B", "zzz", 999.0)],
        "id int, category string, note string, score double")


RULES = [RuleSpec("c", "COMPLETENESS", ("category",), {}, "HIGH"),
         RuleSpec("p", "PATTERN", ("note",), {"regex": r"^[A-Z]{2}-\d{3}$"}),
         RuleSpec("r", "RANGE", ("score",), {"min": 0, "max": 100})]


def test_issues_and_suggestions(spark):
    df = mixed(spark)
    run = validate(df, RULES, ID)
    review = open_review(df, run, profile(df), run_table(spark), "rev", now())
    got = {(r["record_ref"], r["fix_type"]): (r["suggested_value"], r["confidence"]) for r in review.suggestions.collect()}
    assert got == {("3", "mode_fill"): ("A", 0.5), ("3", "trim_whitespace"): ("AB-125", 0.95),
                   ("3", "range_clamp"): ("100", 0.85), ("4", "range_clamp"): ("100", 0.85)}
    assert review.issues.count() == 5
    assert generate.without_suggestion(review.issues, review.suggestions).count() == 1
    counts = generate.suggestion_counts(review.issues, assignment_table(df, RULES), profile(df)).first()
    assert (counts["issues"], counts["issues_with_suggestion"], counts["suggestions"]) == (5, 4, 4)
    unfinished = generate.create_issues(run.failures(), run_table(spark, "FAILED"), "rev", "run", now())
    assert unfinished.count() == 0


def test_generators_on_zero_median_and_bounds(spark):
    df = spark.createDataFrame(
        [("i1", "COMPLETENESS", "INTEGER", None, 0.0, 1.0, 10.0, "{}", None), ("i2", "COMPLETENESS", "INTEGER", None, 50.0, 5.0, 10.0, "{}", None),
         ("i3", "RANGE", "INTEGER", None, None, None, None, '{"min":0,"max":100}', "-5"),
         ("i4", "RANGE", "INTEGER", None, None, None, None, '{"min":0,"max":100}', "150"),
         ("i5", "RANGE", "INTEGER", None, None, None, None, '{"min":0,"max":100}', "abc"),
         ("i6", "COMPLETENESS", "STRING", "x", None, None, 100.0, "{}", None)],
        "issue_id string, rule_type string, normalized_data_type string, mode_value string, median_value double, "
        "stddev_value double, distinct_percentage double, definition string, failed_value string")
    got = {r["issue_id"]: [(d["suggested_value"], d["confidence"]) for d in r["drafts"]] for r in generate.drafts(df).collect()}
    assert got == {"i1": [("0", 0.5)], "i2": [("50", 0.9)], "i3": [("0", 0.85)], "i4": [("100", 0.85)], "i5": [],
                   "i6": [("x", 0.1)]}


def test_evidence_for_a_review(spark):
    rows = [(i, "Apple", float(i), 49.0 * i) for i in range(1, 13)] + [(13, "Apple", 7.0, -500.0)]
    df = spark.createDataFrame(rows, "id int, product string, qty double, amount double")
    rules = [RuleSpec("r", "RANGE", ("amount",), {"min": 0}), RuleSpec("u", "UNIQUENESS", ("product",))]
    run = validate(df, rules, ID)
    prof = profile(df).withColumn("distinct_percentage", F.when(
        F.col("column_name").isin("qty", "amount"), 50.0).otherwise(F.col("distinct_percentage")))
    review = open_review(df, run, prof, run_table(spark), "rev", now())
    ranked = gather_evidence(df, ID, review.issues, prof)
    found = ranked.where("recommended_value IS NOT NULL").first()
    assert (found["recommended_value"], found["recommended_strategy"]) == ("343", "ratio_consistency")
    runs = review.issues.select("run_id").distinct().selectExpr("run_id", "'d' AS dataset_id", "timestamp_ntz'2024-01-02' AS created_at")
    for changed, left in (("2024-01-01", ranked.count()), ("2024-01-03", 0)):
        changes = spark.createDataFrame([("d",)], "dataset_id string").selectExpr("dataset_id", f"timestamp_ntz'{changed}' AS changed_at")
        assert gather_evidence(df, ID, review.issues, prof, changes, runs).count() == left


EVENT = "event_id string, issue_id string, action string, suggestion_id string, value string, decided_by string, decided_at timestamp_ntz"


def events(spark, *rows):
    return spark.createDataFrame([(f"e{i:03d}", *r, "bob", at(i)) for i, r in enumerate(rows)], EVENT)


def test_fold(spark):
    offers = spark.createDataFrame([("s1", "v1", "RULE_BASED"), ("s2", "  ", "RULE_BASED"), ("s3", "v3", "AI")],
                                   "suggestion_id string, suggested_value string, source string")
    log = events(spark, ("i1", "ACCEPT", "s1", None), ("i1", "EDIT", "s3", "mine"), ("i2", "ACCEPT", "s2", None),
                 ("i3", "ACCEPT", "s1", None), ("i3", "REJECT", "s1", None), ("i3", "EDIT", "s1", "late"),
                 ("i4", "SKIP", None, None), ("i5", "CORRECT", None, "typed"))
    got = {r["issue_id"]: r for r in decide.fold_decisions(log, offers).collect()}
    assert set(got) == {"i1", "i3", "i4", "i5"}
    assert (got["i1"]["final_value"], got["i1"]["status"], got["i1"]["value_source"]) == ("mine", "EDITED", "HUMAN")
    assert got["i1"]["selected_suggestion_id"] == "s3"
    assert (got["i3"]["final_value"], got["i3"]["status"], got["i3"]["selected_suggestion_id"]) == (None, "REJECTED", "s1")
    assert (got["i4"]["issue_status"], got["i5"]["final_value"], got["i5"]["suggestion_id"]) == ("SKIPPED", "typed", None)
    refused = {r["event_id"]: r["refused_reason"] for r in decide.refused_events(log, offers).collect()}
    assert refused == {"e002": "blank value", "e005": "already rejected or skipped"}


def test_bulk_against_brute_force(spark):
    import random

    rng = random.Random(1)
    issues = [f"i{n}" for n in range(40)]
    batches = [(f"b{n:02d}", rng.sample(issues + ["ghost"] * (n % 9 == 0), rng.randint(1, 4)), at(n)) for n in range(40)]
    single = {"i3": at(5), "i7": at(0)}
    log = spark.createDataFrame([(f"e{i}", i, "SKIP", None, None, "bob", t) for i, t in single.items()], EVENT)
    rows = [(b, i, "skip", t) for b, items, t in batches for i in items]
    df = spark.createDataFrame(rows, "batch_id string, issue_id string, action string, decided_at timestamp_ntz")
    known = spark.createDataFrame([(i,) for i in issues], "issue_id string")
    got = {r["batch_id"]: r["accepted"] for r in decide.bulk_outcomes(df, known, log).collect()}
    assert got == {b: all(i in issues and not (i in single and single[i] <= t) for i in items) for b, items, t in batches}


def test_approval(spark):
    submitted = spark.createDataFrame([(r, i) for r in "abcd" for i in ("1", "2")], "request_id string, issue_id string")
    log = spark.createDataFrame([("a", "APPROVE", "1"), ("a", "APPROVE", "2"), ("b", "APPROVE", "1"), ("b", "REJECT", "2"), ("c", "APPROVE", "1"),
                                 ("c", "APPROVE", "1")], "request_id string, decision string, issue_id string")
    got = {r["request_id"]: r["status"] for r in decide.approval_status(submitted, decide.decided_issues(log)).collect()}
    assert got == {"a": "APPROVED", "b": "REJECTED", "c": "PARTIALLY_APPROVED", "d": "PENDING"}


SCOPE = "record_ref string, column_name string, issue_id string, original_value string, final_value string"


def test_integrity(spark):
    ok = spark.createDataFrame([("1", "a", "x", "o", "v"), ("1", "a", "y", "o", "v")], SCOPE)
    stage.check_integrity(ok)
    assert stage.corrected_records(ok).first()["corrected_fields"][0]["final_value"] == "v"
    for bad in ([("1", "a", "x", "o", "v"), ("1", "a", "y", "o", "w")], [("1", "a", "x", "o", None)]):
        with pytest.raises(stage.StagingError):
            stage.check_integrity(spark.createDataFrame(bad, SCOPE))


def test_snapshot_and_drift(spark):
    df = spark.createDataFrame([(1, "old", 1.5), (2, "moved", 2.5), (3, None, 3.5)], "id int, a string, n double")
    scope = spark.createDataFrame([("1", "a", "x", "old", "new"), ("2", "a", "y", "was", "new"), ("3", "a", "z", None, "new"),
                                   ("9", "a", "w", "old", "new")], SCOPE)
    got = {r["record_ref"]: r for r in stage.stage_records(df, ID, scope).collect()}
    assert {k: r["drift_status"] for k, r in got.items()} == {
        "1": "UNCHANGED", "2": "VALUE_CHANGED", "3": "UNCHANGED", "9": "RECORD_NOT_FOUND"}
    assert got["2"]["drift_fields"] == ["a"] and got["1"]["drift_fields"] is None
    assert json.loads(got["1"]["row_snapshot"]) == {"id": 1, "a": "new", "n": 1.5}
    assert json.loads(got["9"]["row_snapshot"]) == {"a": "new"}
    summary = stage.staging_summary(stage.stage_records(df, ID, scope)).first()
    assert tuple(summary) == (4, 4, True)
    nokey = stage.stage_records(df, KeySpec(), scope)
    assert {r["drift_status"] for r in nokey.collect()} == {"RECORD_NOT_FOUND"}


@pytest.mark.parametrize("value,data_type,want", [
    ("980.50", T.DecimalType(10, 2), "980.50"), ("yes", T.BooleanType(), "true"), ("No", T.BooleanType(), "false"),
    ("maybe", T.BooleanType(), None), ("2024-01-15", T.TimestampNTZType(), "2024-01-15 00:00:00"),
    ("2024-01-15T10:30:00", T.DateType(), "2024-01-15"), (" 12 ", T.LongType(), "12"), ("12.5", T.LongType(), None),
    ("x", T.StringType(), "x"), ("abc", T.DoubleType(), None)])
def test_coercion(spark, value, data_type, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(stage.coerced(F.col("v"), data_type).cast("string")).first()[0] == want


def fixes(spark, *rows):
    return spark.createDataFrame(list(rows), "record_ref string, column_name string, final_value string")


def test_materialize(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, None), (5, "x")], "id int, a string")
    path = str(tmp_path / "copy")
    assert stage.materialize(df, ID, fixes(spark, ("2", "a", "new"), ("4", "a", None)), path) == 5
    got = {r["id"]: r["a"] for r in spark.read.parquet(path).collect()}
    assert got == {1: "x", 2: "new", 3: "x", 4: None, 5: "x"}
    assert stage.materialize(df, ID, fixes(spark, ("1", "a", "again")), path) == 5
    assert spark.read.parquet(path).count() == 5


def test_materialize_composite_and_null_keys(spark):
    df = spark.createDataFrame([(1, 100, "x"), (1, 101, None), (2, 100, "x"), (2, None, "x")], "r int, o int, a string")
    key = KeySpec(("r", "o"))
    out = stage.overlay(df, key, fixes(spark, ("1\x1f101", "a", "n"), ("2\x1f\x00NULL\x00", "a", "m")))
    assert sorted((r["r"], r["o"] or 0, r["a"]) for r in out.collect()) == [(1, 100, "x"), (1, 101, "n"), (2, 0, "m"), (2, 100, "x")]


def test_materialize_refuses_bad_text_and_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 100), (2, 200)], "id int, amount int")
    with pytest.raises(stage.StagingError):
        stage.materialize(df, ID, fixes(spark, ("1", "amount", "lots")), str(tmp_path / "copy"))
    assert not list(tmp_path.iterdir())


def test_no_key_is_copied_verbatim(spark):
    df = spark.createDataFrame([("x", "y"), (None, "y")], "a string, b string")
    out = stage.overlay(df, KeySpec(), fixes(spark, ("ROWIDX:1", "a", "n")))
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert stage.split_changed(df, KeySpec(), fixes(spark, ("ROWIDX:1", "a", "n")), True).count() == 0
    assert stage.split_changed(df, KeySpec(), fixes(spark, ("ROWIDX:1", "a", "n")), False).count() == 2
    assert not stage.with_change_flag(df, KeySpec(), fixes(spark, ("ROWIDX:1", "a", "n"))).first()["is_changed"]


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "old"), (2, "moved")], "id int, a string")
    scope = spark.createDataFrame([("1", "a", "x", "old", "new"), ("2", "a", "y", "was", "new")], SCOPE)
    staged = stage.stage_records(df, ID, scope)
    base = str(tmp_path)
    assert stage.publish(staged, base, "out", True, True).status == "PENDING"
    done = stage.publish(staged, base, "out", True, True, drift_acknowledged=True)
    assert (done.status, done.row_count) == ("PUBLISHED", 2)
    from plumbrule.sources.sinks import SinkError

    with pytest.raises(SinkError):
        stage.publish(staged, base, "out", True, True, drift_acknowledged=True)
    with pytest.raises(SinkError):
        stage.publish(staged, base, "../out", True, True, drift_acknowledged=True)
    with pytest.raises(stage.StagingError):
        stage.publish(staged, base, "out", False, True)


def test_destination_metadata(spark):
    df = spark.createDataFrame([], "i int, d decimal(10,2), f float, b boolean, t timestamp, s string")
    got = {r["column_name"]: r["staging_type"] for r in stage.destination_metadata(df).collect()}
    assert got == {"i": "bigint", "d": "decimal(10,2)", "f": "double", "b": "boolean", "t": "timestamp_ntz", "s": "string"}


def test_copy_on_write(spark, tmp_path):
    """Files without a corrected key stay as they are; the rest is rewritten, and nothing is left of a failing copy."""
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(40)], "id int, name string, v float")
    rows.repartitionByRange(4, "id").write.parquet(source)
    fixes = spark.createDataFrame([("3", "name", "three"), ("4", "v", "0.5"), ("99", "name", "none")], "record_ref string, column_name string, final_value string")
    made = stage.copy_on_write(spark, source, KeySpec(("id",)), fixes, target)
    assert (made.rewritten, made.taken_over, made.rows) == (1, 3, 40)
    got = {r["id"]: (r["name"], r["v"]) for r in stage.read_copy(spark, target).collect()}
    assert got == {i: ("three" if i == 3 else f"n{i}", 0.5 if i == 4 else float(i)) for i in range(40)}
    assert stage.read_copy(spark, target).dtypes == [("id", "bigint"), ("name", "string"), ("v", "double")]
    bad = fixes.withColumn("final_value", F.lit("x"))
    with pytest.raises(stage.StagingError):
        stage.copy_on_write(spark, source, KeySpec(("id",)), bad, target)
    assert stage.read_copy(spark, target).count() == 40 and [p.name for p in tmp_path.iterdir() if "pending" in p.name] == []
    again = stage.copy_on_write(spark, source, KeySpec(("id",)), fixes.limit(0), target)
    assert (again.rewritten, again.taken_over) == (0, 4) and stage.read_copy(spark, target).where("name = 'three'").count() == 0
