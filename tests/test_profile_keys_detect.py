from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbrule.operators import detect
from plumbrule.operators.evidence.roles import column_roles
from plumbrule.operators.keys import combo_evidence, confirm_key, discover_keys
from plumbrule.operators.profile import dataset_duplicate_percentage, profile, profile_each, profile_run_summary, quartiles, value_counts
from plumbrule.spec import KeySpec, SpecError


def only(df, **kw):
    return profile(df, **kw).first().asDict(recursive=True)


def test_numeric(spark):
    p = only(spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "v int"))
    assert (p["null_count"], p["distinct_count"], p["mean_value"], p["sum_value"]) == (1, 5, 3.0, 15.0)
    assert round(p["stddev_value"], 3) == 1.414 and p["median_value"] == 3.0
    assert p["min_value"] == "1.0" and p["max_value"] == "5.0" and p["mode_value"] == "1.0"


def test_text(spark):
    p = only(spark.createDataFrame([("ab",), ("",), ("abcd",), (None,), ("  ",), ("z",)], "v string"))
    assert (p["min_length"], p["max_length"], p["pattern_summary"]["blank_count"]) == (0, 4, 2)
    assert p["pattern_summary"]["blank_percentage"] == 33.33 and p["avg_length"] == 1.8


def test_dates(spark):
    p = only(spark.sql("SELECT explode(array(DATE'2024-01-01', DATE'2023-05-05', NULL, DATE'2025-12-31')) AS v"))
    assert (p["min_value"], p["max_value"], p["mode_value"]) == ("2023-05-05", "2025-12-31", None)


def test_top_values_are_cut_before_counting(spark):
    rows = [("x" * 500,)] * 5 + [(f"v{i}",) for i in range(20)]
    top = only(spark.createDataFrame(rows, "v string"))["value_distribution"]
    assert len(top) == 10 and top[0] == {"value": "x" * 100, "count": 5}


def test_outliers(spark):
    assert only(spark.createDataFrame([(v,) for v in (10, 11, 12, 13, 14, 15, 1000)], "v int"))["outlier_count"] == 1
    assert only(spark.createDataFrame([(1,), (2,), (1000,)], "v int"))["outlier_count"] == 0


def test_nan_is_left_out_of_numbers(spark):
    p = only(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double"))
    assert p["mean_value"] == 2.0 and p["max_value"] == "3.0" and p["null_count"] == 0


def test_empty_and_all_null(spark):
    assert profile(spark.createDataFrame([], "v int")).count() == 0
    p = only(spark.createDataFrame([(None,), (None,)], "v string"))
    assert p["null_percentage"] == 100.0 and p["min_value"] is None and p["value_distribution"] is None


def test_quartiles_are_exact(spark):
    import random

    rng = random.Random(5)
    values = [round(rng.lognormvariate(3, 2), 3) for _ in range(20000)] + [7.5] * 9000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    freq = value_counts(df).select("c", "n", F.col("value").cast("double").alias("num"))
    got = quartiles(freq).first()
    want = df.select(F.percentile("v", [0.25, 0.5, 0.75])).first()[0]
    assert [got["q1"], got["median"], got["q3"]] == pytest.approx(want, rel=1e-12)


def test_decimal_and_boolean_columns(spark):
    df = spark.createDataFrame([(Decimal("10.50"), True), (Decimal("20.00"), False)], "d decimal(10,2), b boolean")
    rows = {r["column_name"]: r for r in profile(df).collect()}
    assert rows["d"]["sum_value"] == 30.5 and rows["b"]["mode_value"] is None and rows["b"]["distinct_count"] == 2


def test_mode_of_long_texts(spark):
    """Texts that share their first 100 characters are one top value and several modes' candidates."""
    begin = "p" * 100
    rows = [begin + "b"] * 3 + [begin + "a"] * 3 + [begin] * 2 + ["z"] * 2 + [begin + "c"] * 2 + [None]
    p = only(spark.createDataFrame([(v,) for v in rows], "v string"))
    assert (p["mode_value"], p["distinct_count"], p["duplicate_count"]) == (begin + "a", 5, 7)
    assert p["value_distribution"] == [{"value": begin, "count": 10}, {"value": "z", "count": 2}]
    assert only(spark.createDataFrame([(begin,)] * 2 + [(begin + "a",)] * 2, "v string"))["mode_value"] == begin


def test_values_keep_their_type(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (9007199254740993L, CAST(1.10 AS DECIMAL(12, 2)), CAST(123456789012345678901.5 AS DECIMAL(30, 1)), CAST(0.1 AS FLOAT),
       TIMESTAMP_NTZ'2024-03-31 02:30:00', TIMESTAMP'2024-03-31 02:30:00', true, X'6162', array(1, NULL)),
      (9007199254740992L, CAST(1.10 AS DECIMAL(12, 2)), CAST(123456789012345678902.5 AS DECIMAL(30, 1)), CAST(0.1 AS FLOAT),
       TIMESTAMP_NTZ'2024-03-31 03:30:00', NULL, NULL, X'6162', array(1, NULL)) AS t(i, d, big, f, ntz, ts, b, raw, list)""")
    rows = {r["column_name"]: r for r in profile(df).collect()}
    assert {n: r["distinct_count"] for n, r in rows.items()} == {
        "i": 2, "d": 1, "big": 2, "f": 1, "ntz": 2, "ts": 1, "b": 1, "raw": 1, "list": 1}
    shown = {n: [(v["value"], v["count"]) for v in r["value_distribution"]] for n, r in rows.items()}
    assert shown == {
        "i": [("9007199254740992", 1), ("9007199254740993", 1)], "d": [("1.10", 2)], "f": [("0.1", 2)],
        "big": [("123456789012345678901.5", 1), ("123456789012345678902.5", 1)],
        "ntz": [("2024-03-31 02:30:00", 1), ("2024-03-31 03:30:00", 1)], "ts": [("2024-03-31 02:30:00", 1)],
        "b": [("true", 1)], "raw": [("ab", 2)], "list": [("[1,null]", 2)]}
    assert rows["d"]["mode_value"] == "1.1" and rows["f"]["max_value"] == "0.1" and rows["d"]["sum_value"] == 2.2


def test_a_failing_column_fails_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, "7"), (None, "b")], "x int, y string").select(
        "x", F.col("y").cast("int").alias("bad"), "y", F.expr("x / (x - 1)").alias("worse"))
    rows = {r["column_name"]: r for r in profile_each(df).collect()}
    assert {n: (r["ordinal"], r["status"]) for n, r in rows.items()} == {
        "x": (0, "COMPLETED"), "bad": (1, "FAILED"), "y": (2, "COMPLETED"), "worse": (3, "FAILED")}
    assert "CAST_INVALID_INPUT" in rows["bad"]["error"] and rows["bad"]["row_count"] is None and rows["y"]["distinct_count"] == 3
    summary = profile_run_summary(profile_each(df), 99, False).first()
    assert (summary["row_count"], summary["columns_failed"], summary["error_message"]) == (99, 2, "2/4 columns profiled, 2 failed")
    assert [r["status"] for r in profile_each(df.select("bad")).collect()] == ["FAILED"]
    assert {r["status"] for r in profile_each(df.select("x", "y")).collect()} == {"COMPLETED"}


def test_dataset_duplicates(spark):
    rows = [(10, "Alice", "x"), (10, "Alice", "x"), (20, "Bob", None), (20, "Bob", None), (30, "Carol", "")]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    assert dataset_duplicate_percentage(df).first()["duplicate_percentage"] == 40.0
    assert dataset_duplicate_percentage(df.limit(0)).first()["duplicate_percentage"] is None


def test_key_discovery(spark):
    grid = spark.createDataFrame([(r, s) for r in (1, 2, 3) for s in (1, 2)], "region int, seq int")
    found = discover_keys(grid)
    assert found.status == "VERIFIED_UNIQUE" and found.recommended == ("region", "seq")
    assert found.widths_searched == (1, 2)
    assert discover_keys(grid, is_full_scan=False).status == "SAMPLE_CANDIDATE"
    assert discover_keys(grid, decisive_only=True).recommended == ("region", "seq")


def test_key_discovery_verdicts(spark):
    rejected = discover_keys(spark.createDataFrame([(101,), (102,), (102,), (103,)], "id int"))
    assert rejected.status == "NO_CANDIDATE" and rejected.evaluated[0]["reason"] == "duplicate_values"
    both = discover_keys(spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string"))
    assert both.status == "AMBIGUOUS" and both.recommended is None
    assert discover_keys(spark.createDataFrame([(1,)], "id int")).reason == "insufficient_row_count"
    typed = discover_keys(spark.createDataFrame([(1.5,), (2.5,)], "v double"))
    assert typed.reason == "no_eligible_columns" and typed.rejected_columns == ("v",)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_key_lattice_against_every_combination(spark, seed):
    """30 columns: the pruned lattice gives the verdict that counting every combination gives."""
    import random
    from itertools import combinations

    rng = random.Random(seed)
    n, wide = 400, [rng.choice([2, 3, 5, 20, 60]) for _ in range(29)]
    rows = [tuple(rng.randrange(w) if rng.random() > 0.001 * (k == 4) else None for k, w in enumerate(wide)) + (f"s{i % 399}",)
            for i in range(n)]
    names = [f"c,{k}" for k in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c == 'c,29' else 'int'}" for c in names))
    found = discover_keys(df)

    def unique(at):
        keys = [tuple(r[k] for k in at) for r in rows]
        return len(set(keys)) == n and all(None not in k for k in keys)

    for width in (1, 2, 3):
        hits = sorted(tuple(names[k] for k in at) for at in combinations(range(30), width) if unique(at))
        if hits:
            break
    assert found.candidates == tuple(hits) and found.widths_searched == tuple(range(1, width + 1))
    exact = [r for r in found.evaluated if r["counted"] == "EXACT"]
    assert all(r["distinct_key_count"] <= n and (r["status"] == "CANDIDATE") == (tuple(r["key_columns"]) in hits) for r in exact)
    narrow = df.select(*[f"`{c}`" for c in names[20:]])
    assert discover_keys(narrow, decisive_only=False).candidates == discover_keys(narrow).candidates


def test_a_repeated_key_in_one_slice_spares_the_full_count(spark, monkeypatch):
    """every combination near uniqueness was counted over all rows."""
    from plumbrule.operators import keys

    counted = []
    exact = keys._exact
    monkeypatch.setattr(keys, "ROWS_PER_SLICE", 1000, raising=False)
    monkeypatch.setattr(keys, "_exact", lambda df, combos, *more: counted.extend(combos) or exact(df, combos, *more))
    df = spark.range(8000).selectExpr("id DIV 8 AS a", "id % 8 AS b", "id * 50 DIV 51 AS c")
    found = discover_keys(df)
    assert (found.status, found.recommended) == ("AMBIGUOUS", None) and set(found.candidates) == {("a", "b"), ("b", "c")}
    assert ("c",) not in counted and {("a", "b"), ("b", "c")} <= set(counted)
    assert {tuple(r["key_columns"]): r["counted"] for r in found.evaluated}[("c",)] == "ESTIMATED"


def test_evidence_counts_nearly_unique_keys_without_copies_of_rows(spark):
    """grouping sets copied each row once per combination and combined keys that do not repeat."""
    rows = [(i, i % 3, None if i % 5 == 0 else i % 7) for i in range(300)] + [(7, 1, 0)]
    df = spark.createDataFrame(rows, "x int, y int, z int")
    combos = [("x",), ("y",), ("z",), ("x", "y"), ("x", "z"), ("y", "z")]
    made = combo_evidence(df, combos)
    assert "Expand" not in made._jdf.queryExecution().optimizedPlan().toString()
    at = {c: k for k, c in enumerate(("x", "y", "z"))}
    for r in made.collect():
        keys = [tuple(row[at[c]] for c in r["key_columns"]) for row in rows]
        whole = [k for k in keys if None not in k]
        again = sum(n > 1 for n in Counter(whole).values())
        assert (r["null_key_rows"], r["distinct_key_count"], r["duplicate_key_groups"]) == (len(keys) - len(whole), len(set(whole)), again)
        assert r["total_rows_evaluated"] == 301 and (r["status"] == "CANDIDATE") == (not again and len(whole) == 301)
    assert made.count() == 6 and combo_evidence(df.limit(0), combos).count() == 0


def test_free_text_takes_no_part_in_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "x int, y string")
    assert discover_keys(df).recommended == ("y",)
    said = df.withMetadata("y", {"normalized_type": "TEXT"})
    assert discover_keys(said).status == "NO_CANDIDATE" and discover_keys(said).rejected_columns == ("y",)


def test_key_confirmation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c")], "order_no int, name string")
    assert confirm_key(df, ["order_no"]) == KeySpec(("order_no",))
    with pytest.raises(SpecError):
        confirm_key(df.union(df), ["order_no"])
    with pytest.raises(SpecError):
        confirm_key(df, ["order_no"], KeySpec(("order_no",)))


def test_detection(spark):
    rows = [(i, f"u{i}@example.org", f"note {i % 3}", i % 2) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "id int, reach string, notes string, flag int")
    found = {r["column_name"]: r for r in detect.detect_rules(profile(df)).collect()}
    assert (found["reach"]["category"], found["reach"]["rule_type"]) == ("email", "PATTERN")
    assert (found["id"]["confidence"], found["id"]["rule_type"]) == (0.85, "UNIQUENESS")
    assert found["notes"]["rule_type"] is None and found["notes"]["category"] == "free_text"
    assert found["flag"]["definition"] == '{"min":0.0,"max":1.0}'
    assert found["reach"]["status"] == "PENDING_REVIEW"


def test_detection_without_top_values(spark):
    df = spark.createDataFrame([("+1 555-0100100",), ("+1 555-0100100",)], "line string")
    assert detect.detect_rules(profile(df, include_top_values=False)).first()["category"] == "phone"


def test_promotion(spark):
    p = {"column_name": "a", "rule_type": "RANGE", "definition": '{"min": 1}', "severity": "MEDIUM", "status": "PENDING_REVIEW"}
    assert detect.promote(p, "x").columns == ("a",)
    assert detect.promote({**p, "rule_type": "DUPLICATE"}, "x").columns == ()
    for bad in ({**p, "rule_type": "CROSS_COLUMN"}, {**p, "status": "ACTIVE"}):
        with pytest.raises(SpecError):
            detect.promote(bad, "x")
    proposals = spark.createDataFrame(
        [("a", "RANGE", "{}", "MEDIUM", "PENDING_REVIEW"), ("b", "CROSS_COLUMN", "{}", "MEDIUM", "PENDING_REVIEW"),
         ("c", "RANGE", "{}", "MEDIUM", "ACTIVE"), ("d", "RANGE", "{}", "MEDIUM", "PENDING_REVIEW")],
        "column_name string, rule_type string, definition string, severity string, status string")
    acts = spark.createDataFrame([("a", "PROMOTE"), ("b", "PROMOTE"), ("c", "PROMOTE"), ("d", "DISMISS")],
                                 "column_name string, action string")
    out = {r["column_name"]: (r["status"], r["refused_reason"] is None)
           for r in detect.promotion_outcomes(proposals, acts).collect()}
    assert out == {"a": ("ACTIVE", True), "b": ("PENDING_REVIEW", False), "c": ("ACTIVE", False), "d": ("DISABLED", True)}


def test_roles(spark):
    df = spark.createDataFrame([(i, i * 1.5, f"k{i}", "x") for i in range(30)], "id int, m double, code string, kind string")
    roles = {r["column_name"]: r["role"] for r in column_roles(profile(df), ("id",)).collect()}
    assert roles == {"id": "IDENTIFIER", "m": "IDENTIFIER", "code": "IDENTIFIER", "kind": "DIMENSION"}
    few = {r["column_name"]: r["role"] for r in column_roles(profile(df.limit(5))).collect()}
    assert few["m"] == "MEASURE"
