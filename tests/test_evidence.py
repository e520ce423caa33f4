import pytest
from pyspark.sql import functions as F

from plumbrule.functions import text
from plumbrule.operators.evidence import gate, rank
from plumbrule.operators.evidence.relationship import relationship_evidence
from plumbrule.operators.evidence.sequence import sequence_evidence
from plumbrule.operators.evidence.template import (
    closed_targets, learn_templates, template_evidence, template_evidence_for_columns, training_rows)
from plumbrule.operators.evidence.temporal import temporal_evidence
from plumbrule.spec import KeySpec


def values(spark, **columns):
    return spark.createDataFrame([(k, str(v)) for k, vs in columns.items() for v in vs], "column_name string, value string")


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def relate(df, condition, target, dims, measures, **kw):
    failing = df.where(condition).withColumn("issue_id", F.monotonically_increasing_id().cast("string"))
    return relationship_evidence(df, failing, target, dims, measures, **kw).first()


def test_ratio_in_group(spark):
    df = spark.createDataFrame([("Apple", 10, 490.0), ("Apple", 20, 980.0), ("Apple", 5, 245.0), ("Apple", 15, -500.0),
                                ("Pear", 3, 1.0)], "product string, qty int, amount double")
    r = relate(df, "amount < 0", "amount", ["product"], ["qty"])
    assert (r["status"], r["relationship_type"], r["candidate_value"], r["group_size"]) == (
        "CANDIDATE", "ratio_consistency", 735.0, 3)
    assert r["fit_quality"] == 1.0 and r["confidence"] == 0.5


def test_ratio_without_dimension(spark):
    df = spark.createDataFrame([(1000.0, 200.0), (2000.0, 400.0), (1500.0, 300.0), (4000.0, -50.0)], "pay double, tax double")
    r = relate(df, "tax < 0", "tax", [], ["pay"])
    assert (r["status"], round(r["candidate_value"], 6)) == ("CANDIDATE", 800.0)


def test_null_dimension_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 4.0), (None, 3.0, 6.0), (None, 4.0, -1.0), ("a", 1.0, 50.0)],
                               "g string, m double, t double")
    assert relate(df, "t < 0", "t", ["g"], ["m"])["candidate_value"] == 8.0


def test_relationship_declines(spark):
    noise = spark.createDataFrame([(1.0, 90.0), (7.0, 3.0), (2.0, 55.0), (9.0, 1.0), (4.0, -1.0)], "m double, t double")
    assert relate(noise, "t < 0", "t", [], ["m"])["status"] == "NO_RELATIONSHIP"
    small = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, -1.0)], "m double, t double")
    assert relate(small, "t < 0", "t", [], ["m"])["status"] == "INSUFFICIENT_GROUP"
    two = spark.createDataFrame([(1.0, 2.0, 4.0), (2.0, 4.0, 8.0), (3.0, 6.0, 12.0), (4.0, 80.0, -1.0)],
                                "a double, b double, t double")
    assert relate(two, "t < 0", "t", [], ["a", "b"])["status"] == "AMBIGUOUS"


def test_product_sum_and_difference(spark):
    rows = [(2.0, 3.0), (5.0, 7.0), (11.0, 4.0), (6.0, 13.0), (8.0, 9.0)]
    for kind, make in (("product_consistency", lambda a, b: a * b), ("sum_consistency", lambda a, b: a + b),
                       ("difference_consistency", lambda a, b: b - a)):
        df = spark.createDataFrame([(i, a, b, make(a, b)) for i, (a, b) in enumerate(rows)] + [(9, 10.0, 1.0, 1e12)],
                                   "id int, a double, b double, t double")
        r = relate(df, "id = 9", "t", [], ["a", "b"])
        assert (r["relationship_type"], r["candidate_value"]) == (kind, make(10.0, 1.0))


def brute_relationship(rows, failing, measures):
    """Every shape on every other row, straight from the definition."""
    import statistics as st
    from itertools import combinations, permutations

    group = [r for r in rows if r is not failing and r["g"] == failing["g"]]
    if len(group) < 3:
        return "INSUFFICIENT_GROUP", None
    found = []

    def scaled(xs, base):
        if len(xs) >= 3 and st.fmean(xs) != 0 and base is not None:
            found.append((1 - abs(st.pstdev(xs) / st.fmean(xs)), st.fmean(xs) * base))

    scaled([r["t"] for r in group], 1.0)
    for m in measures:
        scaled([r["t"] / r[m] for r in group if r[m] != 0], failing[m] or None)
    for op, pairs in (("*", combinations(measures, 2)), ("+", combinations(measures, 2)), ("-", permutations(measures, 2))):
        for a, b in pairs:
            calc = {"*": lambda r: r[a] * r[b], "+": lambda r: r[a] + r[b], "-": lambda r: r[a] - r[b]}[op]
            err = st.fmean(abs(r["t"] - calc(r)) / max(abs(r["t"]), abs(calc(r)), 1e-9) for r in group)
            found.append((1 - err, calc(failing)))
    good = [f for f in found if round(max(0, f[0]), 9) >= 0.9]
    if not good:
        return "NO_RELATIONSHIP", None
    top = max(good, key=lambda f: round(f[0], 9))
    rival = any(round(top[0], 9) - round(f[0], 9) <= 0.03 and abs(f[1] - top[1]) > max(0.01 * max(abs(f[1]), abs(top[1])), 1e-6)
                for f in good)
    return ("AMBIGUOUS", None) if rival else ("CANDIDATE", top[1])


def test_relationship_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(300):
        g = "hot" if i % 3 == 0 else f"g{i % 20}"
        a, b = rng.uniform(1, 50), rng.uniform(1, 50)
        t = {0: a + b, 1: a * b, 2: 3 * a, 3: rng.uniform(1, 999)}[sum(map(ord, g)) % 4 if g != "hot" else 0]
        rows.append({"id": i, "g": g, "a": a, "b": b, "t": t * rng.choice([1, 1, 1, 1, 1, 1.01])})
    for r in rows[::17]:
        r["t"] = rng.choice([-1.0, 1e9, 0.0])
    df = spark.createDataFrame([(r["id"], r["g"], r["a"], r["b"], r["t"]) for r in rows],
                               "id int, g string, a double, b double, t double")
    failing = df.where(F.col("id").isin([r["id"] for r in rows[::17]])).withColumn("issue_id", F.col("id").cast("string"))
    got = {int(r["issue_id"]): r for r in relationship_evidence(df, failing, "t", ["g"], ["a", "b"]).collect()}
    assert len(got) == len(rows[::17])
    for r in rows[::17]:
        status, value = brute_relationship(rows, r, ["a", "b"])
        assert got[r["id"]]["status"] == status
        if value is not None:
            assert got[r["id"]]["candidate_value"] == pytest.approx(value, rel=1e-6)


def test_sequences(spark):
    got = by_column(sequence_evidence(values(
        spark, gap=[1001, 1002, 1003, 1004, 1006, 1007, 1008], two=[1001, 1002, 1004, 1007, 1008],
        padded=["ORD001", "ORD002", "ORD003", "ORD004", "ORD006", "ORD007", "ORD008"],
        twice=[1001, 1002, 1003, 1002, 1004], minus=["ORD-001", "ORD-002", "ORD-003", "ORD-002", "ORD-004", "ORD-005"],
        whole=[1, 2, 3, 4, 5], few=[1, 2], words=["a", "b", "c", "d", "e"], wild=[1, 2, 3, 4, 5, 99999999],
        above=[0, 5, 10, 15, 18], huge=[str(10**25 + i) for i in (0, 1, 2, 3, 5, 6)])))
    assert (got["gap"]["candidate_value"], got["gap"]["strategy"]) == ("1005", "SEQUENCE_GAP")
    assert (got["padded"]["candidate_value"], got["padded"]["template"]) == ("ORD005", "ORD###")
    assert got["two"]["status"] == "AMBIGUOUS"
    assert (got["twice"]["strategy"], got["twice"]["candidate_value"]) == ("SEQUENCE_NEXT_VALUE", "1005")
    assert got["minus"]["candidate_value"] == "ORD000"
    assert [got[c]["status"] for c in ("whole", "few", "words", "wild")] == [
        "NO_RELATIONSHIP", "INSUFFICIENT_GROUP", "NO_RELATIONSHIP", "AMBIGUOUS"]
    assert got["above"]["candidate_value"] == "20"
    assert got["huge"]["candidate_value"] == str(10**25 + 4)


def test_a_long_sequence_is_decided(spark):
    df = spark.range(50000).select(F.lit("n").alias("column_name"), F.col("id").cast("string").alias("value"))
    assert sequence_evidence(df.where("id <> 7")).first()["candidate_value"] == "7"


def test_temporal(spark):
    got = by_column(temporal_evidence(values(
        spark, month=["2026-01-15", "2026-02-15", "2026-03-15", "2026-05-15"],
        ends=["2026-01-31", "2026-02-28", "2026-03-31", "2026-05-31"],
        year=["2020-03-01", "2021-03-01", "2022-03-01", "2024-03-01"],
        leap=["2016-02-29", "2020-02-29", "2028-02-29", "2032-02-29"],
        day=["2026-01-01", "2026-01-02", "2026-01-03", "2026-01-05", "2026-01-06"],
        twice=["2026-01-01", "2026-01-02", "2026-01-03", "2026-01-02", "2026-01-04"],
        hour=["2026-01-01T00:00:00", "2026-01-01T01:00:00", "2026-01-01T02:00:00", "2026-01-01T04:00:00", "2026-01-01T05:00:00"],
        zone=["2026-01-01T00:00:00Z", "2026-01-01T01:00:00+00:00", "2026-01-01T02:00:00Z", "2026-01-01T04:00:00Z", "2026-01-01T05:00:00Z"],
        mixed=["2026-01-01T00:00:00Z", "2026-01-01T01:00:00", "2026-01-01T02:00:00Z", "2026-01-01T04:00:00Z"],
        local=["1/2/2026", "1/3/2026", "1/4/2026", "1/6/2026"]), min_observations=4))
    expect = {
        "month": ("2026-04-15", "CALENDAR_MONTH_INTERVAL"), "ends": ("2026-04-30", "CALENDAR_MONTH_INTERVAL"),
        "year": ("2023-03-01", "CALENDAR_YEAR_INTERVAL"), "leap": ("2024-02-29", "FIXED_INTERVAL"),
        "day": ("2026-01-04", "FIXED_INTERVAL"), "hour": ("2026-01-01T03:00:00", "FIXED_INTERVAL"),
        "zone": ("2026-01-01T03:00:00+00:00", "FIXED_INTERVAL"), "twice": ("2026-01-05", "FIXED_INTERVAL")}
    for name, want in expect.items():
        if name == "leap":
            continue
        assert (got[name]["candidate_value"], got[name]["progression_type"]) == want, name
    assert got["twice"]["strategy"] == "TEMPORAL_NEXT_VALUE"
    assert got["mixed"]["status"] == "AMBIGUOUS" and got["local"]["status"] == "INSUFFICIENT_GROUP"


PEOPLE = [("Arun Kumar", "arun.kumar@example.org"), ("Priya Raj", "priya.raj@example.org"),
          ("Vijay Kumar", "vijay.kumar@example.org")]


def ask(spark, pairs, query, source="name"):
    df = spark.createDataFrame(pairs, "name string, email string")
    failing = spark.createDataFrame([("i", query, None)], "issue_id string, name string, email string")
    return template_evidence(df, failing, "email", [source]).first()


def test_template(spark):
    r = ask(spark, PEOPLE, "Suresh Kumar")
    assert (r["candidate_value"], r["case_transform"], r["delimiter"], r["supporting_count"]) == (
        "suresh.kumar@example.org", "lower", ".", 3)
    assert ask(spark, PEOPLE, None)["status"] == "NO_RELATIONSHIP"
    assert ask(spark, PEOPLE[:2], "Suresh Kumar")["status"] == "INSUFFICIENT_GROUP"
    assert ask(spark, PEOPLE + [("Anu Rao", "anu.rao@other.org")], "Suresh Kumar")["status"] == "AMBIGUOUS"
    assert ask(spark, [("a b", "x1"), ("c d", "x2"), ("e f", "x3")], "g h")["status"] == "NO_RELATIONSHIP"
    assert ask(spark, [("one", "one"), ("two", "two"), ("six", "six")], "TEN")["status"] == "AMBIGUOUS"


def brute_template(pairs, query):
    """All hypotheses of all pairs, scored on all pairs."""
    import re

    def core(s, case, d):
        return d.join({"as_is": str, "lower": str.lower, "upper": str.upper}[case](t) for t in re.findall("[A-Za-z0-9]+", s))

    found = set()
    for s, t in pairs:
        for case in ("as_is", "lower", "upper"):
            for d in ("", ".", "_", "-", " "):
                at = t.find(core(s, case, d))
                if at >= 0:
                    found.add((case, d, t[:at], t[at + len(core(s, case, d)):]))
    perfect = sorted(h for h in found if all(h[2] + core(s, h[0], h[1]) + h[3] == t for s, t in pairs))
    if not found:
        return "NO_RELATIONSHIP", None
    if not perfect:
        return "AMBIGUOUS", None
    answers = {h[2] + core(query, h[0], h[1]) + h[3] for h in perfect}
    return ("CANDIDATE", answers.pop()) if len(answers) == 1 else ("AMBIGUOUS", None)


@pytest.mark.parametrize("pairs,query", [
    ([("a", "aa"), ("b", "bb"), ("c", "cc")], "d"), ([("a", "aa"), ("b", "ab"), ("c", "ac")], "d"),
    ([("aa", "aaa"), ("ba", "aba"), ("c", "ac")], "zz"), ([("x y", "XY-1"), ("p q", "PQ-1"), ("m n", "MN-1")], "u v"),
    ([("1", "11"), ("2", "12"), ("3", "13")], "4"), ([("a", "aaa"), ("a", "aaa"), ("a", "aaa")], "b")])
def test_template_against_brute_force(spark, pairs, query):
    got = ask(spark, pairs, query)
    assert (got["status"], got["candidate_value"]) == brute_template(pairs, query)


def test_template_from_two_columns_and_training_rows(spark):
    df = spark.createDataFrame(
        [(1, "Arun", "Kumar", "AKumar"), (2, "Priya", "Raj", "Priya-Raj"), (3, "Vijay", "Rao", "Vijay-Rao"),
         (4, "Anu", "Nair", "Anu-Nair")], "id int, first string, last string, login string")
    issues = spark.createDataFrame([("1", "login"), ("2", "first")], "record_ref string, column_name string")
    clean = training_rows(df, text.record_ref(df.schema, KeySpec(("id",))), issues, "login")
    assert sorted(r["id"] for r in clean.collect()) == [2, 3, 4]
    learned = learn_templates(clean, "login", [("first", "last"), "last"]).orderBy("source").collect()
    assert learned[0]["templates"][0]["delimiter"] == "-" and learned[1]["learned"] == "AMBIGUOUS"


def test_templates_of_all_columns_agree_with_one_at_a_time(spark):
    """Twelve text columns make more pairs than one aggregate holds; issues on one target still teach the others."""
    names = [f"c{k}" for k in range(12)]
    people = [("Arun Kumar", "Arun"), ("Priya Raj", "Priya"), ("Vijay Rao", "Vijay"), ("Anu Nair", "Anu"), ("Mia Roy", "x")]
    rows = [(i, name, first.lower() + "@a.org", name.replace(" ", "-").upper(), *[f"{k}:{first}" if i % (k + 2) else None for k in range(9)])
            for i, (name, first) in enumerate(people)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} string" for n in names))
    issues = spark.createDataFrame(
        [("4", "c1", "a"), ("4", "c3", "b"), ("0", "c2", "c"), ("0", "c5", "d"), (None, "c1", "e")],
        "record_ref string, column_name string, issue_id string")
    ref = text.record_ref(df.schema, KeySpec(("id",)))
    targets = {t: [n for n in names if n != t] for t in ("c1", "c2", "c3", "c5")}
    failing = issues.join(df.withColumn("record_ref", ref), "record_ref").withColumnRenamed("column_name", "_column")
    order = ["issue_id", "target_column", "source_column"]
    got = template_evidence_for_columns(closed_targets(df, ref, issues, targets), failing, targets, "_closed").orderBy(*order).collect()
    alone = []
    for target, sources in targets.items():
        mine = failing.where(failing["_column"] == target)
        alone += template_evidence(training_rows(df, ref, issues, target), mine, target, sources).collect()
    assert got == sorted(alone, key=lambda r: [r[c] for c in order]) and len(got) == 44
    assert ("c", "c0", "ARUN-KUMAR") in {(r["issue_id"], r["source_column"], r["candidate_value"]) for r in got}


def ranked(spark, *rows):
    df = spark.createDataFrame([("i", v, s, c, 3, 0) for v, s, c in rows],
                               "issue_id string, value string, strategy string, confidence double, supporting_count long, contradicting_count long")
    return rank.rank_candidates(df).first()


def test_ranking(spark):
    assert ranked(spark, ("735", "A", 0.90), ("700", "B", 0.89))["ambiguous"]
    assert ranked(spark, ("735", "A", 0.97), ("700", "B", 0.50))["recommended_value"] == "735"
    assert ranked(spark, ("735", "A", 0.90), ("735.0", "B", 0.89))["recommended_value"] == "735"
    assert ranked(spark, ("735", "B", 0.90), ("735", "A", 0.90))["recommended_strategy"] == "A"
    none = spark.createDataFrame([("i", "1", "A", 0.5, 1, 0)],
                                 "issue_id string, value string, strategy string, confidence double, supporting_count long, contradicting_count long")
    r = rank.rank_candidates(none.limit(0), none.select("issue_id")).first()
    assert (r["recommended_value"], r["ambiguous"], r["candidates"]) == (None, False, 0)


def test_parse_suggestions(spark):
    texts = ['```json\n{"category": "AI_HIGH_CONFIDENCE", "suggested_value": "7", "confidence": 0.8, "reasoning": "ok"}\n```',
             '{"category": "AI_HIGH_CONFIDENCE", "suggested_value": 7, "confidence": 0.8}',
             '{"category": "NEEDS_REVIEW", "suggested_value": "7", "confidence": 0.8}', "no json", '["a"]',
             '{"category": "AI_HIGH_CONFIDENCE", "suggested_value": "7", "confidence": 3}',
             '{"category": "SURE", "suggested_value": "7"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "issue_id int, text string")
    got = [(r["category"], r["suggested_value"], r["confidence"]) for r in gate.parse_suggestions(df).orderBy("issue_id").collect()]
    assert got == [("AI_HIGH_CONFIDENCE", "7", 0.8), ("NEEDS_REVIEW", None, None), ("NEEDS_REVIEW", None, None),
                   ("NEEDS_REVIEW", None, None), ("NEEDS_REVIEW", None, None), ("AI_HIGH_CONFIDENCE", "7", None),
                   ("NEEDS_REVIEW", None, None)]


def test_peers(spark):
    df = spark.createDataFrame([("run", "a", "UNIQUENESS", str(i), i, "x") for i in range(9)] + [("run", "a", "UNIQUENESS", "z", 99, "y")],
                               "run_id string, assignment_id string, rule_type string, record_ref string, row_index int, failed_value string")
    got = {r["record_ref"]: r["peers"] for r in rank.duplicate_peers(df, 5).collect()}
    assert {r["peer_count"] for r in rank.duplicate_peers(df, 5).collect()} == {8, 0}
    assert got["0"] == ["1", "2", "3", "4", "5"] and got["8"] == ["0", "1", "2", "3", "4"] and got["z"] == []


def test_long_series_are_decided_like_short_ones(spark):
    from plumbrule.operators.evidence.sequence import sequence_evidence
    from plumbrule.operators.evidence.temporal import temporal_evidence

    for n in (900, 25_000):
        numbers = spark.range(n).where(f"id <> {n // 3}").selectExpr("'c' AS column_name", "concat('N', id) AS value")
        got = sequence_evidence(numbers).first()
        assert (got["status"], got["strategy"], got["candidate_value"]) == ("CANDIDATE", "SEQUENCE_GAP", f"N{n // 3}")
        hours = spark.range(n).where(f"id <> {n // 3}").selectExpr(
            "'c' AS column_name", "date_format(timestamp_seconds(id * 3600), \"yyyy-MM-dd'T'HH:mm:ss\") AS value")
        got = temporal_evidence(hours).first()
        assert (got["status"], got["strategy"], got["gap_count"]) == ("CANDIDATE", "TEMPORAL_GAP", 1)


def test_every_measure_is_tried(spark):
    from plumbrule.operators.evidence.relationship import relationship_evidence

    names = [f"m{i}" for i in range(17)]
    rows = [(i, None if i == 3 else 3.0 * (i + 1), *[float((i * 7919 + k * 104729) % 997) for k in range(16)], float(i + 1)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, t double, " + ", ".join(f"{n} double" for n in names))
    failing = df.where("id = 3").selectExpr("*", "'i' AS issue_id")
    got = relationship_evidence(df, failing, "t", [], names).first()
    assert (got["status"], got["related_columns"], round(got["candidate_value"], 6)) == ("CANDIDATE", "m16", 12.0)


def test_large_joins_match_no_null_key(spark):
    from plumbrule.functions.grouping import join_small

    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "x int, k string")
    right = spark.createDataFrame([(None, "N"), ("a", "A")], "k string, y string")
    for how in ("left", "inner"):
        small, large = (sorted(map(tuple, join_small(left, right, ["k"], how, max_rows=m).select("x", "y").collect())) for m in (100, 0))
        assert small == large
    assert (1, None) in map(tuple, join_small(left, right, ["k"], "left", max_rows=0).select("x", "y").collect())


def test_many_measures_are_aggregated_in_chunks(spark, monkeypatch):
    """The verdict does not depend on how many shapes stand side by side."""
    import random

    from plumbrule.operators.evidence import relationship

    rng = random.Random(4)
    rows = [(k, k % 3, *[rng.uniform(1, 9) for _ in range(9)]) for k in range(60)]
    names = [f"m{i}" for i in range(9)]
    df = spark.createDataFrame(rows, "id int, g int, " + ", ".join(f"{n} double" for n in names)).withColumn(
        "t", F.when(F.col("id") == 7, -5.0).otherwise(F.col("m3") - F.col("m6")))
    failing = df.where("id = 7").withColumn("issue_id", F.lit("i"))
    found = {}
    for chunk in (1, 7, 500):
        monkeypatch.setattr(relationship, "CHUNK", chunk)
        found[chunk] = relationship.relationship_evidence(df, failing, "t", ["g"], names).first()
    assert len(set(found.values())) == 1
    assert found[1]["related_columns"] == "m3,m6" and found[1]["relationship_type"] == "difference_consistency"
    assert found[1]["shapes_tested"] == len(relationship.shapes_of(names))
