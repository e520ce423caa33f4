"""String templates: a text column that is built from the words of another one."""

from __future__ import annotations

from functools import reduce
from typing import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions import text
from plumbrule.functions.grouping import join_small, keep_matching
from plumbrule.functions.storage import written
from plumbrule.operators.evidence import AMBIGUOUS, CANDIDATE, INSUFFICIENT, NO_RELATIONSHIP

# The transformations tried and the support they need.
WORD = "[A-Za-z0-9]+"
CASES = ("as_is", "lower", "upper")
DELIMITERS = ("", ".", "_", "-", " ")
MIN_PAIRS = 3

#: Pairs of columns in one aggregate.
_CHUNK = 32

Source = str | tuple[str, ...]

_HYPOTHESES = "array<struct<case:string,delimiter:string,prefix:string,suffix:string>>"


def _label(source: Source) -> str:
    return source if isinstance(source, str) else ",".join(source)


def _source_text(df: DataFrame, source: Source) -> Column:
    """Several source columns are joined with a space, blank ones left out."""
    parts = [source] if isinstance(source, str) else list(source)
    return F.concat_ws(" ", *[F.nullif(text.strip(text.canonical_of(df.schema, p)), F.lit("")) for p in parts])


def _words(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(WORD), F.lit(0))


def _core(source: Column, case: str, delimiter: str) -> Column:
    joined = F.array_join(_words(source), delimiter)
    return {"as_is": joined, "lower": F.lower(joined), "upper": F.upper(joined)}[case]


def _core_of(source: Column, h: Column) -> Column:
    """The same for a hypothesis held in a column."""
    joined = F.call_function("array_join", _words(source), h["delimiter"])
    return F.when(h["case"] == "lower", F.lower(joined)).when(h["case"] == "upper", F.upper(joined)).otherwise(joined)


def _all_readings(source: Column, target: Column) -> Column:
    """Every (case, delimiter, prefix, suffix) that turns the source into the target."""
    def readings(case: str, delimiter: str) -> Column:
        core = _core(source, case, delimiter)
        starts = F.when(
            F.length(core) <= F.length(target), F.sequence(F.lit(1), F.length(target) - F.length(core) + 1)
        ).otherwise(F.array().cast("array<int>"))
        here = F.filter(starts, lambda i: F.substr(target, i, F.length(core)) == core)
        return F.transform(here, lambda i: F.struct(
            F.lit(case).alias("case"), F.lit(delimiter).alias("delimiter"),
            F.substr(target, F.lit(1), i - 1).alias("prefix"),
            F.substr(target, i + F.length(core)).alias("suffix")))

    found = [readings(case, delimiter) for case in CASES for delimiter in DELIMITERS]
    return F.concat(*found).cast(_HYPOTHESES)


def _anchors(frame: DataFrame, pairs: Sequence[tuple[int, tuple[int, int]]]) -> DataFrame:
    """One row per numbered (target, source text) pair: counts, whether any transformation fits, and a short example."""
    rows, stats = [], []
    for p, (target, source) in pairs:
        s, t = F.col(f"_s{source}"), F.col(f"_t{target}")
        valid = t.isNotNull() & s.rlike("[A-Za-z0-9]")
        # Every core begins with the first word, so most contradictions are seen without building one.
        first = F.lower(F.regexp_extract(s, WORD, 0))
        fits = F.contains(F.lower(t), first) & reduce(lambda a, b: a | b, [
            F.contains(t, _core(s, c, d)) for c in CASES for d in DELIMITERS])
        stats += [
            F.count_if(valid).alias(f"n{p}"), F.bool_or(F.when(valid, fits)).alias(f"a{p}"),
            F.min(F.when(valid, F.struct(F.length(t).alias("l"), t.alias("t"), s.alias("s")))).alias(f"p{p}")]
        rows.append(F.struct(
            F.lit(p).alias("pair"), F.col(f"n{p}").alias("pairs"),
            F.coalesce(F.col(f"a{p}"), F.lit(False)).alias("any_fit"), F.col(f"p{p}").alias("anchor")))
    return frame.agg(*stats).select(F.inline(F.array(*rows)))


def learn_for_columns(training: DataFrame, targets: Mapping[str, Sequence[Source]], closed: str | None = None) -> DataFrame:
    """One row per target and source: the transformations that reproduce every training pair.

    Two passes whatever the number of targets. The first consists of ungrouped aggregates (one per ``_CHUNK`` pairs
    of columns) that count pairs and pick a short anchor pair; a transformation without any contradiction must
    reproduce the anchor, so the anchor yields all of them. The second checks those few against every pair with
    map-side combining. ``closed`` names an array column: the targets for which a row teaches nothing. With it
    the texts are written first, because finding the closed rows takes a join.
    """
    texts = list(dict.fromkeys(s for sources in targets.values() for s in sources))
    goals = []
    for j, target in enumerate(targets):
        goal = text.canonical_of(training.schema, target)
        usable = ~text.is_blank(goal)
        if closed is not None:
            usable = usable & ~F.coalesce(F.array_contains(closed, target), F.lit(False))
        goals.append(F.when(usable, goal).alias(f"_t{j}"))
    frame = training.select(*goals, *[_source_text(training, s).alias(f"_s{k}") for k, s in enumerate(texts)])
    if closed is not None:
        frame = written(frame)
    named = [(j, target, i, source) for j, (target, sources) in enumerate(targets.items()) for i, source in enumerate(sources)]
    pairs = list(enumerate((j, texts.index(source)) for j, _, _, source in named))
    anchors = reduce(DataFrame.unionByName, [_anchors(frame, pairs[at:at + _CHUNK]) for at in range(0, len(pairs), _CHUNK)])
    guessed = anchors.select("pair", F.explode(_all_readings(F.col("anchor.s"), F.col("anchor.t"))).alias("h"))
    guesses = guessed.groupBy("pair").agg(F.collect_set("h").alias("hs"))
    cells = F.array(*[F.struct(F.lit(p).alias("pair"), F.col(f"_t{j}").alias("_t"), F.col(f"_s{k}").alias("s"))
                      for p, (j, k) in pairs])
    tried = frame.select(F.inline(cells)).where(F.col("_t").isNotNull() & F.col("s").rlike("[A-Za-z0-9]"))
    # One row per pair of columns.
    checked = tried.join(F.broadcast(guesses), "pair").select("pair", "_t", "s", F.explode("hs").alias("h"))
    core = _core_of(F.col("s"), F.col("h"))
    perfect = (
        checked.groupBy("pair", "h").agg(
            F.bool_and(F.concat(F.col("h.prefix"), core, F.col("h.suffix")) == F.col("_t")).alias("always"),
            # Some pair must show it at the first place its words occur.
            F.bool_or(F.instr(F.col("_t"), core) == F.length(F.col("h.prefix")) + 1).alias("leading"))
        .where(F.col("always") & F.col("leading"))
        .groupBy("pair").agg(F.array_sort(F.collect_list("h")).alias("templates")))
    about = F.get(F.array(*[F.struct(
        F.lit(i).alias("source"), F.lit(target).alias("target_column"), F.lit(_label(source)).alias("source_column"),
        F.lit(texts.index(source)).alias("text")) for _, target, i, source in named]), F.col("pair"))
    out = anchors.select("pair", "pairs", "any_fit").join(F.broadcast(perfect), "pair", "left").withColumn("about", about)
    status = (F.when(F.col("pairs") < MIN_PAIRS, INSUFFICIENT).when(~F.col("any_fit"), NO_RELATIONSHIP)
              .when(F.col("templates").isNull(), AMBIGUOUS).otherwise(CANDIDATE))
    return out.select(
        "about.*", F.col("pairs").alias("observed_pairs_count"), status.alias("learned"),
        F.when(F.col("pairs") >= MIN_PAIRS, F.col("templates")).alias("templates"))


def learn_templates(training: DataFrame, target: str, sources: Sequence[Source]) -> DataFrame:
    """:func:`learn_for_columns` for one target."""
    return learn_for_columns(training, {target: sources}).drop("text")


def template_evidence(training: DataFrame, failing: DataFrame, target: str, sources: Sequence[Source]) -> DataFrame:
    """A replacement for ``target`` per failing row (with issue_id) and source.

    ``training`` must not contain the failing rows or other rows under review
    for the same column (see :func:`training_rows`).
    """
    return template_evidence_for_columns(training, failing.withColumn("_column", F.lit(target)), {target: sources})


def template_evidence_for_columns(training: DataFrame, failing: DataFrame, targets: Mapping[str, Sequence[Source]],
                                  closed: str | None = None) -> DataFrame:
    """A replacement per failing row (with issue_id and ``_column``, its target) and source of that target.

    ``closed`` is as in :func:`learn_for_columns`; :func:`closed_targets` makes it.
    """
    learned = learn_for_columns(training, targets, closed)
    texts = list(dict.fromkeys(s for sources in targets.values() for s in sources))
    cells = F.array(*[F.struct(F.lit(k).alias("text"), _source_text(failing, s).alias("s"))
                      for k, s in enumerate(texts)])
    asked = failing.select("issue_id", F.col("_column").alias("target_column"), F.inline(cells))
    # One row per pair of columns.
    applied = asked.join(F.broadcast(learned), ["target_column", "text"]).withColumn(
        "predicted", F.transform("templates", lambda h: F.concat(
            h["prefix"], _core_of(F.col("s"), h), h["suffix"])))
    top = F.get("templates", F.lit(0))
    value = F.get("predicted", F.lit(0))
    status = (F.when(F.col("learned") != CANDIDATE, F.col("learned"))
              .when(~F.col("s").rlike("[A-Za-z0-9]"), NO_RELATIONSHIP)
              .when(F.exists("predicted", lambda p: p != value), AMBIGUOUS).otherwise(CANDIDATE))
    best = F.col("status") == CANDIDATE
    return applied.withColumn("status", status).select(
        "issue_id", "target_column", "source_column", "status", "observed_pairs_count",
        F.when(best, F.lit("STRING_TEMPLATE")).alias("strategy"),
        F.when(best, value).alias("candidate_value"),
        F.when(best, top["case"]).alias("case_transform"), F.when(best, top["delimiter"]).alias("delimiter"),
        F.when(best, top["prefix"]).alias("prefix"), F.when(best, top["suffix"]).alias("suffix"),
        F.when(best, F.col("observed_pairs_count")).alias("supporting_count"),
        F.when(best, F.lit(0).cast("bigint")).alias("contradicting_count"),
        F.when(best, F.least(F.lit(1.0), F.col("observed_pairs_count") / F.lit(2.0 * MIN_PAIRS))).alias("confidence"))


def closed_targets(df: DataFrame, record_ref: Column, issues: DataFrame, targets: Collection[str]) -> DataFrame:
    """Adds ``_closed``: the targets on which the row has an open issue (null: none)."""
    open_ = issues.where(F.col("column_name").isin(*targets) & F.col("record_ref").isNotNull()).groupBy(
        F.col("record_ref").alias("_ref")).agg(F.collect_set("column_name").alias("_closed"))
    return join_small(df.withColumn("_ref", record_ref), open_, ["_ref"], "left").drop("_ref")


def training_rows(df: DataFrame, record_ref: Column, issues: DataFrame, target: str) -> DataFrame:
    """Rows without an open issue on ``target``."""
    under_review = issues.where(F.col("column_name") == target).select(F.col("record_ref").alias("_ref"))
    return keep_matching(df.withColumn("_ref", record_ref), under_review, "_ref", matching=False).drop("_ref")
