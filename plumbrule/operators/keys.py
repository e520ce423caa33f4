"""Business-key discovery and confirmation.

Discovery walks the lattice of column combinations by width and reads the table a few times, however
many combinations there are. One scan gives the NULL and distinct counts of single columns as sketches;
a combination with a NULL part, or whose narrower parts cannot tell all rows apart, is out. One sketch each,
again in one scan, bounds the rest of a width. Those that may be unique after that are searched for a repeated key in
one hash slice of a large table, which rules out most; what is left is counted exactly, all in one shuffle of hashed keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from typing import Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from plumbrule.functions.repeats import complete_counts, complete_hashes, complete_keys, key_hashes
from plumbrule.spec import DATE, DATETIME, INTEGER, STRING, KeySpec, SpecError, normalized_of

# Key search limits and verdicts.
ELIGIBLE_TYPES = (STRING, INTEGER, DATE, DATETIME)
MAX_WIDTH = 3
MIN_ROWS = 2
VERIFIED, SAMPLED, AMBIGUOUS, NONE = "VERIFIED_UNIQUE", "SAMPLE_CANDIDATE", "AMBIGUOUS", "NO_CANDIDATE"
DISCOVERY_SAMPLE_ROWS = 5_000


#: Sketches of 2**12 registers err by 1.6 percent; a combination is out when even six such errors more leave it below the rows.
SKETCH_SIZE, SKETCH_ERROR = 12, 0.016
#: Sketches of one scan, 4 KB each.
SKETCHES_PER_SCAN = 512
EXACT, ESTIMATED = "EXACT", "ESTIMATED"
#: Keys of which fewer than so many rows share one, on average, are not combined before a shuffle.
MOSTLY_UNIQUE = 2

#: A hash slice of the keys is searched for a repeated one first: of so many rows, but one slice of at most so many.
MAX_SLICES, ROWS_PER_SLICE = 64, 100_000
#: Combinations whose keys are formed in one pass, few enough for compiled code.
COMBOS_PER_PASS = 8


def combo_evidence(df: DataFrame, combos: Sequence[Sequence[str]], is_full_scan: bool = True) -> DataFrame:
    """Uniqueness evidence for several column combinations: one scan, then one count of their hashed keys.

    The scan, done at once, counts complete keys and bounds the distinct ones by sketches. Combinations whose keys repeat
    are combined before the shuffle, the others are not (see :func:`plumbrule.functions.repeats.complete_counts`).
    """
    keys = dict(enumerate(tuple(c) for c in combos))
    total, complete, distinct = _scanned(df, list(keys.values()))
    many = {o: c for o, c in keys.items() if distinct[o] * MOSTLY_UNIQUE < complete[o]}
    found = complete_counts(df, many, {o: c for o, c in keys.items() if o not in many}).groupBy("o").agg(
        F.count(F.lit(1)).alias("d"), F.count_if(F.col("n") > 1).alias("r"))
    # One row per combination.
    about = df.sparkSession.createDataFrame(
        [(o, list(c), len(c), total, total - complete[o]) for o, c in keys.items() if total],
        "o int, key_columns array<string>, width int, total_rows_evaluated bigint, null_key_rows bigint")
    has_null, has_repeat = F.col("null_key_rows") > 0, F.col("duplicate_key_groups") > 0
    reason = (F.when(has_null & has_repeat, "contains_null_values_and_duplicate_values")
              .when(has_null, "contains_null_values").when(has_repeat, "duplicate_values"))
    return about.join(found, "o", "left").select(
        "*", F.coalesce("d", F.lit(0)).alias("distinct_key_count"), F.coalesce("r", F.lit(0)).alias("duplicate_key_groups")).select(
        "key_columns", "width", F.when(reason.isNull(), "CANDIDATE").otherwise("REJECTED").alias("status"), reason.alias("reason"),
        "total_rows_evaluated", "null_key_rows", "distinct_key_count", "duplicate_key_groups",
        F.when(reason.isNull(), F.lit(VERIFIED if is_full_scan else SAMPLED)).alias("verification_level"))


@dataclass(frozen=True)
class KeyDiscovery:
    """``evaluated``: a row of evidence per combination that was looked at (see :data:`EVIDENCE`)."""

    status: str
    recommended: tuple[str, ...] | None
    candidates: tuple[tuple[str, ...], ...]
    evaluated: tuple[Row, ...]
    rejected_columns: tuple[str, ...]
    widths_searched: tuple[int, ...]
    total_rows: int
    is_full_scan: bool
    reason: str | None = None


#: ``counted`` tells exact counts from estimates; an estimated combination was ruled out without being counted.
EVIDENCE = Row("key_columns", "width", "status", "reason", "total_rows_evaluated", "null_key_rows", "distinct_key_count",
               "duplicate_key_groups", "verification_level", "counted")
_EVIDENCE_SCHEMA = ("key_columns array<string>, width int, status string, reason string, total_rows_evaluated bigint, "
                    "null_key_rows bigint, distinct_key_count bigint, duplicate_key_groups bigint, verification_level string, counted string")


def eligible_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if normalized_of(f) in ELIGIBLE_TYPES]


def _sketched(df: DataFrame, combos: Sequence[Sequence[str]]) -> list[int]:
    """About how many distinct keys each combination has."""
    out: list[int] = []
    for k in range(0, len(combos), SKETCHES_PER_SCAN):
        part = combos[k:k + SKETCHES_PER_SCAN]
        row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(key_hashes(df.schema, c)[0], F.lit(SKETCH_SIZE))).alias(f"c{i}")
                       for i, c in enumerate(part)]).first()
        out += list(row)
    return out


def _scanned(df: DataFrame, combos: Sequence[Sequence[str]]) -> tuple[int, list[int], list[int]]:
    """Rows, complete keys of each combination, and about how many of those are distinct."""
    total, complete, distinct = 0, [], []
    for k in range(0, len(combos), SKETCHES_PER_SCAN):
        hashes = [complete_hashes(df.schema, c)[0] for c in combos[k:k + SKETCHES_PER_SCAN]]
        row = df.agg(F.count(F.lit(1)), *[F.count(h) for h in hashes],
                     *[F.hll_sketch_estimate(F.hll_sketch_agg(h, F.lit(SKETCH_SIZE))) for h in hashes]).first()
        total = row[0]
        complete += row[1:len(hashes) + 1]
        distinct += row[len(hashes) + 1:]
    return total, complete, distinct


def _refuted(df: DataFrame, combos: Sequence[tuple[str, ...]], total: int) -> set[tuple[str, ...]]:
    """Combinations of which some key repeats within one hash slice of the keys: all rows of a key fall into the same slice."""
    slices = min(MAX_SLICES, total // ROWS_PER_SLICE)
    if slices < 2 or not combos:
        return set()
    keys = list(enumerate(combos))
    passes = [complete_keys(df, dict(keys[k:k + COMBOS_PER_PASS])) for k in range(0, len(keys), COMBOS_PER_PASS)]
    held = reduce(DataFrame.unionByName, passes).where(F.pmod("k1", F.lit(slices)) == 0)
    found = held.groupBy("o", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("o").distinct()
    return {combos[r["o"]] for r in found.collect()}


def _exact(df: DataFrame, combos: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], tuple[int, int]]:
    """(distinct keys, keys that repeat) of combinations whose keys hardly repeat, all counted in one shuffle."""
    if not combos:
        return {}
    counted = complete_counts(df, {}, dict(enumerate(combos))).groupBy("o").agg(
        F.count(F.lit(1)).alias("d"), F.count_if(F.col("n") > 1).alias("r"))
    found = {combos[r["o"]]: (r["d"], r["r"]) for r in counted.collect()}
    return {c: found.get(c, (0, 0)) for c in combos}


def _room(combo: tuple[str, ...], most: dict[tuple[str, ...], int]) -> int:
    """No more keys than this: what any split into narrower combinations allows."""
    parts = [(combo[:i] + combo[i + 1:], combo[i:i + 1]) for i in range(len(combo))]
    return min((most[a] * most[b] for a, b in parts if a in most and b in most), default=0)


def discover_keys(
    df: DataFrame, is_full_scan: bool = True, max_width: int = MAX_WIDTH, decisive_only: bool = True
) -> KeyDiscovery:
    """Smallest unique column combinations, width by width, stopping at the first hit.

    Only columns of the normalized types in :data:`ELIGIBLE_TYPES` take part, so free text does not
    (see :func:`plumbrule.spec.normalized_of`). ``decisive_only=False`` counts every combination of the
    widths searched exactly, for reports on narrow tables; the verdict is the same.
    """
    names = eligible_columns(df)
    rejected = tuple(c for c in df.columns if c not in names)
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(names)]).first()
    total = row["total"]
    nulls = {c: total - row[f"n{i}"] for i, c in enumerate(names)}
    level = VERIFIED if is_full_scan else SAMPLED

    def none(reason: str, evaluated: list[Row], widths: list[int]) -> KeyDiscovery:
        return KeyDiscovery(NONE, None, (), tuple(evaluated), rejected, tuple(widths), total, is_full_scan, reason)

    if total < MIN_ROWS:
        return none("insufficient_row_count", [], [])
    if not names:
        return none("no_eligible_columns", [], [])

    slack = 1 + 6 * SKETCH_ERROR
    most: dict[tuple[str, ...], int] = {}
    evaluated: list[Row] = []
    widths: list[int] = []
    for width in range(1, min(max_width, len(names)) + 1):
        widths.append(width)
        combos = list(combinations(names, width))
        if decisive_only:
            # Whatever a NULL column is part of is no key; neither is what its parts cannot make unique.
            known = [c for c in combos if width == 1 or (not any(nulls[x] for x in c) and _room(c, most) >= total)]
            # A combination that is not sketched is not looked up by wider ones either, as those have no more room than rows.
            estimates = dict(zip(known, _sketched(df, known), strict=True))
            most |= {c: int(n * slack) + 1 for c, n in estimates.items()}
            open_ones = [c for c in known if not any(nulls[x] for x in c) and most[c] >= total]
            refuted = _refuted(df, open_ones, total)
            found = _exact(df, [c for c in open_ones if c not in refuted])
            for c in known:
                gaps = nulls[c[0]] if width == 1 else 0
                if c in found:
                    distinct, repeats = found[c]
                    most[c] = distinct
                    reason = "duplicate_values" if repeats else None
                    evaluated.append(EVIDENCE(list(c), width, "REJECTED" if reason else "CANDIDATE", reason, total, 0, distinct, repeats,
                                              None if reason else level, EXACT))
                else:
                    reason = "contains_null_values" if gaps else "duplicate_values"
                    evaluated.append(EVIDENCE(list(c), width, "REJECTED", reason, total, gaps, estimates[c], None, None, ESTIMATED))
        else:
            # One row per combination, however large the table.
            evaluated += [EVIDENCE(*r, EXACT) for r in combo_evidence(df, combos, is_full_scan).orderBy("key_columns").collect()]
        hits = tuple(sorted(tuple(r["key_columns"]) for r in evaluated if r["status"] == "CANDIDATE"))
        if len(hits) == 1:
            return KeyDiscovery(level, hits[0], hits, tuple(evaluated), rejected, tuple(widths), total, is_full_scan)
        if hits:
            return KeyDiscovery(AMBIGUOUS, None, hits, tuple(evaluated), rejected, tuple(widths), total,
                                is_full_scan, "multiple_equally_minimal_verified_candidates")
    return none("no_defensible_candidate_up_to_max_width", evaluated, widths)


def evidence_table(spark: SparkSession, found: KeyDiscovery) -> DataFrame:
    """The evidence of a discovery as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in found.evaluated], _EVIDENCE_SCHEMA)


def confirm_key(df: DataFrame, columns: Sequence[str], declared: KeySpec = KeySpec()) -> KeySpec:
    """Adopt a discovered key only while it is still the verified one on the current data."""
    if declared.is_reliable:
        raise SpecError("the dataset already has a reliable key")
    if not columns:
        raise SpecError("a key needs at least one column")
    found = discover_keys(df)
    if found.status != VERIFIED:
        raise SpecError(f"no key can be adopted now ({found.status})")
    if found.recommended != tuple(columns):
        raise SpecError(f"the verified key is now {found.recommended}, not {tuple(columns)}")
    return KeySpec(found.recommended)
