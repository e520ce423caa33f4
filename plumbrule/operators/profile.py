"""Column profiles of a whole table.

Everything that depends on repetition comes from one frequency table: a single
shuffle with map-side combining serves the distinct counts, modes, top values,
quartiles and outliers of all columns, and Spark reuses its exchange for each of
them. Values keep their type in it: numbers, dates and times travel as fixed-width
numbers, and a text as its first 100 characters, with a digest where it is longer.
Lengths, blanks and text extremes need no grouping and come from one ungrouped
aggregate.

Quartiles are exact without sorting a column in one task: an approximate
sketch only draws bucket borders, the counts per bucket locate the wanted
ranks, and only the few buckets holding a wanted rank are ordered.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import add
from typing import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from plumbrule.functions import text
from plumbrule.functions.storage import written
from plumbrule.functions.text import canonical_of
from plumbrule.spec import NUMERIC_TYPES, TEMPORAL_TYPES, TEXT_TYPES, normalized_type

# Top-value limits.
MAX_TOP_VALUES = 10
MAX_TOP_VALUE_LENGTH = 100

# Few enough borders for the generated comparison code to be compiled by the JVM.
_BORDERS = 16
_SLICES = 512

PROFILE_COLUMNS = (
    "column_name", "normalized_data_type", "null_count", "null_percentage", "distinct_count",
    "distinct_percentage", "duplicate_count", "duplicate_percentage", "min_value", "max_value",
    "mean_value", "median_value", "mode_value", "min_length", "max_length", "avg_length",
    "outlier_count", "stddev_value", "sum_value", "value_distribution", "pattern_summary",
)


#: Grouping columns of the frequency table besides the column's position; a value fills one of the first three, or
#: the last two, and NULL none.
_WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_KEYS = {"whole": "bigint", "num": "double", "at": "timestamp_ntz", "head": "string", "digest": "string"}


def _key_parts(schema: T.StructType, name: str) -> dict[str, Column]:
    """The value as fixed-width columns, or as the head of its text and a digest of longer text."""
    c, kind = F.col(name), schema[name].dataType
    if isinstance(kind, _WHOLE_TYPES):
        return {"whole": c.cast("bigint")}
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return {"whole": (c * F.lit(10 ** kind.scale).cast("decimal(19,0)")).cast("bigint")}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # As a float is written, so that it equals what it is read as.
        return {"num": c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c}
    if isinstance(kind, T.DateType):
        return {"whole": F.unix_date(c).cast("bigint")}
    if isinstance(kind, T.TimestampType):
        return {"whole": F.unix_micros(c)}
    if isinstance(kind, T.TimestampNTZType):
        return {"at": c}
    v = canonical_of(schema, name)
    return {"head": F.substring(v, 1, MAX_TOP_VALUE_LENGTH),
            "digest": F.when(F.length(v) > MAX_TOP_VALUE_LENGTH, F.md5(v))}


def _shown(schema: T.StructType, name: str) -> Column:
    """The text of a grouped value, cut to 100 characters."""
    kind = schema[name].dataType
    if isinstance(kind, _WHOLE_TYPES):
        return F.col("whole").cast("string")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return _decimal(kind).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.col("num").cast("string")
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.col("whole").cast("int")).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros("whole").cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.col("at").cast("string")
    return F.col("head")


def _decimal(kind: T.DecimalType) -> Column:
    return (F.col("whole").cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-kind.scale))).cast(kind)


def _number(schema: T.StructType, name: str) -> Column | None:
    """The grouped value of a numeric column as double."""
    kind = schema[name].dataType
    if isinstance(kind, _WHOLE_TYPES):
        return F.col("whole").cast("double")
    if isinstance(kind, T.DecimalType):
        return (_decimal(kind) if kind.precision <= 18 else F.col("head")).cast("double")
    return F.col("num") if isinstance(kind, (T.FloatType, T.DoubleType)) else None


def _of_column(columns: Sequence[Column | None], kind: str) -> Column:
    """The expression that belongs to the row's column; columns with the same expression share a test."""
    chosen: dict[str, tuple[Column, list[int]]] = {}
    for i, c in enumerate(columns):
        if c is not None:
            chosen.setdefault(str(c), (c, []))[1].append(i)
    out = F.lit(None).cast(kind)
    for c, at in chosen.values():
        out = F.when(F.col("c").isin(at), c).otherwise(out)
    return out


def typed_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The frequency table: column position, the value in the columns of its type (none for NULL), count."""
    names = list(columns or df.columns)
    cells = []
    for i, name in enumerate(names):
        parts = _key_parts(df.schema, name)
        cells.append(F.struct(F.lit(i).alias("c"), *[
            (parts[k] if k in parts else F.lit(None)).cast(kind).alias(k) for k, kind in _KEYS.items()]))
    return df.select(F.inline(F.array(*cells))).groupBy("c", *_KEYS).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(c, value, n): column position, value as text cut to 100 characters (NULL included), count."""
    names = list(columns or df.columns)
    return typed_counts(df, names).select("c", _of_column([_shown(df.schema, n) for n in names], "string").alias("value"), "n")


def _by_position(values: Sequence[object], kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("c"))


def quartiles(numbers: DataFrame) -> DataFrame:
    """Exact linear-interpolated quartiles per ``c`` from (c, num, n); NULL numbers are ignored."""
    levels = [i / _BORDERS for i in range(1, _BORDERS)]
    borders = numbers.groupBy("c").agg(
        F.percentile_approx("num", levels, 1000).alias("b"),
        F.min("num").alias("lo"), F.max("num").alias("hi"))
    # At most one row of _BORDERS + 1 numbers per column.
    placed = numbers.join(F.broadcast(borders), "c")
    # Straight-line comparisons compile; a lambda over the array would be interpreted.
    slot = reduce(add, [F.when(F.get("b", F.lit(i)) < F.col("num"), 1).otherwise(0) for i in range(_BORDERS - 1)])
    low = F.when(F.col("slot") == 0, F.col("lo")).otherwise(F.get("b", F.col("slot") - 1))
    high = F.when(F.col("slot") == _BORDERS - 1, F.col("hi")).otherwise(F.get("b", F.col("slot")))
    share = (F.col("num") - F.col("low")) / (F.col("high") - F.col("low"))
    fine = F.when(F.col("high") > F.col("low"),
                  F.least(F.floor(share * _SLICES), F.lit(_SLICES - 1))).otherwise(F.lit(0))
    placed = (
        placed.select("c", "num", "n", "b", "lo", "hi", F.when(F.col("num").isNotNull(), slot).alias("slot"))
        .select("c", "num", "n", "slot", low.alias("low"), high.alias("high"))
        # Never NULL: an inferred IS NOT NULL would be pushed down and repeat this expression.
        .select("c", "num", "n", F.coalesce((F.col("slot") * _SLICES + fine).cast("int"), F.lit(-1))
                .alias("bucket")))
    # At most _BORDERS * _SLICES buckets per column.
    filled = placed.groupBy("c", "bucket").agg(
        F.sum("n").alias("m"), F.count("num").alias("present")).where(F.col("present") > 0)
    running = W.partitionBy("c").orderBy("bucket")
    ranked = filled.select(
        "c", "bucket", "m",
        (F.sum("m").over(running) - F.col("m")).alias("before"),
        F.sum("m").over(W.partitionBy("c")).alias("total"))
    wanted_ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(text.int_div((F.col("total") - 1) * q, F.lit(4)),
                text.int_div((F.col("total") - 1) * q + 3, F.lit(4))) for q in (1, 2, 3)])))
    wanted = ranked.select(
        "c", "bucket", "before", "total",
        F.filter(wanted_ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m"))).alias("ranks"),
    ).where(F.size("ranks") > 0)
    # At most six buckets per column are wanted.
    inside = placed.join(F.broadcast(wanted), ["c", "bucket"]).select(
        "c", "num", "n", "ranks", "total",
        (F.col("before") + F.sum("n").over(W.partitionBy("c", "bucket").orderBy("num")) - F.col("n")).alias("start"))
    hit = inside.select("c", "num", "total", F.explode(F.filter(
        "ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))).alias("rank"))
    sides = hit.groupBy("c").agg(F.max("total").alias("total"), *[
        F.max(F.when(F.col("rank") == text.int_div((F.col("total") - 1) * q + up, F.lit(4)), F.col("num")))
        .alias(f"v{q}{side}") for q in (1, 2, 3) for side, up in (("f", 0), ("c", 3))])

    def interpolated(q: int) -> Column:
        part = ((F.col("total") - 1) * q % 4) / F.lit(4.0)
        return F.when(part == 0, F.col(f"v{q}f")).otherwise(
            F.col(f"v{q}f") * (1 - part) + F.col(f"v{q}c") * part)

    return sides.select("c", interpolated(1).alias("q1"), interpolated(2).alias("median"),
                        interpolated(3).alias("q3"))


def profile(df: DataFrame, columns: Sequence[str] | None = None, include_top_values: bool = True,
            exact: bool = True) -> DataFrame:
    """One row per column with :data:`PROFILE_COLUMNS`.

    ``exact`` is reported in ``pattern_summary``: false when ``df`` is a sample.
    """
    names = list(columns or df.columns)
    kinds = [normalized_type(df.schema[n].dataType) for n in names]
    numeric = [k in NUMERIC_TYPES for k in kinds]
    has_numbers = any(numeric)

    freq = typed_counts(df, names).where(F.col("n") > 0)
    known = reduce(lambda x, y: x | y, [F.col(k).isNotNull() for k in _KEYS])
    parsed = freq.select(
        "c", known.alias("known"), "head", "digest", "n", _of_column([_number(df.schema, n) for n in names], "double").alias("num"))
    # NaN sorts above infinity, so one comparison per side leaves only finite numbers.
    finite = (F.col("num") < F.lit(float("inf"))) & (F.col("num") > F.lit(float("-inf")))
    numbers = parsed.select("c", "known", "head", "digest", "n", F.when(finite, F.col("num")).alias("num"))

    # The mode is the first of (count desc, value asc).
    counts = numbers.groupBy("c").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if("known").alias("distinct_count"),
        F.sum(F.when(F.col("num").isNotNull(), F.col("n"))).alias("num_n"),
        F.sum(F.col("num") * F.col("n")).alias("num_sum"),
        F.min("num").alias("num_min"), F.max("num").alias("num_max"),
        F.min(F.when(F.col("known"), F.struct((-F.col("n")).alias("less"), "num", "head", F.col("digest").isNotNull().alias("cut"))))
        .alias("first")).select("*", F.col("first.num").alias("mode_num"), F.col("first.head").alias("mode_text"))

    out = counts.join(F.broadcast(_text_stats(df, names, kinds)), "c")
    long = [i for i, k in enumerate(kinds) if k in TEXT_TYPES]
    if long:
        out = out.join(F.broadcast(_cut_modes(df, names, long, counts)), "c", "left").withColumn(
            "mode_text", F.coalesce("mode_whole", "mode_text"))
    if has_numbers:
        fences = quartiles(numbers.select("c", "num", "n")).select(
            "c", "q1", "median", "q3",
            (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"),
            (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
        # One row per column.
        about = counts.select("c", (F.col("num_sum") / F.col("num_n")).alias("mean")).join(fences, "c")
        spread = numbers.join(F.broadcast(about), "c").groupBy("c").agg(
            F.sum(F.pow(F.col("num") - F.col("mean"), 2) * F.col("n")).alias("num_m2"),
            F.coalesce(F.sum(F.when((F.col("num") < F.col("low")) | (F.col("num") > F.col("high")), F.col("n"))),
                       F.lit(0)).alias("outside"),
            F.max("median").alias("median"))
        out = out.join(spread, "c", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(x) for x in ("num_m2", "outside", "median")])
    if include_top_values:
        shown = freq.select("c", _of_column([_shown(df.schema, n) for n in names], "string").alias("value"), "n")
        out = out.join(top_values(shown), "c", "left")
    else:
        out = out.withColumn("value_distribution", F.lit(None).cast("array<struct<value:string,count:bigint>>"))

    total, nulls, distinct = F.col("total"), F.col("null_count"), F.col("distinct_count")
    is_num = _by_position(numeric, "boolean") & F.col("num_n").isNotNull()
    is_text = _by_position([k in TEXT_TYPES for k in kinds], "boolean") & (total > nulls)
    is_time = _by_position([k in TEMPORAL_TYPES for k in kinds], "boolean")
    repeated = F.greatest(F.lit(0), total - nulls - distinct)

    def pick(number: Column, words: Column, times: Column | None = None) -> Column:
        chosen = F.when(is_num, number.cast("string")).when(is_text, words)
        return chosen.when(is_time, times) if times is not None else chosen

    return out.select(
        _by_position(names, "string").alias("column_name"),
        _by_position(kinds, "string").alias("normalized_data_type"),
        F.col("c").alias("ordinal"), F.col("total").alias("row_count"),
        nulls.alias("null_count"), text.percent(nulls, total).alias("null_percentage"),
        distinct.alias("distinct_count"), text.percent(distinct, total).alias("distinct_percentage"),
        repeated.alias("duplicate_count"), text.percent(repeated, total).alias("duplicate_percentage"),
        pick(F.col("num_min"), F.col("text_min"), F.col("text_min")).alias("min_value"),
        pick(F.col("num_max"), F.col("text_max"), F.col("text_max")).alias("max_value"),
        F.when(is_num, text.rounded(F.col("num_sum") / F.col("num_n"), 6)).alias("mean_value"),
        F.when(is_num, text.rounded(F.col("median"), 6)).alias("median_value"),
        pick(F.col("mode_num"), F.col("mode_text")).alias("mode_value"),
        F.when(is_text, F.col("length_min")).alias("min_length"),
        F.when(is_text, F.col("length_max")).alias("max_length"),
        F.when(is_text, text.rounded_ratio(F.col("length_sum"), total - nulls)).alias("avg_length"),
        F.when(is_num, F.when(F.col("num_n") < 4, F.lit(0)).otherwise(F.col("outside"))).cast("bigint")
        .alias("outlier_count"),
        F.when(is_num, text.rounded(F.sqrt(F.col("num_m2") / F.col("num_n")), 6)).alias("stddev_value"),
        F.when(is_num, F.round("num_sum", 6)).alias("sum_value"),
        F.col("value_distribution"),
        F.struct(F.lit(exact).alias("exact_stats"), F.col("blank_count").alias("blank_count"),
                 F.coalesce(text.percent(F.col("blank_count"), total), F.lit(0.0)).alias("blank_percentage"))
        .alias("pattern_summary"))


def _cut_modes(df: DataFrame, names: Sequence[str], texts: Sequence[int], counts: DataFrame) -> DataFrame:
    """(c, mode_whole) of the text columns whose mode is longer than what the frequency table holds.

    Only rows that begin like the mode are looked at again: their texts are counted by digest, and the lowest
    text of the most frequent ones is the mode.
    """
    # One row per text column.
    begins = F.broadcast(counts.where(F.col("first.cut")).select("c", F.col("first.head").alias("_head")))
    cells = F.array(*[F.struct(F.lit(i).alias("c"), canonical_of(df.schema, names[i]).alias("v")) for i in texts])
    again = df.select(F.inline(cells)).where(F.length("v") > MAX_TOP_VALUE_LENGTH).join(
        begins, ["c"]).where(F.substring("v", 1, MAX_TOP_VALUE_LENGTH) == F.col("_head"))
    counted = again.groupBy("c", F.md5("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    return counted.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("less"), "v")).alias("m")).select(
        "c", F.col("m.v").alias("mode_whole"))


def _text_stats(df: DataFrame, names: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Extremes, lengths and blanks per column: one ungrouped aggregate, one row per column."""
    measured: list[Column] = []
    for i, (name, kind) in enumerate(zip(names, kinds)):
        if kind in TEXT_TYPES:
            c = canonical_of(df.schema, name)
            measured += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                         F.min(F.length(c)).alias(f"la{i}"), F.max(F.length(c)).alias(f"lb{i}"),
                         F.sum(F.length(c)).alias(f"ls{i}"), F.count_if(c.rlike(r"^\s*$")).alias(f"bl{i}")]
        elif kind in TEMPORAL_TYPES:
            c = F.col(name)
            measured += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    one = df.agg(*(measured or [F.count(F.lit(1)).alias("unused")]))

    def cell(prefix: str, i: int, kind: str, type_name: str) -> Column:
        present = kind in TEXT_TYPES or (kind in TEMPORAL_TYPES and prefix in ("lo", "hi"))
        return (F.col(f"{prefix}{i}") if present else F.lit(None)).cast(type_name)

    return one.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("c"),
        cell("lo", i, k, "string").alias("text_min"), cell("hi", i, k, "string").alias("text_max"),
        cell("la", i, k, "int").alias("length_min"), cell("lb", i, k, "int").alias("length_max"),
        cell("ls", i, k, "bigint").alias("length_sum"),
        F.coalesce(cell("bl", i, k, "bigint"), F.lit(0).cast("bigint")).alias("blank_count"))
        for i, k in enumerate(kinds)])))


def top_values(freq: DataFrame) -> DataFrame:
    """The most frequent values per column, cut to 100 characters before counting."""
    cut = (
        freq.groupBy("c", F.substring("value", 1, MAX_TOP_VALUE_LENGTH).alias("v"))
        .agg(F.sum("n").alias("n"), F.count("value").alias("present")).where(F.col("present") > 0))
    order = W.partitionBy("c").orderBy(F.desc("n"), F.asc("v"))
    best = cut.withColumn("r", F.row_number().over(order)).where(F.col("r") <= MAX_TOP_VALUES)
    return best.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(
        F.col("r"), F.col("v").alias("value"), F.col("n").alias("count")))).alias("t")).select(
        "c", F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))
        .alias("value_distribution"))


def dataset_duplicate_percentage(df: DataFrame) -> DataFrame:
    """Share of rows repeating an earlier full row; NULL for an empty table."""
    sizes = df.groupBy(text.row_digest(df.schema).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_rows"))
    return totals.select(
        "row_count", "distinct_rows", (F.col("row_count") - F.col("distinct_rows")).alias("duplicate_rows"),
        text.percent(F.col("row_count") - F.col("distinct_rows"), F.col("row_count")).alias("duplicate_percentage"))


COMPLETED, FAILED = "COMPLETED", "FAILED"


def profile_each(df: DataFrame, columns: Sequence[str] | None = None, include_top_values: bool = True,
                 exact: bool = True) -> DataFrame:
    """:func:`profile` with ``status`` and ``error``: a column that cannot be evaluated is one FAILED row.

    The columns are profiled together, and the result is written to the checkpoint folder at once, because a bad
    column shows only when it is evaluated. Where that fails, each half of the columns is read once by itself
    (no shuffle), and so on: k bad ones among n cost about 2 k log2(n) scans. The good ones are then profiled together.
    """
    names = list(columns or df.columns)
    errors: dict[str, str] = {}

    def probe(part: list[str]) -> None:
        try:
            df.agg(F.bit_xor(F.xxhash64(*[canonical_of(df.schema, n) for n in part]))).collect()
        except (PySparkException, Py4JError) as error:
            if len(part) == 1:
                errors[part[0]] = str(error).splitlines()[0]
            else:
                probe(part[:len(part) // 2])
                probe(part[len(part) // 2:])

    try:
        done = written(profile(df, names, include_top_values, exact))
    except (PySparkException, Py4JError):
        probe(names)
        good = [n for n in names if n not in errors]
        if not errors:
            raise
        done = written(profile(df.select(*[F.col(f"`{n}`") for n in good]), good, include_top_values, exact).withColumn(
            "ordinal", F.get(F.array(*[F.lit(names.index(n)) for n in good]), F.col("ordinal")))) if good else None
    failed = df.sparkSession.createDataFrame(
        [(names.index(n), n, normalized_type(df.schema[n].dataType), FAILED, e) for n, e in errors.items()],
        "ordinal int, column_name string, normalized_data_type string, status string, error string")
    if done is None:
        return failed
    return done.withColumns({"status": F.lit(COMPLETED), "error": F.lit(None).cast("string")}).unionByName(
        failed, allowMissingColumns=True)


def profile_run_summary(profiles: DataFrame, row_count_estimate: int | None, is_full_scan: bool) -> DataFrame:
    """Size of a profile run: the exact count after a full scan, the estimate after a sample.

    Profiles with a ``status`` (:func:`profile_each`) give the failed columns and a message about them as well.
    """
    tells = "status" in profiles.columns
    good = F.col("status") == COMPLETED if tells else F.lit(True)
    sampled = profiles.agg(F.max("row_count").alias("sample_size"), F.count_if(good).alias("columns_profiled"),
                           F.count_if(~good).alias("columns_failed"))
    rows = F.col("sample_size") if is_full_scan else F.lit(row_count_estimate).cast("bigint")
    failed = F.col("columns_failed")
    message = F.when(failed > 0, F.concat(
        F.col("columns_profiled").cast("string"), F.lit("/"), (F.col("columns_profiled") + failed).cast("string"),
        F.lit(" columns profiled, "), failed.cast("string"), F.lit(" failed")))
    return sampled.select("sample_size", rows.alias("row_count"), "columns_profiled", F.lit(is_full_scan).alias("is_full_scan"),
                          *([failed, message.alias("error_message")] if tells else []))


def steward_summary(profiles: DataFrame) -> DataFrame:
    """What a steward sees of each column: shares and lengths, no raw values."""
    return profiles.select(
        "column_name", "normalized_data_type", "null_percentage", "distinct_percentage",
        "duplicate_percentage", "min_length", "max_length")
