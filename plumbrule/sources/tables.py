"""Table scans, bounded samples, keyed lookups, previews and row positions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from plumbrule.functions.grouping import keep_matching
from plumbrule.functions.storage import cut_lineage
from plumbrule.spec import KeySpec, SpecError

# Sample sizes and preview limits.
DEFAULT_SAMPLE_ROWS = 30_000
DEFAULT_PREVIEW_ROWS = 20
MAX_PREVIEW_ROWS = 100
MAX_PREVIEW_TEXT = 100

# JDBC driver classes, default ports and URL shapes by source type code.
VENDORS: Mapping[str, tuple[str, int, str]] = {
    "POSTGRESQL": ("org.postgresql.Driver", 5432, "jdbc:postgresql://{host}:{port}/{database}"),
    "SQL_SERVER": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433,
                   "jdbc:sqlserver://{host}:{port};databaseName={database}"),
    "MYSQL": ("com.mysql.cj.jdbc.Driver", 3306, "jdbc:mysql://{host}:{port}/{database}"),
    "ORACLE": ("oracle.jdbc.OracleDriver", 1521, "jdbc:oracle:thin:@//{host}:{port}/{database}"),
    "SAP_HANA": ("com.sap.db.jdbc.Driver", 30015, "jdbc:sap://{host}:{port}/?databaseName={database}"),
    # Comes with Spark and runs inside its driver, so it serves local sessions.
    "DERBY": ("org.apache.derby.iapi.jdbc.AutoloadedDriver", 0, "jdbc:derby:{database}"),
}


@dataclass(frozen=True)
class JdbcSource:
    """Connection settings of one source database."""

    code: str
    host: str
    database: str
    port: int | None = None
    options: Mapping[str, str] | None = None

    def __post_init__(self) -> None:
        if self.code not in VENDORS:
            raise SpecError(f"unknown source type {self.code!r}; one of {sorted(VENDORS)}")

    def jdbc_options(self) -> dict[str, str]:
        driver, default_port, url = VENDORS[self.code]
        made = {"driver": driver,
                "url": url.format(host=self.host, port=self.port or default_port, database=self.database)}
        made.update(self.options or {})
        return made


def quoted_name(code: str, *parts: str) -> str:
    """A vendor-quoted, dotted identifier."""
    left, right = {"MYSQL": ("`", "`"), "SQL_SERVER": ("[", "]")}.get(code, ('"', '"'))
    return ".".join(left + p.replace(right, right * 2) + right for p in parts)


def scan_jdbc(
    spark: SparkSession, source: JdbcSource, schema: str, table: str, columns: Sequence[str] | None = None,
    partition_column: str | None = None, bounds: tuple[Any, Any] | None = None, num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Parallel JDBC scan. Column selection and filters are pushed to the database by Spark."""
    reader = spark.read.format("jdbc").options(**source.jdbc_options()).option(
        "dbtable", quoted_name(source.code, schema, table)).option("fetchsize", str(fetch_size))
    if partition_column:
        if bounds is None or not num_partitions:
            raise SpecError("a partitioned scan needs bounds and num_partitions")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1]))
                  .option("numPartitions", str(num_partitions)))
    df = reader.load()
    return df.select(*columns) if columns else df


def query_jdbc(spark: SparkSession, source: JdbcSource, sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**source.jdbc_options()).option("query", sql).load()


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def resolve_sample_size(requested: int | None, row_count_estimate: int | None, full_scan: bool = False) -> int:
    """Rows to read, of a table of any size."""
    if full_scan:
        if row_count_estimate is None:
            raise SpecError("a full scan needs a row count estimate")
        return max(row_count_estimate, 1)
    if requested is None:
        return DEFAULT_SAMPLE_ROWS
    if requested < 1:
        raise SpecError("a sample needs at least one row")
    return requested


@dataclass(frozen=True)
class Sample:
    rows: DataFrame
    is_full_scan: bool


#: A sampling number has so many hex digits.
_DIGITS = 13


def sample_rows(df: DataFrame, size: int, row_count: int, by: Sequence[str], seed: int = 42) -> Sample:
    """Everything when it fits, else about ``size`` rows: those whose hash of ``by`` falls below the wanted share.

    Every partition gives its part, nothing passes through one task, and the same rows come on every run.
    """
    if row_count <= size:
        return Sample(df, True)
    text_of = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.lit(str(seed)))
    number = F.conv(F.substring(F.sha2(text_of, 256), 1, _DIGITS), 16, 10).cast("bigint")
    return Sample(df.where(number < F.lit(size * 16**_DIGITS // row_count)), False)


def fetch_by_keys(df: DataFrame, keys: DataFrame, key: KeySpec, null_safe: bool = True) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (text key columns of the same names).

    The keys are cast to the table's types, never the table to text. Key values are compared as one
    struct, in which NULL equals NULL, so rows with a NULL part are spread like those of any frequent key. Few keys
    are broadcast after a size check; many are looked up.
    """
    casts = {c: F.col(c).try_cast(df.schema[c].dataType) for c in key.columns}
    # Text that is no value of the column's type is no NULL either: it matches nothing.
    fits = reduce(lambda a, b: a & b, [F.col(c).isNull() | v.isNotNull() for c, v in casts.items()])
    wanted = keys.where(fits).select(*[v.alias(c) for c, v in casts.items()])
    if not null_safe:
        wanted = wanted.dropna()
    whole = F.struct(*key.columns)
    return keep_matching(df.withColumn("_key", whole), wanted.select(whole.alias("_key")), "_key").drop("_key")


@dataclass(frozen=True)
class Preview:
    rows: DataFrame
    requested: int
    returned_limit: int
    capped: bool


def preview(df: DataFrame, requested: int | None = None) -> Preview:
    """The first rows with long text cut, at most :data:`MAX_PREVIEW_ROWS`."""
    wanted = DEFAULT_PREVIEW_ROWS if requested is None else requested
    if wanted < 1:
        raise SpecError("a preview needs at least one row")
    limit = min(wanted, MAX_PREVIEW_ROWS)
    shown = [
        F.substring(f.name, 1, MAX_PREVIEW_TEXT).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f.name) for f in df.schema.fields]
    return Preview(df.select(*shown).limit(limit), wanted, limit, wanted > MAX_PREVIEW_ROWS)


def with_row_index(df: DataFrame, order_by: Sequence[str], out: str = "row_index") -> DataFrame:
    """Add the row's position (from 0) in the order of ``order_by``.

    Rows are range partitioned and numbered inside each partition; only the
    partition sizes are gathered. The numbered rows are checkpointed, because
    a position that were computed twice could differ. A unique tie breaker
    keeps one frequent key from filling a partition.
    """
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order_by, "_tie").drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()))
    stored = cut_lineage(ordered)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    # One row per partition.
    starts = sizes.select(
        "_part", "first",
        (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("n")).alias("start"))
    return stored.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("start") + F.col("_at") - F.col("first")).alias(out))
