"""Column roles and which evidence applies where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Role thresholds.
IDENTIFIER_DISTINCT = 95.0
NUMERIC_IDENTIFIER_ROWS = 20

# Strategy by column type and rule type.
STRATEGIES = (
    ("RELATIONSHIP", ("INTEGER", "DECIMAL"), ("RANGE", "PATTERN", "CROSS_COLUMN")),
    ("SEQUENCE", ("INTEGER", "STRING"), ("COMPLETENESS", "UNIQUENESS", "DUPLICATE")),
    ("TEMPORAL", ("DATE", "DATETIME"), ("COMPLETENESS", "UNIQUENESS", "DUPLICATE")),
    ("TEMPLATE", ("STRING", "TEXT"), ("COMPLETENESS", "PATTERN")),
)


def column_roles(profiles: DataFrame, primary_key: tuple[str, ...] = ()) -> DataFrame:
    """IDENTIFIER, DIMENSION, MEASURE or OTHER per profiled column."""
    kind, distinct = F.col("normalized_data_type"), F.col("distinct_percentage")
    nearly_unique = F.coalesce(distinct >= IDENTIFIER_DISTINCT, F.lit(False))
    role = (
        F.when(F.col("column_name").isin(*primary_key) if primary_key else F.lit(False), "IDENTIFIER")
        .when(kind.isin("INTEGER", "DECIMAL"),
              F.when(nearly_unique & (F.col("row_count") >= NUMERIC_IDENTIFIER_ROWS), "IDENTIFIER").otherwise("MEASURE"))
        .when(kind.isin("STRING", "TEXT", "BOOLEAN"), F.when(nearly_unique, "IDENTIFIER").otherwise("DIMENSION"))
        .otherwise("OTHER"))
    return profiles.select("column_name", "normalized_data_type", "ordinal", "row_count", "distinct_percentage",
                           role.alias("role"))


def applicable_strategies(data_type: Column, rule_type: Column) -> Column:
    """Evidence worth gathering for an issue, by its column's type and its rule."""
    cells = [F.when(data_type.isin(*types) & rule_type.isin(*rules), F.lit(name)) for name, types, rules in STRATEGIES]
    return F.filter(F.array(*cells), lambda s: s.isNotNull())


def strategy_fits_rule(strategy: Column, rule_type: Column) -> Column:
    """A gap answers a missing value, a next value answers a repeated one."""
    return (
        F.when(strategy.isin("SEQUENCE_GAP", "TEMPORAL_GAP"), rule_type == "COMPLETENESS")
        .when(strategy.isin("SEQUENCE_NEXT_VALUE", "TEMPORAL_NEXT_VALUE"), rule_type.isin("UNIQUENESS", "DUPLICATE"))
        .otherwise(F.lit(True)))
