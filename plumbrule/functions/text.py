"""Text, row identity and number helpers as Column expressions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F, types as T

from plumbrule.spec import KeySpec

# Record reference encoding.
UNIT_SEPARATOR = "\x1f"
NULL_SENTINEL = "\x00NULL\x00"
ROW_INDEX_PREFIX = "ROWIDX:"

#: Characters that would end a key part or make it look like NULL, as they stand inside a part of a reference.
_ESCAPE = "\x1b"
_ESCAPED = ((_ESCAPE, _ESCAPE + "e"), (UNIT_SEPARATOR, _ESCAPE + "u"), ("\x00", _ESCAPE + "0"))

_EDGE_SPACE = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` only drops spaces)."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def is_blank(c: Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(c.rlike(r"^\s*$"), F.lit(True))


def canonical(name: str, data_type: T.DataType) -> Column:
    """One text per value, used for equality, hashing and display."""
    c = F.col(name)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(data_type, T.BinaryType):
        return F.decode(c, "UTF-8")
    return c.cast("string")


def canonical_of(schema: T.StructType, name: str) -> Column:
    return canonical(name, schema[name].dataType)


def sentinel_text(schema: T.StructType, name: str) -> Column:
    return F.coalesce(canonical_of(schema, name), F.lit(NULL_SENTINEL))


def joined_text(schema: T.StructType, names: Sequence[str]) -> Column:
    """Values joined with the unit separator; NULL keeps its place as a sentinel."""
    return F.concat_ws(UNIT_SEPARATOR, *[sentinel_text(schema, n) for n in names])


def exact_text(schema: T.StructType, names: Sequence[str]) -> Column:
    """Like :func:`joined_text` but unambiguous for any content: text carries its length."""
    def part(name: str) -> Column:
        c = canonical_of(schema, name)
        if isinstance(schema[name].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType,
                                              T.BooleanType)):
            return F.coalesce(c, F.lit(NULL_SENTINEL))
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit(NULL_SENTINEL))

    return F.concat_ws(UNIT_SEPARATOR, *[part(n) for n in names])


def _key_part(schema: T.StructType, name: str) -> Column:
    part = canonical_of(schema, name)
    if not isinstance(schema[name].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        for plain, escaped in _ESCAPED:
            part = F.replace(part, F.lit(plain), F.lit(escaped))
    return F.coalesce(part, F.lit(NULL_SENTINEL))


def record_ref(schema: T.StructType, key: KeySpec, row_index: Column | None = None) -> Column:
    """The key parts as one text. Different keys have different references whatever characters they hold."""
    if key.is_reliable:
        return F.concat_ws(UNIT_SEPARATOR, *[_key_part(schema, n) for n in key.columns])
    if row_index is None:
        raise ValueError("a dataset without a key needs a row index column")
    return F.concat(F.lit(ROW_INDEX_PREFIX), row_index.cast("string"))


def key_parts(ref: Column, key: KeySpec) -> list[Column]:
    """Inverse of :func:`record_ref`: one text column per key part, NULL restored."""
    if not key.is_reliable:
        return []
    parts = [ref] if len(key.columns) == 1 else [F.get(F.split(ref, UNIT_SEPARATOR), F.lit(i)) for i in range(len(key.columns))]

    def restored(part: Column) -> Column:
        part = F.nullif(part, F.lit(NULL_SENTINEL))
        for plain, escaped in reversed(_ESCAPED):
            part = F.replace(part, F.lit(escaped), F.lit(plain))
        return part

    return [restored(p).alias(name) for p, name in zip(parts, key.columns, strict=True)]


def row_hash(schema: T.StructType, names: Sequence[str] | None = None) -> Column:
    """SHA-256 over all columns in name order, reproducible across runs and plans."""
    return F.sha2(joined_text(schema, sorted(names or schema.names)), 256)


def digest(joined: Column) -> Column:
    """SHA-256 as 32 bytes, typed as never NULL.

    Otherwise Spark would filter on IS NOT NULL before joins and hash twice.
    """
    return F.coalesce(F.unhex(F.sha2(joined, 256)), F.lit(bytearray()))


def row_digest(schema: T.StructType, names: Sequence[str] | None = None) -> Column:
    """A 32-byte fingerprint of the whole row, for use as a narrow shuffle key."""
    return digest(exact_text(schema, sorted(names or schema.names)))


def key_digest(schema: T.StructType, names: Sequence[str]) -> Column:
    """Grouping key: the value itself for one fixed-width column, a digest otherwise.

    NULL only for a single NULL column; with several columns NULL is a value.
    """
    if len(names) == 1:
        data_type = schema[names[0]].dataType
        if not isinstance(data_type, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.col(names[0])
        return F.unhex(F.sha2(canonical_of(schema, names[0]), 256))
    return digest(exact_text(schema, names))


def staging_hash(names: Sequence[str], row: str | None = None) -> Column:
    """SHA-256 of the row (or of the struct column ``row``) as JSON with keys in name order."""
    members = [(F.col(row).getField(n) if row else F.col(n)).alias(n) for n in sorted(names)]
    return F.sha2(F.to_json(F.struct(*members), {"ignoreNullFields": "false"}), 256)


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def rounded_ratio(part: Column, whole: Column, scale: int = 1) -> Column:
    """scale * part / whole of two counts, exactly rounded half up to two places.

    Integer arithmetic, so equal counts give equal text on every engine.
    NULL when the whole is 0.
    """
    top = F.lit(200 * scale).cast("bigint") * part + whole
    return F.when(whole != 0, int_div(top, F.lit(2) * whole) / F.lit(100.0))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, two places; NULL when the whole is 0."""
    return rounded_ratio(part, whole, 100)


def rounded(c: Column, digits: int) -> Column:
    """Half-up rounding that is not tipped by the noise of summing in another order."""
    return F.round(F.round(c, digits + 4), digits)


def finite(c: Column) -> Column:
    """The value as double, NULL unless it is a finite number."""
    d = c.try_cast("double")
    # NaN sorts above infinity.
    return F.when((d < F.lit(float("inf"))) & (d > F.lit(float("-inf"))), d)


def close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    """Symmetric closeness: |a-b| <= max(rel * max(|a|,|b|), absolute)."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def same_value(a: Column, b: Column) -> Column:
    """Equal as text or as numbers ("735" equals "735.0")."""
    return (a == b) | F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))


def number_text(c: Column) -> Column:
    """Integers without a fraction, other numbers rounded to six places."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(F.round(c, 6).cast("string"))


def name_has_token(name: Column, tokens: Sequence[str]) -> Column:
    """Whole-word match of a column name ("notes" does not contain "no")."""
    words = F.split(F.lower(name), "[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.lit(t) for t in tokens]))


def quoted(names: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"
