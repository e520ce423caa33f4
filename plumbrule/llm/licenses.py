"""Licence scans by canonical digest.

A text is put in a canonical form: lower case, copyright lines and comment marks
removed, equivalent spellings made one, punctuation and white space reduced to single
spaces. The SHA-256 digest of the whole form is looked up in a table of digests of
known licence texts, which are brought into the same form by the same expression. Single
lines are looked up likewise among the digests of known licence notices. Both tables are in
``known_licenses``; a licence, wording or text outside them is not found.

Everything is DataFrame expressions. The tables of texts and of notices have one row per
digest and are broadcast after a check of their size (``KNOWN_ROWS``); a larger table is
joined by a shuffle.

Defined results: a null text counts as empty; the empty form matches nothing; repeated
rows are looked up each; a digest that several known entries share gives the
smallest name; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrule.llm import known_licenses

#: Known tables up to so many rows are broadcast.
KNOWN_ROWS = 10_000

# Spellings that count as the same (pattern, replacement), applied to lower-case text in this order.
SPELLINGS = (
    ("licence", "license"), ("licensor’s|licensor's", "licensors"), ("organisation", "organization"),
    ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("per cent", "percent"), ("judgement", "judgment"), ("fulfilment", "fulfillment"),
    ("https:", "http:"), ("&", " and "), ("version ", "v"), ("v\\. ?([0-9])", "v$1"),
)
# Lines and signs that do not count.
COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*$"
RIGHTS_LINE = "(?m)^[^a-z0-9\\n]*all rights reserved[^\\n]*$"
NOT_WORDS = "[^a-z0-9]+"

# Public licence texts.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
TEXTS = known_licenses.texts((("MIT", MIT), ("ISC", ISC)))
# Notices that name a licence in one line.
NOTICES = known_licenses.notices((
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
))
#: Every canonical notice contains this word, so other lines are not put in form.
NOTICE_WORD = "licen[cs]e"


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern in (COPYRIGHT_LINE, RIGHTS_LINE):
        out = F.regexp_replace(out, pattern, " ")
    for pattern, same in SPELLINGS:
        literal = not any(c in pattern for c in "\\|[?")
        out = F.replace(out, F.lit(pattern), F.lit(same)) if literal else F.regexp_replace(out, pattern, same)
    return F.trim(F.regexp_replace(out, NOT_WORDS, " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, null if that is empty."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known(spark: SparkSession, entries: tuple[tuple[str, str], ...]) -> DataFrame:
    """(digest, name) of the entries."""
    rows = spark.createDataFrame([*entries], "name string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "name").groupBy("digest").agg(F.min("name").alias("name"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(KNOWN_ROWS + 1).count() <= KNOWN_ROWS else table


def license_scan(docs: DataFrame, texts: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, digest, license (of the whole text), notices (of its lines, sorted, comma-joined): one row per row.

    ``texts`` holds (digest, name); ``notices`` is a setting, (name, line) pairs. Both are joined by digest. Lines that
    hold ``NOTICE_WORD`` become rows for it, and ids and digests alone are shuffled to put a text's notices together.
    Rows that agree in id and text are counted and spread out again, so no row needs a number that a retry could change.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(f"(?i){NOTICE_WORD}"))
    own = ["_id", "_same", "_digest"]
    said = rows.select(
        "_id", F.sha2("_text", 256).alias("_same"), digest(F.col("_text")).alias("_digest"), lines.alias("_lines")).select(
        *own, F.posexplode_outer("_lines").alias("_at", "_line")).select(*own, "_at", digest(F.col("_line")).alias("_line"))
    named = known(docs.sparkSession, notices).select(F.col("digest").alias("_line"), F.col("name").alias("_notice"))
    named = F.broadcast(named) if len(notices) <= KNOWN_ROWS else named
    # At most one entry per licence name and text.
    marked = said.join(named, "_line", "left").groupBy(*own).agg(
        F.count_if(F.coalesce("_at", F.lit(0)) == 0).alias("_rows"),
        F.array_join(F.array_sort(F.collect_set("_notice")), ",").alias("_notices")).select(
        "_id", "_digest", "_notices", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"))
    whole = texts.select(F.col("digest").alias("_digest"), F.col("name").alias("_license"))
    return marked.join(_small(whole), "_digest", "left").select(
        F.col("_id").alias(id_col), F.col("_digest").alias("digest"), F.col("_license").alias("license"),
        F.col("_notices").alias("notices"))


def oracle(docs: str = "documents", texts: tuple[tuple[str, str], ...] = TEXTS,
           notices: tuple[tuple[str, str], ...] = NOTICES) -> str:
    """The result of the registered query as SQL."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def form(expression: str) -> str:
        out = f"lower({expression})"
        for pattern in (COPYRIGHT_LINE, RIGHTS_LINE):
            out = f"regexp_replace({out}, {quoted(pattern)}, ' ', 'g')"
        for pattern, same in SPELLINGS:
            literal = not any(c in pattern for c in "\\|[?")
            out = f"replace({out}, {quoted(pattern)}, {quoted(same)})" if literal else (
                f"regexp_replace({out}, {quoted(pattern)}, {quoted(same.replace('$', chr(92)))}, 'g')")
        return f"trim(regexp_replace({out}, {quoted(NOT_WORDS)}, ' ', 'g'))"

    def table(entries: tuple[tuple[str, str], ...]) -> str:
        rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in entries)
        return f"(SELECT sha256({form('text')}) AS digest, min(name) AS name FROM (VALUES {rows}) t(name, text) GROUP BY 1)"

    return (
        f"WITH texts AS MATERIALIZED {table(texts)}, notices AS MATERIALIZED {table(notices)}, "
        f"forms AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {form("coalesce(text, '')")} AS form "
        f"FROM {docs}), lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM forms), "
        f"found AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT r, {form('line')} AS form "
        f"FROM lines WHERE regexp_matches(line, '(?i){NOTICE_WORD}')) l JOIN notices n ON l.form <> '' AND sha256(l.form) = n.digest "
        "GROUP BY r) SELECT f.doc_id, CASE WHEN f.form <> '' THEN sha256(f.form) END AS digest, t.name AS license, "
        "coalesce(found.names, '') AS notices FROM forms f LEFT JOIN texts t ON f.form <> '' AND sha256(f.form) = t.digest "
        "LEFT JOIN found USING (r)")
