"""Mixing sources to target weights by iterative proportional fitting.

Token totals per cell (source, language, topic) are raked to the target shares: each margin in turn is scaled to its
targets, until all margins hold to ``RESIDUAL`` or ``SWEEPS`` sweeps are done. Fitted over own tokens, divided by the largest
such ratio, is the probability of a cell's documents: the largest sample at which no cell gives more tokens than it
has, so the sample's expected shares are the targets. A ``size`` may be asked for instead; beyond that largest sample, cells
give what they have and the targets are missed. :func:`reached` tells by how much. A document is kept when a number
derived from its id and the seed falls below its probability.

Everything is DataFrame expressions. A document's tokens are its words, counted by
white space. Only totals per cell shuffle; the fitting works on the table of cells, whose size
depends on the categories and not on the documents, and its lineage is cut every few
sweeps. The cells are
broadcast to the documents after a check of their number, and joined by a shuffle
if there are more than ``BROADCAST_CELLS``.

Defined results: a null category is a category of its own; a null text has no tokens
and is kept like its cell; categories without a target keep their own tokens, and the
targets are scaled to the rest (those of categories that do not occur are ignored); a
cell of no tokens is kept whole; repeated
rows are sampled alike; rows without an id are sampled by their text; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbrule.functions.storage import written

#: At most so many sweeps: only targets that contradict each other need more.
SWEEPS = 40
SEED = 17
#: Largest relative distance of a margin's category from its target at which fitting ends.
RESIDUAL = 1e-10
#: Sweeps between cuts of the lineage, after which the distance is measured.
CUT_SWEEPS = 4
BROADCAST_CELLS = 10_000
#: Default targets of a margin: own shares to this power, scaled to 1. Below 1 large categories give way.
TEMPER = 0.7


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of a text: table, list of figures, notice or prose."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(text.isNull() | (text == ""), "empty").when(bars >= 4, "table")
        .when(F.contains(F.lower(text), F.lit("licens")), "licensed").when(F.length(text) < 200 * lines, "short lines")
        .otherwise("prose"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts, the same on every run."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """(value, share): target shares of a margin from its own; :func:`rake` scales them to 1."""
    totals = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("_t"))
    return totals.select("value", F.when(F.col("_t") > 0, F.pow(F.col("_t").cast("double"), F.lit(power))).otherwise(0.0).alias("share"))


def _targets(cells: DataFrame, margin: str, target: DataFrame, size: float) -> DataFrame:
    """(_v, _want): tokens that each category of the margin shall have."""
    given = target.groupBy(F.col("value").alias("_v")).agg(F.max("share").cast("double").alias("_share"))
    own = cells.groupBy(F.col(margin).alias("_m")).agg(F.sum("tokens").cast("double").alias("_own"))
    both = own.join(given, F.col("_m").eqNullSafe(F.col("_v")), "left").select(
        F.col("_m").alias("_v"), "_own", F.when(F.col("_own") > 0, F.col("_share")).alias("_share"))
    sums = both.agg(F.sum("_own"), F.sum(F.when(F.col("_share").isNull(), F.col("_own"))), F.sum("_share")).first()
    total, free, shares = (x or 0.0 for x in sums)
    scaled = F.col("_share") * F.lit((total - free) / shares if shares else 0.0)
    return both.select("_v", (F.coalesce(scaled, "_own") * F.lit(size)).alias("_want"))


def rake(cells: DataFrame, margins: dict[str, DataFrame], sweeps: int = SWEEPS, size: float | None = None) -> DataFrame:
    """Adds ``fitted``: the part of the cells' tokens that gives each margin its target shares of the sample."""
    fitted = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for margin, target in margins.items():
        want = _targets(cells, margin, target, size or 1.0).withColumnRenamed("_want", f"_want_{margin}")
        fitted = fitted.join(want, F.col(margin).eqNullSafe(F.col("_v")), "left").drop("_v")
    fitted = written(fitted)

    def now(margin: str) -> Column:
        return F.sum("fitted").over(W.partitionBy(margin))

    def distance(margin: str) -> Column:
        return F.abs(now(margin) / F.nullif(F.col(f"_want_{margin}"), F.lit(0.0)) - 1)

    for sweep in range(1, sweeps + 1):
        for margin in margins:
            step = fitted.withColumn("_f", F.col(f"_want_{margin}") / F.nullif(now(margin), F.lit(0.0)))
            moved = F.col("fitted") * F.coalesce("_f", F.lit(1.0))
            fitted = step.withColumn("fitted", moved if size is None else F.least(moved, F.col("tokens").cast("double"))).drop("_f")
        if sweep % CUT_SWEEPS == 0:
            fitted = written(fitted)
            far = fitted.select(*[distance(m).alias(m) for m in margins]).agg(*[F.max(m) for m in margins]).first()
            if all((x or 0.0) <= RESIDUAL for x in far):
                break
    if size is None:
        # One number per margin category and cell shuffles; the least of them is a literal.
        room = fitted.where("fitted > 0").agg(F.min(F.col("tokens") / F.col("fitted"))).first()[0]
        fitted = fitted.withColumn("fitted", F.least(F.col("fitted") * F.lit(room or 1.0), F.col("tokens").cast("double")))
    return written(fitted.select(*cells.columns, "fitted"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margins: dict[str, Column] | None = None,
            targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, size: float | None = None, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and _tokens, _share (the probability) and _kept.

    ``margins`` names the categories (source, lang and topic by default) and ``targets`` their (value, share) tables;
    a margin without one gets its own shares tempered.
    """
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text_col))}
    names = {margin: f"_margin_{margin}" for margin in margins}
    marked = docs.withColumns({"_tokens": word_count(F.col(text_col)), **{names[m]: c.cast("string") for m, c in margins.items()}})
    # Sums per cell are combined inside tasks before anything shuffles.
    cells = written(marked.groupBy(*names.values()).agg(F.sum("_tokens").alias("tokens")))
    wanted = {names[m]: (targets or {}).get(m) for m in margins}
    fitted = rake(cells, {n: tempered(cells, n) if t is None else t for n, t in wanted.items()}, sweeps, size)
    share = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0)
    shares = fitted.select(*[F.col(n).alias(f"{n}_") for n in names.values()], share.alias("_share"))
    same = None
    for n in names.values():
        one = F.col(n).eqNullSafe(F.col(f"{n}_"))
        same = one if same is None else same & one
    joined = marked.join(F.broadcast(shares) if fitted.count() <= BROADCAST_CELLS else shares, same)
    drawn = uniform(F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(text_col, F.lit("")), 256)), F.lit(str(seed)))
    return joined.withColumn("_kept", drawn < F.col("_share")).drop(*[f"{n}_" for n in names.values()])


def reached(docs: DataFrame, text_col: str = "text", margins: dict[str, Column] | None = None,
            targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, size: float | None = None) -> DataFrame:
    """margin, value, wanted, fitted, residual (fitted less wanted), all in tokens: one row per category of :func:`mixture`.

    Without a ``size``, what is wanted are the target shares of the sample's tokens.
    """
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text_col))}
    cells = written(docs.select(word_count(F.col(text_col)).alias("_n"), *[c.cast("string").alias(m) for m, c in margins.items()])
                    .groupBy(*margins).agg(F.sum("_n").alias("tokens")))
    wanted = {m: (targets or {}).get(m) for m in margins}
    wanted = {m: tempered(cells, m) if t is None else t for m, t in wanted.items()}
    fitted, out = rake(cells, wanted, sweeps, size), None
    if size is None:
        sums = fitted.agg(F.sum("fitted"), F.sum("tokens")).first()
        size = (sums[0] or 0.0) / (sums[1] or 1.0)
    for margin, target in wanted.items():
        got = fitted.groupBy(F.col(margin).alias("value")).agg(F.sum("fitted").alias("fitted"))
        one = got.join(_targets(cells, margin, target, size), F.col("value").eqNullSafe(F.col("_v"))).select(
            F.lit(margin).alias("margin"), "value", F.col("_want").alias("wanted"), "fitted", (F.col("fitted") - F.col("_want")).alias("residual"))
        out = one if out is None else out.unionByName(one)
    return out


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The sampled rows; columns and values stay as they are. Settings as for :func:`mixture`."""
    return mixture(docs, **settings).where("_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(docs: str = "documents", sweeps: int = SWEEPS, seed: int = SEED, power: float = TEMPER) -> str:
    """The result of the registered query as SQL: one materialised step per margin and sweep."""
    words = "len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    topic = ("CASE WHEN text IS NULL OR text = '' THEN 'empty' "
             "WHEN length(text) - length(replace(text, '|', '')) >= 4 THEN 'table' "
             "WHEN contains(lower(text), 'licens') THEN 'licensed' "
             "WHEN length(text) < 200 * (length(text) - length(replace(text, chr(10), '')) + 1) THEN 'short lines' ELSE 'prose' END")
    margins = ("source", "lang", "topic")
    parts = [
        f"marked AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, {words}::BIGINT AS n_tokens FROM {docs})",
        "f0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS fitted "
        "FROM marked GROUP BY ALL)"]
    for m in margins:
        parts.append(
            f"own_{m} AS MATERIALIZED (SELECT {m} AS v, sum(tokens) AS own, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {power}) "
            f"ELSE 0 END AS share FROM f0 GROUP BY 1), want_{m} AS MATERIALIZED (SELECT v, share * (SELECT sum(own) / "
            f"nullif(sum(share), 0) FROM own_{m}) AS want FROM own_{m})")
    step = 0
    for _ in range(sweeps):
        for m in margins:
            parts.append(
                f"f{step + 1} AS MATERIALIZED (SELECT f.source, f.lang, f.topic, f.tokens, f.fitted * "
                f"coalesce(w.want / nullif(n.now, 0), 1) AS fitted FROM f{step} f LEFT JOIN want_{m} w ON f.{m} IS NOT DISTINCT FROM w.v LEFT JOIN "
                f"(SELECT {m} AS v, sum(fitted) AS now FROM f{step} GROUP BY 1) n ON f.{m} IS NOT DISTINCT FROM n.v)")
            step += 1
    draw = f"('0x' || substr(sha256(doc_id::VARCHAR || ':{seed}'), 1, 13))::BIGINT / {16**13}.0"
    return (
        f"WITH {', '.join(parts)}, shares AS (SELECT source, lang, topic, least(1, coalesce(fitted / nullif(tokens, 0) * "
        f"(SELECT min(tokens / fitted) FROM f{step} WHERE fitted > 0), 1)) AS share FROM f{step}) SELECT m.doc_id, m.topic, m.n_tokens, round(s.share, 6) AS share, "
        f"{draw} < s.share AS kept FROM marked m JOIN shares s ON m.source IS NOT DISTINCT FROM s.source "
        "AND m.lang IS NOT DISTINCT FROM s.lang AND m.topic IS NOT DISTINCT FROM s.topic")
