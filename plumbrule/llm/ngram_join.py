"""Jaccard self-join on word shingles by token-combination prefixes.

Tokens are the distinct shingles of a document, as 64-bit hashes. They are put in
one global order, rare ones first. Whatever links at the threshold shares a token
near the front of both orders; tokens that occur in many documents would make long
lists, so they are split into classes and indexed as combinations: below
``FREQUENT`` documents single tokens, then pairs, then triples. A prefix is
extended until (tokens of a class) - (tokens of a combination) + 1, summed over
classes, exceeds the number of tokens that a linked document may lack; then one
combination at least is shared. Classes are divided further by a hash, more for
longer documents, which keeps the combinations about as many as the tokens. The
smaller document of a pair is indexed with the shorter prefix its role allows.

Steps:

1. Copies are collapsed to their smallest id, first inside tasks, then by digest.
2. Texts are dealt into batches by digest. A batch counts its tokens once each
   (32 bits beside the bucket's number), buckets add the batches' counts and send
   back what occurs twice or more. A document that has too few of those links with
   nothing and is done.
3. The others get index and probe combinations. Combinations of all documents meet
   in groups. A group's most typical member is compared with all others first; what
   links is one component, and only pairs of different components remain to be
   compared. Those that belong around the same larger component are compared block by
   block inside tasks, the others as pairs of rows.
4. Comparisons count the common tokens of two documents exactly.

The truncated counts only order tokens and may count too many; links rest on the
64-bit hashes.

Defined results: null and empty texts and texts of separators have no shingles and
link with nothing (component: themselves); a text shorter than a shingle is one
shingle; repeated rows come out as often, an id with several texts joins their
components; a row without an id has no component; an empty table gives an empty
result; other columns are not read. Ids are integers.
"""

from __future__ import annotations

from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrule.functions.storage import cut_lineage
from plumbrule.llm import words as w
from plumbrule.llm.components import components

WIDTH = 5
#: The threshold as a fraction.
AT_LEAST = (75, 100)
#: From so many documents on, tokens are indexed as pairs, and as triples.
FREQUENT = (16, 256)
#: Rounds in which one member of a group is compared with the others.
PIVOT_ROUNDS = 2
#: Documents per side of a block of comparisons.
BLOCK_DOCS = 512


def token_sets(column: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = w.buffers(column)
    out = []
    for i, j in w.chunks(offsets):
        cut = w.cut(data, offsets[i:j + 1], w.SPACED)
        whole = w.shingles(cut.hash, width)
        for k in range(j - i):
            a, b = int(cut.first[k]), int(cut.first[k + 1])
            out.append(np.unique(whole[a:b - width + 1] if b - a >= width else w.shingles(cut.hash[a:b], b - a)[:b - a]))
    return out


def _distinct(table: pa.Table) -> pa.Table:
    """One row per digest, with its smallest id."""
    best: dict[bytes, tuple[bool, int, int]] = {}
    ids = table.column("_id").to_pylist()
    for row, digest in enumerate(table.column("_digest").to_pylist()):
        rank = (ids[row] is None, ids[row] or 0, row)
        if digest not in best or rank < best[digest]:
            best[digest] = rank
    return table.take(pa.array(sorted(r[2] for r in best.values()), pa.int64()))


def _collapse(partitions: int):
    def collapse(batches):
        for batch in batches:
            texts = batch.column(1)
            digests = [md5((t.as_py() or "").encode(), usedforsecurity=False).digest() for t in texts]
            one = _distinct(pa.table({"_id": batch.column(0), "_digest": pa.array(digests, pa.binary()), "_text": texts}))
            part = [int.from_bytes(d[:4], "big") % partitions for d in one.column("_digest").to_pylist()]
            yield from one.append_column("_part", pa.array(part, pa.int32())).to_batches()

    return collapse


def _keys(tokens: np.ndarray, partitions: int) -> np.ndarray:
    """Bucket (from the upper half) and lower half of tokens, as one number."""
    bucket = ((tokens >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))


def _count(width: int, partitions: int):
    def count(table: pa.Table) -> pa.Table:
        one = _distinct(table)
        sets = [s for s, i in zip(token_sets(one.column("_text"), width), one.column("_id").to_pylist(), strict=True)
                if i is not None]
        keys, counts = np.unique(_keys(np.concatenate([np.zeros(0, np.uint64), *sets]), partitions), return_counts=True)
        bounds = np.searchsorted(keys >> np.uint64(32), np.arange(partitions + 1, dtype=np.uint64))
        low, counts = keys.astype(np.uint32), counts.astype(np.uint32)
        rows = [b for b in range(partitions) if bounds[b] < bounds[b + 1]]
        part = table.column("_part")[0].as_py()
        return pa.table({
            "_bucket": pa.array(rows, pa.int32()), "_part": pa.array([part] * len(rows), pa.int32()),
            "_low": pa.array([low[bounds[b]:bounds[b + 1]].tobytes() for b in rows], pa.binary()),
            "_n": pa.array([counts[bounds[b]:bounds[b + 1]].tobytes() for b in rows], pa.binary())})

    return count


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: the tokens of each batch that occur in two documents or more, with their counts."""
    blobs = [np.frombuffer(x, np.uint32) for x in table.column("_low").to_pylist()]
    low = np.concatenate(blobs)
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("_n").to_pylist()]).astype(np.int64)
    order = np.argsort(low, kind="stable")
    starts = np.flatnonzero(np.diff(low[order], prepend=low[order[0]] ^ np.uint32(1)))
    total = np.empty(len(low), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], starts), np.diff(np.append(starts, len(low))))
    at, lows, counts = 0, [], []
    for blob in blobs:
        mine = total[at:at + len(blob)]
        at += len(blob)
        lows.append(blob[mine > 1].tobytes())
        counts.append(np.minimum(mine[mine > 1], 0xFFFFFFFF).astype(np.uint32).tobytes())
    return pa.table({"_bucket": table.column("_bucket"), "_part": table.column("_part"),
                     "_low": pa.array(lows, pa.binary()), "_n": pa.array(counts, pa.binary())})


def _need(n: int, share: tuple[int, int]) -> int:
    """One more than the tokens that may be missing when at least this share is common."""
    return n - -(-n * share[0] // share[1]) + 1


def signatures(tokens: np.ndarray, df: np.ndarray, unique: int, need: int, band: int) -> set[int]:
    """Combinations of the prefix that holds ``need``. ``tokens`` (with counts over 1) are in global order."""
    if need <= unique:
        return set()
    need -= unique
    groups = 1 << max(0, band - 3)
    size = np.ones(len(tokens), np.int64) if band < 4 else 1 + np.searchsorted(np.array(FREQUENT), df, side="right")
    group = (w.mix(tokens) % np.uint64(groups)).astype(np.int64) * 4 + size
    out: list[int] = []
    classes: dict[int, list[int]] = {}
    got, salt = 0, band * 0x9E3779B97F4A7C15
    for token, g, k in zip(tokens.tolist(), group.tolist(), size.tolist(), strict=True):
        if k == 1:
            out.append(token ^ salt & (1 << 64) - 1)
            got += 1
        else:
            members = classes.setdefault(g, [])
            if len(members) >= k - 1:
                got += 1
            members.append(token)
        if got >= need:
            break
    for g, members in classes.items():
        for some in combinations(members, g % 4):
            x = salt
            for token in some:
                x = (x * 0xBF58476D1CE4E5B9 + token) & (1 << 64) - 1
            out.append(x ^ x >> 29)
    return set(out)


def _plan(width: int, partitions: int, share: tuple[int, int]):
    index_share = 2 * share[0], share[0] + share[1]

    def plan(shared: pa.Table, docs: pa.Table) -> pa.Table:
        one = _distinct(docs) if docs.num_rows else docs
        ids = one.column("_id").to_pylist()
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for bucket, low, n in zip(*(shared.column(c).to_pylist() for c in ("_bucket", "_low", "_n")), strict=True):
            keys.append(np.frombuffer(low, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
            counts.append(np.frombuffer(n, np.uint32).astype(np.int64))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        sizes, common, kept, index, probe = [], [], [], [], []
        for i, tokens in zip(ids, token_sets(one.column("_text"), width) if docs.num_rows else [], strict=True):
            n = len(tokens)
            at = np.minimum(np.searchsorted(keys, own := _keys(tokens, partitions)), max(len(keys) - 1, 0))
            df = np.where(keys[at] == own, counts[at], 1) if len(keys) else np.ones(n, np.int64)
            some = df > 1
            m = int(some.sum())
            sizes.append(n)
            common.append(m)
            if i is None or n == 0 or share[1] * m < share[0] * n:
                for column in (kept, index, probe):
                    column.append(None)
                continue
            tokens, df = tokens[some], df[some]
            order = np.lexsort((tokens, df))
            ordered, df = tokens[order], df[order]
            band, lowest = n.bit_length(), (-(-share[0] * n // share[1])).bit_length()
            kept.append(tokens.view(np.int64))
            index.append(np.array([*signatures(ordered, df, n - m, _need(n, index_share), band)], np.uint64).view(np.int64))
            both: set[int] = set()
            for b in range(lowest, band + 1):
                both |= signatures(ordered, df, n - m, _need(n, share), b)
            probe.append(np.array([*both], np.uint64).view(np.int64))
        lists = pa.list_(pa.int64())
        return pa.table({
            "_digest": one.column("_digest"), "_id": one.column("_id"), "_size": pa.array(sizes, pa.int64()),
            "_common": pa.array(common, pa.int64()), "_tokens": pa.array(kept, lists), "_index": pa.array(index, lists),
            "_probe": pa.array(probe, lists)})

    return plan


def _possible(share: tuple[int, int]) -> Column:
    """Whether documents x and y can link by their sizes and by their tokens that others have as well."""
    num, den = share
    common, sizes = F.least("x_common", "y_common"), F.col("x_size") + F.col("y_size")
    return ((den + num) * common >= num * sizes) & (
        den * F.least("x_size", "y_size") >= num * F.greatest("x_size", "y_size"))


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{name}{c}" if c != "_sig" else c) for c in df.columns])


def _verified(pairs: DataFrame, tokens: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that link."""
    one = tokens.select(F.col("_id").alias("a"), F.col("_size").alias("_sa"), F.col("_tokens").alias("_ta"))
    two = tokens.select(F.col("_id").alias("b"), F.col("_size").alias("_sb"), F.col("_tokens").alias("_tb"))
    overlap = F.size(F.array_intersect("_ta", "_tb"))
    return cut_lineage(
        pairs.join(one, "a").join(two, "b").withColumn("_o", overlap)
        .where(share[1] * F.col("_o") >= share[0] * (F.col("_sa") + F.col("_sb") - F.col("_o"))).select("a", "b"))


def links(planned: DataFrame, share: tuple[int, int] = AT_LEAST) -> DataFrame:
    """Links (a, b) that connect whatever links connect: verified ones, without those inside known components."""
    wanted = planned.where(F.col("_tokens").isNotNull())
    tokens = wanted.select("_id", "_size", "_tokens")
    facts = [F.col("_id"), F.col("_size"), F.col("_common")]
    posted = cut_lineage(
        wanted.select(F.explode("_index").alias("_sig"), *facts, F.lit(True).alias("_indexed"))
        .unionByName(wanted.select(F.explode("_probe").alias("_sig"), *facts, F.lit(False).alias("_indexed"))))
    # A combination that one document has alone, or that none has indexed, compares nothing.
    useful = posted.groupBy("_sig").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.max("_indexed").alias("_any"))
    posted = cut_lineage(posted.join(useful.where("_any and _lo <> _hi").select("_sig"), "_sig"))
    found, known = None, None
    pair = (F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
    for turn in range(PIVOT_ROUNDS):
        labelled = _labelled(posted, known)
        rank = F.col("_size") - F.col("_common") if turn == 0 else F.xxhash64("_id", F.lit(turn))
        first = F.min(F.struct(rank.alias("_rank"), "_id", "_size", "_common", "_comp")).alias("_p")
        pivots = labelled.groupBy("_sig").agg(first).select(
            "_sig", *[F.col(f"_p.{c}").alias(f"y{c}") for c in ("_id", "_size", "_common", "_comp")])
        met = _side(labelled, "x").join(pivots, "_sig")
        new = _verified(met.where((F.col("x_comp") != F.col("y_comp")) & _possible(share)).select(*pair).distinct(), tokens, share)
        found = new if found is None else found.unionByName(new)
        if not new.isEmpty():
            known = components(found)
    # What is left are pairs of different components. Of each combination the largest component only answers.
    labelled = cut_lineage(_labelled(posted, known))
    parts = labelled.groupBy("_sig", "_comp").agg(F.count(F.lit(1)).alias("_k"))
    major = parts.groupBy("_sig").agg(F.max(F.struct("_k", "_comp")).alias("_m"), F.count(F.lit(1)).alias("_c")).where(
        "_c > 1").select("_sig", F.col("_m._comp").alias("_major"))
    open_ = cut_lineage(parts.join(major, "_sig").where("_comp <> _major").select("_sig", "_comp", "_major"))
    homes = _homes(open_, _labelled(wanted.select("_id"), known))
    at_home = cut_lineage(_labelled(wanted.select(*facts), known).join(homes, "_comp", "left").withColumn(
        "_home", F.coalesce("_home", "_comp")))
    found = found.unionByName(_compared_at_home(at_home, tokens, share))
    placed = labelled.join(at_home.select("_id", "_home"), "_id")
    asking = placed.join(open_.select("_sig", "_comp"), ["_sig", "_comp"])
    roles = (F.col("x_indexed") & ~F.col("y_indexed") & (F.col("x_size") <= F.col("y_size"))) | (
        ~F.col("x_indexed") & F.col("y_indexed") & (F.col("x_size") >= F.col("y_size")))
    met = _side(asking, "x").join(_side(placed, "y"), "_sig").where(
        roles & (F.col("x_comp") != F.col("y_comp")) & (F.col("x_home") != F.col("y_home")) & _possible(share))
    return found.unionByName(_verified(met.select(*pair).distinct(), tokens, share))


def _labelled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Adds the component that each id is known to be in."""
    if known is None:
        return rows.withColumn("_comp", F.col("_id"))
    return rows.join(known, F.col("_id") == F.col("node"), "left").select(*rows.columns, F.coalesce("component", "_id").alias("_comp"))


def _homes(open_: DataFrame, labelled: DataFrame) -> DataFrame:
    """(_comp, _home): the larger component that a component shares most combinations with."""
    sizes = labelled.groupBy("_comp").agg(F.count(F.lit(1)).alias("_n"))
    votes = open_.groupBy("_comp", "_major").agg(F.count(F.lit(1)).alias("_votes"))
    larger = (
        votes.join(sizes, "_comp").join(sizes.select(F.col("_comp").alias("_major"), F.col("_n").alias("_m")), "_major")
        .where((F.col("_m") > F.col("_n")) | ((F.col("_m") == F.col("_n")) & (F.col("_major") < F.col("_comp")))))
    return larger.groupBy("_comp").agg(F.max(F.struct("_votes", "_major")).alias("_best")).select(
        "_comp", F.col("_best._major").alias("_home"))


def _compared_at_home(at_home: DataFrame, tokens: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links between the components that have the same home.

    The documents of a home that are not in its component (guests) are compared with all documents of the
    home. Both are dealt into blocks of about ``BLOCK_DOCS``, each pair of blocks is a group, and groups return
    links only, so documents travel once per block of guests and no pair is a row.
    """
    guests = at_home.where("_home <> _comp")
    few = guests.groupBy("_home").agg(F.count(F.lit(1)).alias("_g"))
    blocks = few.join(at_home.groupBy("_home").agg(F.count(F.lit(1)).alias("_a")), "_home").select(
        "_home", F.ceil(F.col("_g") / BLOCK_DOCS).cast("int").alias("_gb"), F.ceil(F.col("_a") / BLOCK_DOCS).cast("int").alias("_ab"))
    full = at_home.join(blocks, "_home").join(tokens.select("_id", "_tokens"), "_id")

    def dealt(rows: DataFrame, own: str, other: str, guest: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("_id"), F.col(own)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        named = rows.withColumn("_mine", mine).withColumn("_theirs", theirs)
        left, right = ("_mine", "_theirs") if guest else ("_theirs", "_mine")
        return named.select("_home", F.col(left).alias("_left"), F.col(right).alias("_right"), F.lit(guest).alias("_guest"),
                            "_id", "_comp", "_size", "_common", "_tokens")

    met = dealt(full.where("_home <> _comp"), "_gb", "_ab", True).unionByName(dealt(full, "_ab", "_gb", False))
    return cut_lineage(met.groupBy("_home", "_left", "_right").applyInArrow(_block_links(share), "a bigint, b bigint"))


def _block_links(share: tuple[int, int]):
    num, den = share

    def compare(table: pa.Table) -> pa.Table:
        guest, ids, comp, size, common = (
            table.column(c).to_numpy() for c in ("_guest", "_id", "_comp", "_size", "_common"))
        tokens = table.column("_tokens").combine_chunks()
        bounds = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1]
        values = tokens.values.to_numpy()
        left, right = np.flatnonzero(guest), np.flatnonzero(~guest)
        one, two = [], []
        for x in left.tolist():
            low, both = np.minimum(common[right], common[x]), size[right] + size[x]
            fits = (comp[right] != comp[x]) & ((den + num) * low >= num * both) & (
                den * np.minimum(size[right], size[x]) >= num * np.maximum(size[right], size[x]))
            mine = np.sort(values[bounds[x]:bounds[x + 1]])
            ys = right[fits]
            if not len(ys):
                continue
            lengths = bounds[ys + 1] - bounds[ys]
            starts = np.cumsum(lengths) - lengths
            theirs = values[np.repeat(bounds[ys] - starts, lengths) + np.arange(int(lengths.sum()))]
            same = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            overlap = np.add.reduceat(same.astype(np.int64), starts)
            ys = ys[den * overlap >= num * (size[ys] + size[x] - overlap)]
            one.append(np.minimum(ids[ys], ids[x]))
            two.append(np.maximum(ids[ys], ids[x]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(one or none)), "b": pa.array(np.concatenate(two or none))})

    return compare


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                     share: tuple[int, int] = AT_LEAST) -> DataFrame:
    """``id_col``, n_shingles, component_id: one row per row, the component named after its smallest id."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    dealt = rows.mapInArrow(_collapse(partitions), "_id bigint, _digest binary, _text string, _part int").repartition(
        partitions, "_part")
    counted = dealt.groupBy("_part").applyInArrow(_count(width, partitions), "_bucket int, _part int, _low binary, _n binary")
    shared = counted.repartition(partitions, "_bucket").groupBy("_bucket").applyInArrow(
        _repeated, "_bucket int, _part int, _low binary, _n binary")
    planned = cut_lineage(shared.groupBy("_part").cogroup(dealt.groupBy("_part")).applyInArrow(
        _plan(width, partitions, share), "_digest binary, _id bigint, _size bigint, _common bigint, _tokens array<bigint>, "
        "_index array<bigint>, _probe array<bigint>"))
    members = rows.select("_id", F.unhex(F.md5("_text")).alias("_digest"))
    classes = planned.select("_digest", F.col("_id").alias("_rep"), "_size")
    # Ids that stand at several texts join them.
    several = members.where(F.col("_id").isNotNull()).groupBy("_id").agg(
        F.min("_digest").alias("_lo"), F.max("_digest").alias("_hi")).where("_lo <> _hi").select("_id")
    own = members.join(several, "_id").join(classes.where("_size > 0"), "_digest").select(F.col("_id").alias("a"), F.col("_rep").alias("b"))
    known = components(links(planned, share).unionByName(own))
    named = classes.join(known, F.col("_rep") == F.col("node"), "left").select(
        "_digest", "_size", F.coalesce("component", "_rep").alias("_comp"))
    # Texts without words are copies of each other but link with nothing; their ids may stand at other texts.
    placed = members.join(named, "_digest").join(
        known.join(several, F.col("node") == F.col("_id"), "left_semi"), (F.col("_id") == F.col("node")) & (F.col("_size") == 0), "left")
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.when(F.col("_size") == 0, F.coalesce("component", "_id")).otherwise(F.col("_comp")))
        .alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                      share: tuple[int, int] = AT_LEAST) -> DataFrame:
    """The rows whose id names their component, one per id; columns and values stay as they are.

    Rows that repeat an id keep the one with the smallest text (then the smallest row); rows without an id are kept.
    """
    heads = ngram_components(docs, id_col, text_col, width, share).where(F.col(id_col) == F.col("component_id")).select(
        F.col(id_col).cast("bigint").alias("_head")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(heads, F.col(id_col).cast("bigint") == F.col("_head")).groupBy("_head").agg(
        F.min(F.struct(F.col(text_col).alias("_first"), *columns)).alias("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
