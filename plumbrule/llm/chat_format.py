"""Chat formatting in budgeted windows.

Turns of a conversation are rendered with a template that marks turn borders. A
control string inside a text (of this template or of other common ones) is escaped
reversibly by a backslash before it, and so is a backslash; an unescaped ``<|`` is
always a mark.

Prefix sums of the turns' tokens choose the windows. A conversation is first cut
into segments where the sum passes a multiple of ``SEGMENT_BUDGETS`` budgets;
within a segment a window takes the longest run of whole turns that fits the budget
(a longer turn gets a window of its own), found by binary search in the sums. Each
window opens with the conversation's leading system turns and repeats the last turns
before it that fit ``HISTORY`` tokens; where the budget is short, history gives way to the
system turns and the window's own turns. Repeated turns are not under the loss mask, so
every assistant turn is a target once, in the window that it belongs to.

The sums are taken in two levels, over runs of ``RUN_TURNS`` turn numbers and over
runs, so that a conversation of any length is neither sorted nor held in one task.
Segments of a conversation are formatted independently.

Defined results: leading system turns are repeated whole as long as they leave room
within the budget, so a turn that does not fit beside them gets a window over it, like one longer
than the budget; of leading system turns that fill the budget, those before the one that does are
repeated and the rest stand once, in their own windows; a null text is empty; a null role is the empty role; turns of a
conversation are ordered by number (nulls first), then role, then text, so ties and
repeated rows have a fixed order and are all formatted; rows without a conversation
id form one conversation of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbrule.functions.storage import cut_lineage
from plumbrule.llm.token_counts import Counter, vocabulary_path

BUDGET, HISTORY = 2048, 256
SEGMENT_BUDGETS = 64
RUN_TURNS = 64
SYSTEM, ASSISTANT = "system", "assistant"

# The template: fixed marks.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_TURN = re.compile(r"<\|turn\|>((?:[^\\<]|\\.|<(?!\|))*)<\|body\|>((?:[^\\<]|\\.|<(?!\|))*)<\|end\|>\n", re.DOTALL)


#: Strings that open or close turns in this or another template, and the escape itself.
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """The turn's form, and where its body stands in it."""
    head = f"{TURN}{escaped(role)}{BODY}"
    body = escaped(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end delimit the body as it stands in the form."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def windows(tokens: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Longest runs of turns within the budget, by binary search in the prefix sums."""
    sums, out, at = np.append(0, np.cumsum(tokens)), [], 0
    while at < len(tokens):
        to = max(int(np.searchsorted(sums, sums[at] + budget, side="right")) - 1, at + 1)
        out.append((at, to))
        at = to
    return out


def _measured(rows: DataFrame, path: str) -> DataFrame:
    """The turns with their form's token count."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            forms = [rendered(r, t)[0] for r, t in zip(
                batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counter.counts(pa.array(forms, pa.string())), pa.int64())],
                names=[*batch.schema.names, "_tokens"])

    return rows.mapInArrow(measure, "_conv bigint, _turn bigint, _role string, _text string, _run bigint, _tokens bigint")


def _placed(turns: DataFrame) -> DataFrame:
    """Adds each turn's position and the tokens before it in its conversation."""
    order = [F.asc_nulls_first("_turn"), "_role", "_text"]
    runs = turns.groupBy("_conv", "_run").agg(F.sum("_tokens").alias("_sum"), F.count(F.lit(1)).alias("_count"))
    earlier = W.partitionBy("_conv").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("_conv").alias("_c"), F.col("_run").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_first"))
    inside = W.partitionBy("_conv", "_run").orderBy(*order)
    local = turns.withColumn("_before", F.coalesce(
        F.sum("_tokens").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_nr", F.row_number().over(inside) - 1)
    return local.join(offsets, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_run") == F.col("_r"))).select(
        "_conv", "_role", "_text", "_tokens", (F.col("_base") + F.col("_before")).alias("_before"),
        (F.col("_first") + F.col("_nr")).alias("_position"))


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """conv_id, segment, window, n_tokens, formatted, repeated (turns that open it), mask: one row per window.

    ``mask`` lists [start, end) of the text that is trained on, in code points of ``formatted``.
    """
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("_conv"), F.col(turn_col).cast("bigint").alias("_turn"),
        F.coalesce(role_col, F.lit("")).alias("_role"), F.coalesce(text_col, F.lit("")).alias("_text"),
        F.coalesce(F.floor(F.col(turn_col) / RUN_TURNS), F.lit(-(1 << 62))).cast("bigint").alias("_run"))
    # Written once: every later step reads the counts, not the tokenizer.
    placed = cut_lineage(_placed(cut_lineage(_measured(rows, path or vocabulary_path()))))
    length = budget * SEGMENT_BUDGETS
    own = F.floor(F.col("_before") / length).cast("bigint")
    main = placed.withColumn("_segment", own).withColumn("_kind", F.lit(1))
    # A turn that ends near a segment's end is history for the next one.
    after = F.floor((F.col("_before") + F.col("_tokens") + history) / length).cast("bigint")
    spill = placed.where(after > own).withColumn("_segment", after).withColumn("_kind", F.lit(0))
    # The leading system turns open every segment.
    head = placed.where((F.col("_role") == SYSTEM) & (F.col("_before") + F.col("_tokens") < budget))
    lead = placed.where(F.col("_role") != SYSTEM).groupBy("_conv").agg(F.min("_position").alias("_until"))
    head = head.join(lead.withColumnRenamed("_conv", "_c"), F.col("_conv").eqNullSafe(F.col("_c")), "left").where(
        F.col("_until").isNull() | (F.col("_position") < F.col("_until"))).drop("_c", "_until")
    many = main.where("_segment > 0").select(F.col("_conv").alias("_c"), F.col("_segment").alias("_s")).distinct()
    opened = head.join(many, F.col("_conv").eqNullSafe(F.col("_c"))).withColumn("_segment", F.col("_s")).withColumn(
        "_kind", F.lit(2)).select(*main.columns)
    parts = main.unionByName(spill.select(*main.columns)).unionByName(opened)
    return parts.groupBy("_conv", "_segment").applyInArrow(
        _formatter(budget, history), "conv_id bigint, segment bigint, window bigint, n_tokens bigint, formatted string, "
        "repeated bigint, mask array<array<bigint>>")


def _formatter(budget: int, history: int):
    def form(table: pa.Table) -> pa.Table:
        columns = ("_kind", "_position", "_role", "_text", "_tokens", "_before")
        rows = sorted(zip(*(table.column(c).to_pylist() for c in columns), strict=True), key=lambda r: (r[1], r[0]))
        own = [r for r in rows if r[0] == 1]
        outside = [r for r in rows if r[0] == 0]
        lead = [r for r in rows if r[0] == 2]
        if own and own[0][1] == 0:
            for r in own:
                if r[2] != SYSTEM or r[5] + r[4] >= budget:
                    break
                lead.append(r)
        fixed, led = sum(r[4] for r in lead), {r[1] for r in lead}
        # Beside long system turns, history and own turns share what is left.
        past = min(history, (budget - fixed) // 2)
        out = []
        # The first window holds the system turns as its own; later ones repeat them.
        for number, (a, b) in enumerate(windows(np.array([r[4] for r in own], np.int64), max(1, budget - fixed - past))):
            start = own[a][5]
            opened = [r for r in lead if r[1] < own[a][1]]
            left = budget - sum(r[4] for r in [*opened, *own[a:b]])
            # A window over the budget for its own turn keeps its history as it is.
            fits = min(past, left) if left >= 0 else past
            before = [r for r in [*outside, *own[:a]] if r[5] >= start - fits and r[5] + r[4] <= start]
            opening = [*opened, *[r for r in before if r[1] not in led]]
            parts, mask, at = [], [], 0
            for k, r in enumerate([*opening, *own[a:b]]):
                text, body, end = rendered(r[2], r[3])
                if k >= len(opening) and r[2] == ASSISTANT:
                    mask.append([at + body, at + end])
                parts.append(text)
                at += len(text)
            out.append((number, sum(r[4] for r in [*opening, *own[a:b]]), "".join(parts), len(opening), mask))
        n = len(out)
        number, tokens, formatted, repeated, mask = zip(*out, strict=True) if out else ((),) * 5
        return pa.table({
            "conv_id": pa.array([table.column("_conv")[0].as_py()] * n, pa.int64()),
            "segment": pa.array([table.column("_segment")[0].as_py()] * n, pa.int64()),
            "window": pa.array(number, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()),
            "formatted": pa.array(formatted, pa.string()), "repeated": pa.array(repeated, pa.int64()),
            "mask": pa.array(mask, pa.list_(pa.list_(pa.int64())))})

    return form


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the windows alone.

    A digest runs over a whole conversation in order, so its windows pass through one task, one after another;
    only the running digests are held.
    """
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int | None] | None = None
        turns = loss = 0
        chars = 0
        of_turns, of_loss = sha256(), sha256()

        def row() -> pa.RecordBatch:
            values = [current[0], turns, of_turns.hexdigest(), loss, of_loss.hexdigest(), chars]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["conv_id", *names])

        for batch in batches:
            for conv, text, repeated, mask in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if current != (conv,):
                    if current is not None:
                        yield row()
                    current, turns, loss, chars, of_turns, of_loss = (conv,), 0, 0, 0, sha256(), sha256()
                chars += len(text)
                for role, body, _, _ in read_turns(text)[repeated:]:
                    turns += 1
                    of_turns.update(f"{role}\n{body}\n".encode())
                for start, end in mask:
                    target = unescaped(text[start:end])
                    loss += len(target)
                    of_loss.update(target.encode())
        if current is not None:
            yield row()

    ordered = formatted.select("conv_id", "segment", "window", "formatted", "repeated", "mask").repartition(
        "conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return ordered.select("conv_id", "formatted", "repeated", "mask").mapInArrow(
        read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
