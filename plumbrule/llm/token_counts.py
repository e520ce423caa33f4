"""Token counts.

Texts arrive as Arrow batches; only lengths go back. A text is split before
every single space that stands between two non-space characters: the byte-level
pre-tokenizer always starts a piece there, whatever stands around it, so the
counts of the pieces add up to the count of the text. Equal pieces of a task are
encoded once; the pieces that are new go to the tokenizer in batches of about
equal bytes, whatever texts they come from: a very long text is many small pieces.
Vocabularies of other kinds, whose words depend on their neighbours, get whole texts.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
are counted each; an empty table gives an empty result; other columns are not
read, whatever their names. A stretch without such a space is one piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of new pieces in one call of the tokenizer.
BATCH_BYTES = 8 << 10
#: Pieces a task remembers before it forgets all of them.
REMEMBERED = 400_000

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: A space beside white space or at an end of the text (RE2).
_UNSAFE_RE2 = r"^ | $|[\s\pZ\x0B\x1C-\x1F\x{85}] | [\s\pZ\x0B\x1C-\x1F\x{85}]"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """Pieces that are tokenized independently; joined they give the text."""
    first, *rest = _SAFE_SPACE.split(text)
    return [first, *[" " + p for p in rest]]


def load(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, for a .json or a .model vocabulary."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    marks = [(i, t.content) for i, t in sorted(model.get_added_tokens_decoder().items())
             if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]

    def each(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(texts: list[str]) -> list[int]:
        """One call for many short texts: a special token between them keeps them apart and shows their ends."""
        mark_id, mark = marks[0]
        whole = mark.join(texts)
        if whole.count(mark) != len(texts) - 1:
            return each(texts)
        ids = np.array(model.encode_batch_fast([whole], add_special_tokens=False)[0].ids)
        ends = np.append(np.flatnonzero(ids == mark_id), len(ids))
        return (np.diff(ends, prepend=-1) - 1).tolist()

    return joined if marks and splits_at_spaces(path) else each


def splits_at_spaces(path: str) -> bool:
    """Whether the vocabulary's pre-tokenizer starts a piece at each space between two non-spaces."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    before = own.get("pre_tokenizer") or {}
    return (own.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space", True))


class Counter:
    """Counts tokens of texts; keeps the counts of the pieces it has seen."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES) -> None:
        self.encode, self.batch_bytes = load(path), batch_bytes
        self.splits = splits_at_spaces(path)
        self.known: dict[str, int] = {}

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Token counts of a string array without nulls."""
        if not self.splits:
            return np.array(self._in_batches(texts.to_pylist()), np.int64)
        texts = texts.cast(pa.large_string())
        plain = pc.invert(pc.match_substring_regex(texts, _UNSAFE_RE2))
        parts = pc.if_else(plain, pc.split_pattern(texts, " "), None)
        # Pieces after the first of a text start with the space before them.
        flat, offsets = parts.flatten(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy()))
        codes = flat.dictionary_encode()
        words, index = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        first = np.zeros(len(index), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        sizes = np.zeros(len(index), np.int64)
        for mask, mark in ((first, ""), (~first, " ")):
            used = np.unique(index[mask])
            by_word = np.zeros(len(words), np.int64)
            by_word[used] = self._pieces([mark + words[i] for i in used.tolist()])
            sizes[mask] = by_word[index[mask]]
        sums = np.append(0, np.cumsum(sizes))
        out = sums[offsets[1:]] - sums[offsets[:-1]]
        for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            out[i] = sum(self._pieces(pieces(texts[i].as_py())))
        return out

    def _pieces(self, wanted: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({p for p in wanted if p not in known})
        known.update(zip(new, self._in_batches(new), strict=True))
        return [known[p] for p in wanted]

    def _in_batches(self, texts: list[str]) -> list[int]:
        """Counts of the texts, encoded in batches of about equal bytes."""
        bounds = np.cumsum([len(p) for p in texts]) // self.batch_bytes
        out: list[int] = []
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(bounds)) + 1) if len(texts) else []:
            out.extend(self.encode(texts[at[0]:at[-1] + 1]))
        return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row."""
    where = path or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = T.StructType([
        T.StructField("_id", rows.schema["_id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(where, batch_bytes)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()),
                 pa.array(counter.counts(texts), pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, schema).select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
