"""Secret scans.

One pass of an Aho-Corasick automaton over each text finds keywords; a regular
expression is tried only where a keyword stands, anchored there. Runs of hex
digits have no keyword: a byte table maps hex digits to one value and a plain
substring search finds 32 of them. Tokens that carry a checksum (access tokens
that end in the base-62 CRC-32 of their body, card numbers with a Luhn digit)
count only if it is right. A card number has 16 digits in fours, or 15 as 4-6-5 after 34 or 37, with blanks, hyphens or
nothing between, and stands within ``CARD_REACH`` characters before or after a keyword; farther off it is not found.

Kinds, in the order in which they are listed at equal starts: assign, access,
hex (the base kinds) and then token and card. Spans are code points, end exclusive. Within a
kind matches are leftmost and do not overlap; a match that fails its length or
checksum is dropped, and what it covered stays covered for that kind.

Defined results: a null text is empty and has no spans; an empty table gives an
empty result; repeated rows are scanned each; texts of any length are scanned
whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "card")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 8, 16, 32

# Keywords and forms of secrets.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
TOKEN_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_CARD = re.compile(
    r"(?<![0-9])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9])")
_CARD_NEAR = ("card", "ccnum", "visa", "cc:", "amex", "american express", "credit", "debit", "discover", "maestro", "pan ", "pan:")
#: At most so many characters stand between a card number and its keyword.
CARD_REACH = 40
_CARD_SIZE = 19

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_MARK = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = b"\x01" * MIN_HEX

Span = tuple[int, int, int]


def base62_crc(body: str) -> str:
    value, out = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in ((0, ASSIGN_WORDS), (1, (ACCESS_WORD,)), (3, TOKEN_WORDS), (4, _CARD_NEAR)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _hex_spans(text: str) -> list[Span]:
    raw = text.encode()
    marks = raw.translate(_HEX_MARK)
    at, out = marks.find(_HEX_RUN), []
    while at >= 0:
        end = marks.find(b"\x00", at)
        end = len(marks) if end < 0 else end
        start = len(raw[:at].decode()) if len(raw) != len(text) else at
        out.append((start, 2, start + end - at))
        at = marks.find(_HEX_RUN, end)
    return out


def _card_spans(text: str, near: list[tuple[int, int]]) -> list[Span]:
    """Card numbers on either side of the keywords ``near``, which are sorted."""
    out: list[Span] = []
    done = 0
    for start, end in near:
        # One character more, so that a longer run of digits is seen to go on.
        for m in _CARD.finditer(text, max(done, start - CARD_REACH - _CARD_SIZE), end + CARD_REACH + _CARD_SIZE + 1):
            if m.start() > end + CARD_REACH:
                break
            if m.end() < start - CARD_REACH:
                continue
            done = m.end()
            if luhn(re.sub("[ -]", "", m[0])):
                out.append((m.start(), 4, m.end()))
    return out


def spans(text: str, words) -> list[Span]:
    """(start, kind number, end) of all secrets, sorted."""
    out = _hex_spans(text)
    done = [0] * len(KINDS)
    near: list[tuple[int, int]] = []
    # Only ASCII letters are lowered, so positions stay.
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    for last, (kind, size) in words.iter(low):
        start = last - size + 1
        if kind == 4:
            near.append((start, last + 1))
            continue
        if start < done[kind]:
            continue
        m = (_ASSIGN, _ACCESS, None, _TOKEN)[kind].match(text, start)
        if m is None:
            continue
        done[kind] = m.end()
        if kind == 0 and len(m[2]) < MIN_ASSIGNED or kind == 1 and m.end() - start < MIN_ACCESS:
            continue
        if kind == 3 and base62_crc(m[1]) != m[2]:
            continue
        out.append((start, kind, m.end()))
    return sorted(out + _card_spans(text, sorted(near)))


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_assign, n_access, n_hex, n_checked (the kinds with a checksum), base_sha256, spans; a row per row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    names = ["n_assign", "n_access", "n_hex", "n_checked"]
    schema = T.StructType([
        T.StructField("_id", rows.schema["_id"].dataType), *[T.StructField(n, T.LongType()) for n in names],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            counts, digests, lists = [[], [], [], []], [], []
            for text in batch.column(1):
                found = spans(text.as_py(), words)
                kinds = [kind for _, kind, _ in found]
                for k in range(3):
                    counts[k].append(kinds.count(k))
                counts[3].append(len(kinds) - kinds.count(0) - kinds.count(1) - kinds.count(2))
                digests.append(sha256(written([s for s in found if s[1] < 3]).encode()).hexdigest())
                lists.append(written(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array(lists, pa.string())], names=["_id", *names, "base_sha256", "spans"])

    return rows.mapInArrow(scan, schema).withColumnRenamed("_id", id_col)


def without_secrets(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows with each secret replaced by [kind]; all columns stay. ``count_col`` gets the new text's length."""
    own = docs.schema

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = [None if t.as_py() is None else redacted(t.as_py(), spans(t.as_py(), words)) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.column(at).type))

    changed = docs.mapInArrow(redact, own)
    return changed if count_col is None else changed.withColumn(
        count_col, F.when(F.col(count_col).isNotNull(), F.length(text_col)).cast(own[count_col].dataType))


def redacted(text: str, found: list[Span]) -> str:
    """Overlapping secrets become one mark, named after the first."""
    parts, at = [], 0
    for start, kind, end in found:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
