"""Benchmark decontamination by suffix arrays over the training texts.

Texts are cut into words; each task joins its texts into shards of about
``SHARD_WORDS`` words (a longer text is cut into several, which overlap) and sorts the suffixes
of a shard by their first words: words become numbers, and each round of sorting pairs of ranks
doubles the depth. Every window of every test item is then found by binary search in the shard;
the range of suffixes that begin with it gives all its occurrences.

For longest verbatim matches the items are sorted into the same array, to a depth of the longest
item. A suffix's nearest suffixes of the other side give its longest match, whose length the
ranks of the rounds tell; all suffixes that share it stand side by side, so the smallest
location is a minimum over a range. Texts cut into several shards overlap there by the longest item.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` bytes, which bounds what
is sent to the tasks; a larger benchmark takes one pass over the texts per block.
Words are compared by 64-bit hashes.

Defined results: null and empty texts have no words and are not contaminated; an
item of fewer than 13 words is one window, an item without words none; repeated
rows are judged each; equal items all count; items without an id count as matches
but cannot be named; an empty benchmark marks nothing; extra columns are not read;
of a text's longest matches the first in the text is given, with the smallest (item, position
in the item) that it occurs at, no item first; without a common word its length is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbrule.functions.storage import cut_lineage
from plumbrule.llm import words as w

WINDOW = 13
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 4 << 20
#: A text is contaminated when its hit words are at least one in so many.
ONE_IN = 20


class Items(NamedTuple):
    """Words of the test items of a block, one after another."""

    names: list[str | None]
    hashes: np.ndarray
    first: np.ndarray

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and item number of every window."""
        sizes = np.diff(self.first)
        per = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
        item = np.repeat(np.arange(len(sizes)), per)
        within = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        return self.first[item] + within, np.minimum(sizes[item], width), item


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    names, texts, size = [], [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where(
            F.col("t").isNotNull()).toLocalIterator():
        if texts and size + len(row["t"].encode()) > block_bytes:
            yield _block(names, texts)
            names, texts, size = [], [], 0
        names.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"].encode())
    if texts:
        yield _block(names, texts)


def _block(names: list[str | None], texts: list[str]) -> Items:
    cut = w.cut(*w.buffers(pa.array(texts, pa.string())), w.ALPHANUMERIC)
    return Items(names, cut.hash, cut.first.astype(np.int64))


def suffix_ranks(codes: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions ordered by at least ``depth`` numbers that begin there, and the ranks by 1, 2, 4... numbers.

    ``codes`` are 0 after the end. Stops early when no two suffixes are alike.
    """
    n = len(codes)
    levels, reach = [codes.astype(np.uint32)], 1
    order = np.argsort(levels[0], kind="stable")
    while reach < depth:
        key = levels[-1].astype(np.uint64) << np.uint64(32)
        key[:max(n - reach, 0)] |= levels[-1][reach:]
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint32)
        rank[order] = np.append(1, 1 + np.cumsum(ordered[1:] != ordered[:-1]))[:n]
        levels.append(rank)
        reach *= 2
        if n and rank.max() == n:
            break
    return order, levels


def suffix_array(codes: np.ndarray, depth: int = 27) -> np.ndarray:
    """Positions ordered by at least ``depth`` numbers that begin there. ``codes`` are 0 after the end."""
    return suffix_ranks(codes, depth)[0]


def search(codes: np.ndarray, order: np.ndarray, queries: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
    """For rows of numbers: how many suffixes come before the row's prefix, or (``after``) begin with it or come before."""
    width = queries.shape[1]
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    while (active := np.flatnonzero(low < high)).size:
        middle = (low[active] + high[active]) // 2
        at = order[middle]
        undecided = np.arange(len(active))
        less = np.full(len(active), after)
        for k in range(width):
            undecided = undecided[lengths[active[undecided]] > k]
            if not undecided.size:
                break
            mine, other = padded[at[undecided] + k], queries[active[undecided], k]
            less[undecided[mine < other]] = True
            less[undecided[mine > other]] = False
            undecided = undecided[mine == other]
        low[active[less]] = middle[less] + 1
        high[active[~less]] = middle[~less]
    return low


class Both(NamedTuple):
    """Suffixes of a shard's texts and of the items in one order. Texts stand first, then items with a 0 after each."""

    order: np.ndarray
    place: np.ndarray
    levels: list[np.ndarray]
    n_texts: int
    at: np.ndarray
    room: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, query: np.ndarray, items: Items, width: int) -> Both:
        sizes = np.diff(items.first)
        at = len(codes) + np.arange(len(query)) + np.repeat(np.arange(len(sizes)), sizes)
        joint = np.zeros(len(codes) + len(query) + len(sizes), np.int64)
        joint[:len(codes)] = codes
        joint[at] = query
        order, levels = suffix_ranks(joint, max(width, int(sizes.max(initial=0))))
        place = np.empty(len(joint), np.int64)
        place[order] = np.arange(len(joint))
        room = np.zeros(len(joint), np.int64)
        room[at] = np.repeat(items.first[1:], sizes) - np.arange(len(query))
        return cls(order, place, levels, len(codes), at, room)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that suffixes at ``a`` and ``b`` begin with alike, up to the depth of the order."""
        size, n = np.zeros(len(a), np.int64), len(self.order)
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = a + size, b + size
            inside = (i < n) & (j < n)
            same = inside & (self.levels[k][np.where(inside, i, 0)] == self.levels[k][np.where(inside, j, 0)])
            size[same] += 1 << k
        return size

    def nearest(self, a: np.ndarray, of_items: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of suffixes at ``a``: words of the longest match with a suffix of the other side (0: none), and its place."""
        n = len(self.order)
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        other = (self.room[self.order] > 0) if of_items else (self.order < self.n_texts)
        places = np.where(other, np.arange(n), -1)
        before = np.maximum.accumulate(places)[self.place[a]]
        after = np.minimum.accumulate(np.where(other, np.arange(n), n)[::-1])[::-1][self.place[a]]
        best, where = np.zeros(len(a), np.int64), np.full(len(a), -1)
        for near in (before, after):
            valid = (near >= 0) & (near < n)
            b = self.order[np.where(valid, near, 0)]
            size = np.where(valid, np.minimum(self.common(a, b), self.room[b if of_items else a]), 0)
            better = size > best
            best[better], where[better] = size[better], near[better]
        return best, where

    def smallest(self, a: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> np.ndarray:
        """For suffixes at ``a``: the smallest key (by position) among those that share their first ``sizes`` words."""
        n, home = len(self.order), self.place[a]
        low, high = np.zeros(len(a), np.int64), home.copy()
        while (low < high).any():
            middle = (low + high) // 2
            alike = self.common(a, self.order[middle]) >= sizes
            low, high = np.where((low < high) & ~alike, middle + 1, low), np.where((low < high) & alike, middle, high)
        begin, low, high = low, home.copy(), np.full(len(a), n - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            alike = self.common(a, self.order[middle]) >= sizes
            low, high = np.where((low < high) & alike, middle, low), np.where((low < high) & ~alike, middle - 1, high)
        spans = low - begin + 1
        power = np.frexp(spans.astype(np.float64))[1] - 1
        # Minima of ranges of 1, 2, 4... places; a range is covered by two of them.
        out, table = np.empty(len(a), key.dtype), key[self.order]
        for k in range(int(power.max(initial=-1)) + 1):
            mine = power == k
            out[mine] = np.minimum(table[begin[mine]], table[low[mine] + 1 - (1 << k)])
            table = np.minimum(table[:-(1 << k)], table[1 << k:]) if len(table) > 1 << k else table
        return out


class Shard(NamedTuple):
    """Texts of one shard: word codes with a 0 after each text, suffixes in order, and the items in the same codes."""

    codes: np.ndarray
    order: np.ndarray
    first: np.ndarray
    query: np.ndarray
    both: Both | None

    @classmethod
    def of(cls, hashes: np.ndarray, first: np.ndarray, items: Items, width: int, longest: bool = False) -> Shard:
        vocabulary, inverse = np.unique(hashes, return_inverse=True)
        texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
        codes = np.zeros(len(hashes) + len(first) - 1, np.int64)
        codes[np.arange(len(hashes)) + texts] = inverse + 1
        at = np.searchsorted(vocabulary, items.hashes)
        found = vocabulary[np.minimum(at, max(len(vocabulary) - 1, 0))] == items.hashes if len(vocabulary) else np.zeros(
            len(at), bool)
        query, starts = np.where(found, at + 1, -1), first + np.arange(len(first))
        if not longest:
            return cls(codes, suffix_array(codes, width), starts, query, None)
        both = Both.of(codes, np.where(found, query, len(vocabulary) + 1), items, width)
        return cls(codes, both.order[both.order < len(codes)], starts, query, both)


def occurrences(shard: Shard, items: Items, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, length, item number and item position of each occurrence of each window in the shard."""
    start, length, item = items.windows(width)
    # A window with a word that the shard lacks occurs nowhere in it.
    lacking = np.append(0, np.cumsum(shard.query < 0))
    keep = lacking[start + length] == lacking[start]
    start, length, item = start[keep], length[keep], item[keep]
    padded = np.append(shard.query, np.full(width, -1))
    rows = padded[start[:, None] + np.arange(width)] if len(start) else np.zeros((0, width), np.int64)
    low = search(shard.codes, shard.order, rows, length, after=False)
    high = search(shard.codes, shard.order, rows, length, after=True)
    many = high - low
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return (shard.order[np.repeat(low, many) + within], np.repeat(length, many), np.repeat(item, many), np.repeat(start, many))


_FAR = np.iinfo(np.int64).max
#: Keys pack a text or item and a word in it.
_WORD_BITS = 40


def _ranked(names: list) -> np.ndarray:
    """Ranks of names, equal for equal ones, None first."""
    ranks = {name: k for k, name in enumerate(sorted(set(names), key=lambda x: (x is not None, x or "")))}
    return np.array([ranks[x] for x in names], np.int64)


def longest(shard: Shard, items: Items, ids: list[str | None], begins: np.ndarray,
            at_least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Item position, length, text and word in the text of the longest verbatim match of each item suffix.

    Among equally long matches the one with the smallest (id, word). ``begins`` are the words of the texts before the shard's.
    """
    both = shard.both
    size, where = both.nearest(both.at, of_items=False)
    at = np.flatnonzero(size >= at_least)
    text = np.repeat(np.arange(len(ids)), np.diff(shard.first))
    word = np.arange(len(shard.codes)) - shard.first[text] + begins[text]
    key = np.full(len(both.order), _FAR)
    key[:len(text)] = (_ranked(ids)[text] << _WORD_BITS) | word
    best = both.smallest(both.order[where[at]], size[at], key)
    by_rank = np.zeros(len(ids), np.int64)
    by_rank[_ranked(ids)] = np.arange(len(ids))
    return at, size[at], by_rank[best >> _WORD_BITS] if len(at) else at, best & ((1 << _WORD_BITS) - 1)


class Match(NamedTuple):
    """A text's longest match: words, where it begins in the text, item and where it begins there."""

    words: int
    at: int
    item: str | None
    item_at: int

    def order(self) -> tuple:
        return -self.words, self.at, self.item is not None, self.item or "", self.item_at


_NO_MATCH = Match(0, 0, None, 0)


def longest_of_texts(shard: Shard, items: Items, begins: np.ndarray) -> dict[int, Match]:
    """The longest match of each text of the shard that has one."""
    both = shard.both
    text = np.repeat(np.arange(len(begins)), np.diff(shard.first))
    size, where = both.nearest(np.arange(len(text)), of_items=True)
    some = np.flatnonzero(size)
    # By text, longest first, then position.
    some = some[np.lexsort((some, -size[some], text[some]))]
    some = some[np.append(True, text[some][1:] != text[some][:-1])] if len(some) else some
    item = np.repeat(np.arange(len(items.names)), np.diff(items.first))
    key = np.full(len(both.order), _FAR)
    key[both.at] = (_ranked(items.names)[item] << _WORD_BITS) | (np.arange(len(item)) - items.first[item])
    best = both.smallest(both.order[where[some]], size[some], key)
    names = sorted(set(items.names), key=lambda x: (x is not None, x or ""))
    return {t: Match(w, p, names[b >> _WORD_BITS], b & ((1 << _WORD_BITS) - 1)) for t, w, p, b in zip(
        text[some].tolist(), size[some].tolist(), (some - shard.first[text[some]] + begins[text[some]]).tolist(), best.tolist(), strict=True)}


def _shards(first: np.ndarray, limit: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of texts i to j of about ``limit`` words, as (i, j, from word, to word).

    A longer text is cut into runs that overlap by ``width`` less a word, so each stretch of ``width`` words lies in one.
    """
    at, n = 0, len(first) - 1
    while at < n:
        to = int(np.searchsorted(first, first[at] + limit, side="right")) - 1
        if to > at:
            yield at, min(to, n), int(first[at]), int(first[min(to, n)])
            at = min(to, n)
            continue
        step = max(limit - width + 1, limit // 2, 1)
        for start in range(int(first[at]), int(first[at + 1]), step):
            yield at, at + 1, start, min(start + step + width - 1, int(first[at + 1]))
        at += 1


class _State(NamedTuple):
    """What the blocks so far have found in a text: covered word ranges, named items, number of items, longest match."""

    runs: np.ndarray
    names: list[str]
    items: int
    match: Match = _NO_MATCH

    def joined(self, other: _State) -> _State:
        return _State(np.concatenate([self.runs, other.runs]), self.names + other.names, self.items + other.items,
                      min(self.match, other.match, key=Match.order))

    def hit(self) -> int:
        reached = total = 0
        for start, end in sorted(self.runs.tolist()):
            total += max(0, end - max(start, reached))
            reached = max(reached, end)
        return total


_NOTHING = _State(np.zeros((0, 2), np.int64), [], 0)


def _read(kept: bytes | None) -> _State:
    return _NOTHING if kept is None else _State(*(x := pickle.loads(kept))[:3], Match(*x[3]))


def _cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts and where each text's begin."""
    data, offsets = w.buffers(texts)
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in w.chunks(offsets):
        cut = w.cut(data, offsets[i:j + 1], w.ALPHANUMERIC)
        hashes.append(cut.hash)
        sizes.append(np.diff(cut.first))
    return np.concatenate(hashes), np.append(0, np.cumsum(np.concatenate(sizes)))


def _overlap(items: Items, width: int) -> int:
    """Words that any match with the items has at most, a window at least."""
    return max(width, int(np.diff(items.first).max(initial=0)))


def _search_texts(texts: pa.Array, items: Items, width: int, shard_words: int,
                  longest: bool = False) -> tuple[np.ndarray, dict[int, _State]]:
    """Word counts of the texts, and what was found in those that match."""
    hashes, first = _cut_words(texts)
    found: dict[int, tuple[np.ndarray, set[int]]] = {}
    matches: dict[int, Match] = {}
    for i, j, a, b in _shards(first, shard_words, _overlap(items, width) if longest else width) if len(items.hashes) else ():
        own = np.clip(first[i:j + 1], a, b) - a
        shard = Shard.of(hashes[a:b], own, items, width, longest)
        if longest:
            for k, match in longest_of_texts(shard, items, own[:-1] + a - first[i:j]).items():
                matches[i + k] = min(match, matches.get(i + k, _NO_MATCH), key=Match.order)
        at, length, item, _start = occurrences(shard, items, width)
        if not len(at):
            continue
        marks = np.zeros(len(shard.codes) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        edge = np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0)
        runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
        run_text = np.searchsorted(shard.first, runs[:, 0], side="right") - 1
        pairs = np.unique(np.stack([np.searchsorted(shard.first, at, side="right") - 1, item]), axis=1)
        for k in np.unique(pairs[0]).tolist():
            # Positions within the text: shard codes have one separator per earlier text.
            shift = a - first[i + k] + (own[k] - shard.first[k])
            numbers = pairs[1][pairs[0] == k]
            new = (runs[run_text == k] + shift, set(numbers.tolist()))
            before = found.get(i + k)
            found[i + k] = new if before is None else (np.concatenate([before[0], new[0]]), before[1] | new[1])
    nothing = (_NOTHING.runs, set())
    return np.diff(first), {
        k: _State(runs, [x for m in sorted(numbers) if (x := items.names[m]) is not None], len(numbers), matches.get(k, _NO_MATCH))
        for k in found.keys() | matches.keys() for runs, numbers in (found.get(k, nothing),)}


_KEPT = "_decontamination"
#: Blocks searched before the carried rows are written to the checkpoint folder; bounds what the driver holds.
BLOCKS_AT_ONCE = 16


def _carried(items: Items, text_col: str, width: int, shard_words: int, longest: bool = False):
    """Adds what a block finds to the state column."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(_KEPT)
            _, found = _search_texts(batch.column(batch.schema.get_field_index(text_col)), items, width, shard_words, longest)
            states = [x.as_py() for x in batch.column(at)]
            for k, state in found.items():
                both = _read(states[k]).joined(state)
                states[k] = pickle.dumps((*both[:3], tuple(both.match)))
            yield batch.set_column(at, batch.schema.field(at), pa.array(states, pa.binary()))

    return carry


def _last_block(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, width: int,
                shard_words: int, block_bytes: int, longest: bool = False) -> tuple[DataFrame, Items]:
    """The rows with the state after all blocks but the last, and the last block."""
    frame = docs.withColumn(_KEPT, F.lit(None).cast("binary"))
    last = _block([], [])
    for number, block in enumerate(item_blocks(items, item_col, item_text_col, block_bytes)):
        if number:
            frame = frame.mapInArrow(_carried(last, text_col, width, shard_words, longest), frame.schema)
            if number % BLOCKS_AT_ONCE == 0:
                frame = cut_lineage(frame)
        last = block
    return frame, last


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
                  shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, longest: bool = False) -> DataFrame:
    """``id_col``, n_words, n_hit, n_items, items_sha256, contaminated: one row per row.

    ``longest`` adds longest_words, longest_at, longest_item, longest_item_at: the longest verbatim match of any length.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    frame, block = _last_block(rows, items, "_text", item_col, item_text_col, width, shard_words, block_bytes, longest)
    id_type = rows.schema["_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = _search_texts(batch.column(1), block, width, shard_words, longest)
            states = [_read(x.as_py()) for x in batch.column(2)]
            states = [s.joined(found[k]) if k in found else s for k, s in enumerate(states)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([s.hit() for s in states], pa.int64()),
                 pa.array([s.items for s in states], pa.int64()),
                 pa.array([sha256(",".join(sorted(s.names)).encode()).hexdigest() for s in states], pa.string()),
                 *[pa.array([getattr(s.match, n) if n == "words" or s.match.words else None for s in states], kind)
                   for n, kind in zip(Match._fields, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)]],
                names=["_id", "n_words", "n_hit", "n_items", "items_sha256", *places])

    places = ["longest_words", "longest_at", "longest_item", "longest_item_at"]
    judged = frame.mapInArrow(
        judge, f"_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, longest_words bigint, "
        "longest_at bigint, longest_item string, longest_item_at bigint")
    hit = (F.col("n_hit") > 0) & (F.lit(ONE_IN) * F.col("n_hit") >= F.col("n_words"))
    return judged.select(F.col("_id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", hit.alias("contaminated"),
                         *(places if longest else ()))


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", width: int = WINDOW, shard_words: int = SHARD_WORDS,
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that are not contaminated; columns and values stay as they are."""
    frame, block = _last_block(docs, items, text_col, item_col, item_text_col, width, shard_words, block_bytes)
    text_at, kept_at = docs.columns.index(text_col), len(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = _search_texts(batch.column(text_at), block, width, shard_words)
            keep = []
            for k, (size, state) in enumerate(zip(sizes.tolist(), batch.column(kept_at), strict=True)):
                n = _read(state.as_py()).joined(found.get(k, _NOTHING)).hit()
                keep.append(not (n > 0 and ONE_IN * n >= size))
            yield batch.select(list(range(kept_at))).filter(pa.array(keep, pa.bool_()))

    return frame.mapInArrow(clean, docs.schema)


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", at_least: int = WINDOW,
                    shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, item_at, words, doc, doc_at: the longest verbatim match (of ``at_least`` words or more) of each item suffix.

    Positions count words from 0; among equally long matches the one with the smallest (doc, doc_at) is given.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))

    def matches(block: Items):
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                hashes, first = _cut_words(batch.column(1))
                for i, j, a, b in _shards(first, shard_words, _overlap(block, at_least)):
                    own = np.clip(first[i:j + 1], a, b) - a
                    shard = Shard.of(hashes[a:b], own, block, at_least, longest=True)
                    at, size, text, word = longest(shard, block, ids[i:j], own[:-1] + a - first[i:j], at_least)
                    item = np.searchsorted(block.first, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.names[k] for k in item.tolist()], pa.string()), pa.array(at - block.first[item]),
                         pa.array(size), pa.array([ids[i + k] for k in text.tolist()], pa.string()), pa.array(word)],
                        names=["item", "item_at", "words", "doc", "doc_at"])

        return match

    out = None
    for block in item_blocks(items, item_col, item_text_col, block_bytes):
        one = rows.mapInArrow(matches(block), "item string, item_at bigint, words bigint, doc string, doc_at bigint")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item string, item_at bigint, words bigint, doc string, doc_at bigint")
    best = F.min(F.struct((-F.col("words")).alias("_w"), "doc", "doc_at")).alias("_best")
    return out.groupBy("item", "item_at").agg(best).select(
        "item", "item_at", (-F.col("_best._w")).alias("words"), "_best.doc", "_best.doc_at")
