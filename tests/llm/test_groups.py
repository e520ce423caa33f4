"""Operators that compare rows with each other or with a benchmark."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from plumbrule.llm import components, decontaminate, ngram_join, queries, vector_dedup
from plumbrule.llm import words as w
from tests.llm import brute
from tests.llm.conftest import SF

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aZ9é日 \t\n-_/", max_size=30), max_size=6))
def test_words(texts):
    import pyarrow as pa

    for separators, pattern in ((w.SPACED, brute.SPACED), (w.ALPHANUMERIC, brute.ALNUM)):
        cut = w.cut(*w.buffers(pa.array(texts, pa.string())), separators)
        data, _ = w.buffers(pa.array(texts, pa.string()))
        seen = {}
        for i, t in enumerate(texts):
            own = range(int(cut.first[i]), int(cut.first[i + 1]))
            assert [bytes(data[cut.start[k]:cut.end[k]]).decode().translate(brute.LOWER) for k in own] == brute.words(pattern, t)
            for k, word in zip(own, brute.words(pattern, t), strict=True):
                assert seen.setdefault(word, cut.hash[k]) == cut.hash[k]
        assert len(set(seen.values())) == len(seen)


def near_copies(n: int, size: int, swaps: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{seed}_{i}" for i in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(swaps)):
            own[rng.randrange(size)] = f"x{rng.random()}"
        out.append(" ".join(own))
    return out


def test_ngram_components(frame):
    texts = [None, "", " \n ", "one", "One", "a b c d", "a b c d e", "A B C D E", *near_copies(60, 90, 7, 1), *near_copies(25, 300, 14, 2),
             *near_copies(300, 40, 3, 3), "same text here " * 400]
    texts += ["a common passage of words that many texts share word for word " * 2 + t for t in near_copies(40, 30, 4, 4)]
    texts += texts[10:30]
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts))
    got = ngram_join.ngram_components(frame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_shingles int")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components_by_jaccard(rows) and len(got) == len(rows)


def test_ngram_prefixes_are_complete():
    """Whatever links shares an indexed combination with a probe, for any counts."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
        keep = rng.random(len(x)) < rng.uniform(0.75, 1)
        y = np.union1d(x[keep], rng.integers(1, 1 << 62, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))
        o = len(np.intersect1d(x, y))
        if 100 * o < 75 * (len(x) + len(y) - o):
            continue
        if len(x) > len(y):
            x, y = y, x
        df = {int(t): int(c) for t, c in zip(np.union1d(x, y), rng.choice([2, 3, 20, 100, 400, 9000], len(np.union1d(x, y))), strict=True)}

        def prefix(tokens, share, bands):
            own = np.array([df[int(t)] for t in tokens])
            order = np.lexsort((tokens, own))
            return set().union(*(ngram_join.signatures(tokens[order], own[order], 0, ngram_join._need(len(tokens), share), b) for b in bands))

        low = -(-75 * len(y) // 100)
        assert prefix(x, (150, 175), [len(x).bit_length()]) & prefix(y, (75, 100), range(low.bit_length(), len(y).bit_length() + 1))


def test_ngram_of_odd_rows(frame):
    rows = [(7, "p q r s t u"), (7, "k l m n o p"), (3, "k l m n o p"), (9, "p q r s t u"), (None, "p q r s t u"), (5, None), (5, None),
            (8, ""), (2, ""), (2, "k l m n o p")]
    got = ngram_join.ngram_components(frame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {7: 2, 3: 2, 9: 2, None: None, 5: 5, 8: 8, 2: 2} and len(got) == 10
    docs = frame([(*r, "z") for r in rows], "doc_id long, text string, component_id string")
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "8", "None"]
    assert ngram_join.ngram_components(frame([], "doc_id long, text string")).count() == 0


@needs_data
def test_ngram_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.registry.queries["op10_ngram_jaccard_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components_by_jaccard(rows) and len(got) == len(rows)


def test_components(frame):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [
        (2000, 2000), (None, 3)] + [(5000 - i, 4000) for i in range(200)]
    got = {r.node: r.component for r in components.components(frame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    root = brute.roots(len(nodes), [(at[a], at[b]) for a, b in real])
    assert got == {x: nodes[root[i]] for i, x in enumerate(nodes)}
    assert components.components(frame([], "a long, b long")).count() == 0


ITEMS = [(1, "The quick brown fox jumps over the lazy dog, and then it sleeps all day long in the sun."), (2, "short item"), (10, "short  ITEM!"),
         (3, None), (4, "..."), (5, "é è 1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (None, "unnamed passage of three")]


def documents() -> list[tuple]:
    text = ITEMS[0][1]
    return [(1, text), (2, "x " * 300 + text), (3, "x " * 900 + text), (4, None), (5, ""), (6, "Short item short item"), (7, text[:40]),
            (8, "é è 1 2 3 4 5 6 7 8 9 10 11 12 13 " * 3), (9, "an unnamed passage of three words"), (1, text), (11, "z " * 40_000), (12, "quick " + text[4:])]


@pytest.mark.parametrize("setting", [{}, {"shard_words": 40}, {"block_bytes": 30}])
def test_contamination(frame, setting):
    docs, items = frame([(*d, 1) for d in documents()], "doc_id long, text string, n_hit int"), frame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contamination(docs, items, **setting).collect()]
    expected = brute.contamination(documents(), ITEMS)
    assert sorted(got) == sorted(expected)
    clean = decontaminate.without_contaminated(docs, items, **setting)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(e[0] for e in expected if not e[-1])
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0), **setting).collect())
    assert decontaminate.contamination(docs.limit(0), items, **setting).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for _ in range(30):
        codes = rng.integers(0, 4, int(rng.integers(1, 200)))
        order = decontaminate.suffix_array(codes)
        padded = [*codes.tolist(), *[0] * 27]
        assert [padded[i:i + 27] for i in order] == sorted(padded[i:i + 27] for i in range(len(codes)))


def test_longest_matches(frame):
    docs, items = frame(documents(), "doc_id long, text string"), frame(ITEMS[:1], "item_id long, text string")
    got = {(r.item_at, r.words) for r in decontaminate.longest_matches(docs, items).collect()}
    n = len(brute.words(brute.ALNUM, ITEMS[0][1]))
    assert got == {(k, n - k) for k in range(n - 12)}


def prefix(a: list[str], b: list[str]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("setting", [{}, {"shard_words": 40}, {"block_bytes": 30}])
def test_longest_matches_are_whole(frame, setting):
    rng = random.Random(6)
    long = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(59)]
    items = [(1, " ".join(long)), (2, " ".join(long[5:20] * 3)), (3, "x y"), (None, "y z"), (4, None)]
    docs = [(1, " ".join(long[:40] + ["q"] * 9)), (2, " ".join(["r"] * 50 + long + ["r"] * 50)), (3, " ".join(["s"] * 30 + long)), (4, "q x y z q"), (5, None),
            (6, " ".join(long[:45])), (7, " ".join((long[5:20] * 4)[2:])), (7, " ".join(long[3:])), (10, " ".join(["t"] * 7 + long)), (11, "none at all")]
    words = {k: t.split() for k, t in items if t}
    wanted = {}
    for k, item in words.items():
        for i in range(len(item)):
            found = [(-prefix(item[i:], t.split()[p:]), str(d), p) for d, t in docs if t for p in range(len(t.split()))]
            if (best := min(found)) and -best[0] >= 13:
                wanted[(None if k is None else str(k), i)] = (-best[0], *best[1:])
    frames = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    got = {(r.item, r.item_at): (r.words, r.doc, r.doc_at) for r in decontaminate.longest_matches(*frames, **setting).collect()}
    assert got == wanted
    rows = decontaminate.contamination(*frames, **setting, longest=True).collect()
    expected = []
    for d, t in docs:
        found = [(-n, p, k is not None, str(k or ""), i) for p in range(len((t or "").split())) for k, item in words.items()
                 for i in range(len(item)) if (n := prefix(item[i:], t.split()[p:]))]
        n, p, named, k, i = min(found, default=(0, None, False, "", None))
        expected.append((d, -n, p, k if named else None, i))
    assert sorted(map(str, expected)) == sorted(
        str((r.doc_id, r.longest_words, r.longest_at, r.longest_item, r.longest_item_at)) for r in rows)


def test_vectors(frame):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 24))
    rows = [c + rng.normal(0, s, 24) for c in centres for s in (0.05, 0.1, 0.2, 0.25, 0.3)] + [rng.standard_normal(24) for _ in range(200)]
    rows += [centres[0] + rng.normal(0, 0.1, 24) for _ in range(150)] + [rows[3]] * 20 + [rows[7] * 3]
    vectors = [[float(x) for x in np.float32(r)] for r in rows]
    odd = [None, [], [0.0] * 24, [None] * 24, [1.0, float("nan")], [float("inf")] * 24, [1.0], [1.0, 0.0]]
    data = [(i, v, 1) for i, v in enumerate([*vectors, *odd])]
    got = {r.vec_id: r for r in vector_dedup.vector_components(frame(data, "vec_id long, embedding array<float>, n_links int")).collect()}
    assert len(got) == len(data)
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    links = np.array([got[i].n_links for i in range(len(vectors))])
    assert (links <= linked.sum(axis=1)).all() and links.sum() >= 0.95 * linked.sum()
    assert [got[len(vectors) + k].n_links for k in range(len(odd))] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    root = brute.roots(len(vectors), list(zip(*np.nonzero(linked), strict=True)))
    assert sum(got[i].component_id == root[i] for i in range(len(vectors))) >= 0.97 * len(vectors)
    assert vector_dedup.vector_components(frame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_with_a_shared_direction(frame):
    """Shifted by twice their spread: bits balance, few pairs are compared, and no less is found."""
    rng = np.random.default_rng(5)
    own = rng.standard_normal((1400, 32))
    rows = own / np.linalg.norm(own, axis=1, keepdims=True) + 2 * np.eye(32)[3]
    near = rows[:600] + rng.standard_normal((600, 32)) * rng.uniform(0.02, 0.14, (600, 1))
    x = np.float32(np.concatenate([rows, near])).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre, tables, bits = vector_dedup.coded_by(unit, len(unit))
    assert centre.any()
    projection = vector_dedup.learn(unit - centre, tables * bits)
    bit = unit @ projection >= centre @ projection
    assert 0.35 < bit.mean(axis=0).min() and bit.mean(axis=0).max() < 0.65
    keys = vector_dedup.keys_of(unit, projection, centre @ projection, tables, bits)
    assert tables * vector_dedup._compared_share(keys) < 0.3
    data = [(i, [float(v) for v in r]) for i, r in enumerate(np.float32(x))]
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_components(frame(data, "vec_id long, embedding array<float>")).collect()}
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    links = np.array([got[i] for i in range(len(x))])
    assert linked.sum() > 400 and (links <= linked.sum(axis=1)).all() and links.sum() >= 0.9 * linked.sum()
    # Without a shared direction nothing is taken off, nor where all vectors are alike.
    flat = own / np.linalg.norm(own, axis=1, keepdims=True)
    assert not vector_dedup.coded_by(flat, len(flat))[0].any()


def test_large_buckets_are_dealt_into_blocks(frame, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    data = [(i, [float(v) for v in np.eye(8)[0] + rng.normal(0, 0.01, 8)]) for i in range(150)]
    got = vector_dedup.vector_components(frame(data, "vec_id long, embedding array<float>")).collect()
    assert {r.n_links for r in got} == {149} and {r.component_id for r in got} == {0}


@needs_data
def test_recall_on_embeddings(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {r.vec_id: r.n_links for r in queries.registry.queries["op8_embedding_near_dedup"](spark, SF).collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    real = (x @ x.T >= 0.95).sum() - len(ids)
    assert 0.9 * real <= sum(got.values()) <= real
