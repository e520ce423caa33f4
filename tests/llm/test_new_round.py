"""Spelling variants, whitening and repeated passages against plain restatements."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from plumbrule.llm import queries, spelling, substring_dedup, whitening
from tests.compare import compare, connect
from tests.llm import brute
from tests.llm.conftest import SF

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def passages() -> list[tuple]:
    rng = random.Random(5)
    shared = [" ".join(rng.choice(["ab", "Ab", "c", "día", "x" * 40]) + str(rng.randrange(300)) for _ in range(30)) for _ in range(6)]
    rows: list[tuple] = [(7, None), (8, ""), (9, "  \t"), (10, "one two"), (11, "w " * 19), (12, "w " * 20), (13, "w " * 21),
                         (15, "\x1c " + shared[0]), (14, shared[0]), (16, shared[0].upper()), (17, shared[0].replace(" ", "\n\t ")),
                         (18, "long " * 3 + " ".join(f"n{i % 5000}" for i in range(12_000))), (None, shared[1]), (5, shared[1] + " end")]
    for k in range(60):
        own = [f"own{rng.randrange(10_000)}" for _ in range(rng.randrange(40))]
        rows.append((100 + k, " ".join([*own[:5], *rng.sample(shared, 2), *own[5:], rng.choice(shared)[:rng.randrange(400)]])))
    return rows


@pytest.mark.parametrize("part", [substring_dedup.PART_BYTES, 700])
def test_repeated_passages(frame, monkeypatch, part):
    monkeypatch.setattr(substring_dedup, "PART_BYTES", part)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", part * 3)
    monkeypatch.setattr(substring_dedup, "WEIGHT_BYTES", 200)
    rows = passages()
    docs = frame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _part int, _id string")
    got = substring_dedup.substring_dedup(docs).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    expected = [(i, n, sum(b - a for a, b in spans), spans, kept) for i, n, spans, kept in brute.kept_words(rows)]
    assert sorted((str(r[0]), r[1], r[2], [tuple(s) for s in r[3]], r[4]) for r in got) == sorted((str(e[0]), *e[1:]) for e in expected)


def test_repeated_passages_of_one_id(frame, monkeypatch):
    """Rows that share an id, in several parts: of equal rows the first keeps its words."""
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "WEIGHT_BYTES", 100)
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(8)]
    rows = [(4, t) for t in texts for _ in range(5)] + [(3, texts[0]), (9, texts[1])]
    got = substring_dedup.substring_dedup(frame(rows, "doc_id long, text string")).collect()
    assert sorted((r._id, r._n_removed) for r in got) == sorted(
        [(3, 0), (9, 30), *[(4, 30)] * 33, *[(4, 0)] * 7])


def test_no_passages(frame):
    assert substring_dedup.substring_dedup(frame([], "doc_id long, text string")).collect() == []


@needs_data
@pytest.mark.parametrize("part", [1 << 24, 20_000])
def test_passages_of_documents(spark, monkeypatch, part):
    monkeypatch.setattr(substring_dedup, "PART_BYTES", part)
    name = "op13_substring_dedup"
    ok, note = compare(spark, name, queries.registry.queries[name], queries.registry.sql[name], SF, connect(SF))
    assert ok, note


def test_packed_hashes():
    for h in ([0], [5, 6, 1 << 63], list(range(300)), [(1 << 64) - 1]):
        h = np.array(h, np.uint64)
        assert (substring_dedup._unpacked(substring_dedup._packed(h)) == h).all()


def misspelt() -> list[tuple]:
    rng = random.Random(3)
    base = ["estación", "garçonnière", "Ampersand", "question", "commonly", "stations", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÿabcdefg"]
    rows: list[tuple] = [(1, None), (2, ""), (None, "question question"), (3, "shortābroken×letters÷Question"), (4, "a" * 3000 + " " + "a" * 3001)]
    for k in range(900):
        w = rng.choice(base) if k % 3 else base[3]
        if k % 7 == 0:
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1:], w[:at] + "xé"[k % 2] + w[at:], w[:at] + "z" + w[at + 1:]])
        rows.append((k, f"{w} {rng.choice(base)},{w}"))
    rows += [(5000, "a" * 3000), (5001, "a" * 3001), (5001, "a" * 3001)] + [(k, "questio") for k in range(6000, 6009)]
    return rows


@pytest.mark.parametrize("letters", [spelling.SHARD_LETTERS, 40])
def test_spelling(frame, monkeypatch, letters):
    monkeypatch.setattr(spelling, "SHARD_LETTERS", letters)
    rows = misspelt()
    got = spelling.spelling_variants(frame([(i, t, "y", 2) for i, t in rows], "doc_id long, text string, word string, n int")).collect()
    expected = brute.spelling(rows)
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert sum(r.form is not None for r in got) > 5


def test_no_spelling(frame):
    assert spelling.spelling_variants(frame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(frame([(1, "letters letters"), (2, None)], "doc_id long, text string")).count() < 2


@needs_data
def test_spelling_of_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.registry.queries["op11_spelling_variants"](spark, SF).collect()
    assert {tuple(r) for r in got} == brute.spelling(docs) and len({r.word for r in got}) == len(got)


def whitened_by_numpy(rows: list[tuple], dims: int):
    kept = [(i, [float(c) for c in v] + [0.0] * (dims - len(v))) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array(x, np.float64) - np.array(sums) / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    return [i for i, _ in kept], deviation, centred, value, vector


@pytest.mark.parametrize("block", [whitening.BLOCK_NUMBERS, 24])
def test_whitening(frame, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", block)
    rng = np.random.default_rng(2)
    spread = np.array([9, 7, 5, 4, 3, 2, 1.5, 1, 0.7, 0.4, 0.2, 0.1])
    rows = [(k, (rng.standard_normal(12) * spread + 3).tolist()) for k in range(80)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0]),
             (None, rows[3][1]), (3, rows[3][1])]
    got = whitening.whitened(frame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, _x string, component int")).collect()
    ids, deviation, centred, value, vector = whitened_by_numpy(rows, 12)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {len(ids)} and {r.identity_error for r in got} < {1e-9} | {r.identity_error for r in got}
    assert max(r.identity_error for r in got) < 1e-9
    for c in range(8):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c + 1)
        w = centred @ vector[:, c] / np.sqrt(value[c])
        one = sorted((str(i), d, x) for i, d, x in zip(ids, deviation, w, strict=True))
        other = sorted((str(i), d, -x) for i, d, x in zip(ids, deviation, w, strict=True))
        assert any([m[:2] for m in mine] == [o[:2] for o in side] and np.allclose([m[2] for m in mine], [o[2] for o in side], atol=1e-8)
                   for side in (one, other))
        assert abs(next(r.explained for r in got if r.component == c + 1) * value.sum() / value[c] - 1) < 1e-9


def test_whitening_without_variance(frame):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(frame([], schema)).collect() == []
    assert whitening.whitened(frame([(1, None), (2, [])], schema)).collect() == []
    got = whitening.whitened(frame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 2.0])], schema)).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in got} == {(1, False, 1.0), (2, True, 0.0)}
    alone = whitening.whitened(frame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(0, None, 0.0, 0.0)] * 2


def test_deviation_of_wide_vectors(frame):
    """Squares beyond a long become decimals; what exceeds a long is null."""
    rows = [(1, [3e6, 0.0]), (2, [-3e6, 1.0]), (3, [0.0, 0.5]), (4, [1e300, 0.0])]
    got = whitening.whitened(frame(rows[:3], "vec_id long, embedding array<double>")).collect()
    ids, deviation, *_ = whitened_by_numpy(rows[:3], 2)
    fits = dict(zip(ids, [d if d < 1 << 63 else None for d in deviation], strict=True))
    assert None in fits.values() and {r.vec_id: r.deviation for r in got} == fits
    assert {r.deviation for r in whitening.whitened(frame(rows, "vec_id long, embedding array<double>")).collect()} >= {None}


@needs_data
def test_whitening_of_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, deviation, centred, value, vector = whitened_by_numpy(rows, 64)
    got = queries.registry.queries["op12_embedding_whitening"](spark, SF).collect()
    at, w = {i: k for k, i in enumerate(ids)}, np.zeros((len(ids), 8))
    for r in got:
        w[at[r.vec_id], r.component - 1] = r.whitened
    assert all(r.deviation == deviation[at[r.vec_id]] for r in got) and len(got) == 8 * len(ids)
    want = centred @ vector[:, :8] / np.sqrt(value[:8])
    assert np.allclose(np.abs(w), np.abs(want), atol=1e-7)
