"""Plain restatements of what the operators return."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import sha256

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(pattern: re.Pattern, text: str | None) -> list[str]:
    return pattern.findall((text or "").translate(LOWER))


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    w = words(SPACED, text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def roots(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def components_by_jaccard(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (size of its set, smallest id it hangs together with); ids are distinct."""
    rows = sorted(rows)
    sets = [shingle_set(t) for _, t in rows]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
              and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = roots(len(rows), linked)
    return {rows[i][0]: (len(sets[i]), rows[root[i]][0]) for i in range(len(rows))}


def contamination(docs: list[tuple], items: list[tuple], width: int = 13) -> list[tuple]:
    windows: dict[tuple, set[int]] = {}
    for number, (_, text) in enumerate(items):
        w = words(ALNUM, text)
        for s in [tuple(w)] if 0 < len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]:
            windows.setdefault(s, set()).add(number)
    sizes, out = {len(s) for s in windows}, []
    for doc, text in docs:
        w, hit, found = words(ALNUM, text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i:i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        names = sorted(str(items[k][0]) for k in found if items[k][0] is not None)
        out.append((doc, len(w), len(hit), len(found), sha256(",".join(names).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])"""
    r"""|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base_spans(text: str | None) -> list[str]:
    text, found = text or "", []
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def kept_words(docs: list[tuple], width: int = 20) -> list[tuple]:
    """Of documents in order: (id, words, removed spans, kept text)."""
    cut = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in docs]
    first: dict[tuple, tuple[int, int]] = {}
    for d, w in enumerate(cut):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i:i + width]), (d, i))
    out = []
    for d, w in enumerate(cut):
        gone = {k for i in range(len(w) - width + 1) if first[tuple(w[i:i + width])] < (d, i) for k in range(i, i + width)}
        begins = [k for k in sorted(gone) if k - 1 not in gone]
        ends = [k + 1 for k in sorted(gone) if k + 1 not in gone]
        out.append((docs[d][0], len(w), list(zip(begins, ends, strict=True)), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def spelling(docs: list[tuple]) -> set[tuple]:
    """(word, form, root, n, n_near, form_n), near words found by trying every edit."""
    counts: Counter = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        edits |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        found = sorted((e for e in edits - {w} if e in n), key=lambda e: (-n[e], e))
        near[w], form[w] = len(found), found[0] if found and n[found[0]] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], near[w], n.get(form[w])))
    return out
