"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCHMARK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dups, len(hit), failed


def contamination(docs, items):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)] of (id, text) rows."""

    def words(text):
        return BENCHMARK_WORD.findall((text or "").translate(UPPER))

    windows = defaultdict(set)
    for item, text in items:
        found = words(text)
        size = min(10, len(found))
        for i in range(len(found) - size + 1):
            if size:
                windows[tuple(found[i : i + size])].add(str(item))
    rows = []
    for doc, text in docs:
        found, hit, which = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(found) - size + 1):
                owners = windows.get(tuple(found[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    which |= owners
        digest = hashlib.sha256(",".join(sorted(which)).encode()).hexdigest()
        rows.append((doc, len(found), len(hit), len(which), digest, bool(hit)))
    return rows


def shingles(text, width):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(docs, width=3, percent=85):
    """{position: smallest reachable id} of (id, text) rows."""
    sets = [shingles(text, width) for _, text in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if docs[i][0] is None or docs[j][0] is None or not a or not b:
                continue
            if 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            best[find(i)] = min(best.get(find(i), doc), doc)
    return [best.get(find(i)) if docs[i][0] is not None else None for i in range(len(docs))]


def repeats(docs, length=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)] of (id, text) rows."""
    order = {i: (doc if doc is not None else 2**63 - 1) for i, (doc, _) in enumerate(docs)}
    data = [(text or "").encode() for _, text in docs]
    first = {}
    for i, b in enumerate(data):
        for k in range(len(b) - length + 1):
            piece = b[k : k + length]
            first[piece] = min(first.get(piece, order[i]), order[i])
    rows = []
    for i, b in enumerate(data):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order[i]:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        rows.append((docs[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


SECRETS = (
    ("assign", re.compile(
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def base_secrets(text):
    """[(start, kind number, end, value)] of the base kinds."""
    found = []
    for number, (_, pattern, group, least) in enumerate(SECRETS):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), number, m.end(), m[group]))
    return sorted(found)
