"""Brute-force versions that several test modules use."""

import itertools
import re

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def grams(words, n):
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def brute_print(text):
    words = BLANK.findall(lowered(text or ""))
    if not words:
        return 0
    hashed = [xxhash.xxh64_intdigest(g.encode(), 42) for g in (grams(words, 4) or [" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_groups(prints, distance):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(prints)), 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance:
            root[find(b)] = find(a)
    return {p: find(p) for p in prints}


def shingle_set(text, n=5):
    words = BLANK.findall(lowered(text or ""))
    return frozenset(grams(words, n) or [" ".join(words)] * bool(words))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_similar_groups(sets, least=0.8):
    """Per set a name of its group: sets linked by similarity, directly or over others."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(sets), key=sorted), 2):
        if jaccard(a, b) >= least:
            root[find(b)] = find(a)
    return {s: find(s) for s in sets}


def brute_contamination(rows, items):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lowered(t or ""))
        for g in grams(w, 13) if len(w) >= 13 else [" ".join(w)] * bool(w):
            windows.setdefault(tuple(g.split(" ")), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, met = ALNUM.findall(lowered(t or "")), set(), set()
        for size in {len(k) for k in windows}:
            for j in range(len(w) - size + 1):
                if (key := tuple(w[j : j + size])) in windows:
                    hit |= set(range(j, j + size))
                    met |= windows[key]
        met.discard(None)
        out.append((str(d), len(w), len(hit), tuple(sorted(met)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def brute_base(text):
    spans = [(m.start(), k, m.end()) for k, (p, g, least) in enumerate(BASE.values()) for m in p.finditer(text or "") if len(m[g]) >= least]
    return sorted(spans)
