"""Plain versions of the operators, a document at a time."""

import collections
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lower(text))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def classes(docs):
    """(doc_id -> (n_shingles, component_id)) by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def base_stats(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def lm(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base, score)."""
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    one, two = collections.Counter(), collections.Counter()
    for d, w in tokens.items():
        if not held[d]:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    kept = {p: c for p, c in two.items() if c >= 2}
    rest = collections.defaultdict(lambda: 1.0)
    for (u, _), c in kept.items():
        rest[u] -= (c - 0.75) / one[u]
    out = {}
    for d, w in tokens.items():
        p1 = [(one[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        p = [p1[0]] + [(((kept[u, x] - 0.75) / one[u]) if (u, x) in kept else 0.0) + (rest[u] if u in rest else 1.0) * q for u, x, q in zip(w, w[1:], p1[1:], strict=False)]
        out[d] = (held[d], len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, p1)), sum(map(math.log10, p)))
    return out


LOOSE = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def leaks(docs, items, threshold=0.75):
    """doc_id -> items with a window of the item's length whose weighted shingle similarity reaches the threshold."""
    words = {i: LOOSE.findall(lower(t)) for i, t in items if t}
    words = {i: w for i, w in words.items() if w}

    def shingles(w, k):
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}

    sets = {i: shingles(w, min(5, len(w))) for i, w in words.items()}
    df = collections.Counter(s for x in sets.values() for s in x)
    weigh = lambda x: sum(math.log1p(len(words) / df[s]) if s in df else math.log1p(len(words)) for s in x)
    out = {}
    for d, t in docs:
        w = LOOSE.findall(lower(t))
        hit = set()
        for i, item in words.items():
            for s in range(max(1, len(w) - len(item) + 1)):
                x = shingles(w[s : s + len(item)], min(5, len(item)))
                if x & sets[i] and weigh(x & sets[i]) / weigh(x | sets[i]) >= threshold:
                    hit.add(i)
                    break
        out[d] = hit
    return out
