"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def hits(docs, items, size=10):
    """Per document: words, hit words, items."""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(size, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[p : p + k])].add(str(i))
    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if s := windows.get(tuple(w[p : p + k])):
                    found |= s
                    hit.update(range(p, p + k))
        out.append((len(w), len(hit), sorted(found)))
    return out


def longest(docs, items, size=10):
    """Per document: words and first word of its longest match, of a window or of a whole shorter item at least."""
    out = []
    for t in docs:
        w, best = words(t), (0, 0)
        for item in {tuple(words(x)) for _, x in items} - {()}:
            least = min(size, len(item))
            for p in range(len(w)):
                for q in range(len(item)):
                    n = 0
                    while p + n < len(w) and q + n < len(item) and w[p + n] == item[q + n]:
                        n += 1
                    if n >= least:
                        best = max(best, (n, -p))
        out.append((best[0], -best[1] if best[0] else None))
    return out


def shingles(text, n=5):
    w = words(text)
    k = min(n, len(w))
    return Counter(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if k else Counter()


def probability_jaccard(a, b):
    x, y = shingles(a), shingles(b)
    every = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in set(x) & set(y))


def classes(docs, least=0.8):
    """doc_id -> least doc_id of its connected class, for (doc_id, text)."""
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having, equal, pairs = defaultdict(list), {}, set()
    for i, (_, t) in enumerate(docs):
        if (first := equal.setdefault(t, i)) != i:
            parent[i] = first
            continue
        for s in shingles(t):
            pairs.update((i, j) for j in having[s])
            having[s].append(i)
    for i, j in sorted(pairs):  # pairs without a common shingle have a similarity of 0
        if probability_jaccard(docs[i][1], docs[j][1]) >= least:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    members = defaultdict(list)
    for i, d in enumerate(docs):
        members[root(i)].append(d[0])
    return {d: min(m) for m in members.values() for d in m}


def removed(docs, size=100):
    """Per document in order: bytes, removed, runs, sha of what is kept."""
    seen, out = set(), []
    for t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if b[i : i + size] in seen:
                cover[i : i + size] = b"\1" * size
            seen.add(b[i : i + size])
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
