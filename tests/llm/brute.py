"""Plain versions of the corpus operators for small inputs."""

import hashlib
from collections import Counter


def repeats(docs, length):
    """(doc, bytes, removed, runs, sha256 of the rest) as sorted rows."""
    seen = Counter()
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def earlier(docs, length):
    order = lambda d: -(2**63) if d is None else d
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, 2**63), order(d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < order(d):
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def shingles(t):
    w = (t or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))


def near(docs, similarity=0.8):
    """(doc, smallest doc of its class) as sorted rows."""
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [shingles(t) for _, t in docs]
    for i, (_, t) in enumerate(docs):
        for j in range(i):
            if (docs[j][1] or "") == (t or "") or (bags[i] and probability_jaccard(bags[i], bags[j]) >= similarity - 1e-12):
                parent[root(i)] = root(j)
    members = {}
    for i, (d, _) in enumerate(docs):
        members.setdefault(root(i), []).append(d)
    return sorted(((d, min((x for x in members[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)), key=str)


def edits(passage, text):
    """Least edits between a passage and any part of a text."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        now = [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            now[j] = min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1)
        before = now
    return min(before)


def words(docs, every=97, least_points=5, least_n=3):
    """Counts of the runs of op12's texts."""
    import re
    import zlib

    seen = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_points:
                seen[w] += 1
    return {w: n for w, n in seen.items() if n >= least_n}


def variants(counts):
    """(word, form, root, n, n_near, form_n): near words by what is left when a code point goes."""
    near = {w: set() for w in counts}
    holes = {}
    for w in counts:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in counts:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= set(same) - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def inner(x, y):
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total += a * b  # sum() would compensate
    return total


def neighbours(rows, k=20, every=20):
    """(query, rank, other, score) over all rows (key, vector)."""
    good = sorted({i: v for i, v in sorted(rows, key=str) if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v) and any(v)}.items())
    out = []
    for q, x in good:
        if q % every == 0:
            far = sorted((-inner(x, y), i) for i, y in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(far[:k])]
    return out
