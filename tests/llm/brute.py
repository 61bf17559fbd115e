"""Plain Python versions of the contracts, for small tables."""
import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substring(rows, size=50):
    """rows: (doc_id, text) -> {(doc_id, n_words, n_removed, kept_sha256)} as a sorted list."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - size + 1):
                if least[tuple(w[i : i + size])] < d:
                    gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def byte_repeats(rows, size=200):
    count = defaultdict(int)
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        for i in range(len(b) - size + 1):
            count[b[i : i + size]] += 1
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(rows):
    """(doc_id, n_shingles, component_id, kept)"""
    sets = [(d, shingles(t)) for d, t in rows]
    ids = sorted({d for d, _ in sets})
    top = {d: d for d in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    where = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].add(k)
    for k, (d, s) in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                if j < k:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = root(d), root(sets[j][0])
                top[max(a, b)] = min(a, b)
    return [(d, len(s), root(d), root(d) == d) for d, s in sets]


def thue_morse(n):
    """The string of n letters a and b, and its complement: they meet under any polynomial modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))
