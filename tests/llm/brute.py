"""Plain one-process versions of the operators, to compare with on small inputs."""

import hashlib
import re
from collections import Counter

SPACE = re.compile("[\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in SPACE.split(lower(text)) if w]


def shingles(text, size=5):
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def jaccard_components(docs):
    """{doc_id: (n_shingles, component_id)} over all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


def line_dedup(docs, at_least=10, least_points=1):
    """{doc_id: (n_lines, n_dropped, kept text)}."""

    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    lines = {d: (t or "").split("\n") for d, t in docs.items()}
    found = Counter(k for own in lines.values() for k in {key(x) for x in own})
    out = {}
    for d, own in lines.items():
        kept = [x for x in own if len(key(x)) < least_points or found[key(x)] < at_least]
        out[d] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def repeats(docs, length=200):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of what is left)}."""
    data = {d: (t or "").encode() for d, t in docs.items()}
    count = Counter(x[i : i + length] for x in data.values() for i in range(len(x) - length + 1))
    out = {}
    for d, x in data.items():
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out[d] = (len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def nearest(vectors, k, every):
    import numpy as np

    ids = sorted(vectors)
    rows = []
    for q in [i for i in ids if i % every == 0]:
        scores = [(-float(np.dot(vectors[q], vectors[i])), i) for i in ids if i != q]
        rows += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return rows
