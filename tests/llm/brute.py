"""Plain versions of the operators, for small tables."""

import hashlib
import re


def repeats(rows, least):
    """{index: (n_bytes, n_removed, n_spans, kept_sha256)} by the definition."""
    first = {}
    for doc, text in rows:
        t = (text or "").encode()
        for i in range(len(t) - least + 1):
            w = t[i : i + least]
            if w not in first or doc < first[w]:
                first[w] = doc
    out = []
    for doc, text in rows:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < doc:
                gone[i : i + least] = b"\x01" * least
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def components(nodes, links):
    """{node: smallest node reachable}"""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
