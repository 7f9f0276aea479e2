"""Brute-force versions of operators that SQL cannot express at size."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_windows(docs, window):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, kept_sha256)]; docs in order of doc_id."""
    seen, out = set(), []
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def removed_bytes(docs, length):
    """[(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]."""
    from collections import Counter
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(hashlib.blake2b(b[i:i + length], digest_size=12).digest() for _, b in data for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in data:
        gone = bytearray(len(b))
        upto = 0
        for i in range(len(b) - length + 1):
            if count[hashlib.blake2b(b[i:i + length], digest_size=12).digest()] > 1:
                for k in range(max(i, upto), i + length):
                    gone[k] = 1
                upto = i + length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def linked_shingles(docs, words=5, percent=85):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id)}."""
    sets = {}
    for doc_id, text in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    inverted = {}
    for d, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(d)
    from collections import Counter
    for d, s in sets.items():
        both = Counter(e for x in s for e in inverted[x] if e < d)
        for e, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}
