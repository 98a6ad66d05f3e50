"""Plain versions of the corpus operators for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash


def simhash(text: str | None) -> int:
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n: int, pairs) -> list[int]:
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        up[top(a)] = top(b)
    return [top(i) for i in range(n)]


def simhash_components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component_id) by comparing all fingerprints."""
    fps = np.array([simhash(t) for _, t in rows], np.uint64)
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2) + i + 1]
    root = roots(len(rows), near)
    low: dict[int, int] = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, f"{int(f):016x}", low.get(r)) for (d, _), f, r in zip(rows, fps, root, strict=True)]


def substring(rows: list[tuple], length: int = 35) -> list[tuple]:
    words = [[w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w] for _, t in rows]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))
    return len(a), len(b), len(c), hashlib.sha256(line.encode()).hexdigest()
