"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
UPPER = {i: i + 32 for i in range(65, 91)}


def encode(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def substrings(docs, size=50):
    first = {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - size + 1):
            first.setdefault(tuple(split[d][i : i + size]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), SHA(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def pii(text):
    text = text or ""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    )
    spans = [(m.start(), o, m.end(), k) for o, (k, rx, ok) in enumerate(kinds) for m in re.finditer(rx, text) if ok(m[0])]
    return sorted(spans)


def pii_row(text):
    spans = pii(text)
    n = Counter(s[3] for s in spans)
    return n["email"], n["ip"], n["card"], n["phone"], SHA(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans))


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def decontaminate(docs, bench, n=13):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rx.findall((t or "").translate(UPPER))
    grams = {}
    for i, t in bench:
        w = words(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in grams:
                    hit.update(range(p, p + k))
                    items |= grams[g]
        out[d] = (len(w), len(hit), len(items), SHA(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(docs, k=4, percent=80):
    sets = {d: shingles(t, k) for d, t in docs}
    of, parent = {}, {d: d for d in sets}
    for d, s in sets.items():
        for g in s:
            of.setdefault(g, []).append(d)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shared = Counter()
    for ds in of.values():
        for i, x in enumerate(ds):
            for y in ds[i + 1 :]:
                shared[x, y] += 1
    for (x, y), n in shared.items():
        if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
