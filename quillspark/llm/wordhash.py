"""64-bit hashes of the words of many texts at once, by prefix sums over their bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
SEED = np.random.Generator(np.random.PCG64(20240131))
BYTE = SEED.integers(1, 2**64, 256, dtype=U)
#: Odd multipliers and their inverses modulo 2**64.
BASE, WINDOW, WINDOW2 = (int(x) | 1 for x in SEED.integers(2**32, 2**63, 3, dtype=U))
#: Bytes of text that are hashed together; a longer text is hashed alone.
CHUNK = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 4_200_000 if n < 4_200_000 else n), base, dtype=U)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def spans(values: np.ndarray, base: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[first:last], for arrays of first and last."""
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[last] - total[first]) * powers(inverse(base), len(values) + 1)[first])


def chunks(texts: list[bytes]):
    """(first, last) of runs of texts of about CHUNK bytes."""
    start = 0
    while start < len(texts):
        end, n = start, 0
        while end < len(texts) and (n == 0 or n + len(texts[end]) < CHUNK):
            n += len(texts[end]) + 1
            end += 1
        yield start, end
        start = end


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words start (one more than texts)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1 if len(edge) else np.zeros(0, int)
    last = last[: len(first)]
    hashes = spans(BYTE[raw], BASE, first, last)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(first, ends)])
