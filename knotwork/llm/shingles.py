"""Word shingles of whole texts as 64-bit hashes, computed on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The base of the words' polynomials and the multipliers of a shingle's words, all odd.
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text hashed at once.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` from 0 on, ``n`` or more; those of a block are kept."""
    if base in _POWERS and len(_POWERS[base]) >= n:
        return _POWERS[base]
    have = np.ones(max(n, BLOCK + (BLOCK >> 4)), np.uint64)
    have[1:] = np.uint64(base)
    have = np.cumprod(have, dtype=np.uint64)
    if len(have) <= BLOCK + (BLOCK >> 4):
        _POWERS[base] = have
    return have


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, the runs of bytes outside 9-13 and 32, and where it starts."""
    a = np.frombuffer(data, np.uint8)
    gap = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    start, end = edge[::2], edge[1::2]
    run = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(a))[: len(a)], out=run[1:])
    h = (run[end] - run[start]) * powers(INVERSE, len(a))[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40))), start


def _blocks(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts as bytes, ASCII letters lowered, in groups of about BLOCK bytes; longer ones in parts cut at a space."""
    of, group, size = [], [], 0
    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass").lower()
        while data:
            cut = len(data)
            if cut > BLOCK:
                at = [p for p in (data.find(c, BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                cut = min(at, default=cut)
            of.append(i)
            group.append(data[:cut])
            size += cut
            data = data[cut:]
            if size >= BLOCK:
                yield of, group
                of, group, size = [], [], 0
    if group:
        yield of, group


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted hashes; fewer words make one shingle, no word none."""
    words: list[list[np.ndarray]] = [[] for _ in texts]
    for of, group in _blocks(texts):
        h, start = word_hashes(b" ".join(group))
        ends = np.cumsum([len(g) + 1 for g in group])
        for i, w in zip(of, np.split(h, np.searchsorted(start, ends)[:-1])):
            words[i].append(w)
    out = []
    for parts in words:
        w = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n = min(k, len(w))
        if n == 0:
            out.append(w)
            continue
        s = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            s = mix(s * np.uint64(BASE) + w[j : len(w) - n + 1 + j])
        out.append(np.unique(s))
    return out


def signature(s: np.ndarray, clashes: frozenset[int] = frozenset()) -> int:
    """64 bits that equal sets share, as a signed number; of sets whose bits are among ``clashes`` others."""
    x = mix(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s) if len(s) else 0, len(s)], np.uint64)) * np.array([1, 3, 5], np.uint64)
    own = int(mix(x.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])
    return other_signature(s) if own in clashes else own


def other_signature(s: np.ndarray) -> int:
    """64 further bits, from other hashes of the shingles: sets that share both signatures are taken for equal."""
    return signature(mix(s ^ np.uint64(INVERSE)))
