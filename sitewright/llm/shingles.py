"""Word-shingle sets of whole texts as 64-bit hashes, vectorised over batches of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_IS_WS = np.zeros(256, bool)
_IS_WS[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:  # longer ones are made anew each time, so that one very long text holds no memory
            _powers[base] = have
    return have[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and the index of each word's text. Words of up to 16 bytes
    are mixed from all their bytes at once, longer ones are named by a cryptographic digest."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = (b"\n".join(texts) + b"\n" * 17).translate(_LOWER)
    buf = np.frombuffer(raw, np.uint8, len(raw) - 16)
    ws = _IS_WS[buf]
    inside = np.concatenate(([False], ~ws, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    n = ends - starts
    at_byte = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    head = at_byte[starts] & _MASKS[np.minimum(n, 8)]
    tail = at_byte[np.minimum(starts + 8, len(raw) - 8)] & _MASKS[np.clip(n - 8, 0, 8)]
    hashes = mix(head + mix(tail + n.astype(np.uint64) * np.uint64(_R)))
    for i in np.flatnonzero(n > 16).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return hashes, owner


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; of fewer words, the whole sequence is
    the one shingle; of no words, there is none."""
    hashes, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))
    n = max(0, len(hashes) - width + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(width):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    runs = mix(runs)
    for i, c in enumerate(counts):
        if c >= width:
            got = np.sort(runs[first[i] : first[i] + c - width + 1])
            yield got if len(got) < 2 else got[np.concatenate(([True], got[1:] != got[:-1]))]
        elif c:
            short = np.uint64(c)
            with np.errstate(over="ignore"):
                for h in hashes[first[i] : first[i] + c]:
                    short = short * np.uint64(0xA0761D6478BD642F) + h
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
