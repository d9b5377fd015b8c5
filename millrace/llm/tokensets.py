"""Trigram sets of many short texts as flat numpy arrays, and 64-bit sketches of them."""

from __future__ import annotations

import numpy as np



def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def trigram_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the distinct trigrams of each text, padded with one blank on either side, ascending.

    A trigram is three UTF-16 units packed into 48 bits, so equal tokens are equal trigrams. An empty text has none.
    """
    parts, offsets = [], [np.zeros(1, np.int64)]
    base = 0
    for at in range(0, len(texts), 65536):
        tokens, counts = _chunk(texts[at : at + 65536])
        parts.append(tokens)
        offsets.append(base + np.cumsum(counts))
        base += len(tokens)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(offsets)


def _chunk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    lens = np.fromiter((len(r) // 2 for r in raw), np.int64, len(raw))
    blank = b" \0"
    units = np.frombuffer(b"".join(blank + r + blank for r in raw) + blank * 2, "<u2").astype(np.uint64)
    if not lens.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    grams = units[:-2] << np.uint64(32) | units[1:-1] << np.uint64(16) | units[2:]
    starts = np.cumsum(lens + 2) - (lens + 2)
    row = np.repeat(np.arange(len(raw)), lens)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens) + starts[row]
    keys = np.sort(row.astype(np.uint64) << np.uint64(48) | grams[at])
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    return keys & np.uint64((1 << 48) - 1), np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(raw))


def rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def parity_sketch(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """64 parity bits a set. Two sets differ in at least as many elements as their sketches differ in bits."""
    out = np.zeros(n, np.uint64)
    np.bitwise_xor.at(out, row, np.uint64(1) << (hashes >> np.uint64(58)))
    return out


def seeded(hashes: np.ndarray, seed: int) -> np.ndarray:
    return mix(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
