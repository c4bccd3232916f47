"""Words of texts as 64-bit hashes, in blocks of bytes with numpy."""

from __future__ import annotations

import numpy as np

BLOCK = 2 << 20
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the powers of an odd base and of its inverse.
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and all bytes of non-ASCII characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[k] * BASE**k for i <= k < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise hashes so that all bits depend on all."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def slice_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the slice stands."""
    inverse = powers(pow(BASE, -1, 1 << 64), len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts])


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words, in order: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII bytes."""
    out, at = [], 0
    data = LOWER[np.frombuffer(text, np.uint8)]
    is_word = WORD_BYTE[data]
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # cut between words; a word longer than the block stays whole
            gaps = np.flatnonzero(~is_word[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(~is_word[end:])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        part, inside = data[at:end], is_word[at:end]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out.append(slice_hashes(prefix_hashes(BYTE_VALUES[part]), starts, ends))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
