"""Words of a whole Arrow column of texts at once, with numpy, and CRC-32 of runs of words from those of the words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are held as numpy arrays at a time; a longer word stays whole.
BLOCK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and all bytes of non-ASCII characters (of lower-cased text).
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True
#: All but the space and the control characters 9 to 13.
NO_SPACE = np.ones(256, bool)
NO_SPACE[32] = NO_SPACE[9:14] = False


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text starts, and the end); a null is an empty text."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_blocks(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the words, block by block in order; no word crosses the start of a text."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    at = 0
    while at < len(data):
        end = min(at + block, len(data))
        while end < len(data):  # cut where no word goes on
            breaks = np.flatnonzero(first[at + 1 : end + 1] | ~is_word[data[at:end]])
            if len(breaks):
                end = at + int(breaks[-1]) + 1
                break
            end = min(end + block, len(data))
        inside, cut = is_word[data[at:end]], first[at : end + 1]
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | cut[:-1])) + at
        ends = np.flatnonzero(inside & (~after | cut[1:])) + at + 1
        yield starts, ends
        at = end


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC of each byte, and for each k the four tables that put 2**k zero bytes behind a CRC."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    part = np.arange(1024, dtype=np.uint64)
    one = ((part & 255) << (8 * (part >> 8))).astype(np.uint32)  # a value with one byte set
    shifts = [(byte[one & 255] ^ (one >> 8)).astype(np.uint32)]
    for _ in range(31):
        shifts.append(shifted_by(shifts[-1], shifts[-1]))
    return byte, np.stack(shifts)


def shifted_by(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[crc & 255]
    for k in (1, 2, 3):
        out = out ^ table[256 * k + ((crc >> (8 * k)) & 255)]
    return out


BYTE_CRC, ZERO_BYTES = _tables()
#: The same for 0 to 63 zero bytes, one behind the other.
NEAR = np.zeros((64, 1024), np.uint32)
_part = np.arange(1024, dtype=np.uint64)
NEAR[0] = ((_part & 255) << (8 * (_part >> 8))).astype(np.uint32)
for _n in range(1, 64):
    NEAR[_n] = shifted_by(ZERO_BYTES[0], NEAR[_n - 1])
NEAR = NEAR.reshape(-1)
SPACE = np.uint32(zlib.crc32(b" "))


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word; data has the bytes as they count."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-left, -63, "left"))  # the words of 64 bytes and more come first
    for j in range(int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # words longer than j
        now = crc[long:n]
        crc[long:n] = BYTE_CRC[(now ^ data[at[long:n] + j]) & 255] ^ (now >> 8)
    crc = ~crc
    for k in range(long):
        crc[k] = zlib.crc32(data[at[k] : at[k] + left[k]].tobytes())
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


def behind(crc: np.ndarray, tail: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings joined, from theirs and the second's size."""
    near = np.minimum(sizes, 63).astype(np.int64) * 1024
    out = NEAR[near + (crc & 255)]
    for k in (1, 2, 3):
        out ^= NEAR[near + 256 * k + ((crc >> (8 * k)) & 255)]
    far = np.flatnonzero(sizes > 63)
    if len(far):
        rest = sizes[far] - 63
        for k in range(32):
            on = (rest >> k) & 1 == 1
            out[far[on]] = shifted_by(ZERO_BYTES[k], out[far[on]])
    return out ^ tail


def run_crcs(crc: np.ndarray, sizes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For n = 1 to longest the CRC-32 of the n words that end at word n - 1 and on, joined by one space."""
    runs = [crc]
    for _ in range(longest - 1):
        spaced = shifted_by(ZERO_BYTES[0], runs[-1][:-1]) ^ SPACE
        runs.append(behind(spaced, crc[len(runs) :], sizes[len(runs) :]))
    return runs
