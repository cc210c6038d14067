"""Words and runs of words as 64-bit hashes, for whole chunks of text."""

from __future__ import annotations

import hashlib

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight
SHORT = 15  # bytes of a word that is mixed as it is, with its length


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word `[^\\x20\\x09-\\x0D]+` of the texts in order, and the number of words of each text.

    The bytes of words up to SHORT bytes and their number are mixed as two numbers, so that no two words of one length
    up to eight share a hash; longer ones have a cryptographic hash, so that no rule makes two long words that do.
    """
    data = np.frombuffer(b" ".join(texts) + b" " + bytes(16), np.uint8)
    solid = ~_BLANK[data[:-16]]
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.cumsum([0] + [len(x) + 1 for x in texts])
    counts = np.diff(np.searchsorted(starts, offsets))
    sizes = ends - starts
    at_each = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    low = at_each[starts] & _EIGHT[np.minimum(sizes, 8)]
    high = at_each[starts + np.minimum(sizes, 8)] & _EIGHT[np.clip(sizes - 8, 0, 7)] | (sizes.astype(np.uint64) << np.uint64(56))
    out = mix(mix(low + np.uint64(0x9E3779B97F4A7C15)) ^ (mix(high) * np.uint64(0xD6E8FEB86659FD93)))
    for i in np.flatnonzero(sizes > SHORT).tolist():
        word = data[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out, counts


def runs(words: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each run of n consecutive words (across text borders too): len(words) - n + 1 values."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    power, length, have = np.uint64(base), 1, words
    done, done_length = None, 0
    while True:
        if n & length:
            if done is None:
                done, done_length = have, length
            else:  # the longer part comes first
                m = len(words) - (done_length + length) + 1
                done = have[:m] * np.uint64(pow(base, done_length, 1 << 64)) + done[length : length + m]
                done_length += length
        if length * 2 > n:
            return mix(done)
        have = have[:-length] * power + have[length:]
        power, length = np.uint64(pow(base, length * 2, 1 << 64)), length * 2


def inside(counts: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words lie within one text."""
    total = int(counts.sum())
    if total < n:
        return np.empty(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner[: total - n + 1] == owner[n - 1 :]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    length = 1
    while length * 2 <= n:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return np.minimum(x[: len(x) - (n - length)], x[n - length :]) if n > length else x
