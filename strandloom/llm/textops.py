"""Vectorised tokenising and hashing over UTF-8 bytes, shared by the corpus operators.

All functions work on whole texts. A batch of texts is laid end to end with a separator
byte that never belongs to a word, so that one numpy pass serves many documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: positions in a word whose byte values are looked up; further ones are computed
_TABLED = 64
_POSITION = np.uint64(0x9E3779B97F4A7C15)
_RUN = np.uint64(0xD6E8FEB86659FD93)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

#: words are runs of anything but space and \t \n \v \f \r
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False

#: words are runs of digits, a-z and all non-ASCII bytes (apply after lower-casing)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = True
ALNUM[97:123] = True
ALNUM[128:] = True


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(byte: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A value for each byte at each place of a word."""
    key = (place.astype(np.uint64) << np.uint64(8)) | byte.astype(np.uint64)
    return splitmix(splitmix(key + np.uint64(seed * int(_RUN) % (1 << 64))) + _POSITION)


_TABLES: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    if seed not in _TABLES:
        at = np.arange(_TABLED << 8, dtype=np.int64)
        _TABLES[seed] = _byte_values(at & 255, at >> 8, seed)
    return _TABLES[seed]


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` values, by place of its first: runs of a power of two are put together from halves.

    Each step mixes, so that no two orders of the same few values cancel out."""
    out, done, size, power = None, 0, 1, values
    if len(values) < length:
        return np.zeros(0, np.uint64)
    while done < length:
        if length & size:
            n = len(power) - done
            out = power if out is None else splitmix(out[:n] * _RUN + power[done : done + n])
            done += size
        if done < length:
            power, size = splitmix(power[:-size] * _RUN + power[size:]), 2 * size
    return out[: len(values) - length + 1]


def word_spans(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of word bytes."""
    mask = np.zeros(len(raw) + 2, np.int8)
    mask[1:-1] = is_word[raw]
    edge = np.diff(mask)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64 bits of each word: the mixed sum of a pseudo-random value for every byte and its place.

    Sums are modulo 2**64 but not of powers of a base, whose differences cancel for words such as
    the Thue-Morse sequence and its complement. Seeds give independent values."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    step = np.zeros(len(raw), kind)
    step[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(raw), dtype=kind) - np.cumsum(step, dtype=kind)
    if lengths.max() > _TABLED:
        far = np.concatenate([np.arange(a + _TABLED, b) for a, b in zip(starts[lengths > _TABLED].tolist(), ends[lengths > _TABLED].tolist(), strict=True)])
        beyond = _byte_values(raw[far], place[far], seed)
    # bytes between words get a value too, which no difference of sums holds
    place = np.clip(place, 0, _TABLED - 1, out=place)
    place <<= 8
    place |= raw
    values = _table(seed)[place]
    if lengths.max() > _TABLED:
        values[far] = beyond
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return splitmix(sums[ends] - sums[starts] + lengths.astype(np.uint64))


def pieces(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if begin < len(texts):
        yield begin, len(texts)


def tokens(texts: list[bytes], is_word: np.ndarray, lower: bool, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of words of each text."""
    hashes, counts = [], []
    for a, b in pieces(texts):
        raw = np.frombuffer(b" ".join(texts[a:b]), np.uint8)
        if lower:
            raw = ASCII_LOWER[raw]
        starts, ends = word_spans(raw, is_word)
        lengths = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
        bounds = np.searchsorted(starts, np.cumsum(lengths))
        counts.append(np.diff(bounds, prepend=0))
        hashes.append(word_hashes(raw, starts, ends, seed))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null is the empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
