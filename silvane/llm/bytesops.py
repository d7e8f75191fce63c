"""Vectorised byte kernels: Arrow text columns seen as flat numpy arrays, words, rolling hashes.

Nothing here knows Spark. A *flat* batch is ``(data, off)``: the UTF-8 bytes of all rows in one
uint8 array and the int64 row offsets into it (``len(off) == rows + 1``). Null texts are empty rows.

Two kinds of hash are kept apart. *Identities* tell words and word sequences apart: two independent
64-bit sums of random values, one for each byte at each place of the word, so that 128 bits decide
(``word_hashes``, ``shingle_hashes``). *Gram* hashes only choose places in a text (``grams``): equal
bytes have equal ones, and a collision costs time but never changes a result, because callers compare
128-bit digests of the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240917))
#: Places of a word with random values of their own; longer words use them again, times a random factor.
_PLACES = 64
#: Random values of each place and byte: two independent tables.
_PLACED = [_RNG.integers(0, 2**64, _PLACES * 256, dtype=U64) for _ in range(2)]
_ODD = U64(0x9E3779B97F4A7C15)

#: Byte -> the same byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int], negate: bool = False) -> np.ndarray:
    """Boolean table of the bytes in the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if negate else table


#: Bytes of words that white space (space, \t..\r) separates, and of words of letters and digits.
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), negate=True)
WORDLIKE = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), negate=True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary Arrow array; nulls become empty rows."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, most: int):
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    rows, first = len(off) - 1, 0
    while first < rows:
        last = int(np.searchsorted(off, off[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each position, by doubling: chooses places, identifies nothing."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    # Hashes of a power of two of bytes, then two that overlap cover any k.
    now, size = _PLACED[0][data], 1
    while 2 * size <= k:
        now = now[:-size] * _ODD + (now[size:] ^ (now[size:] >> U64(29)))
        size *= 2
    if size < k:
        now = now[:n] * _ODD + (now[k - size : k - size + n] ^ (now[k - size : k - size + n] >> U64(31)))
    return mix(now[:n])


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of member bytes within rows, and each row's first word.

    The third array has rows + 1 entries: row r holds the words first[r]..first[r + 1] - 1.
    """
    inside = member[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        before[cuts] = False
        after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word. Words don't overlap and are in order; none is empty."""
    size = end - start
    if not len(size):
        return np.zeros(0, U64), np.zeros(0, U64)
    first = np.concatenate([[0], np.cumsum(size[:-1])])
    place = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
    own = data[place + np.repeat(start, size)]
    at = (place % _PLACES) * 256 + own
    long = np.flatnonzero(place >= _PLACES) if int(size.max()) > _PLACES else None
    out = []
    for k, table in enumerate(_PLACED):
        value = table[at]
        if long is not None:
            value[long] *= mix((place[long] // _PLACES).astype(U64) * U64(2) + U64(k)) | U64(1)
        out.append(mix(np.add.reduceat(value, first) + size.astype(U64) * _ODD))
    return out[0], out[1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block prefix and suffix minima."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    top = np.iinfo(values.dtype).max
    blocks = np.concatenate([values, np.full(pad, top, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def shingle_hashes(word: tuple[np.ndarray, np.ndarray], first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each ``size`` consecutive words within rows, with each row's first shingle.

    A row with fewer words, but not none, has its whole sequence as one shingle.
    """
    n_words = np.diff(first)
    count = np.where(n_words == 0, 0, np.maximum(n_words - size + 1, 1))
    starts = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=starts[1:])
    at = np.repeat(first[:-1] - starts[:-1], count) + np.arange(starts[-1])
    whole = np.repeat(n_words >= size, count)
    base = at[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    both = []
    for k, hashes in enumerate(word):
        odd = mix(np.arange(1, size + 1, dtype=U64) + U64(k << 32)) | U64(1)
        out = np.zeros(starts[-1], U64)
        total = np.zeros(len(base), U64)
        for j in range(size):
            total += hashes[base + j] * odd[j]
        out[whole] = mix(total)
        for r in short:
            own = hashes[first[r] : first[r + 1]]
            out[starts[r]] = mix(np.array([(own * odd[: len(own)]).sum(dtype=U64) + U64(len(own))], U64))[0]
        both.append(out)
    return both[0], both[1], starts
