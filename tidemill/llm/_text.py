"""Vectorised work on the bytes of an Arrow batch of texts: words, rolling hashes, sliding minima."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is one piece, which operators work through in segments.
PIECE = 1 << 20
#: Bytes of a word that its number holds as they are; longer words go by a digest.
SHORT_WORD = 16
KEYS = tuple(U(x) for x in (0x8E9D5AAB3C1F7E21, 0x3F84D5B5B5470917, 0xC0AC29B7C97C50DD, 0x9216D5D98979FB1B, 0xD1310BA698DFB5AC))


def tidy(work):
    """The same function of batches, after which a worker gives freed memory back; workers outlive tasks."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """A function of its own, so that what tidy() makes doesn't take the tables of powers along to the workers."""
    for powers in (BYTES, UNITS):
        powers.shrink()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + PIECE // 8)
            up, down = np.full(size, U(self.base)), np.full(size, U(_inverse(self.base)))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        return self.up[:n], self.down[:n]

    def shrink(self) -> None:
        """Forget powers that only a very long text needed."""
        if len(self.up) > 2 * PIECE:
            self.up, self.down = np.ones(1, U), np.ones(1, U)


BYTES, UNITS = Powers(0x9E6C63D0876A9A47), Powers(0xD1342543DE82EF95)


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values; equal ranges have equal hashes wherever they are."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    if len(v) < width:
        return v[:0]
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    rest = width - have
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def sliding_last_min(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each `width` consecutive values, the rightmost on ties."""
    at = np.arange(len(v))
    if len(v) < width:
        return at[:0]

    def with_next(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = v[shift:] <= v[:-shift]
        return np.where(right, v[shift:], v[:-shift]), np.where(right, at[shift:], at[:-shift])

    have = 1
    while 2 * have <= width:
        v, at = with_next(have)
        have *= 2
    return with_next(width - have)[1] if width > have else at


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together and where each begins and the last ends; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(array: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `size` bytes."""
    data, offsets = column(array)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words `[^\\x20\\x09-\\x0D]+` begin and end, and the number of the first word of each text (and the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    starts, ends = [], []
    for a in range(0, n, 4 * PIECE):  # in stretches, as a long text would take several times its size in temporaries
        z = min(n, a + 4 * PIECE)
        space = SPACE[data[max(0, a - 1) : min(n, z + 1)]]
        own = space[min(a, 1) : min(a, 1) + z - a]
        inside = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z, "right")]
        before, after = np.ones(z - a, bool), np.ones(z - a, bool)
        before[0 if a else 1 :] = space[: z - a - (0 if a else 1)]
        after[: len(space) - min(a, 1) - 1] = space[min(a, 1) + 1 : min(a, 1) + 1 + z - a]
        before[inside[inside < z] - a] = True
        after[inside[inside > a] - a - 1] = True
        starts.append(np.flatnonzero(~own & before) + a)
        ends.append(np.flatnonzero(~own & after) + a + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def word_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each word, the same for the same bytes.

    A word of up to SHORT_WORD bytes is taken as it is and scrambled by a bijection of 128 bits (for its length), so
    different words have different numbers; a longer one goes by a BLAKE2b digest of 128 bits.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(SHORT_WORD, np.uint8)])
    eight = np.ndarray((len(data) + SHORT_WORD - 7,), "<u8", padded, 0, (1,))
    mask = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
    a, b = eight[starts] & mask[np.clip(size, 0, 8)], eight[starts + 8] & mask[np.clip(size - 8, 0, 8)]
    n = size.astype(U)
    a = a ^ mix(b + KEYS[0] + n * KEYS[4])
    b = b ^ mix(a + KEYS[1])
    a ^= mix(b + KEYS[2])
    b ^= mix(a + KEYS[3])
    long = np.flatnonzero(size > SHORT_WORD)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        raw = b"".join(blake2b(view[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        a[long], b[long] = np.frombuffer(raw, "<u8").reshape(-1, 2).T
    return a, b


def segments(data: np.ndarray, overlap: int, size: int = 4 * PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(number of its first word, bytes) of stretches of one text: each overlap + 1 consecutive words are in just one of them.

    A text of up to `size` bytes is one stretch; a longer one is cut at white space, after at most as many bytes unless words are longer.
    """
    at = word = 0
    want = size
    while True:
        stop = min(len(data), at + want)
        while stop < len(data) and not SPACE[data[stop - 1]]:
            space = np.flatnonzero(SPACE[data[stop : stop + PIECE]])
            stop = stop + int(space[0]) + 1 if len(space) else min(len(data), stop + PIECE)
        if stop == len(data):
            yield word, data[at:]
            return
        starts = word_spans(data[at:stop], np.array([0, stop - at]))[0]
        if len(starts) <= overlap:
            want *= 2
            continue
        yield word, data[at:stop]
        fresh = len(starts) - overlap
        at, word, want = (at + int(starts[fresh]) if overlap else stop), word + fresh, size


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_lanes(data, starts, ends)[0]


def word_counts(array: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    out = [np.zeros(0, np.int64)]
    for first, end, data, offsets in pieces(array):
        if end - first == 1:
            out.append(np.array([sum(len(word_spans(part, np.array([0, len(part)]))[0]) for _, part in segments(data, 0))], np.int64))
        else:
            out.append(np.diff(word_spans(data, offsets)[2]))
    return np.concatenate(out)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)
