"""Substring dedup by bytes: longest previous factors, from previous and next smaller positions in suffix order.

Anchors (see _repeats) bring together the contexts that may share a window of `length` bytes. Over the contexts of
a shard, laid out by document and start, suffixes are sorted by their first `length` bytes (prefix doubling). The
longest previous factor of a position is the longer of the prefixes that it shares with the previous and with the next
smaller position in that order, as any earlier one lies beyond those. It is known up to `length` bytes; where it
reaches that, the string at the position also starts earlier, and later copies go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemill.llm._repeats import Plan, without_repeats
from tidemill.llm._text import ragged


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="quicksort")
    sorted_ = key[order]
    new = np.zeros(len(key), np.int64)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def prefix_levels(data: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The first eight bytes at each position as a number, and for growing widths up to `length` the rank of so many bytes (zero bytes after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    width = 1
    while width * 2 <= min(length, 8):
        width *= 2
    rank = _ranked(key >> np.uint64(64 - 8 * width) if width < 8 else key)
    levels = [(width, rank)]
    while width < length:
        step = min(width, length - width)
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        rank = _ranked(rank * (n + 1) + ahead)
        width += step
        levels.append((width, rank))
    return key, levels


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """For each position, the rank of the `length` bytes that follow it (zero bytes after the end)."""
    return prefix_levels(data, length)[1][-1][1]


def shared_prefix(key: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes agree from positions a and b on, up to the widest level: by ever narrower levels, then by single bytes."""
    n, most = len(key), levels[-1][0]
    out = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        x, y = a + out, b + out
        fits = (x < n) & (y < n) & (out + width <= most)
        out += width * (fits & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
    x, y = a + out, b + out
    differ = key[np.minimum(x, n - 1)] ^ key[np.minimum(y, n - 1)]
    same = sum((differ < np.uint64(1 << 8 * i)).astype(np.int64) for i in range(8))
    return np.minimum(out + np.where((x < n) & (y < n), same, 0), most)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, the place of the nearest smaller value before it, or -1."""
    found = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(found >= 0)
    while len(todo):
        todo = todo[values[found[todo]] > values[todo]]
        found[todo] = found[found[todo]]
        todo = todo[found[todo] >= 0]
    return found


def previous_factors(data: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
    """For each of the positions, the length (up to `length`) of the longest prefix that also starts at a smaller one of them."""
    key, levels = prefix_levels(data, length)
    rank = levels[-1][1][positions]
    order = np.lexsort((positions, rank))
    at = positions[order]
    before = smaller_before(at)
    after = len(at) - 1 - smaller_before(at[::-1])[::-1]
    found = np.zeros(len(at), np.int64)
    for near, there in ((before, before >= 0), (after, after < len(at))):
        i = np.flatnonzero(there)
        found[i] = np.maximum(found[i], shared_prefix(key, levels, at[i], at[near[i]]))
    out = np.zeros(len(at), np.int64)
    out[order] = found
    return out


class PreviousFactors:
    """The engine: see _repeats.Engine."""

    def __init__(self, length: int):
        self.length = length

    def __call__(self, contexts: list[bytes], n: np.ndarray) -> np.ndarray:
        size = n + self.length - 1
        positions = np.repeat(np.cumsum(size) - size, n) + ragged(n)
        return previous_factors(np.frombuffer(b"".join(contexts), np.uint8), positions, self.length) >= self.length


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100, k: int = 48) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, removed (list of [start, end) in bytes), kept (binary).

    Removed is each byte of the UTF-8 text covered by a string of `length` bytes that also starts earlier: in a
    document with a smaller id, or before in the same one. Strings are judged on the input and never cross
    documents. Null, empty and short texts lose nothing; of rows that repeat an id only the smallest text counts
    and gets a row; rows without an id are left out; other columns are not read, whatever their names. An empty table
    gives no rows. Texts of any length are read whole; long ones are searched in segments that overlap.
    """
    plan = Plan(words=False, length=length, k=k, compared=1, engine=PreviousFactors(length))
    return without_repeats(docs, id_col, text_col, plan, "suffix-dedup").withColumnRenamed("n_units", "n_bytes")
