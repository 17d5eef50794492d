"""Numbers that classifiers read off texts: hashed byte trigrams, shapes, and hashes of the words that occur.

Texts of any length are read whole, long ones in segments.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._text import LOWER, PIECE, U, mix, pieces, segments, tidy, word_hashes, word_spans

#: Buckets of hashed trigrams.
BUCKETS = 4096
#: Bits of a word's hash by which classifiers know it; so what a text gives them is bounded, however long it is.
WORD_BITS = 22
#: Combinations of label values at most.
COMBINATIONS = 64
SHAPES = ("chars", "upper", "marks", "digits", "wide", "spaces", "again", "distinct", "long", "bias")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WIDE = np.arange(256) >= 128
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = ~(_LETTER | _DIGIT | _WIDE | _SPACE)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Letters and digits lower-cased, all else but bytes over 127 a space: words without punctuation.
_PLAIN = np.where(_LETTER | _DIGIT | _WIDE, LOWER, 0x20).astype(np.uint8)


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of SHAPES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = (_UPPER, _MARK, _DIGIT, _WIDE, _SPACE)
    if n == 1 and len(data) > 4 * PIECE:
        sums = [np.array([sum(int(t[data[a : a + PIECE]].sum()) for a in range(0, len(data), PIECE))]) for t in kinds]
        words, again, seen = 0, 0, np.zeros(0, U)
        for first, part in segments(data, 1):
            starts, ends, _ = word_spans(part, np.array([0, len(part)]))
            h = word_hashes(part, starts, ends)
            words, again, seen = first + len(h), again + int((h[1:] == h[:-1]).sum()), np.unique(np.concatenate([seen, h]))
        words, again, distinct = np.array([words]), np.array([again]), np.array([len(seen)])
    else:
        sums = [np.diff(np.concatenate([[0], np.cumsum(t[data])])[offsets]) for t in kinds]
        starts, ends, where = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        words = np.diff(where)
        row = np.repeat(np.arange(n), words)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        _, first = np.unique(mix(h ^ mix(row.astype(U) + U(1))), return_index=True)
        again, distinct = np.bincount(row, same, minlength=n), np.bincount(row[first], minlength=n)
    upper, marks, digits, wide, spaces = (x / np.maximum(size, 1) for x in sums)
    some = np.maximum(words, 1)
    columns = [np.log1p(size) / 10, upper * 4, marks * 4, digits * 4, wide, spaces * 4, again / some * 4, np.minimum(distinct / some * np.sqrt(some) / 10, 3), size / some / 20, np.ones(n)]
    return np.stack(columns, 1)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed trigrams of bytes, one row for each text."""
    n = len(offsets) - 1
    counts = np.zeros((n, BUCKETS))
    if n == 1:
        for a in range(0, max(0, len(data) - 2), 4 * PIECE):
            counts[0] += np.bincount(_grams(data[a : a + 4 * PIECE + 2]), minlength=BUCKETS)
    elif len(data) > 2:
        row = np.repeat(np.arange(n), np.diff(offsets))
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * BUCKETS + _grams(data)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _grams(data: np.ndarray) -> np.ndarray:
    """The bucket of each trigram."""
    wide = data.astype(np.uint32)
    return ((wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16) * np.uint32(2654435761)) >> np.uint32(32 - 12)


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word that occurs in a text, without punctuation and case, once for each text."""

    def hashes(data, offsets):
        data = _PLAIN[data]
        starts, ends, where = word_spans(data, offsets)
        return word_hashes(data, starts, ends) >> U(64 - WORD_BITS), where

    if len(offsets) == 2:
        seen = np.zeros(0, U)
        for _, part in segments(data, 0):
            # a cut is at white space, so plain words are whole
            seen = np.unique(np.concatenate([seen, hashes(part, np.array([0, len(part)]))[0]]))
        return np.zeros(len(seen), np.int64), seen
    h, where = hashes(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(where))
    both = np.unique(h | (row.astype(U) << U(WORD_BITS)))
    return (both >> U(WORD_BITS)).astype(np.int64), both & U((1 << WORD_BITS) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: list[str], most: int, read: Callable[[pa.Array], list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(what `read` makes of each text, their labels, weights) of at most `most` labelled rows for each combination of labels.

    Which rows: those whose ids have the smallest hashes, so reruns agree. weights make up for combinations that
    are sampled less. Rows without a label or id, or with a label that isn't a number, don't count, and equal texts
    with equal labels count once. Texts are read by the executors; only what `read` makes of them, whose size is bounded by
    the hashes that there are, comes to the driver.
    """
    rows = labels.select(F.col(id_col).alias("_id"), *[F.col(c).cast("int").alias(f"_l{i}") for i, c in enumerate(label_cols)]).dropna()
    names = [f"_l{i}" for i in range(len(label_cols))]
    found = rows.groupBy(*names).count().limit(COMBINATIONS + 1).collect()
    if len(found) > COMBINATIONS:
        raise ValueError(f"the labels {label_cols} have more than {COMBINATIONS} combinations of values")
    sizes = {tuple(r[:-1]): r[-1] for r in found}
    picked = None
    for combination in sorted(sizes):
        part = rows
        for c, v in zip(names, combination, strict=True):
            part = part.filter(F.col(c) == v)
        part = part.orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return [], np.zeros((0, len(label_cols)), int), np.zeros(0)

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(read(b.column(0)), pa.binary())], [*names, "_digest", "_read"])

    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # at most `most` rows for each combination: bounded, so sent to where the texts are
    texts = texts.join(F.broadcast(picked), "_id").select("_text", *names).distinct().withColumn("_digest", F.sha2(F.col("_text").cast("binary"), 256))
    found = texts.mapInArrow(tidy(work), ", ".join(f"{c} int" for c in names) + ", _digest string, _read binary").toArrow().sort_by([("_digest", "ascending"), *[(c, "ascending") for c in names]])
    y = np.array([found.column(c).to_numpy() for c in names], int).T.reshape(found.num_rows, len(names))
    have: dict[tuple, int] = {}
    for r in y.tolist():
        have[tuple(r)] = have.get(tuple(r), 0) + 1
    weight = np.array([sizes[tuple(r)] / have[tuple(r)] for r in y.tolist()])
    return found.column("_read").to_pylist(), y, weight / weight.mean() if len(weight) else weight


def adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimises by Adam; gradient(x) is the gradient at x."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def matrices(array: pa.Array):
    """(first row, end row, trigrams and shapes) of runs of texts."""
    for first, end, data, offsets in pieces(array, 1 << 20):
        for a in range(0, end - first, 512):
            b = min(a + 512, end - first)
            d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield first + a, first + b, np.hstack([trigrams(d, o), shapes(d, o).astype(np.float32)])


def packed_matrices(array: pa.Array) -> list[bytes]:
    """Trigrams and shapes of each text, without zeros; see unpacked()."""
    out = []
    for _, _, x in matrices(array):
        for row in x:
            at = np.flatnonzero(row)
            out.append(at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes())
    return out


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The matrix of rows from packed_matrices()."""
    x = np.zeros((len(rows), BUCKETS + len(SHAPES)), np.float32)
    for i, raw in enumerate(rows):
        n = len(raw) // 6
        x[i, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return x
