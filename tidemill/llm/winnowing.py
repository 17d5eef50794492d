"""Document fingerprints by winnowing.

Of each `window` consecutive hashes of k-grams of code points the smallest is kept, the rightmost on ties, with its
place. Two texts that share a passage of at least window + k - 1 code points share a kept hash. A text with fewer
k-grams than a window has its smallest one; a text shorter than k has the hash of the whole; an empty text none.
Texts of any length are read whole; a long one is worked through in segments, each window being in one of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._repeats import one_row_each
from tidemill.llm._state import prepare
from tidemill.llm._text import U, UNITS, Rolling, mix, ragged, sliding_last_min, tidy

K, WINDOW = 12, 16
#: Code points that are worked on at once.
LOAD = 1 << 19
#: Bytes of text that a range of ids has about, which one task streams; ranges at most, beyond which they grow.
RANGE, MOST_RANGES = 32 << 20, 50_000


def winnow(texts: list[str], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, place) of what is kept of each text, in order."""
    found = [(np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))]
    for first, end in _loads(texts):
        if end - first == 1 and len(texts[first]) > 2 * LOAD:
            row, h, place = _kept_of_long(texts[first], k, window)
        else:
            row, h, place = _kept(texts[first:end], k, window)
        found.append((row + first, h, place))
    row, h, place = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, h, place


def _kept_of_long(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    span = window + k - 1
    found = [_kept([text[a : a + LOAD + span - 1]], k, window)[1:] + (a,) for a in range(0, len(text) - span + 1, LOAD)]
    h, place = np.concatenate([x for x, _, _ in found]), np.concatenate([p + a for _, p, a in found])
    place, first = np.unique(place, return_index=True)
    return np.zeros(len(place), np.int64), h[first], place


def _kept(texts: list[str], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    roll = Rolling(mix(points + U(0x9E3779B97F4A7C15)), UNITS)
    text = np.repeat(np.arange(len(texts)), sizes)
    grams = roll.grams(k)
    low = sliding_last_min(grams, window)
    span = window + k - 1
    inside = text[: len(low)] == text[span - 1 : span - 1 + len(low)] if len(low) else np.zeros(0, bool)
    at = np.unique(low[inside])
    rows, hashes, places = [text[at]], [grams[at]], [at - begin[text[at]]]
    for i in np.flatnonzero((sizes > 0) & (sizes < span)).tolist():
        b, n = int(begin[i]), int(sizes[i])
        if n < k:
            place, h = 0, roll.ranges(np.array([b]), np.array([b + n]))[0]
        else:
            place = n - k - int(np.argmin(grams[b : b + n - k + 1][::-1]))
            h = grams[b + place]
        rows.append(np.array([i]))
        hashes.append(np.array([h], U))
        places.append(np.array([place]))
    row, h, place = np.concatenate(rows), np.concatenate(hashes), np.concatenate(places)
    by = np.lexsort((place, row))
    return row[by], h[by], place[by]


def likeness(a: tuple, b: tuple, pairs: list[tuple[int, int]]) -> np.ndarray:
    """For pairs (text of a, text of b): twice the shared distinct hashes by all distinct hashes; two empty ones are alike (1)."""

    def keys(kept, which):
        row, h = kept[0], kept[1]
        begin, end = np.searchsorted(row, which), np.searchsorted(row, which, "right")
        size = end - begin
        pair = np.repeat(np.arange(len(which)), size)
        tagged = mix(h[np.repeat(begin, size) + ragged(size)] ^ mix(pair.astype(U) + U(1)))
        tagged, first = np.unique(tagged, return_index=True)
        return tagged, pair[first]

    one, two = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    (x, px), (y, py) = keys(a, one), keys(b, two)
    n = len(pairs)
    shared = np.bincount(px[np.isin(x, y, assume_unique=True)], minlength=n)
    total = np.bincount(px, minlength=n) + np.bincount(py, minlength=n)
    return np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_chars, hashes (array<long>), places (array<int>, in code points).

    A null text counts as empty. Repeated rows and rows without an id get a row each, an empty table gives none; other
    columns are not read, whatever their names.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for first, end in _loads(texts):
                row, h, place = winnow(texts[first:end], k, window)
                cut = pa.array(np.searchsorted(row, np.arange(end - first + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, end - first),
                        pa.array([len(t) for t in texts[first:end]], pa.int64()),
                        pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))),
                        pa.ListArray.from_arrays(cut, pa.array(place.astype(np.int32))),
                    ],
                    ["_id", "n_chars", "hashes", "places"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(tidy(work), f"_id {kind}, n_chars long, hashes array<long>, places array<int>").withColumnRenamed("_id", id_col)


def _loads(texts: list[str]):
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > LOAD:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def digests(kept: tuple, n: int) -> list[str]:
    """A name of each text's fingerprint: the digest of its kept hashes and places."""
    row, h, place = kept
    cut = np.searchsorted(row, np.arange(n + 1)) * 16
    raw = np.stack([h, place.astype(U)], 1).astype("<u8").tobytes()
    return [hashlib.sha256(raw[cut[i] : cut[i + 1]]).hexdigest() for i in range(n)]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints beside those of an edited text and of the next document, by descending id (after the last: the first).

    The edited text is the text whose last floor(n/3) code points are replaced by the first as many (or all) of
    the next document. One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text counts as empty; of rows that repeat an id the smallest text stays; rows
    without an id are left out; a single document is its own next; no rows give no rows; other columns are not read,
    whatever their names.

    Ranges of ids, as many as the bytes of all texts need, begin at ids that exist, so each range's first document can also be sent, once, to the end of the
    range before it; every task then streams its documents with their successors.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = one_row_each(docs, id_col, text_col)
    bytes_ = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, bytes_ // RANGE, min(200, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cuts = ", ".join(repr(i / ranges) for i in range(1, ranges)) or "0.5"
    found = texts.select(F.expr(f"percentile_approx(_id, array({cuts}), {max(10_000, 20 * ranges)})").alias("p"), F.max("_id").alias("m")).first()
    heads = np.unique(np.array([*(found["p"] or []), *([] if found["m"] is None else [found["m"]])], np.int64))[::-1]  # descending

    def deal(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            part = len(heads) - np.searchsorted(heads[::-1], ids) - 1
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(ids), bool)), b.column(0), b.column(1)], names)
            head = np.flatnonzero(heads[part] == ids)
            if len(head):
                at = pa.array(head)
                yield pa.RecordBatch.from_arrays([pa.array((part[head] - 1) % len(heads)), pa.array(np.ones(len(head), bool)), b.column(0).take(at), b.column(1).take(at)], names)

    def work(batches):
        part, rows, size = None, [], 0

        def out(rows):
            """Results for all rows but the last, which only follows."""
            texts = [t for _, t in rows]
            edited = []
            for a, b in zip(texts[:-1], texts[1:], strict=True):
                m = len(a) // 3
                edited.append(a[: len(a) - m] + b[:m])
            n = len(edited)
            kept, of_edited = winnow(texts, k, window), winnow(edited, k, window)
            same = [(i, i) for i in range(n)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows[:-1]], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(digests(kept, n)),
                    pa.array(digests(of_edited, n)),
                    pa.array(likeness(kept, of_edited, same)),
                    pa.array(likeness(kept, kept, [(i, i + 1) for i in range(n)])),
                ],
                ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for b in batches:
            for p, i, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if p != part:
                    if len(rows) > 1:
                        yield out(rows)
                    part, rows, size = p, [], 0
                rows.append((i, t or ""))
                size += len(t or "")
                if size > LOAD and len(rows) > 1:
                    yield out(rows)
                    rows = rows[-1:]
                    size = len(rows[0][1])
        if len(rows) > 1:
            yield out(rows)

    names = ["_part", "_tail", "_id", "_text"]
    dealt = texts.mapInArrow(tidy(deal), "_part long, _tail boolean, _id long, _text string").repartition(ranges, "_part").sortWithinPartitions("_part", "_tail", F.desc("_id"))
    schema = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(tidy(work), schema).withColumnRenamed("_id", id_col)
