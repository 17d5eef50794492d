"""Every passage of L units (words or bytes) that also starts earlier in the corpus, without comparing all with all.

Each window of L units owns the anchor with the smallest hash among its k-grams (leftmost on ties), so equal
windows own equal anchors at equal offsets. The windows that one anchor occurrence owns are consecutive; with the
text they cover they are a *context*. Only contexts that share an anchor can share a window:

1. Each context becomes a slim row (anchor hash, BLAKE2b digest of its text, document, start, windows). Contexts equal
   to earlier ones that the same task has seen leave at once as removed; the others are dealt and sorted by anchor.
   Rows of anchors that come often in a task are dealt by anchor and context, so a hot anchor is split.
2. A pass over the sorted rows drops anchors that don't recur, marks contexts that equal earlier ones, and names
   the contexts that must be compared. One row at most is held back, however large an anchor's group is.
3. The text of contexts to compare is cut out and dealt by anchor (windows of very frequent anchors one by one, by
   their own hash), and a local engine finds which windows occur earlier.
4. Removed stretches go back to their documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._state import Steps, prepare
from tidemill.llm._text import BYTE, PIECE, U, UNITS, Rolling, mix, pieces, ragged, segments, sliding_min, tidy, word_hashes, word_spans

#: Low bits of a k-gram's order value that hold its place in the piece of text at hand.
PLACE = 30
#: Contexts of one anchor beyond which its windows are dealt one by one.
HOT = 4096
#: Frequent anchors up to this many are broadcast.
BROADCAST_ANCHORS = 500_000
#: Bytes of contexts that an engine works on at once.
LOAD = 1 << 19
#: Contexts that came often which a task remembers.
KNOWN = 1 << 18
#: Rows of one anchor (by the low bits of its hash) after which a task deals further ones by their context, too.
OFTEN, CELLS = 256, 1 << 20
#: White space of any kind becomes a space.
BLANK = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b for b in range(256))

#: (bytes of each context, their numbers of windows) -> for each window in turn whether it occurs earlier
Engine = Callable[[list[bytes], np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Plan:
    """What repeats: windows of `length` units, found by anchors of `k`; up to `compared` equal contexts go to the engine."""

    words: bool
    length: int
    k: int
    compared: int
    engine: Engine

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """Number of the first unit of each text (and the end), and for words where they begin and end."""
        if not self.words:
            return offsets, None
        starts, ends, where = word_spans(data, offsets)
        return where, (starts, ends)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of its first unit, bytes, offsets) of a piece, or of segments of one long text; each window is in one of them."""
        if len(offsets) > 2 or len(data) <= 4 * PIECE:
            yield 0, data, offsets
        elif self.words:
            yield from ((first, part, np.array([0, len(part)])) for first, part in segments(data, self.length - 1))
        else:
            for a in range(0, len(data) - self.length + 1, 4 * PIECE):
                part = data[a : a + 4 * PIECE + self.length - 1]
                yield a, part, np.array([0, len(part)])

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """Hash of each unit, number of the first unit of each text, the text in a plain form, and where units begin and end in it."""
        if not self.words:
            at = np.arange(len(data) + 1)
            return BYTE[data], offsets, data.tobytes(), at[:-1], at[1:]
        starts, ends, where = word_spans(data, offsets)
        raw = data.tobytes()
        plain = b" ".join([w for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for w in raw[a:e].split()])
        stop = np.cumsum(ends - starts + 1) - 1
        return word_hashes(data, starts, ends), where, plain, stop - (ends - starts), stop


def digests(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each stretch of bytes."""
    return np.frombuffer(b"".join([blake2b(raw[a:e], digest_size=8).digest() for a, e in zip(start.tolist(), stop.tolist(), strict=True)]), "<u8").astype(U)


def one_space(words: bytes) -> bytes:
    """Words with one space between them, whatever white space was there."""
    words = words.translate(BLANK).strip(b" ")
    while b"  " in words:
        words = words.replace(b"  ", b" ")
    return words


def contexts(values: np.ndarray, where: np.ndarray, k: int, length: int):
    """(text, start, windows, anchor hash, place of the first unit) of each context of the texts that begin at `where`."""
    none = np.zeros(0, np.int64)
    if len(values) < length:
        return none, none, none, none.view(U), none
    roll = Rolling(values, UNITS)
    grams = roll.grams(k)
    order = (grams >> U(PLACE)) << U(PLACE) | np.arange(len(grams), dtype=U)
    owner = (sliding_min(order, length - k + 1) & U((1 << PLACE) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(where) - 1), np.diff(where))
    n = len(owner)
    valid = text[:n] == text[length - 1 : length - 1 + n]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    # a context ends where the next begins or where windows would leave the text
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    return text[at], at - where[text[at]], stop - at, grams[owner[at]], at


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the first of each run of touching stretches (sorted by row and start, equal lengths of run)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    return np.flatnonzero(new)


MARK = "_id long, _start long, _n long, _anchor long, _kind int"
REMOVE, COMPARE = 0, 1
#: Kinds of slim rows: an ordinary one, one that earlier ones equal, one whose anchor is known to recur, a note of that.
PLAIN, DUPLICATE, SURE, NOTE = 0, 1, 2, 3


class _Known:
    """Contexts that a task has handed on as often as they may be compared, and the first place of each among those."""

    def __init__(self):
        self.ctx = self.anchor = np.zeros(0, U)
        self.id = self.start = np.zeros(0, np.int64)

    def later(self, anchor, ctx, ids, start) -> np.ndarray:
        """Which contexts equal a known one that is before them."""
        if not len(self.ctx):
            return np.zeros(len(ctx), bool)
        at = np.minimum(np.searchsorted(self.ctx, ctx), len(self.ctx) - 1)
        same = (self.ctx[at] == ctx) & (self.anchor[at] == anchor)
        return same & ((self.id[at] < ids) | ((self.id[at] == ids) & (self.start[at] < start)))

    def add(self, anchor, ctx, ids, start) -> None:
        c, a, i, s = (np.concatenate(x) for x in ((self.ctx, ctx), (self.anchor, anchor), (self.id, ids), (self.start, start)))
        order = np.lexsort((s, i, c))
        first = np.ones(len(order), bool)
        first[1:] = c[order][1:] != c[order][:-1]
        order = order[first]
        if len(order) > KNOWN:  # begin anew with those that came now
            self.__init__()
            return
        self.ctx, self.anchor, self.id, self.start = c[order], a[order], i[order], s[order]


def _slim(texts: DataFrame, plan: Plan) -> DataFrame:
    """(_anchor, _ctx, _id, _start, _n, _kind) of all contexts.

    DUPLICATE: enough earlier ones equal it (then _anchor is any). SURE: its anchor came often in this task, so it
    recurs for sure, and only contexts that equal this one need to meet it; those that came before, and other tasks'
    rows, may still be dealt by the anchor alone, so a NOTE tells them that the anchor recurs.
    """

    def work(batches):
        known, cells, noted = _Known(), np.zeros(CELLS, np.int64), set()
        for b in batches:
            ids_all = b.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in pieces(b.column(1), 8 * PIECE):
                for base, part, cut in plan.parts(data, offsets):
                    values, where, plain, begin, stop = plan.read(part, cut)
                    text, start, n, anchor, at = contexts(values, where, plan.k, plan.length)
                    if not len(text):
                        continue
                    ctx = digests(plain, begin[at], stop[at + n - 2 + plan.length])
                    del values, plain, begin, stop
                    yield from told(known, cells, noted, ids_all[first:end][text], start + base, n, anchor, ctx)

    def told(known, cells, noted, ids, start, n, anchor, ctx):
        late = known.later(anchor, ctx, ids, start)
        order = np.flatnonzero(~late)
        order = order[np.lexsort((start[order], ids[order], ctx[order], anchor[order]))]
        if len(order):
            new = np.ones(len(order), bool)
            new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(order)))
            late[order[ragged(size) >= plan.compared]] = True
            often = order[at[size >= max(plan.compared, 2)]]
            if len(often):
                known.add(anchor[often], ctx[often], ids[often], start[often])
        rows = [x[~late] for x in (anchor, ctx, ids, start, n)]
        cell = (rows[0] & U(CELLS - 1)).astype(np.int64)
        sure = cells[cell] >= OFTEN
        cells += np.bincount(cell, minlength=CELLS)
        yield batch(*rows, np.where(sure, SURE, PLAIN))
        fresh = [x for x in np.unique(rows[0][sure]).tolist() if x not in noted]
        if fresh:
            if len(noted) > KNOWN:
                noted.clear()
            noted.update(fresh)
            at, none = np.array(fresh, U), np.zeros(len(fresh), np.int64)
            yield batch(at, mix(at + U(1)), none, none, none, np.full(len(fresh), NOTE))
        if late.any():
            order = np.flatnonzero(late)
            order = order[np.lexsort((start[order], ids[order]))]
            i, s, e = ids[order], start[order], start[order] + n[order]
            at = _merged(i, s, e)
            e = np.maximum.reduceat(e, at)
            i, s = i[at], s[at]
            spread = mix(i.astype(np.int64).view(U) ^ (s.astype(np.int64).view(U) << U(32)))
            yield batch(spread, spread, i, s, e - s, np.full(len(i), DUPLICATE))

    def batch(anchor, ctx, *others):
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), *[pa.array(x) for x in others[:3]], pa.array(others[3], pa.int32())], names)

    names = ["_anchor", "_ctx", "_id", "_start", "_n", "_kind"]
    return texts.mapInArrow(tidy(work), "_anchor long, _ctx long, _id long, _start long, _n long, _kind int")


def _marks(slim: DataFrame, plan: Plan) -> DataFrame:
    """Stretches of windows to remove, and contexts to compare, from rows sorted by anchor and context."""

    def work(batches):
        last_anchor = last_ctx = held = None
        run = 0
        for b in batches:
            dup = b.column(5).to_numpy(zero_copy_only=False) == DUPLICATE
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            direct = [x[dup] for x in cols[2:5]]
            anchor, ctx, ids, start, n, kind_ = (x[~dup] for x in cols)
            real = kind_ != NOTE
            m = len(anchor)
            kinds = [np.zeros(len(direct[0]), np.int32)]
            out = [[*direct, np.zeros(len(direct[0]), np.int64)]]
            if m:
                new_a = np.ones(m, bool)
                new_a[1:] = anchor[1:] != anchor[:-1]
                new_a[0] = last_anchor is None or anchor[0] != last_anchor
                new_c = new_a.copy()
                new_c[1:] |= ctx[1:] != ctx[:-1]
                new_c[0] |= last_ctx is None or ctx[0] != last_ctx
                begin = np.flatnonzero(new_c)
                if not len(begin) or begin[0]:
                    begin = np.append(0, begin)
                pos = ragged(np.diff(np.append(begin, m)))
                if not new_c[0]:
                    pos[: begin[1] if len(begin) > 1 else m] += run
                # with one compared per context, what makes an anchor recur is another context; else any other row
                second = (new_c if plan.compared == 1 else np.ones(m, bool)) & ~new_a | (kind_ == SURE)
                seg = np.flatnonzero(new_a)
                if not len(seg) or seg[0]:
                    seg = np.append(0, seg)
                has = np.add.reduceat(second.astype(np.int64), seg) > 0
                lead = np.zeros(m, bool)
                lead[seg[has]] = True
                compare = (pos < plan.compared) & (second | (new_a & lead)) & real
                remove = (pos >= plan.compared) & real
                if held is not None and (new_a[0] or has[0]):
                    if has[0] and not new_a[0] and held[-1]:
                        out.append([np.array([x]) for x in held[:-1]])
                        kinds.append(np.full(1, COMPARE, np.int32))
                    held = None
                if not has[-1] and new_a[seg[-1]]:
                    i = seg[-1]
                    held = (ids[i], start[i], n[i], anchor[i], real[i])
                for mask, kind in ((compare, COMPARE), (remove, REMOVE)):
                    out.append([ids[mask], start[mask], n[mask], anchor[mask]])
                    kinds.append(np.full(int(mask.sum()), kind, np.int32))
                last_anchor, last_ctx, run = anchor[-1], ctx[-1], pos[-1] + 1
            both = [np.concatenate(x) for x in zip(*out, strict=True)]
            if len(both[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in both] + [pa.array(np.concatenate(kinds), pa.int32())], ["_id", "_start", "_n", "_anchor", "_kind"])

    together = F.when(F.col("_kind") == SURE, F.xxhash64("_anchor", "_ctx")).otherwise(F.col("_anchor"))
    dealt = slim.repartition(together).sortWithinPartitions("_anchor", "_ctx", "_id", "_start")
    return dealt.mapInArrow(tidy(work), MARK)


def _cut(texts: DataFrame, compare: DataFrame, plan: Plan) -> DataFrame:
    """(_key, _id, _start, _n, _bytes) of contexts to compare; of frequent anchors, of each window.

    Windows that equal an earlier one which the same task handed on have no bytes: there is nothing left to find out.
    """
    hot = compare.groupBy("_anchor").agg(F.count("*").alias("_c")).filter(F.col("_c") > HOT).select("_anchor", F.lit(True).alias("_hot"))
    few = hot.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS
    listed = compare.join(F.broadcast(hot) if few else hot, "_anchor", "left").groupBy("_id").agg(F.collect_list(F.struct("_start", "_n", "_anchor", F.coalesce("_hot", F.lit(False)).alias("_hot"))).alias("_list"))

    def work(batches):
        seen: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            lists = b.column(2)
            for first, end, data, offsets in pieces(b.column(1)):
                where, spans = plan.spans(data, offsets)
                sizes = np.array([len(lists[i]) for i in range(first, end)], np.int64)
                flat = lists.slice(first, end - first).flatten()
                start, n, anchor, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                row = np.repeat(np.arange(end - first), sizes)
                hot = hot.astype(bool)
                if hot.any():  # each window by itself
                    times = np.where(hot, n, 1)
                    start = np.repeat(start, times) + ragged(times)
                    row, anchor, n, hot = (np.repeat(x, times) for x in (row, anchor, np.where(hot, 1, n), hot))
                at = where[row] + start
                stop = at + n - 1 + plan.length
                if spans is not None:
                    at, stop = spans[0][at], spans[1][stop - 1]
                raw = data.tobytes()
                texts_ = [raw[a:e] for a, e in zip(at.tolist(), stop.tolist(), strict=True)]
                key, ids = anchor.copy(), b.column(0).slice(first, end - first).take(pa.array(row))
                for i, doc in zip(np.flatnonzero(hot).tolist(), ids.filter(pa.array(hot)).to_pylist(), strict=True):
                    whole, place = one_space(texts_[i]) if plan.words else texts_[i], (doc, int(start[i]))
                    name = blake2b(whole, digest_size=8).digest()
                    key[i] = int.from_bytes(name, "little", signed=True) ^ int(anchor[i])
                    before = seen.get(whole)
                    if before is not None and before < place:  # this task has handed on an earlier one
                        texts_[i], key[i] = None, int.from_bytes(name, "little", signed=True) ^ hash(place)
                    else:
                        if len(seen) >= KNOWN:
                            seen.clear()
                        seen[whole] = place
                yield pa.RecordBatch.from_arrays([pa.array(key), ids, pa.array(start), pa.array(n), pa.array(texts_, pa.binary())], ["_key", "_id", "_start", "_n", "_bytes"])

    joined = texts.join(listed, "_id").select("_id", "_text", "_list")
    return joined.mapInArrow(tidy(work), "_key long, _id long, _start long, _n long, _bytes binary")


def _compared(cut: DataFrame, plan: Plan) -> DataFrame:
    """Stretches of windows (_id, _start, _n) that occur earlier, from contexts sorted by key, document and start."""

    def judge(rows, fresh_from):
        """Stretches to remove of rows[fresh_from:], and which rows hold a window that isn't removed."""
        n = np.array([r[3] for r in rows], np.int64)
        gone = plan.engine([r[4] for r in rows], n).astype(np.int8)
        row = np.repeat(np.arange(len(rows)), n)
        kept = np.bincount(row, 1 - gone, minlength=len(rows)) > 0
        edge = np.ones(len(row), bool)
        edge[1:] = (gone[1:] != gone[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(edge)
        size = np.diff(np.append(at, len(row)))
        use = (gone[at] > 0) & (row[at] >= fresh_from)
        at, size = at[use], size[use]
        ids, start = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        offset = at - (np.cumsum(n) - n)[row[at]]
        return pa.RecordBatch.from_arrays([pa.array(ids[row[at]]), pa.array(start[row[at]] + offset), pa.array(size)], ["_id", "_start", "_n"]), kept

    def work(batches):
        rows, load, fresh = [], 0, 0
        for b in batches:
            plain = b.column(4).is_valid()
            if plain.false_count:
                yield b.filter(pc.invert(plain)).select([1, 2, 3])
                b = b.filter(plain)
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if load > LOAD and r[0] != rows[-1][0]:
                    yield judge(rows, fresh)[0]
                    rows, load, fresh = [], 0, 0
                elif load > 4 * LOAD and len(rows) > 2 * fresh:  # one key goes on: keep what later rows must be compared with
                    found, kept = judge(rows, fresh)
                    yield found
                    rows = [x for x, k in zip(rows, kept, strict=True) if k and x[0] == r[0]]
                    fresh, load = len(rows), sum(len(x[4]) for x in rows)
                rows.append(r)
                load += len(r[4])
        if len(rows) > fresh:
            yield judge(rows, fresh)[0]

    dealt = cut.repartition("_key").sortWithinPartitions("_key", "_id", "_start")
    return dealt.mapInArrow(tidy(work), "_id long, _start long, _n long")


def one_row_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text) with integer ids; rows without an id are left out, and of rows that repeat one the smallest text stays."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_id is not null")
    if texts.groupBy("_id").count().filter("count > 1").limit(1).count():
        texts = texts.groupBy("_id").agg(F.min("_text").alias("_text"))
    return texts


def without_repeats(docs: DataFrame, id_col: str, text_col: str, plan: Plan, name: str) -> DataFrame:
    """One row per document: id, n_units, n_removed, n_spans, removed (list of [start, end) in units), kept (binary)."""
    spark = docs.sparkSession
    prepare(spark)
    steps = Steps(spark, name)
    texts = one_row_each(docs, id_col, text_col)
    marks = steps.put(_marks(_slim(texts, plan), plan), "marks")
    compare = marks.filter(F.col("_kind") == COMPARE)
    found = steps.put(_compared(_cut(texts, compare, plan), plan), "compared")
    gone = marks.filter(F.col("_kind") == REMOVE).select("_id", "_start", "_n").unionByName(found)
    gone = gone.groupBy("_id").agg(F.collect_list(F.struct("_start", (F.col("_start") + F.col("_n") - 1 + plan.length).alias("_end"))).alias("_gone"))

    def work(batches):
        for b in batches:
            for first, end, data, offsets in pieces(b.column(1)):
                where, spans = plan.spans(data, offsets)
                n = end - first
                lists = b.column(2).slice(first, n)
                sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                row = np.repeat(np.arange(n), sizes)
                if len(row):
                    flat = lists.drop_null().flatten()
                    begin, stop = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                    order = np.lexsort((begin, row))
                    row, begin, stop = row[order], begin[order], stop[order]
                    # stretches that touch or overlap are one: ends so far, the texts laid one after the other with a gap
                    far = np.maximum.accumulate(stop + where[row] + row)
                    new = np.ones(len(row), bool)
                    new[1:] = begin[1:] + where[row[1:]] + row[1:] > far[:-1]
                    at = np.flatnonzero(new)
                    stop = np.maximum.reduceat(stop, at)
                    row, begin = row[at], begin[at]
                else:
                    begin = stop = row
                n_spans = np.bincount(row, minlength=n)
                removed = np.bincount(row, stop - begin, minlength=n).astype(np.int64)
                cut = np.concatenate([[0], np.cumsum(n_spans)])
                raw, kept = data.tobytes(), []
                for i in range(n):
                    # what lies between the stretches
                    a, e = np.append(0, stop[cut[i] : cut[i + 1]]) + where[i], np.append(begin[cut[i] : cut[i + 1]], where[i + 1] - where[i]) + where[i]
                    a, e = a[e > a], e[e > a]
                    if spans is None:
                        kept.append(b"".join([raw[x:y] for x, y in zip(a.tolist(), e.tolist(), strict=True)]))
                    else:
                        kept.append(b" ".join([one_space(raw[x:y]) for x, y in zip(spans[0][a].tolist(), spans[1][e - 1].tolist(), strict=True)]))
                pairs = pa.StructArray.from_arrays([pa.array(begin), pa.array(stop)], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), pa.array(np.diff(where)), pa.array(removed), pa.array(n_spans.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs), pa.array(kept, pa.binary())],
                    ["_id", "n_units", "n_removed", "n_spans", "removed", "kept"],
                )

    joined = texts.join(gone, "_id", "left").select("_id", "_text", "_gone")
    schema = "_id long, n_units long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept binary"
    return joined.mapInArrow(tidy(work), schema).withColumnRenamed("_id", id_col)
