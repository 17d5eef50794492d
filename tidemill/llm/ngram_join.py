"""N-gram Jaccard join: groups of documents whose sets of word shingles overlap by a threshold or more.

1. A text becomes its set of shingles, each known by two 64-bit hashes made from two independent numbers of its words.
   Documents with equal sets are one node from here on.
2. Nodes meet in blocks: a set's prefix (its floor((1-t)|A|)+1 first shingles, in an order that puts rare words
   first) shares a shingle with the prefix of every set that overlaps with it by t or more.
3. Each set's shingles are hashed into groups; the group counts are a point. The sum of coordinate minima of two
   points (or of a point and the upper corner of an R-tree box) bounds the overlap from above.
4. Pairs that the bound lets through are verified on the sets, shingles being equal if both hashes are. First each
   node meets one other, the first node of most of its blocks, which joins nearly all copies in linear work; then an
   R-tree over each block that still holds several components finds the remaining pairs between components. That
   goes on with ever more partners until no block held a pair back.
5. Components of verified links: pointer jumping for the first ones, which are a forest; later ones only join whole
   components, which alternating large and small stars do on one row for each such pair.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._repeats import one_row_each
from tidemill.llm._state import Steps, prepare, sent_if_few
from tidemill.llm._text import LOWER, PIECE, U, UNITS, Rolling, mix, pieces, ragged, segments, tidy, word_hashes, word_lanes, word_spans

#: Coordinates of a point in the tree. Sets of more than FINE shingles have twice as many, of more than 2 * FINE four
#: times, and so on; those are summed for the tree, and the finer bound judges what the tree lets through.
GROUPS, FINE = 512, 10_000
#: Coordinates are bytes; one that is at least CLIPPED isn't known and counts as UNKNOWN, which bounds nothing.
CLIPPED, UNKNOWN = 255, 1 << 24
#: Words whose frequency orders shingles: those that are one of so many words of the corpus or more, so never more than that.
COMMON_SHARE = 65_536
#: Bits of the table that finds them; of words that fall on one place the more frequent one is listed.
SLOTS = 18
WEIGHTS = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Nodes of a block that one task compares with as many others.
CHUNK = 1024
#: Points of a leaf of the R-tree, and children of an inner node.
LEAF = 16
#: A node of a block hands on one partner in other components in the first round, the closest, and so many times more in each further one.
MORE = 8
#: Nodes of blocks with one first node that come to one task; such blocks repeat pairs, but there can be any number of them.
TOGETHER = 2048
#: Pairs that a task remembers to have handed on.
TOLD = 200_000
#: Node ids up to this many are broadcast (16 bytes each) to find the texts of candidates; beyond, they are joined by shuffling.
BROADCAST_NODES = 2_000_000


class Shingler:
    """Sets of shingle hashes of the texts of an Arrow array."""

    def __init__(self, n: int, threshold_percent: int, common: tuple[np.ndarray, np.ndarray] | None = None):
        self.n, self.percent, self.common = n, threshold_percent, common

    def sets(self, array: pa.Array):
        """For each run of texts: first row, end row, sizes of sets, and both hashes of their shingles in the order that prefixes are taken in."""
        for first, end, data, offsets in pieces(array):
            if end - first == 1 and len(data) > 4 * PIECE:  # a long text: a set for each segment, and the union of those
                cuts = [part for _, part in segments(data, self.n - 1)]
                found = [self._distinct(*self._shingles(part, np.array([0, len(part)]), len(cuts) == 1), 1) for part in cuts]
                row, key, h, g = self._distinct(*(np.concatenate(x) for x in zip(*found, strict=True)), 1)
            else:
                row, key, h, g = self._distinct(*self._shingles(data, offsets), end - first)
            yield first, end, np.bincount(row, minlength=end - first), h, g

    def _shingles(self, data: np.ndarray, offsets: np.ndarray, whole: bool = True) -> tuple[np.ndarray, ...]:
        """(text, place in the order, first hash, second hash) of each shingle of whole texts or of a segment of one."""
        data = LOWER[data]
        starts, ends, where = word_spans(data, offsets)
        words = word_lanes(data, starts, ends)
        count = np.diff(where)
        row = np.repeat(np.arange(len(count)), count)
        # shingles begin at each word; those that would leave their text are dropped
        size = max(0, len(row) - self.n + 1)
        inside = row[:size] == row[self.n - 1 : self.n - 1 + size]
        short = np.flatnonzero((count > 0) & (count < self.n) & whole)  # the whole sequence is one shingle
        rows, out = np.concatenate([row[:size][inside], short]), []
        for lane, w in enumerate(words):
            h = np.zeros(size, U)
            for i in range(self.n):
                h = (h + w[i : i + size]) * WEIGHTS[(i + lane) % 3] + U(i)
            h = mix(h[inside])
            if len(short):
                h = np.concatenate([h, mix(Rolling(w, UNITS).ranges(where[short], where[short + 1]) ^ U(self.n + lane))])
            out.append(h)
        if self.common is None:
            return rows, out[0], *out
        rank = self.levels(words[0])
        level = rank[:size]
        for i in range(1, self.n):
            level = np.maximum(level, rank[i : i + size])
        level = np.concatenate([level[inside], np.zeros(len(short), level.dtype)])
        # within a text, rare words first: the rarest word of a shingle decides, then the hash
        return rows, (out[0] >> U(5)) | ((U(31) - level.astype(U)) << U(59)), *out

    @staticmethod
    def _distinct(rows: np.ndarray, key: np.ndarray, h: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Shingles in order, each once for a text."""
        bits = U(max(1, (n - 1).bit_length()))
        packed = (key >> bits) | (rows.astype(U) << (U(64) - bits))
        order = np.argsort(packed)
        packed = packed[order]
        same = np.flatnonzero(packed[1:] == packed[:-1])
        if (h[order[same + 1]] != h[order[same]]).any() or (g[order[same + 1]] != g[order[same]]).any():  # the bits that were cut off decide
            order = np.lexsort((g, h, key, rows))
        rows, key, h, g = rows[order], key[order], h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        return rows[new], key[new], h[new], g[new]

    def levels(self, words: np.ndarray) -> np.ndarray:
        """0 to 20: how rare each word is, in halvings of the share of the most frequent one; unlisted words are rarest."""
        hashes, level = self.common
        at = words >> U(64 - SLOTS)
        return np.where(hashes[at] == words, level[at], np.int8(20))

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        return np.where(sizes > 0, sizes - -(-sizes * self.percent // 100) + 1, 0)


def common_words(texts: DataFrame, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """A table of the frequent words of all texts: hash and rarity level, placed by the first bits of the hash."""

    def parts(array):
        for first, end, data, offsets in pieces(array):
            if end - first > 1:
                yield data, offsets
            else:
                yield from ((part, np.array([0, len(part)])) for _, part in segments(data, 0))

    def tally(batches):
        total = 0
        hashes, counts = np.zeros(0, U), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged(hashes, counts, waiting):
            h, c = np.unique(np.concatenate(waiting), return_counts=True)
            both, inverse = np.unique(np.concatenate([hashes, h]), return_inverse=True)
            return both, np.bincount(inverse, np.concatenate([counts, c])).astype(np.int64)

        def out(hashes, counts):
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["_word", "_n"])

        for b in batches:
            for data, offsets in parts(b.column(0)):
                data = LOWER[data]
                waiting.append(word_hashes(data, *word_spans(data, offsets)[:2]))
                total += len(waiting[-1])
                if total > PIECE:
                    hashes, counts = merged(hashes, counts, waiting)
                    total, waiting = 0, []
                    if len(hashes) > 4 * PIECE // 8:
                        yield out(hashes, counts)
                        hashes, counts = hashes[:0], counts[:0]
        if waiting:
            hashes, counts = merged(hashes, counts, waiting)
        # a word seen once in a whole partition is hardly frequent; leaving it out only changes an order that may be any
        yield out(hashes[counts > 1], counts[counts > 1])

    found = steps.put(texts.select("_text").mapInArrow(tidy(tally), "_word long, _n long").groupBy("_word").agg(F.sum("_n").alias("_n")), "words")
    total = found.agg(F.sum("_n")).first()[0] or 0
    rows = sorted((r[1], r[0]) for r in found.filter(F.col("_n") * COMMON_SHARE >= total).collect())
    steps.drop(found)
    table, level = np.zeros(1 << SLOTS, U), np.full(1 << SLOTS, 20, np.int8)
    for n, word in rows:
        h = int(word) & (2**64 - 1)
        table[h >> (64 - SLOTS)], level[h >> (64 - SLOTS)] = h, min(19, int(np.log2(rows[-1][0] / n)))
    return table, level


def points_of(sizes: np.ndarray, h: np.ndarray) -> list[bytes]:
    """The packed point of each set; a group is known by the first bits of the hash."""
    n, stop = len(sizes), np.cumsum(sizes)
    bits = GROUPS.bit_length() - 1
    rows = np.repeat(np.arange(n), sizes)
    coarse = np.bincount(rows * GROUPS + (h >> U(64 - bits)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS)
    out = [x.tobytes() for x in np.minimum(coarse, CLIPPED).astype(np.uint8)]
    for i in np.flatnonzero(sizes > FINE).tolist():
        more = bits + int(sizes[i] // FINE).bit_length()
        own = np.bincount((h[stop[i] - sizes[i] : stop[i]] >> U(64 - more)).astype(np.int64), minlength=1 << more)
        out[i] = np.minimum(own, CLIPPED).astype(np.uint8).tobytes()
    return out


def unpacked(point: bytes, groups: int | None = None) -> np.ndarray:
    """Coordinates of a packed point, summed to fewer groups if asked."""
    x = np.frombuffer(point, np.uint8).astype(np.int32)
    if x.max() == CLIPPED:
        x[x == CLIPPED] = UNKNOWN
    return x if groups is None or len(x) == groups else x.reshape(groups, -1).sum(1)


def overlap_bound(a: bytes, b: bytes) -> int:
    """The sum of coordinate minima: no fewer than the shingles that two sets share."""
    groups = min(len(a), len(b))
    return int(np.minimum(unpacked(a, groups), unpacked(b, groups)).sum(dtype=np.int64))


def describe(texts: DataFrame, shingler: Shingler) -> DataFrame:
    """(_id, _n, _set: 128 bits that name the set, _prefix: packed longs, _point: packed group counts) of each text."""
    kind = texts.schema["_id"].dataType.simpleString()
    sent = texts.sparkSession.sparkContext.broadcast(shingler)

    def work(batches):
        s = sent.value
        for b in batches:
            for first, end, sizes, h, g in s.sets(b.column(1)):
                n = end - first
                stop = np.cumsum(sizes)
                begin = stop - sizes
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)]) for x in (mix(h ^ U(0x5851F42D4C957F2D)), mix(g + U(0x14057B7EF767814F)))]
                names = np.stack([mix(x[stop] - x[begin] + sizes.astype(U)) for x in sums], 1).astype("<u8")
                size = s.prefix(sizes)
                keys = h[np.repeat(begin, size) + ragged(size)].astype("<u8").tobytes()
                cut = np.concatenate([[0], np.cumsum(size)]) * 8
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, n),
                        pa.array(sizes.astype(np.int64)),
                        pa.array([x.tobytes() for x in names], pa.binary()),
                        pa.array([keys[cut[i] : cut[i + 1]] for i in range(n)], pa.binary()),
                        pa.array(points_of(sizes, h), pa.binary()),
                    ],
                    ["_id", "_n", "_set", "_prefix", "_point"],
                )

    return texts.mapInArrow(tidy(work), f"_id {kind}, _n long, _set binary, _prefix binary, _point binary")


def _exploded(nodes: DataFrame) -> DataFrame:
    """(_key, _node) for each shingle of each node's prefix."""
    kind = nodes.schema["_node"].dataType.simpleString()

    def work(batches):
        for b in batches:
            packed = b.column(1).to_pylist()
            sizes = np.array([len(x) // 8 for x in packed], np.int64)
            at = pa.array(np.repeat(np.arange(len(packed)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), "<i8")), b.column(0).take(at)], ["_key", "_node"])

    return nodes.select("_node", "_prefix").mapInArrow(tidy(work), f"_key long, _node {kind}")


def verified(pairs: DataFrame, texts: DataFrame, shingler: Shingler) -> DataFrame:
    """Those of pairs (a, b) whose sets overlap enough, judged on the sets of their texts, by both hashes of each shingle.

    pairs is a written table. If it is small enough to send, the texts of a are dealt once, to their b, and of the
    other texts only those that some pair names; else all joins shuffle. Texts are less than half the size of their sets.
    """
    few = pairs.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    kind, percent = pairs.schema["a"].dataType.simpleString(), shingler.percent
    maker = texts.sparkSession.sparkContext.broadcast(Shingler(shingler.n, percent))

    def sent(df):
        return F.broadcast(df) if few else df

    def sets(array: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for _, _, sizes, h, g in maker.value.sets(array):
            cut = np.cumsum(sizes)[:-1]
            out += zip(np.split(h, cut), np.split(g, cut), strict=True)
        return out

    def work(batches):
        for batch in batches:
            # many rows can have one b; its set is made once
            _, first, which = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            ones, others, near = sets(batch.column(2)), sets(batch.column(3).take(pa.array(first))), []
            for (h, g), i in zip(ones, which.tolist(), strict=True):
                k, m = others[i]
                at = np.minimum(np.searchsorted(k, h), max(len(k) - 1, 0))
                common = int(((k[at] == h) & (m[at] == g)).sum()) if len(k) else 0
                near.append(100 * common >= percent * (len(h) + len(k) - common))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    left = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_a")).join(sent(pairs), "a")
    right = texts.select(F.col("_id").alias("b"), F.col("_text").alias("_b")).join(sent(pairs.select("b").distinct()), "b", "left_semi")
    return left.join(right, "b").select("a", "b", "_a", "_b").mapInArrow(tidy(work), f"a {kind}, b {kind}")


def tree_roots(links: DataFrame, steps: Steps) -> DataFrame:
    """(_node, _root) of nodes that link to a smaller one, where no node links (a to b) to more than one: pointers jump until they all end at roots."""
    found = steps.put(links.select(F.col("a").alias("_node"), F.col("b").alias("_root")), "roots")
    while True:
        ahead = found.select(F.col("_node").alias("_root"), F.col("_root").alias("_ahead"))
        jumped = found.join(sent_if_few(ahead), "_root", "left").select("_node", F.coalesce("_ahead", "_root").alias("_root"), F.col("_ahead").isNotNull().alias("_moved"))
        before = found
        found, told = steps.put_and_tell(jumped, "roots", moved=F.count_if("_moved"))
        found = steps.same(found, found.drop("_moved"))
        steps.drop(before)
        if not told["moved"]:
            return found


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(_node, _root) for each node that has an edge and isn't the smallest node of its component, which is _root."""
    told = {"n": F.count("*"), "low": F.bit_xor(F.xxhash64("u", "v")), "high": F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))}
    e, now = steps.put_and_tell(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges", **told)
    while True:
        before, was = e, now
        # large star: greater neighbours of u point to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = steps.put(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"), "large-stars")
        steps.drop(before)
        # small star: u and its smaller neighbours point to the smallest of them
        before = e
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        e, now = steps.put_and_tell(e, "stars", **told)
        steps.drop(before)
        if was == now:
            return steps.same(e, e.select(F.col("u").alias("_node"), F.col("v").alias("_root")))


class RTree:
    """Points packed level by level; a box is known by its upper corner and its smallest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*points.T[:4], sizes))
        self.order = order
        self.levels = [(points[order], sizes[order])]
        while len(self.levels[-1][1]) > LEAF:
            p, s = self.levels[-1]
            cut = np.arange(0, len(s), LEAF)
            self.levels.append((np.maximum.reduceat(p, cut, axis=0), np.minimum.reduceat(s, cut)))

    def search(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose overlap with the given one may reach the threshold, and how far it may exceed that."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            points, sizes = self.levels[depth]
            bound = np.minimum(points[at], point).sum(1, dtype=np.int64)
            beyond = (100 + percent) * bound - percent * (size + sizes[at])
            at, beyond = at[beyond >= 0], beyond[beyond >= 0]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at], beyond


def _across(blocks: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b, null), and (null, null, key) of blocks that hold pairs back, from blocks (_key, _first, _one, _two, _side, _node, _root, _n, _point): pairs of different components that the bound lets through."""
    kind = blocks.schema["_node"].dataType.simpleString()

    def block(rows: list[tuple]) -> list[tuple]:
        one, two, out = [r for r in rows if r[3] == 0], [r for r in rows if r[3] == 1], []
        two = two or one
        tree = RTree(np.array([unpacked(r[7], GROUPS) for r in two]), np.array([r[6] for r in two]))
        for r in one:
            found, beyond = tree.search(unpacked(r[7], GROUPS), r[6], percent)
            n = 0
            for i in found[np.lexsort((found, -beyond))].tolist():
                o = two[i]
                if o[5] == r[5] or ((r[6] > FINE and o[6] > FINE) and (100 + percent) * overlap_bound(r[7], o[7]) < percent * (r[6] + o[6])):
                    continue
                n += 1
                if n > most:
                    out.append((None, None, r[0]))
                    break
                out.append((r[4], o[4], None))
        return out

    def work(batches):
        key, rows = None, []
        told: set[tuple] = set()  # a pair can meet in many blocks of a task

        def out(rows):
            if len(told) > TOLD:
                told.clear()
            rows = [r for r in dict.fromkeys((max(a, b), min(a, b), h) if h is None else (a, b, h) for a, b, h in rows) if not (r in told or told.add(r))] or rows[:1]
            a, b, held = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, keyed), pa.array(b, keyed), pa.array(held, pa.int64())], ["a", "b", "_held"])

        for batch in batches:
            keyed = batch.schema.field(4).type
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != key:
                    if rows and (found := block(rows)):
                        yield out(found)
                    key, rows = r[:3], []
                rows.append(r)
        if rows and (found := block(rows)):
            yield out(found)

    cols = ["_key", "_one", "_two", "_side", "_node", "_root", "_n", "_point"]
    # blocks with the same first node come to the same tasks as far as those can hold them, which hand on each pair once
    near = [F.col("_first"), F.pmod(F.col("_key"), F.col("_tasks")), F.col("_one"), F.col("_two")]
    dealt = blocks.select(*cols, "_first", "_tasks").repartition(*near).sortWithinPartitions("_key", "_one", "_two", "_side", "_node").select(*cols)
    return dealt.mapInArrow(tidy(work), f"a {kind}, b {kind}, _held long")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, threshold_percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles (size of its set), component_id (smallest id linked with it, directly or not).

    Words are maximal runs without ASCII white space, A-Z lower-cased; a shingle is n consecutive words (all of
    them, if there are fewer). Documents link if 100 * intersection >= threshold_percent * union. Null, empty or
    blank texts have empty sets and link with nothing. Ids are integers; of rows that repeat an id only the smallest
    text counts and gets a row; rows without an id are left out. An empty table gives no rows; other columns are
    not read, whatever their names. A text of any length is read whole, a long one in segments, whose sets are united.
    """
    spark = docs.sparkSession
    prepare(spark)
    steps = Steps(spark, "ngram-join")
    texts = one_row_each(docs, id_col, text_col)
    shingler = Shingler(n, threshold_percent, common_words(texts, steps))
    described = steps.put(describe(texts, shingler), "sets")
    groups = described.filter("_n > 0").groupBy("_set").agg(F.min("_id").alias("_node"))
    first = F.col("_id") == F.col("_node")
    members = described.filter("_n > 0").select("_id", "_n", "_set", "_prefix", "_point").join(groups, "_set")
    members = steps.put(members.select("_id", "_node", "_n", F.when(first, F.col("_prefix")).alias("_prefix"), F.when(first, F.col("_point")).alias("_point")), "members")
    # from here on, of most documents only ids matter; what is wide goes as soon as it was used
    ids = members.select("_id", "_node", "_n").unionByName(described.filter("_n = 0").select("_id", F.col("_id").alias("_node"), "_n"))
    ids = steps.put(ids, "ids")
    steps.drop(described)
    nodes = members.filter("_prefix is not null")
    prefixes = steps.put(_exploded(nodes), "prefixes")
    # blocks of several nodes; of blocks with the same nodes one, with their number
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "_node")).alias(f"_x{i}") for i in range(2)]
    shared = prefixes.groupBy("_key").agg(F.min("_node").alias("_first"), F.max("_node").alias("_last"), F.count("*").alias("_size"), *marks).filter("_first != _last")
    shared = shared.groupBy("_first", "_last", "_size", "_x0", "_x1").agg(F.min("_key").alias("_key"), F.count("*").alias("_times"))
    blocks = steps.put(prefixes.join(shared.select("_key", "_first", "_times"), "_key"), "blocks")
    near = steps.put(nodes.select("_node", "_n", "_point").join(blocks.select("_node").distinct(), "_node", "left_semi"), "points")
    steps.drop(prefixes, members)
    roots = _resolve(steps, texts, blocks, near, shingler)
    result = ids.join(roots, "_node", "left").select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_root", "_node").alias("component_id"))
    return steps.finish(result, "result")


def _resolve(steps: Steps, texts: DataFrame, blocks: DataFrame, near: DataFrame, shingler: Shingler) -> DataFrame:
    """(_node, _root) of the nodes that links connect with a smaller one; _root is the smallest that they reach."""
    percent = shingler.percent
    # each node meets the first node that it shares most blocks with
    shared = blocks.filter("_first != _node").groupBy("_node", "_first").agg(F.sum("_times").alias("_c"))
    stars = shared.groupBy("_node").agg(F.max_by("_first", F.struct("_c", -F.col("_first"))).alias("b")).withColumnRenamed("_node", "a")
    stars = stars.join(near.select(F.col("_node").alias("a"), F.col("_n").alias("_na"), F.col("_point").alias("_pa")), "a")
    stars = stars.join(near.select(F.col("_node").alias("b"), F.col("_n").alias("_nb"), F.col("_point").alias("_pb")), "b")
    tried = steps.put(_bounded(stars, percent), "stars")
    roots = tree_roots(_checked(steps, texts, tried, shingler), steps)
    for most in (MORE**i for i in count()):
        found = steps.put(_across(_dealt(blocks, roots, near), percent, most), "across")
        fresh = steps.put(found.filter("_held is null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            tried = tried.unionByName(fresh)
            roots = _joined(roots, _checked(steps, texts, fresh, shingler), steps)
        # only blocks that held pairs back are looked at again, with more partners for each node
        held = found.filter("_held is not null").select(F.col("_held").alias("_key")).distinct()
        if held.isEmpty():
            return roots
        seen = blocks
        blocks = steps.put(seen.join(held, "_key", "left_semi"), "held-blocks")
        steps.drop(seen, found)


def _joined(roots: DataFrame, links: DataFrame, steps: Steps) -> DataFrame:
    """The roots after links (a, b) between components."""

    def ends(side: str) -> DataFrame:
        return roots.select(F.col("_node").alias(side), F.col("_root").alias(f"_{side}"))

    rooted = links.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
    joined = components(rooted.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")), steps)
    moved = roots.join(joined.select(F.col("_node").alias("_root"), F.col("_root").alias("_to")), "_root", "left").select("_node", F.coalesce("_to", "_root").alias("_root"))
    found = steps.put(moved.unionByName(joined), "roots")
    steps.drop(roots, joined)
    return found


def _dealt(blocks: DataFrame, roots: DataFrame, near: DataFrame) -> DataFrame:
    """Nodes of the blocks that still hold several components, once for each part of a block in which they meet others.

    A block of more than CHUNK nodes is cut into chunks by a hash, those of its largest component and those of all
    others. Each two chunks make a part, but none of the largest component alone: where most nodes are linked
    already, the work is linear in the block.
    """
    labelled = blocks.select("_key", "_node", "_first").join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    sizes = labelled.groupBy("_key", "_first", "_root").agg(F.count("*").alias("_c"))
    several = sizes.groupBy("_key", "_first").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.sum("_c").alias("_size"), F.max("_c").alias("_most"), F.max_by("_root", F.struct("_c", "_root")).alias("_main"))
    several = several.filter("_lo != _hi").select("_key", "_first", "_size", "_most", "_main")
    tasks = several.groupBy("_first").agg((F.floor(F.sum("_size") / TOGETHER) + 1).alias("_tasks"))
    left = labelled.select("_key", "_node", "_root").join(several.join(tasks, "_first"), "_key").join(near, "_node")

    def chunks(n):
        return F.ceil(n / CHUNK).cast("int")

    cut, main = F.col("_size") > CHUNK, F.col("_root") == F.col("_main")
    whole, rest = chunks(F.col("_most")), chunks(F.col("_size") - F.col("_most"))
    at = F.xxhash64("_node")
    left = left.withColumn("_chunk", F.when(~cut, 0).when(main, F.pmod(at, whole)).otherwise(whole + F.pmod(at, rest)).cast("int"))
    others = F.when(~cut, F.array(F.lit(0))).when(main, F.sequence(whole, whole + rest - 1)).otherwise(F.sequence(F.lit(0), whole + rest - 1))
    left = left.withColumn("_other", F.explode(others))
    return left.withColumns({"_one": F.greatest("_chunk", "_other"), "_two": F.least("_chunk", "_other")}).withColumn("_side", (F.col("_chunk") != F.col("_one")).cast("int"))


def _checked(steps: Steps, texts: DataFrame, pairs: DataFrame, shingler: Shingler) -> DataFrame:
    """The verified ones of written pairs, written."""
    return steps.put(verified(pairs, texts, shingler), "links")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and points (_na, _nb, _pa, _pb) let their overlap reach the threshold."""
    kind = pairs.schema["a"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            na, nb, one, two = (batch.column(i).to_pylist() for i in range(2, 6))
            near = [(100 + percent) * overlap_bound(p, q) >= percent * (x + y) for x, y, p, q in zip(na, nb, one, two, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return pairs.select("a", "b", "_na", "_nb", "_pa", "_pb").mapInArrow(tidy(work), f"a {kind}, b {kind}")

