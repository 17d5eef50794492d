"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding by joining vocabulary strings.

The vocabulary file (the JSON format of the public tokenizers library) is a parameter and is read on the driver
only; workers get its tables (a vocabulary's size, which doesn't grow with the data) by broadcast.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._state import prepare
from tidemill.llm._text import tidy

#: Fixed: the pattern by which byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers; beyond, it starts anew. Longer pieces aren't remembered.
REMEMBERED, LONGEST = 400_000, 48
#: Characters beyond which a text isn't split into a list of pieces, but piece by piece; tokens that are decoded at once.
LONG = 1 << 20
#: Bytes of text after which a worker hands on a batch.
BATCH = 4 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Remembered(dict):
    """Packed ids by piece; merges what it doesn't know."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


@dataclass
class Bpe:
    """Tables of one vocabulary."""

    strings: list[bytes]  # by id
    first: list[int]  # id of each single byte
    merges: dict[int, tuple[int, int]]  # left id * 2^32 + right id: rank, id of the merged symbol
    special: dict[str, int]
    known: _Remembered | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        to_byte = {c: b for b, c in byte_alphabet().items()}
        vocab: dict[str, int] = j["model"]["vocab"]
        special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        strings = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for s, i in vocab.items():
            strings[i] = bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        for s, i in special.items():
            strings[i] = s.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        merges = {(vocab[a] << 32) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        return cls(strings, [vocab[byte_alphabet()[b]] for b in range(256)], merges, special)

    def merge(self, piece: bytes) -> bytes:
        """Ids (little-endian, 32 bits each) of one piece of text."""
        first, merges = self.first, self.merges
        ids = [first[b] for b in piece]
        n = len(ids)
        if n > 1:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            right[-1] = -1
            queue = []
            for i in range(n - 1):
                found = merges.get((ids[i] << 32) | ids[i + 1])
                if found:
                    queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
            heapq.heapify(queue)
            while queue:
                _, i, a, b, merged = heapq.heappop(queue)
                j = right[i]
                if ids[i] != a or j < 0 or ids[j] != b:
                    continue  # stale: one of the two symbols was merged meanwhile
                ids[i], ids[j] = merged, -1
                k = right[i] = right[j]
                if k >= 0:
                    left[k] = i
                    found = merges.get((merged << 32) | ids[k])
                    if found:
                        heapq.heappush(queue, (found[0], i, merged, ids[k], found[1]))
                h = left[i]
                if h >= 0:
                    found = merges.get((ids[h] << 32) | merged)
                    if found:
                        heapq.heappush(queue, (found[0], h, ids[h], merged, found[1]))
            ids = [x for x in ids if x >= 0]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; the strings of special tokens in it become those tokens."""
        if self.known is None:
            self.known = _Remembered(self.merge)
            pattern = regex.compile(PATTERN)
            self.split = lambda text: pattern.findall(text) if len(text) <= LONG else (m.group() for m in pattern.finditer(text))
            self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        if self.cut and any(s in text for s in self.special):
            parts = self.cut(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        get = self.known.__getitem__
        if len(text) <= LONG:
            return b"".join(map(get, self.split(text)))
        packed = bytearray()
        for piece in self.split(text):
            packed += get(piece)
        return bytes(packed)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included."""
        ids, get = np.frombuffer(packed, "<u4"), self.strings.__getitem__
        return b"".join([b"".join(map(get, ids[a : a + LONG].tolist())) for a in range(0, len(ids), LONG)]).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids (binary: little-endian 32-bit integers), n_tokens, decoded.

    ids are those of the whole text; decoded is made from ids alone. A null text counts as empty: no ids, empty
    decoded. Repeated rows and rows without an id get a row each, an empty table gives none; other columns are not
    read, whatever their names. A long text is merged piece by piece; memory grows with its longest piece (a run of
    letters, say), which is merged whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    tables = spark.sparkContext.broadcast(Bpe.load(path))

    def work(batches):
        bpe = tables.value

        def out(rows):
            keys, packed, decoded = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, keyed), pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(decoded, pa.string())], ["_id", "ids", "n_tokens", "decoded"]
            )

        for b in batches:
            keyed, rows, size = b.schema.field(0).type, [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packed = bpe.encode(text.as_py() or "")
                rows.append((key, packed, bpe.decode(packed)))
                size += len(packed)
                if size > BATCH:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(tidy(work), f"_id {kind}, ids binary, n_tokens long, decoded string")
    return found.withColumnRenamed("_id", id_col)
