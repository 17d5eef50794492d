"""Substring dedup by words: passages that recur are compiled into Aho-Corasick automata, which locate every occurrence.

Anchors (see _repeats) show which stretches of text may hold a recurring window of `length` words. They are dealt
into shards by anchor. In a shard, what recurs is confirmed and becomes the phrases of an automaton over word
numbers: whole stretches that come again, and windows that different stretches share. All the shard's stretches
then run through it, and every occurrence but the first is removed.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from tidemill.llm._repeats import Plan, without_repeats
from tidemill.llm._text import UNITS, Rolling, U, mix, ragged

#: Equal contexts of one anchor that run through the automaton; later ones equal an earlier one by anchor and digest.
COMPARED = 64


class Automata:
    """The engine: see _repeats.Engine. Contexts are words between single or other ASCII white space."""

    def __init__(self, length: int):
        self.length = length

    def __call__(self, contexts: list[bytes], n: np.ndarray) -> np.ndarray:
        length, numbers = self.length, defaultdict()
        numbers.default_factory = numbers.__len__
        # equal stretches, whatever white space is in them, by the first of them
        of_bytes: dict[bytes, int] = {}
        of_words: dict[tuple, int] = {}
        seen = []
        for r, c in enumerate(contexts):
            f = of_bytes.get(c)
            if f is None:
                f = of_bytes[c] = of_words.setdefault(tuple(map(numbers.__getitem__, c.split())), r)
            seen.append(f)
        base = np.cumsum(n) - n
        gone = np.zeros(int(n.sum()), bool)
        split = {r: words for words, r in of_words.items()}
        # confirm: windows that recur in different stretches, and whole stretches that do
        rows = np.array(list(split), np.int64)
        size = n[rows]
        flat = np.fromiter(chain.from_iterable(split.values()), np.int64)
        begin = np.repeat(np.cumsum(size + length - 1) - (size + length - 1), size) + ragged(size)
        hashes = Rolling(mix(flat.astype(U) + U(1)), UNITS).ranges(begin, begin + length)
        _, first, number, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        row, offset = np.repeat(rows, size), ragged(size)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i in first[count > 1].tolist():
            r, a = int(row[i]), int(offset[i])
            automaton.add_word(split[r][a : a + length], (length, base[r] + a))
        for r in {f for r, f in enumerate(seen) if f != r}:
            if n[r] > 1 or not automaton.exists(split[r]):
                automaton.add_word(split[r], (len(split[r]), base[r]))
        if not len(automaton):
            return gone
        automaton.make_automaton()
        again = set(row[count[number] > 1].tolist())
        for r, f in enumerate(seen):
            if f == r and r not in again:
                continue
            at = int(base[r]) + 1
            for end, (size_, place) in automaton.iter(split[f]):
                begin_ = at + end - size_
                if begin_ > place:
                    gone[begin_ : begin_ + size_ - length + 1] = True
        return gone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 20, k: int = 5) -> DataFrame:
    """One row per document: id, n_words, n_removed, n_spans, removed (list of [start, end) in words), kept (binary, words joined by a space).

    Removed is each word covered by a window of `length` words that also starts earlier: in a document with a
    smaller id, or before in the same one. Windows are judged on the input. Null, empty and short texts lose
    nothing; of rows that repeat an id only the smallest text counts and gets a row; rows without an id are left
    out; other columns are not read, whatever their names. An empty table gives no rows. Texts of any length are
    read whole; long ones are searched in segments that overlap.
    """
    plan = Plan(words=True, length=length, k=k, compared=COMPARED, engine=Automata(length))
    return without_repeats(docs, id_col, text_col, plan, "phrase-dedup").withColumnRenamed("n_units", "n_words")
