"""Properties that results rest on, over made-up inputs; no Spark."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import _repeats, mixing, ngram_join, phrase_dedup, suffix_dedup
from tidemill.llm._text import BYTE, column, pieces, ragged, word_spans

TEXT = st.text(alphabet=st.sampled_from("ab \n\té\x0b C"), max_size=40)
TEXTS = st.lists(st.one_of(st.none(), TEXT), max_size=8)
FAST = settings(max_examples=150, deadline=None)


@FAST
@given(TEXTS, st.integers(1, 30))
def test_words_are_those_of_split(texts, size):
    found = []
    for _, _, data, offsets in pieces(pa.array(texts, pa.string()), size):
        starts, ends, where = word_spans(data, offsets)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found += [words[where[i] : where[i + 1]] for i in range(len(offsets) - 1)]
    assert found == [(t or "").encode().split() for t in texts]


@FAST
@given(TEXTS, st.integers(0, 3))
def test_columns_of_slices(texts, skip):
    data, offsets = column(pa.array(texts, pa.string()).slice(skip))
    assert [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)] == [(t or "").encode() for t in texts[skip:]]


@FAST
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(2, 5), st.integers(0, 6))
def test_equal_windows_own_equal_anchors(texts, k, more):
    """Every window lies in one context, and equal windows lie in contexts of one anchor, at equal distances from it."""
    length = k + more
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    text, start, n, anchor, _ = _repeats.contexts(BYTE[data], offsets, k, length)
    owners: dict[bytes, set] = {}
    seen = []
    for t, s, m, a in zip(text.tolist(), start.tolist(), n.tolist(), anchor.tolist(), strict=True):
        for p in range(s, s + m):
            seen.append((t, p))
            owners.setdefault(texts[t][p : p + length], set()).add(a)
    assert sorted(seen) == [(t, p) for t, x in enumerate(texts) for p in range(len(x) - length + 1)]
    assert all(len(v) == 1 for v in owners.values())


@FAST
@given(st.lists(st.binary(min_size=6, max_size=20).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=10))
def test_engines_find_what_occurs_before(texts):
    length = 6
    n = np.array([len(t) - length + 1 for t in texts])
    seen, want = set(), []
    for t in texts:
        for p in range(len(t) - length + 1):
            want.append(t[p : p + length] in seen)
            seen.add(t[p : p + length])
    assert suffix_dedup.PreviousFactors(length)(texts, n).tolist() == want
    spaced = [b" ".join(bytes([c]) for c in t) for t in texts]
    # the automata may be told of stretches in order only: whole ones that come again are later ones
    assert phrase_dedup.Automata(length)(spaced, n).tolist() == want


@FAST
@given(st.sets(st.integers(0, 400), min_size=1, max_size=60), st.sets(st.integers(0, 400), max_size=6), st.sets(st.integers(0, 59), max_size=6), st.integers(50, 99))
def test_prefixes_of_linked_sets_meet(a, extra, drop, percent):
    b = {x for i, x in enumerate(sorted(a)) if i not in drop} | extra
    if not b or 100 * len(a & b) < percent * len(a | b):
        return
    s = ngram_join.Shingler(1, percent)
    cut = [sorted(x, key=lambda v: (v * 7919) % 1009)[: int(s.prefix(np.array([len(x)]))[0])] for x in (a, b)]
    assert set(cut[0]) & set(cut[1])


@FAST
@given(st.lists(st.tuples(st.integers(1, 300), st.floats(0, 1)), max_size=60), st.integers(0, 5))
def test_flights_keep_totals(rows, seed):
    size, p = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
    out = mixing.flight(size, p, np.random.default_rng(seed).random(100))
    assert ((out >= 0) & (out <= 1)).all() and ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-5) and (out * size).sum() == pytest.approx((p * size).sum(), abs=1e-3)
    landed = mixing.landing(size, out, float((p * size).sum()))
    assert set(landed.tolist()) <= {0.0, 1.0}


@FAST
@given(st.lists(st.integers(0, 5), max_size=12))
def test_ragged(lengths):
    assert ragged(np.array(lengths, np.int64)).tolist() == [i for n in lengths for i in range(n)]


def test_functions_for_workers_are_small():
    """However large the tables of the module have become in this process."""
    from pyspark import cloudpickle

    from tidemill.llm import _text

    _text.UNITS.upto(100)
    _text.BYTES.upto(100)
    assert len(cloudpickle.dumps(_text.tidy(lambda batches: batches))) < 5_000
