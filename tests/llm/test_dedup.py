"""Exact dedup, URL rules, n-gram join and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import _repeats, exact_dedup, ngram_join, phrase_dedup, suffix_dedup, url_filter
from tidemill.llm._text import BYTE, BYTES, Rolling, segments, sliding_min

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.7 else rng.choice(["the", "of", "and", "a"]) for _ in range(n)]


def corpus(seed=1, n=120):
    """Texts with copies, near copies, shared passages, nulls, blanks, short and long ones, odd white space and letters."""
    rng = random.Random(seed)
    passage, line = words(rng, 60), words(rng, 9)
    texts = [None, "", "  \n\t ", "one", "one two", "One TWO", "é\u00a0x\u2003y z", "\x0b\x0cword\r\n", "a " * 300, "ab " * 45, "x" * 500, "ab" * 400]
    for i in range(n):
        w = words(rng, rng.choice([3, 19, 20, 21, 60, 200, 500]))
        if i % 4 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        if i % 3 == 0:
            w[0:0] = line
        texts.append((" " if i % 5 else "\n").join(w))
    for i in range(0, n, 6):
        base = texts[12 + i].split()
        texts.append(" ".join(base))
        texts.append(texts[12 + i].upper())
        for _ in range(3):
            b = list(base)
            b[rng.randrange(len(b))] = f"changed{rng.randrange(99)}"
            texts.append(" ".join(b))
    texts.append(" ".join(words(rng, 6000)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return sorted((3 * i, t, "en", f"s{i % 3}", len(t or "")) for i, t in zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(5).cache()


def odd_columns(df):
    names = ["_id", "_text", "_n", "_key", "_node", "_set", "_anchor", "_digest", "_row", "keep_id", "count", "copies", "_size", "kept"]
    return df.withColumns({c: F.lit(1) for c in names})


# ---- exact ----


def exact_truth(rows):
    groups = defaultdict(list)
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("least", [1, 3, 10**9])
def test_exact_copies(docs, rows, least):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.mark_copies(odd_columns(docs), least=least).collect()}
    assert got == exact_truth(rows)
    kept = exact_dedup.drop_copies(odd_columns(docs), least=least)
    assert kept.columns == odd_columns(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in exact_truth(rows).items() if v[2])


@pytest.mark.parametrize("least", [1, 10**9])
def test_exact_ties_and_nulls(spark, least):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = exact_dedup.mark_copies(df, least=least).collect()
    assert len(got) == 6 and sum(r["kept"] for r in got) == 2 and {r["group_size"] for r in got} == {2, 4}
    assert exact_dedup.drop_copies(df, least=least).count() == 2


# ---- urls ----

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def url_truth(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http:///en/x", "HTTP://WWW.Example.COM/en/7abc?q=/x#y", "https://example.com/en/6", "https://a.b.c.example.com/en/75", "http://notexample.com/en/7", "http://com/en/", "http://com/en",
    "http://x.net/de/8", "http://example.net/de/8/9", "http://www.example.net/de/7", "http://x.org?/es/", "http://x.org#/es/", "http://x.org/es/é", "http://x.org./es/", "http://..org/es/", "x://y://com/en/", "http://user@x.com:80/en/", "http://x.com\n/en/", "http://" + "a." * 300 + "com/en/",
]


def test_urls(spark):
    pages = odd_columns(spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string"))
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = sorted(map(tuple, url_filter.judge(pages, rules).collect()))
    assert got == [(i, *url_truth(u)) for i, u in enumerate(URLS * 2)]
    plan = url_filter.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    none = url_filter.judge(pages, rules.limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}


# ---- n-gram join ----


def sets_of(rows, n):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def join_truth(rows, n, percent):
    sets = sets_of(rows, n)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(docs, rows, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(odd_columns(docs), n=n, threshold_percent=percent).collect()}
    assert got == join_truth(rows, n, percent)


def test_ngram_join_in_small_chunks(spark, monkeypatch):
    """Blocks cut into chunks, few partners a round, and long chains of near copies."""
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "MORE", 2)
    monkeypatch.setattr(ngram_join, "TOGETHER", 5)
    monkeypatch.setattr(ngram_join, "FINE", 8)
    rng = random.Random(5)
    text, rows = words(rng, 40), []
    for i in range(30):
        text = list(text)
        text[rng.randrange(len(text))] = f"n{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(words(rng, 30) + text[:12])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(df, n=3, threshold_percent=80).collect()}
    assert got == join_truth(rows, 3, 80)


def two_words(n=1024):
    """Texts of two letters which differ in every place, but agree in any polynomial of an odd base modulo 2^64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_alike_to_a_weak_hash_are_different(spark):
    a, b = two_words()
    df = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, f"{a} {b} {a} {b}"), (6, f"{a} {a}")], "doc_id long, text string")
    for n in (1, 3):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(df, n=n, threshold_percent=90).collect()}
        assert got == join_truth([(r["doc_id"], r["text"]) for r in df.collect()], n, 90)


@pytest.mark.parametrize("together", [4, 2048])
def test_blocks_of_many_nodes(spark, monkeypatch, together):
    """Thousands of different texts with one rare shingle: a few large groups, and many texts of their own."""
    monkeypatch.setattr(ngram_join, "CHUNK", 64)
    monkeypatch.setattr(ngram_join, "TOGETHER", together)
    rng = random.Random(9)
    key = "rare unheard phrase"
    rows = []
    for g, copies in enumerate((700, 150)):
        base = words(rng, 60)
        for _ in range(copies):
            w = list(base)
            w[rng.randrange(60)] = f"x{len(rows)}"
            rows.append((len(rows), f"{key} " + " ".join(w)))
    rows += [(len(rows) + i, f"{key} " + " ".join(words(rng, 30))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(df, n=3, threshold_percent=80).collect()}
    assert got == join_truth(rows, 3, 80)


def test_long_texts_have_the_same_sets(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(words(rng, 3000, 50)), "one two", "z " * 2000, "long" * 900]
    array = pa.array([texts[0]]), pa.array([texts[1]]), pa.array([texts[2]]), pa.array([texts[3]])
    shingler = ngram_join.Shingler(3, 90)
    whole = [[x.tolist() for x in next(iter(shingler.sets(a)))[2:]] for a in array]
    monkeypatch.setattr(ngram_join, "PIECE", 16)
    monkeypatch.setattr(ngram_join, "segments", lambda data, overlap: segments(data, overlap, 64))
    assert [[x.tolist() for x in next(iter(shingler.sets(a)))[2:]] for a in array] == whole


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (500, ngram_join.GROUPS))
    points[100:140] = points[100] + rng.integers(0, 2, (40, ngram_join.GROUPS))
    sizes = points.sum(1)
    tree = ngram_join.RTree(points, sizes)
    for i in range(0, 500, 7):
        bound = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(190 * bound >= 90 * (sizes[i] + sizes))
        assert sorted(tree.search(points[i], int(sizes[i]), 90)[0]) == want.tolist()


def test_points_bound_the_overlap():
    rng = np.random.default_rng(2)
    for size in (10, 3000, 12000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(3))
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 2**63, size * 3).astype(np.uint64)]))
        p, q = ngram_join.points_of(np.array([len(a), len(b)]), np.concatenate([a, b]))
        assert ngram_join.overlap_bound(p, q) >= len(np.intersect1d(a, b))
        assert ngram_join.overlap_bound(p, p) == len(a)


def test_components_of_a_path_and_a_star(spark):
    from tidemill.llm._state import Steps

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(201, 200)]
    got = {r["_node"]: r["_root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long"), Steps(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200}


def test_roots_of_trees(spark):
    from tidemill.llm._state import Steps

    links = [(i, i - 1) for i in range(1, 20)] + [(i, 50) for i in range(51, 60)] + [(70, 55)]
    got = {r["_node"]: r["_root"] for r in ngram_join.tree_roots(spark.createDataFrame(links, "a long, b long"), Steps(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 20)} | {i: 50 for i in range(51, 60)} | {70: 50}


# ---- substring ----


def repeats_truth(rows, units, length):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        u = units(t or "")
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - length + 1):
            key = u[p : p + length] if isinstance(u, bytes) else tuple(u[p : p + length])
            if key in seen:
                gone[p : p + length] = True
            seen.add(key)
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g) if isinstance(u, bytes) else b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[i] = (len(u), int(gone.sum()), int((edges == 1).sum()), kept)
    return out


def words_of(t):
    return t.encode().split()


def found(df, n):
    return {r["doc_id"]: (r[n], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()}


@pytest.mark.parametrize("hot,load", [(4096, 1 << 19), (2, 1 << 8)])
def test_repeated_phrases(docs, rows, monkeypatch, hot, load):
    monkeypatch.setattr(_repeats, "HOT", hot)
    monkeypatch.setattr(_repeats, "LOAD", load)
    assert found(phrase_dedup.remove_repeats(odd_columns(docs)), "n_words") == repeats_truth(rows, words_of, 20)
    assert found(phrase_dedup.remove_repeats(docs, length=6, k=3), "n_words") == repeats_truth(rows, words_of, 6)


@pytest.mark.parametrize("hot,load", [(4096, 1 << 19), (2, 1 << 8)])
def test_repeated_bytes(docs, rows, monkeypatch, hot, load):
    monkeypatch.setattr(_repeats, "HOT", hot)
    monkeypatch.setattr(_repeats, "LOAD", load)
    assert found(suffix_dedup.remove_repeats(odd_columns(docs)), "n_bytes") == repeats_truth(rows, str.encode, 100)
    assert found(suffix_dedup.remove_repeats(docs, length=24, k=8), "n_bytes") == repeats_truth(rows, str.encode, 24)


def test_passages_alike_to_a_weak_hash_are_kept(spark):
    a, b = two_words()
    w = [f"w{i}" for i in range(19)]
    rows = [(i, " ".join([*w[:10], a, *w[10:]])) for i in range(1, 19)] + [(100, " ".join([*w[:10], b, *w[10:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(phrase_dedup.remove_repeats(df), "n_words") == repeats_truth(rows, words_of, 20)
    rows = [(i, "x" * 60 + a + "y" * 60) for i in range(1, 19)] + [(100, "x" * 60 + b + "y" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffix_dedup.remove_repeats(df), "n_bytes") == repeats_truth(rows, str.encode, 100)


def test_long_texts_in_segments(spark):
    """A text of several segments, which repeats itself and others across their edges."""
    rng = random.Random(12)
    long = words(rng, 900_000, 200_000)
    passage = long[700_000:700_300]
    rows = [(1, " ".join(passage)), (2, "  ".join(long[:300_000])), (3, " ".join(long)), (4, "q" * 5_000_000 + " z"), (5, "q" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(phrase_dedup.remove_repeats(df), "n_words") == repeats_truth(rows, words_of, 20)
    rows = [(1, "ab" * 60), (2, " ".join(long[:600_000])), (3, "x" + " ".join(long[550_000:600_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffix_dedup.remove_repeats(df), "n_bytes") == repeats_truth(rows, str.encode, 100)


@pytest.mark.parametrize("often", [0, 1, 5])
def test_rows_of_hot_anchors_are_split(docs, rows, monkeypatch, often):
    """Tasks that know an anchor as hot and tasks that don't find the same; with 0 all rows are dealt by context."""
    monkeypatch.setattr(_repeats, "OFTEN", often)
    monkeypatch.setattr(_repeats, "CELLS", 1 << 10)
    assert found(phrase_dedup.remove_repeats(docs), "n_words") == repeats_truth(rows, words_of, 20)
    assert found(suffix_dedup.remove_repeats(docs), "n_bytes") == repeats_truth(rows, str.encode, 100)
    monkeypatch.setattr(phrase_dedup, "COMPARED", 2)
    assert found(phrase_dedup.remove_repeats(docs, length=6, k=3), "n_words") == repeats_truth(rows, words_of, 6)


def test_a_task_remembers_what_came_often():
    known = _repeats._Known()
    u = lambda *x: np.array(x, np.uint64)
    known.add(u(7), u(1), np.array([5]), np.array([3]))
    known.add(u(7, 8), u(1, 2), np.array([4, 9]), np.array([9, 0]))
    got = known.later(u(7, 7, 7, 8, 8, 6), u(1, 1, 1, 2, 3, 1), np.array([4, 4, 3, 10, 10, 9]), np.array([10, 9, 99, 0, 0, 0]))
    assert got.tolist() == [True, False, False, True, False, False]


def test_removed_spans_name_what_is_removed(docs, rows):
    truth = repeats_truth(rows, str.encode, 100)
    for r in suffix_dedup.remove_repeats(docs).collect():
        text = next(t or "" for i, t, *_ in rows if i == r["doc_id"]).encode()
        for s in reversed(r["removed"]):
            text = text[: s["start"]] + text[s["end"] :]
        assert text == truth[r["doc_id"]][3]


def test_many_equal_contexts(spark):
    """More copies than the automata compare, within a batch and across."""
    rng = random.Random(3)
    same = " ".join(words(rng, 50))
    rows = [(i, (f"a{i} " if i % 2 else "") + same) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(phrase_dedup.remove_repeats(df), "n_words") == repeats_truth(rows, words_of, 20)
    assert found(suffix_dedup.remove_repeats(df), "n_bytes") == repeats_truth(rows, str.encode, 100)


@pytest.mark.parametrize("operator", [phrase_dedup.remove_repeats, suffix_dedup.remove_repeats, ngram_join.link_documents, exact_dedup.mark_copies, exact_dedup.drop_copies])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("operator", [phrase_dedup.remove_repeats, suffix_dedup.remove_repeats, ngram_join.link_documents])
def test_repeated_and_missing_ids(spark, operator):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (1, "z" + text), (None, text), (2, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in operator(df).collect()}
    assert set(got) == {1, 2}
    if "n_removed" in got[1]:
        assert got[1]["n_removed"] == 0 and got[2]["n_removed"] > 0
    else:
        assert got[2]["component_id"] == 1


# ---- parts ----


def test_suffix_order():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    raw = data.tobytes() + bytes(40)
    for length in (1, 3, 8, 20, 37):
        ranks = suffix_dedup.prefix_ranks(data, length)
        order = sorted(range(400), key=lambda i: raw[i : i + length])
        assert all((ranks[a] < ranks[b]) == (raw[a : a + length] < raw[b : b + length]) for a, b in zip(order, order[1:], strict=False) if max(a, b) + length <= 400)
    values = rng.permutation(200)
    assert suffix_dedup.smaller_before(values).tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(200)]


def test_longest_previous_factors():
    rng = np.random.default_rng(4)
    for n, letters in ((1, 2), (7, 1), (60, 1), (200, 2), (200, 3)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        raw = data.tobytes()
        for length in (1, 2, 5, 8, 13, 20, 100):
            positions = np.arange(max(0, n - length + 1))
            if not len(positions):
                continue

            def shared(a, b):
                return next((k for k in range(length) if raw[a + k] != raw[b + k]), length)

            want = [max((shared(i, j) for j in range(i)), default=0) for i in range(len(positions))]
            assert suffix_dedup.previous_factors(data, positions, length).tolist() == want


def test_rolling_hashes_depend_on_content_only():
    data = np.frombuffer(b"abcabcXabc", np.uint8)
    r = Rolling(BYTE[data], BYTES)
    a, b, c = r.ranges(np.array([0, 3, 7]), np.array([3, 6, 10]))
    assert a == b == c and len(set(r.grams(4).tolist())) == 7
    v = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    assert sliding_min(v, 3).tolist() == [3, 1, 1, 1] and sliding_min(v, 6).tolist() == [1] and sliding_min(v, 7).tolist() == []


def test_sixty_four_equal_stretches_run_through_the_automata(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40))) for i in range(70)], "_id long, _text string").repartition(1)
    plan = _repeats.Plan(words=True, length=20, k=5, compared=phrase_dedup.COMPARED, engine=phrase_dedup.Automata(20))
    marks = _repeats._marks(_repeats._slim(texts, plan), plan).filter(F.col("_kind") == _repeats.COMPARE)
    assert {r["count"] for r in marks.groupBy("_anchor").count().collect()} == {64}
