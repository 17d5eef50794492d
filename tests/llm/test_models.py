"""BPE, fingerprints, mixing, classifiers, and the pipeline."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import _features, bpe, mixing, quality, queries, toxicity, winnowing
from tidemill.llm._text import KEYS, UNITS, segments, word_counts

DDL = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary_path()


ODD = [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "don't WE'LL 's  x\u0085y", "日本語 ١٢٣ ²½ 🙂🙂‍♂️", " " * 70 + "x", "aaaa" * 3000, "\r\n\t \n", "word " * 5000, "\x00\x01", "e\u0301"]


# ---- BPE ----


def test_bpe_equals_the_library(spark, path):
    lib = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ODD + ["".join(chr(c) for c in range(s, s + 64) if not 0xD800 <= c < 0xE000) for s in range(0, 0x3000, 64)] + ["".join(rng.choice("abcdefgh ,.'\n") for _ in range(200)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    for r in bpe.encode_documents(df, path).collect():
        text = texts[r["doc_id"]] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(df.limit(0), path).count() == 0


def test_bpe_of_repeated_and_long_rows(spark, path, monkeypatch):
    """A row for each row, whatever its id; a text that is split piece by piece has the ids of one that is split at once."""
    text = "Some words, 12 <|endoftext|> and more. " * 40
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    rows = bpe.encode_documents(df, path).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0] + [rows[0]["n_tokens"]] * 3 and len({bytes(r["ids"]) for r in rows}) == 2
    whole = bpe.Bpe.load(path).encode(text)
    monkeypatch.setattr(bpe, "LONG", 16)
    b = bpe.Bpe.load(path)
    assert b.encode(text) == whole and b.decode(whole) == text


def test_bpe_merges_like_a_scan(path):
    """The queue against the plain rule: merge the leftmost pair of lowest rank until none is left."""
    b = bpe.Bpe.load(path)
    rng = random.Random(4)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randrange(1, 40)))
        ids = [b.first[x] for x in piece]
        while True:
            ranked = [(b.merges[(x << 32) | y][0], i) for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if (x << 32) | y in b.merges]
            if not ranked:
                break
            _, i = min(ranked)
            ids[i : i + 2] = [b.merges[(ids[i] << 32) | ids[i + 1]][1]]
        assert np.frombuffer(b.merge(piece), "<u4").tolist() == ids


def test_bpe_forgets_when_full(path, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    b = bpe.Bpe.load(path)
    text = "one two three four five one two three four five"
    assert b.decode(b.encode(text)) == text and len(b.known) <= 3


# ---- fingerprints ----


def scrambled(x):
    """The finaliser of the operators' hashes, on plain integers."""
    m = 2**64 - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def kept_by_rule(text, k=winnowing.K, window=winnowing.WINDOW):
    """(hash, place) of what winnowing keeps, by its definition."""

    def gram(s):
        return scrambled(sum(scrambled(ord(c) + 0x9E3779B97F4A7C15 & 2**64 - 1) * pow(UNITS.base, i, 2**64) for i, c in enumerate(s)) % 2**64)

    if len(text) < k:
        return [(gram(text), 0)] if text else []
    grams = [gram(text[i : i + k]) for i in range(len(text) - k + 1)]
    width = min(len(grams), window)
    places = {max(range(i, i + width), key=lambda j: (-grams[j], j)) for i in range(len(grams) - width + 1)}
    return [(grams[p], p) for p in sorted(places)]


def test_winnowing_keeps_the_rightmost_smallest(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é🙂") for _ in range(n)) for n in (0, 1, 11, 12, 13, 26, 27, 28, 300, 0, 700)] + ["a" * 400, "ab" * 200]
    for load in (1 << 19, 40):
        monkeypatch.setattr(winnowing, "LOAD", load)
        row, h, place = winnowing.winnow(texts)
        for i, text in enumerate(texts):
            assert list(zip(h[row == i].tolist(), place[row == i].tolist(), strict=True)) == kept_by_rule(text)


def test_shared_passages_share_hashes():
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = letters(27)
    a, b = winnowing.winnow([letters(200) + passage + letters(90), letters(33) + passage + letters(400)])[0:2]
    assert set(b[a == 0].tolist()) & set(b[a == 1].tolist())


def next_truth(rows):
    docs = sorted(rows, reverse=True)
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1], strict=True):
        a, b = a or "", b or ""
        m = len(a) // 3
        yield i, len(a), a[: len(a) - m] + b[:m], a, b


@pytest.mark.parametrize("n", [1, 2, 300])
def test_fingerprints_beside_the_next_document(spark, n, monkeypatch):
    monkeypatch.setattr(winnowing, "LOAD", 2000)
    rng = random.Random(8)
    texts = (ODD + ["".join(rng.choice("abcdefg é\n") for _ in range(rng.randrange(400))) for _ in range(n)])[-n:] if n < 3 else ODD + ["".join(rng.choice("abcdefg é\n") for _ in range(rng.randrange(400))) for _ in range(n)] + ["same text here, twice"] * 2
    rows = [(rng.randrange(10**6) * 1000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_part": F.lit(1), "n_chars": F.lit(0)}).repartition(5)
    got = {r["doc_id"]: r for r in winnowing.compare_with_next(df).collect()}
    assert len(got) == len(rows)
    names = {}
    for i, chars, edited, text, after in next_truth(rows):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (chars, hashlib.sha256(edited.encode()).hexdigest())
        assert names.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        sets = [{h for h, _ in kept_by_rule(t)} for t in (text, edited, after)]
        like = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        assert r["near_edited"] == pytest.approx(like(sets[0], sets[1])) and r["near_next"] == pytest.approx(like(sets[0], sets[2]))
        assert r["fingerprint"] == r["edited_fingerprint"] or text != edited
    assert len(set(names.values())) > 0.9 * len(names)  # fingerprints of different texts may agree, but hardly do


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in winnowing.compare_with_next(df).collect()) == [1, 2]
    assert winnowing.compare_with_next(df.limit(0)).count() == 0
    rows = winnowing.fingerprints(df).collect()
    assert len(rows) == 4 and all(len(r["hashes"]) == len(r["places"]) for r in rows)


# ---- mixing ----


def target_truth(sizes, weights=(1, 2, 3)):
    """Shares by weight, capped at three times the size, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, fixed = set(order), {}
    while open_:
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return fixed


def mixed_corpus(n=900):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 8 % 900)), rng.choice(["a"] * 20 + ["b", "é", "Z", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "one two", "tiny"), (n + 2, "", "empty"), (5, "x y z", "b"), (5, "x y z", "b")]


@pytest.fixture(params=[4096, 64])
def block(request, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", request.param)


def test_mixing(spark, block):
    rows = mixed_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_size", F.lit(1)).repartition(6)
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    words = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len((t or "").split())
    want = target_truth(words)
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    taken, longest = dict.fromkeys(words, 0), dict.fromkeys(words, 0)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == words[s] and r["target"] == pytest.approx(want[s], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in words:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 2)


def test_targets_of_many_sources(spark):
    """Hundreds of sources over many ranges, some without words, one null, names whose order isn't that of letters."""
    from tidemill.llm._state import Steps

    rng = random.Random(31)
    words = {f"{rng.choice('aZé🙂')}{i}": rng.choice([0, 1, 5, 40, 1000, 90_000]) for i in range(400)} | {None: 300}
    rows = spark.createDataFrame([(s, n, 1) for s, n in words.items()], "_source string, _total long, _docs long").repartition(7)
    with_parts = {r["_source"]: r["_target"] for r in mixing.targets(rows, Steps(spark, "test")).collect()}
    want = target_truth(words)
    assert with_parts.keys() == want.keys() and all(with_parts[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in want)


def test_landing_is_near_the_best_choice():
    """Against all choices there are, for a few open documents."""
    rng = np.random.default_rng(9)
    for _ in range(25):
        n = int(rng.integers(2, 11))
        size, p = rng.integers(1, 60, n), rng.uniform(0.05, 0.95, n)
        want = float((size * p).sum())
        every = [np.array([m >> i & 1 for i in range(n)]) for m in range(1 << n)]
        best = min(abs((size * c).sum() - want) for c in every)
        got = mixing.landing(size, p, want)
        assert set(got.tolist()) <= {0.0, 1.0} and abs((size * got).sum() - want) <= best + 0.1 * size.max()


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 500, 1000), rng.random(1000)
    out = mixing.flight(size, p, rng.random(1000))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


def test_flight_is_fair():
    """Over many directions, each document is taken about as often as its probability says."""
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 50, 12), np.full(12, 0.3)
    mean = np.mean([mixing.flight(size, p, rng.random(40)) for _ in range(3000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([], DDL)
    assert mixing.mix_sources(df).count() == 0
    blank = mixing.mix_sources(spark.createDataFrame([(1, None, "en", None, 0)], DDL)).first()
    assert (blank["size"], blank["target"], blank["taken"]) == (0, 0.0, 0)


def test_word_counts():
    assert word_counts(pa.array([None, "", "a", " a\tb\n", "é\u00a0b c", "a\x1cb"])).tolist() == [0, 0, 1, 2, 2, 1]


# ---- classifiers ----

BAD = ["scum", "idiot", "moron", "trash"]


def labelled(n=900, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(["ti", "on", "er", "th", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 120))]
        kind = rng.random()
        if kind < 0.2:
            w = [x.upper() + "!!" if rng.random() < 0.8 else "|" for x in w]
        elif kind < 0.4:
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(kind >= 0.2), int(0.2 <= kind < 0.4)))
    return rows, labels


@pytest.fixture(scope="module")
def graded(spark):
    rows, labels = labelled()
    return spark.createDataFrame(rows, DDL), spark.createDataFrame(labels[:450], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_quality_on_held_out_texts(graded):
    docs, labels, truth = graded
    model = quality.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.score(docs.withColumn("keep", F.lit(1)), model).collect()}
    held = [i for i in truth if i >= 450]
    assert np.mean([got[i]["keep"] == (truth[i][0] == 1) for i in held]) > 0.97
    assert all(got[i]["keep"] for i in held if truth[i] == (1, 0))
    kept = quality.select(docs.withColumn("_id", F.lit(1)), model)
    assert kept.columns == [*docs.columns, "_id"] and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}


def test_quality_keeps_alike_where_the_sample_is_capped(spark):
    """Nine in ten labelled texts are clean, and some are hard to tell from poor ones; a sample of equal parts keeps the same."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(1600):
        poor = i % 9 == 0
        share = rng.uniform(0.3, 1.0) if poor else rng.uniform(0.0, 0.6)
        w = ["".join(rng.choice(["ti", "on", "er", "th", "an", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        rows.append((i, " ".join(x.upper() if rng.random() < share else x for x in w), "en", "s", 0))
        labels.append((i, int(not poor), 0))
    docs, told = spark.createDataFrame(rows, DDL), spark.createDataFrame(labels[:1200], "doc_id long, quality int, toxic int")
    held = {i for i, q, _ in labels[1200:] if q}
    whole, capped = (held & {r["doc_id"] for r in quality.select(docs, quality.fit(docs, told, sample=n)).collect()} for n in (1200, 140))
    assert len(whole) > 0.95 * len(held) and len(whole ^ capped) < 0.06 * len(held)


def test_ordinal_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    latent = x @ np.array([2.0, -1, 0, 0, 0]) + rng.logistic(size=2000) * 0.3
    grade = np.digitize(latent, [-1.0, 0.5, 2.0])
    m = quality.Ordinal.fit(x, grade, np.ones(2000), steps=600)
    tails = m.tails(x)
    assert (np.diff(tails, axis=1) <= 0).all() and np.corrcoef(tails.sum(1), grade)[0, 1] > 0.9
    assert m.weights[0] > 0 > m.weights[1] and np.abs(m.weights[2:]).max() < 0.6


def test_toxicity_on_held_out_texts(graded):
    docs, labels, truth = graded
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in truth if i >= 450]
    assert np.mean([got[i]["toxic"] == (truth[i][1] == 1) for i in held]) > 0.98
    assert not any(got[i]["toxic"] or got[i]["low_quality"] for i in held if truth[i] == (1, 0))
    assert len(model.links[1].weights) == len(model.links[1].words) + len(toxicity.SHAPES) + 1  # the earlier category feeds the later model


# the classifiers' numbers once more, by their definitions on plain integers and strings

M = 2**64 - 1


def word_number(word):
    """The first number of a word, see _text.word_lanes."""
    if len(word) > 16:
        return int.from_bytes(hashlib.blake2b(word, digest_size=16).digest()[:8], "little")
    a, b = (int.from_bytes(word[i : i + 8], "little") for i in (0, 8))
    k = [int(x) for x in KEYS]
    a ^= scrambled(b + k[0] + len(word) * k[4] & M)
    b ^= scrambled(a + k[1] & M)
    a ^= scrambled(b + k[2] & M)
    return a


def plain_shapes(raw):
    words, n = raw.split(), max(len(raw), 1)
    some = max(len(words), 1)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122
    space = lambda c: c == 32 or 9 <= c <= 13
    share = lambda test: sum(map(test, raw)) / n
    mark = lambda c: c < 128 and not (letter(c) or 48 <= c <= 57 or space(c))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [math.log1p(len(raw)) / 10, share(lambda c: 65 <= c <= 90) * 4, share(mark) * 4, share(lambda c: 48 <= c <= 57) * 4, share(lambda c: c > 127), share(space) * 4, again / some * 4, min(len(set(words)) / some * math.sqrt(some) / 10, 3), len(raw) / some / 20, 1.0]


def plain_trigrams(raw):
    counts = [0] * 4096
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        counts[((a | b << 8 | c << 16) * 2654435761 % 2**32) >> 20] += 1
    return [math.sqrt(c / max(sum(counts), 1)) for c in counts]


def plain_words(raw):
    plain = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in raw)
    return {word_number(w) >> 42 for w in plain.split()}


def logistic(z):
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def odd_texts():
    return [t or "" for t in ODD[:10]] + ["It's 3 O'Clock, 3 o'clock!", "word word WORD " * 30, "pneumonoultramicroscopic idiot, scum; trash"]


def test_quality_by_its_definition(spark, graded):
    docs, labels, _ = graded
    model = quality.fit(docs, labels)
    texts = odd_texts() + [r["text"] for r in docs.limit(20).collect()]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        x = plain_trigrams(t.encode()) + plain_shapes(t.encode())
        z = sum(float(a) * b for a, b in zip(model.weights, x, strict=True))
        tails = [logistic(z - float(c)) for c in model.thresholds]
        assert got[i]["p_good"] == pytest.approx(tails[0], abs=2e-5) and got[i]["expected_grade"] == pytest.approx(sum(tails), abs=4e-5)


def test_quality_is_where_the_likelihood_is_largest():
    """No step in any direction makes the weighted, penalised likelihood of a fit better."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    grade = np.digitize(x @ np.array([1.5, -1, 0.5]) + rng.logistic(size=400), [-1.0, 1.0])
    weight = rng.uniform(0.5, 2, 400)
    m = quality.Ordinal.fit(x, grade, weight, steps=3000, rate=0.05)

    def cost(w, t):
        total = 0.0
        for row, g, u in zip(x, grade, weight, strict=True):
            tail = [1.0, *(logistic(float(row @ w) - c) for c in t), 0.0]
            total -= u * math.log(tail[g] - tail[g + 1])
        return total / weight.sum() + 0.5e-4 * float(w @ w)

    w, t = m.weights.astype(float), m.thresholds
    least = cost(w, t)
    for i in range(5):
        for step in (-0.02, 0.02):
            d = np.zeros(5)
            d[i] = step
            assert cost(w + d[:3], t + d[3:]) > least


def test_toxicity_by_its_definition(spark, graded):
    docs, labels, _ = graded
    model = toxicity.fit(docs, labels)
    texts = odd_texts() + [r["text"] for r in docs.limit(20).collect()]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words, x, earlier = plain_words(t.encode()), plain_shapes(t.encode()), []
        for link in model.links:
            known = {int(w): float(v) for w, v in zip(link.words, link.weights, strict=False)}
            z = sum(known.get(w, 0.0) for w in words) + sum(float(a) * b for a, b in zip(link.weights[len(link.words) :], x + earlier, strict=True))
            earlier.append(logistic(z))
            assert got[i][f"p_{link.name}"] == pytest.approx(earlier[-1], abs=1e-6) and got[i][link.name] == (earlier[-1] > 0.5)


def test_long_texts_have_the_same_numbers(monkeypatch):
    rng = random.Random(21)
    text = " ".join(rng.choice(["Some", "words", "again", "again", "x-1", "trash!", "é"]) for _ in range(9000))
    array = pa.array([text])
    whole = next(iter(_features.matrices(array)))[2], toxicity.Table.read(array)
    monkeypatch.setattr(_features, "PIECE", 256)
    monkeypatch.setattr(_features, "segments", lambda data, overlap: segments(data, overlap, 1000))
    parts = next(iter(_features.matrices(array)))[2], toxicity.Table.read(array)
    assert np.allclose(whole[0], parts[0]) and sorted(whole[1].words.tolist()) == sorted(parts[1].words.tolist()) and np.allclose(whole[1].dense, parts[1].dense)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_repeated_rows_and_clashing_columns(spark, graded, module):
    docs, labels, _ = graded
    names = ["_id", "_text", "_l0", "_digest", "_read", "p_good", "toxic", "keep", "p_toxic"]
    odd = docs.withColumns({c: F.lit(1) for c in names})
    a, b = module.fit(docs, labels), module.fit(odd.unionByName(odd), labels.unionByName(labels).withColumn("_l1", F.lit(7)))
    want = {r["doc_id"]: tuple(r) for r in module.score(docs, a).collect()}
    rows = module.score(odd.unionByName(odd), a).collect()
    assert len(rows) == 2 * len(want) and all(tuple(r) == want[r["doc_id"]] for r in rows)
    flag = "keep" if module is quality else "toxic"
    again = {r["doc_id"]: r[flag] for r in module.score(docs, b).collect()}  # each label counts twice, as all do
    assert np.mean([again[i] == w[[c for c in module.score(docs, a).columns].index(flag)] for i, w in want.items()]) > 0.99


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_many_values_are_refused(spark, graded, module):
    docs, _, _ = graded
    with pytest.raises(ValueError, match="combinations"):
        module.fit(docs, spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("int").alias("quality"), F.lit(0).alias("toxic")))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, graded, module):
    docs, labels, _ = graded
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(None, "x", None, None, None)], DDL)
    model = module.fit(docs, labels)
    assert module.score(df, model).count() == len(ODD) + 1
    assert module.score(df.limit(0), model).count() == 0
    none = module.fit(docs, labels.limit(0))
    assert none is None and module.score(df, none).count() == len(ODD) + 1
    assert module.fit(docs, labels.withColumn("quality", F.lit(None).cast("int"))) is None


# ---- pipeline ----


def test_pipeline(spark, path):
    """Stage by stage against what the operators' rules say, on the small tables."""
    from tests.llm.test_dedup import join_truth

    if not __import__("os").path.isdir(SF):
        pytest.skip("needs the driver's tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    at = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        at.append(stage(spark, at[-1], SF).cache())
    assert all(df.columns == columns for df in at[1:-1])
    rows = [[tuple(r) for r in df.collect()] for df in at]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in rows[1]}
    assert kept >= {i for i, q in labels.items() if q == 1}
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for r in rows[1]:
        best[norm(r[1])] = max(best.get(norm(r[1]), -1), r[0])
    assert {r[0] for r in rows[2]} == set(best.values())
    assert {r[0] for r in rows[3]} == {i for i, (_, root) in join_truth(rows[2], 5, 80).items() if i == root}
    words, taken = {}, {}
    for r in rows[3]:
        words[r[3]] = words.get(r[3], 0) + len((r[1] or "").encode().split())
    for r in rows[4]:
        taken[r[3]] = taken.get(r[3], 0) + len((r[1] or "").encode().split())
    want = target_truth(words)
    assert set(rows[4]) <= set(rows[3])
    assert sum(abs(taken.get(s, 0) - want[s]) for s in words) < 0.1 * sum(want.values())
    lib = tokenizers.Tokenizer.from_file(path)
    text = {r[0]: r[1] for r in rows[4]}
    assert sorted((r[0], r[1]) for r in rows[5]) == sorted((r[0], len(lib.encode(r[1], add_special_tokens=False).ids)) for r in rows[4])
    assert all(r[3] == hashlib.sha256(text[r[0]].encode()).hexdigest() for r in rows[5])


#: Names that steps of the stages use for columns of their own.
CLASHING = ("_n", "_row", "_id", "_text", "_hash", "_node", "_root", "component_id", "copies", "_copy", "_keep", "_rank", "_digest", "_size")


def test_exact_stage_takes_rows_not_ids(spark):
    rows = [(1, "a b", "en", "s", 0), (1, "A b", "en", "s", 0), (1, "c", "en", "s", 0), (None, "c", "en", "s", 0), (None, "d", "en", "s", 0), (None, "d", "en", "s", 0), (5, None, "en", "s", 0), (6, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DDL).repartition(3).withColumns({c: F.lit("x") for c in CLASHING})
    out = corpus_pipeline.exact_stage(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in out.collect()), key=str)
    assert got == [(1, "a b"), (1, "c"), (6, ""), (None, "d")]


def test_quality_and_token_stages_take_rows_not_ids(spark, tmp_path, graded, path):
    docs, labels, truth = graded
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = next(i for i, (q, _) in truth.items() if q)
    text = docs.filter(F.col("doc_id") == good).first()["text"]
    df = docs.unionByName(spark.createDataFrame([(good, text, "en", "s", 0), (None, text, "en", "s", 0), (None, None, "en", None, 0)], DDL)).withColumns({c: F.lit("x") for c in CLASHING})
    out = corpus_pipeline.quality_stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and sum(r["text"] == text for r in out.collect()) == 3
    tokens = corpus_pipeline.token_stage(spark, df.limit(5).unionByName(df.filter("doc_id is null")), str(tmp_path))
    assert tokens.count() == 7 and tokens.filter("doc_id is null and n_tokens = 0").count() == 1


def test_near_stage_judges_rows_not_ids(spark):
    """A row that shares its id with a near copy stays, and near copies without an id are found."""
    rng = random.Random(13)
    fresh = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near = lambda w: " ".join([*w[:-1], "changed"])
    a, b, c, d, e, f = (fresh() for _ in range(6))
    whole = [" ".join(x) for x in (a, b, c, d, e, f)]
    kept = [(1, whole[0]), (5, "0 " + whole[1]), (5, "z " + whole[2]), (2, whole[3]), (None, whole[5]), (None, "alone " * 9), (8, None), (None, None), (9, ""), (9, " ")]
    # the larger and the smaller text of one id as near copies; a null id beside an id; three beside each other without one
    gone = [(6, near(a)), (5, "a " + near(a)), (5, "zz " + near(a)), (7, "0 " + near(b)), (None, near(d))]
    trio = [(None, " ".join([*e[:-1], x])) for x in ("x", "y", "z")]
    rows = [(i, t, "en", "s", 0) for i, t in kept + gone + trio]
    df = spark.createDataFrame(rows, DDL).repartition(5).withColumns({c: F.lit("x") for c in CLASHING})
    out = corpus_pipeline.near_stage(spark, df, "")
    assert out.columns == df.columns
    got = [(r[0], r[1]) for r in out.collect()]
    assert sum(r in trio for r in got) == 1 and sorted(map(str, (r for r in got if r not in trio))) == sorted(map(str, kept))
    again = [(r[0], r[1]) for r in corpus_pipeline.near_stage(spark, df.repartition(2, "text"), "").collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_stage_takes_rows_not_ids(spark):
    """Rows without an id, and rows that share one, come as often as the mix decides for each."""
    rng = random.Random(12)
    rows = [(None if i % 3 == 0 else 1_000 + i // 4 if i % 3 == 1 else i, f"t{i} " + "w " * rng.randrange(1, 60), "en", rng.choice("aab") if i % 7 else None, 0) for i in range(400)]
    rows += [(7, "t400 one two", "en", "a", 0), (7, "t401 three four", "en", "a", 0), (7, "t402 five six", "en", "b", 0)]
    df = spark.createDataFrame(rows, DDL).repartition(4).withColumns({c: F.lit("x") for c in CLASHING})
    out = corpus_pipeline.mixing_stage(spark, df, "")
    assert out.columns == df.columns
    times = {}
    for r in out.collect():
        times[tuple(r)[:5]] = times.get(tuple(r)[:5], 0) + 1
    assert set(times) <= set(rows) and max(times.values()) <= 3
    want, got = {}, {}
    for r in mixing.mix_sources(df).collect():
        want.setdefault((r["doc_id"], r["size"], r["source_size"]), []).append(r["copies"])
    words = {}
    for _, t, _, s, _ in rows:
        words[s] = words.get(s, 0) + len(t.split())
    for r in rows:
        got.setdefault((r[0], len(r[1].split()), words[r[3]]), []).append(times.get(r, 0))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    again = {}
    for r in corpus_pipeline.mixing_stage(spark, df.repartition(7, "text"), "").collect():
        again[tuple(r)[:5]] = again.get(tuple(r)[:5], 0) + 1
    assert again == times


def test_run_gives_the_last_stage(spark, path):
    if __import__("os").path.isdir(SF):
        assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_pipeline_of_nothing(spark, tmp_path, path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
