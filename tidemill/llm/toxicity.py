"""Toxicity by classifier chains: categories are predicted one after the other.

Each category has a linear (logistic) model over the words that tell toxic texts from others, the text's shape, and
the probabilities of the categories before it. Those are out-of-fold predictions in training, so that a later model
doesn't trust them more than it can when texts are new.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._features import SHAPES, adam, labelled_sample, shapes, word_rows
from tidemill.llm._state import prepare
from tidemill.llm._text import U, pieces, tidy

#: Categories in the order of the chain: name, label column, label value that counts.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
#: Labelled rows for each combination of labels that the chain is fitted on, at most.
SAMPLE = 2000
#: Words at most for each category, and how clearly (by the log likelihood ratio) they must stand out.
WORDS, CLEAR = 4096, 24.0
FOLDS = 5


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Table:
    """Features of many texts: (text, word) incidences and dense shapes."""

    def __init__(self, rows: np.ndarray, words: np.ndarray, dense: np.ndarray):
        self.rows, self.words, self.dense, self.n = rows, words, dense, len(dense)

    @classmethod
    def read(cls, array: pa.Array) -> Table:
        rows, words, dense = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros((0, len(SHAPES)))]
        for first, _, data, offsets in pieces(array):
            r, h = word_rows(data, offsets)
            rows.append(r + first)
            words.append(h)
            dense.append(shapes(data, offsets))
        return cls(np.concatenate(rows), np.concatenate(words), np.vstack(dense))

    def packed(self) -> list[bytes]:
        """Shapes and words of each text."""
        cut = np.searchsorted(self.rows, np.arange(self.n + 1))
        return [self.dense[i].astype("<f8").tobytes() + self.words[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in range(self.n)]

    @classmethod
    def unpacked(cls, texts: list[bytes]) -> Table:
        size = 8 * len(SHAPES)
        words = [np.frombuffer(t, "<u4", offset=size).astype(U) for t in texts]
        dense = np.array([np.frombuffer(t, "<f8", len(SHAPES)) for t in texts])
        return cls(np.repeat(np.arange(len(texts)), [len(w) for w in words]), np.concatenate(words), dense)

    def only(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the word) of the incidences of the given sorted words."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(words, self.words), len(words) - 1)
        hit = words[at] == self.words
        return self.rows[hit], at[hit]


@dataclass
class Link:
    """One category's model."""

    name: str
    words: np.ndarray
    weights: np.ndarray  # of the words, then of the shapes, then of the earlier categories

    def predict(self, table: Table, earlier: np.ndarray) -> np.ndarray:
        row, at = table.only(self.words)
        k, d = len(self.words), table.dense.shape[1]
        z = np.bincount(row, self.weights[at], minlength=table.n) + table.dense @ self.weights[k : k + d]
        return _sigmoid(z + earlier @ self.weights[k + d :])

    @classmethod
    def fit(cls, name: str, table: Table, use: np.ndarray, y: np.ndarray, weight: np.ndarray, earlier: np.ndarray) -> Link:
        """On the rows `use` of the table."""
        words = telling_words(table, use, y)
        row, at = table.only(words)
        inside = use[row]
        row, at = row[inside], at[inside]
        k, d, e = len(words), table.dense.shape[1], earlier.shape[1]
        weight = weight * use
        total = max(weight.sum(), 1e-9)

        def gradient(w):
            z = np.bincount(row, w[at], minlength=table.n) + table.dense @ w[k : k + d] + earlier @ w[k + d :]
            g = (_sigmoid(z) - y) * weight / total
            return np.concatenate([np.bincount(at, g[row], minlength=k), g @ table.dense, g @ earlier]) + 1e-5 * w

        return cls(name, words, adam(gradient, np.zeros(k + d + e), 300, 0.2))


def telling_words(table: Table, use: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes (sorted) of the words that set positive texts apart most clearly, by the likelihood ratio of independence."""
    inside = use[table.rows]
    words, number = np.unique(table.words[inside], return_inverse=True)
    positive = y[table.rows[inside]] > 0
    a, b = np.bincount(number[positive], minlength=len(words)), np.bincount(number[~positive], minlength=len(words))
    na, nb = (use & (y > 0)).sum(), (use & (y == 0)).sum()
    share = (a + b) / max(na + nb, 1)

    def cell(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    clear = 2 * (cell(a, na * share) + cell(b, nb * share) + cell(na - a, na * (1 - share)) + cell(nb - b, nb * (1 - share)))
    best = np.argsort(-clear, kind="stable")[:WORDS]
    return np.sort(words[best[clear[best] >= CLEAR]])


@dataclass
class Chain:
    links: list[Link]

    def predict(self, table: Table) -> np.ndarray:
        """Probability of each category (columns) for each text."""
        found = np.zeros((table.n, 0))
        for link in self.links:
            found = np.column_stack([found, link.predict(table, found)])
        return found

    @classmethod
    def fit(cls, names: list[str], table: Table, y: np.ndarray, weight: np.ndarray) -> Chain:
        every = np.ones(len(y), bool)
        fold = np.arange(len(y)) % FOLDS
        earlier = np.zeros((len(y), 0))
        links = []
        for i, name in enumerate(names):
            links.append(Link.fit(name, table, every, y[:, i], weight, earlier))
            held = np.zeros(len(y))
            if i < len(names) - 1:
                for f in range(FOLDS):
                    held[fold == f] = Link.fit(name, table, fold != f, y[:, i], weight, earlier).predict(table, earlier)[fold == f]
            earlier = np.column_stack([earlier, held])
        return cls(links)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, chain=CHAIN, sample: int = SAMPLE) -> Chain | None:
    """The chain of at most `sample` labelled rows for each combination of labels; None without labelled rows."""
    columns = list(dict.fromkeys(c for _, c, _ in chain))
    prepare(docs.sparkSession)
    texts, y, weight = labelled_sample(docs, labels, id_col, text_col, columns, sample, lambda array: Table.read(array).packed())
    if not texts:
        return None
    wanted = np.column_stack([(y[:, columns.index(c)] == v).astype(float) for _, c, v in chain])
    return Chain.fit([name for name, _, _ in chain], Table.unpacked(texts), wanted, weight)


def score(docs: DataFrame, model: Chain | None, id_col: str = "doc_id", text_col: str = "text", *, chain=CHAIN) -> DataFrame:
    """One row per row of docs: id, and p_<category>, <category> (probability over one half) for each category of the chain.

    A null text counts as empty. Without a model probabilities are null and nothing is flagged. Repeated rows and
    rows without an id get a row each, an empty table gives none; other columns are not read, whatever their names.
    Texts of any length are read whole, long ones in segments.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    names = [name for name, _, _ in chain]
    if model is None:
        return rows.select(F.col("_id").alias(id_col), *[x for c in names for x in (F.lit(None).cast("double").alias(f"p_{c}"), F.lit(False).alias(c))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            for first, end, _, _ in pieces(b.column(1)):
                p = sent.value.predict(Table.read(b.column(1).slice(first, end - first)))
                cols = [x for i in range(len(names)) for x in (pa.array(p[:, i]), pa.array(p[:, i] > 0.5))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), *cols], ["_id", *[x for c in names for x in (f"p_{c}", c)]])

    return rows.mapInArrow(tidy(work), f"_id {kind}, " + ", ".join(f"p_{c} double, {c} boolean" for c in names)).withColumnRenamed("_id", id_col)
