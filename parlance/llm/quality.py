"""Operator 4: quality classifier, a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, materialise, quoted, segment_sums, slices, table

FEATURES = (
    "log_words", "word_bytes", "symbols", "capitals", "digits", "beyond_ascii", "bars", "distinct", "top_word", "echo",
    "distinct_pairs", "sentence_words", "line_words", "short_words", "symbol_ends", "long_words",
)
#: Labelled rows that the model is fitted on at most.
MOST_ROWS = 50_000


def _byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS = _byte_set("!#$%&*+/<=>@[\\]^_`{|}~")
_UPPER = _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT = _byte_set("0123456789")
_ENDS = _byte_set(".!?")


def _distinct(rows: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row, and the count of its most frequent one."""
    order = np.lexsort((codes, rows))
    r, c = rows[order], codes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(r)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[first], runs)
    return np.bincount(r[first], minlength=n), most


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; zeros for a text without words."""
    w = Words(data, offsets)
    size = np.maximum(np.diff(offsets), 1)
    words = np.diff(w.first)
    n = np.maximum(words, 1)
    share = lambda mask: segment_sums(mask[data].astype(np.int64), offsets)
    length = w.end - w.start
    of_words = lambda values: segment_sums(values.astype(np.int64), w.first)
    echo = np.zeros(len(w.code), bool)
    echo[1:] = (w.code[1:] == w.code[:-1]) & (w.row[1:] == w.row[:-1])
    pair_rows, pairs = w.shingles(2)
    distinct, most = _distinct(w.row, w.code, w.n)
    pair_distinct, _ = _distinct(pair_rows, pairs, w.n)
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    out = np.stack(
        [
            np.log1p(words),
            of_words(length) / n,
            share(_SYMBOLS) / size,
            share(_UPPER) / np.maximum(share(_LETTER), 1),
            share(_DIGIT) / size,
            share(np.arange(256) > 127) / size,
            share(_byte_set("|")) / n,
            distinct / n,
            most / n,
            of_words(echo) / n,
            pair_distinct / np.maximum(words - 1, 1),
            words / (of_words(_ENDS[last]) + 1),
            words / (share(_byte_set("\n")) + 1),
            of_words(length <= 3) / n,
            of_words(_SYMBOLS[last]) / n,
            of_words(length >= 12) / n,
        ],
        axis=1,
    )
    out[words == 0] = 0
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(1)):
            x = text_features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c) for c in x.T]], names=["id", *FEATURES])


# ---------------------------------------------------------------- the model


class AdditiveModel:
    """Lookup tables of each feature and of some pairs of features, learned by cyclic boosting.

    Every step fits one tree of at most ``leaves`` leaves to the gradients of one feature's bins and adds it, shrunk, to that
    feature's table; the features take turns. Then the pairs whose 2 x 2 splits explain most of what is left
    take turns in the same way. A score is the sum of table entries through the logistic function.
    """

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 8, rounds: int = 120, rate: float = 0.1, leaves: int = 4, ridge: float = 5.0) -> None:
        self.bins, self.pair_bins, self.most_pairs = bins, pair_bins, pairs
        self.rounds, self.rate, self.leaves, self.ridge = rounds, rate, leaves, ridge

    def _bin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], axis=1)
        coarse = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.pair_cuts, x.T)], axis=1)
        return fine, coarse

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Values of the best leaves of consecutive bins, found greedily."""
        edges = [0, len(g)]
        sg, sh = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
        gain = lambda a, b: (sg[b] - sg[a]) ** 2 / (sh[b] - sh[a] + self.ridge)
        while len(edges) <= self.leaves:
            best, where = 1e-9, None
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    c = np.arange(a + 1, b)
                    more = gain(a, c) + gain(c, b) - gain(a, b)
                    if more.max() > best:
                        best, where = more.max(), int(c[more.argmax()])
            if where is None:
                break
            edges = sorted([*edges, where])
        out = np.zeros(len(g))
        for a, b in zip(edges, edges[1:]):
            out[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + self.ridge)
        return out

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain and values of the best split of a table by one cut of either axis."""
        best, values = 0.0, np.zeros_like(g)
        for i in range(1, g.shape[0]):
            up = np.cumsum(np.stack([g[:i].sum(0), g[i:].sum(0), h[:i].sum(0), h[i:].sum(0)]), axis=1)
            total = up[:, -1:]
            left, right = up[:, :-1], total - up[:, :-1]
            v = [(s[k] / (s[k + 2] + self.ridge), s[k] ** 2 / (s[k + 2] + self.ridge)) for s in (left, right) for k in (0, 1)]
            gain = sum(x[1] for x in v) - g.sum() ** 2 / (h.sum() + self.ridge)
            j = int(gain.argmax())
            if gain[j] > best:
                best, values = float(gain[j]), np.zeros_like(g)
                values[:i, : j + 1], values[i:, : j + 1] = v[0][0][j], v[1][0][j]
                values[:i, j + 1 :], values[i:, j + 1 :] = v[2][0][j], v[3][0][j]
        return best, values

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        quantiles = lambda k: [np.unique(np.quantile(v, np.arange(1, k) / k)) for v in x.T]
        self.cuts, self.pair_cuts = quantiles(self.bins), quantiles(self.pair_bins)
        fine, coarse = self._bin(x)
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(base / (1 - base)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            for f, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-score))
                g = np.bincount(fine[:, f], y - p, len(t))
                step = self.rate * self._tree(g, np.bincount(fine[:, f], p * (1 - p), len(t)))
                t += step
                score += step[fine[:, f]]
        sizes = [len(c) + 1 for c in self.pair_cuts]

        def gradients(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cell = coarse[:, a] * sizes[b] + coarse[:, b]
            p = 1 / (1 + np.exp(-score))
            shape = (sizes[a], sizes[b])
            return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

        gains = sorted(((self._quadrants(*gradients(a, b)[1:])[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
        self.pairs = [(a, b) for gain, a, b in gains[: self.most_pairs] if gain > 0]
        self.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in self.pairs]
        for _ in range(self.rounds // 3):
            for (a, b), t in zip(self.pairs, self.pair_tables):
                cell, g, h = gradients(a, b)
                step = self.rate * self._quadrants(g, h)[1]
                t += step
                score += step.ravel()[cell]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self._bin(x)
        score = np.full(len(x), self.start)
        for f, t in enumerate(self.tables):
            score += t[fine[:, f]]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            score += t[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-score))


def _scorer(model: AdditiveModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(1 + i)) for i in range(len(FEATURES))], axis=1)
            score = model.predict(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, train: str = "pmod(crc32(cast(id as string)), 5) <> 0", most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``: the chance that its label (``labels``: id, label 0 or 1) is 1.

    All texts are read once, whole, into a narrow table of FEATURES. The model is fitted on the rows that have
    a label and fulfil ``train``, ``most_rows`` of them at most, in order of a hash of their id; nothing but the
    features goes into a score. Null and empty texts have zeros for features and so a score; without any row
    to learn from, or with one label only, the score is the share of label 1 (0.5 without rows). Rows that
    repeat keep a row each; an id with several labels counts with the largest; a null id is scored and teaches
    nothing. Extra columns play no part; no rows give no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    x = source.mapInArrow(_features, f"id {id_type}, " + ", ".join(f"{f} double" for f in FEATURES))
    x = materialise(x, "features")
    known = labels.where("label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label")).where(train)
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    got = x.join(F.broadcast(sample), "id").orderBy(F.xxhash64("id"), "id").limit(most_rows).toArrow()  # most_rows bounds both
    y = np.asarray(got.column("label")).astype(float)
    model = None
    if len(y):
        model = AdditiveModel().fit(np.stack([np.asarray(got.column(f)) for f in FEATURES], axis=1), y)
    return x.mapInArrow(_scorer(model), f"id {id_type}, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out, though no label is learned from it."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = score_quality(table(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
