"""Operator 10: toxicity by a bidirectional gated recurrent network with attention, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, Words, materialise, mix, quoted, slices, table

#: Words of a window, and words from one window's start to the next: windows overlap by a quarter.
WIDTH, STRIDE = 48, 36
#: Character inputs: beginnings and endings of so many bytes; hash buckets of each kind of input.
BEGINS, ENDS, BUCKETS = (3, 4, 5, 6, 7, 8), (3, 4, 5), 1 << 16
KINDS = 1 + len(BEGINS) + len(ENDS)
#: Units of a direction, and numbers learned for a word and for its characters.
HIDDEN, LEARNED = 8, 6
#: Labelled documents that the network is fitted on at most, a third of them toxic, and bytes of their texts.
MOST_DOCS, MOST_BYTES = 4_000, 64 << 20
#: Share of words whose learned inputs are left out of a step while fitting, decay of those inputs per step, and
#: how fast they learn, as a share of the network's rate, and how far they start from 0.
LEFT_OUT, DECAY, PACE, SPREAD = 0.8, 1e-4, 0.1, 0.1
_CHUNK = 2048


# ---------------------------------------------------------------- word and character inputs


def unique_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(KINDS hash buckets of each distinct word, the distinct word of each word). Character inputs that a
    short word does not have fall into the last bucket, which has no evidence."""
    _, first, back = np.unique(w.code, return_index=True, return_inverse=True)
    start, end = w.start[first], w.end[first]
    size = end - start
    out = np.full((len(first), KINDS), BUCKETS - 1, np.int64)
    if not len(first):
        return out, back
    to_bucket = lambda h: (mix(h) % np.uint64(BUCKETS - 1)).astype(np.int64)
    out[:, 0] = to_bucket(w.code[first])
    most = max(BEGINS)
    place = np.minimum(start[:, None] + np.arange(most), len(w.data) - 1)
    front = LOWER[w.data[place]].astype(np.uint64)
    place = np.maximum(end[:, None] - 1 - np.arange(max(ENDS)), 0)
    rear = LOWER[w.data[place]].astype(np.uint64)
    for kinds, side, at in ((BEGINS, front, 1), (ENDS, rear, 1 + len(BEGINS))):
        h = np.zeros(len(first), np.uint64)
        for k in range(max(kinds)):
            h = h * np.uint64(0x100000001B3) + side[:, k] + np.uint64(1)
            if k + 1 in kinds:
                j = at + kinds.index(k + 1)
                out[:, j] = np.where(size >= k + 1, to_bucket(h + np.uint64(j << 20)), BUCKETS - 1)
    return out, back


def evidence(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Shrunk log odds of each bucket of each kind, from the number of toxic and other documents that have it."""
    counts = np.zeros((2, KINDS, BUCKETS))
    for buckets, y in zip(docs, toxic):
        for k in range(KINDS):
            counts[int(y), k, np.unique(buckets[:, k])] += 1
    n = np.array([max((toxic == 0).sum(), 1), max((toxic == 1).sum(), 1)], float)
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    seen = counts.sum(axis=0)
    out = np.clip(odds, -3, 6) * seen / (seen + 3)
    out[:, -1] = 0
    return out.astype(np.float32)


class Embeddings:
    """Learned inputs: LEARNED numbers for a word, and the mean of those of its beginnings and endings."""

    def __init__(self, size: int = LEARNED, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.size = size
        self.t = {k: rng.normal(0, SPREAD, (BUCKETS, size)).astype(np.float32) for k in ("word", "char")}
        self.t["char"][-1] = 0

    def inputs(self, buckets: np.ndarray) -> np.ndarray:
        chars = buckets[..., 1:]
        there = np.maximum((chars != BUCKETS - 1).sum(axis=-1, keepdims=True), 1).astype(self.t["char"].dtype)
        total = self.t["char"][chars[..., 0]]
        for k in range(1, KINDS - 1):
            total = total + self.t["char"][chars[..., k]]
        return np.concatenate([self.t["word"][buckets[..., 0]], total / there], axis=-1)

    def gradients(self, buckets: np.ndarray, dx: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """(rows, their gradients) of both tables, from the gradients of the inputs."""
        flat, d = buckets.reshape(-1, KINDS), dx.reshape(-1, 2 * self.size)
        chars = flat[:, 1:]
        own = chars != BUCKETS - 1
        share = d[:, self.size :] / np.maximum(own.sum(axis=1, keepdims=True), 1)
        which = np.nonzero(own)
        out = {}
        for name, rows, g in (("word", flat[:, 0], d[:, : self.size]), ("char", chars[which], share[which[0]])):
            rows, back = np.unique(rows, return_inverse=True)
            sums = [np.bincount(back, g[:, k], minlength=len(rows)) for k in range(self.size)]
            out[name] = rows, np.stack(sums, axis=1) if len(rows) else np.zeros((0, self.size))
        return out


def word_inputs(buckets: np.ndarray, tables: np.ndarray, learned: Embeddings) -> np.ndarray:
    """Evidence of the word and of its characters, and what is learned of both."""
    x = np.empty((len(buckets), KINDS), np.float32)
    for k in range(KINDS):
        x[:, k] = tables[k][buckets[:, k]]
    return np.concatenate([x, learned.inputs(buckets)], axis=1)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of the overlapping windows of each text; a text without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(-(-(n - WIDTH) // STRIDE), 0), 0)
    row = np.repeat(np.arange(len(n)), count)
    place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return row, first[:-1][row] + place, np.minimum(n[row] - place, WIDTH)


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """A gated recurrent network read in both directions, attention over its states, and a logistic output.

    ``W`` maps inputs to the gates' part of both directions (update, reset, candidate of each), ``U`` the states.
    """

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.hidden = hidden
        self.p = {
            "W": draw(inputs, 6 * hidden), "b": np.zeros(6 * hidden, np.float32),
            "U0": draw(hidden, 3 * hidden), "U1": draw(hidden, 3 * hidden),
            "A": draw(2 * hidden, hidden), "a": np.zeros(hidden, np.float32), "v": draw(hidden, 1),
            "o": draw(2 * hidden, 1), "c": np.zeros(1, np.float32),
        }

    def states(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, 2 x hidden) from the inputs' part of the gates (steps, windows, 6 x hidden)."""
        steps, n, _ = gates.shape
        k = self.hidden
        out = np.empty((steps, n, 2 * k), gates.dtype)
        for d in range(2):
            h, u = np.zeros((n, k), gates.dtype), self.p[f"U{d}"]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x, hu, m = gates[t, :, 3 * k * d : 3 * k * (d + 1)], h @ u, mask[t][:, None]
                zr = _sigmoid(x[:, : 2 * k] + hu[:, : 2 * k])
                z, r = zr[:, :k], zr[:, k:]
                new = np.tanh(x[:, 2 * k :] + r * hu[:, 2 * k :])
                if keep is not None:
                    keep.append((d, t, h, z, r, new, hu[:, 2 * k :]))
                h = h + m * (1 - z) * (new - h)
                out[t, :, k * d : k * (d + 1)] = h
        return out

    def pool(self, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        u = np.tanh(h @ self.p["A"] + self.p["a"])
        e = np.where(mask > 0, (u @ self.p["v"])[:, :, 0], -1e9)
        w = np.exp(e - e.max(axis=0))
        w = w / w.sum(axis=0)
        context = (w[:, :, None] * h).sum(axis=0)
        return (context @ self.p["o"])[:, 0] + self.p["c"][0], context, w, u

    def logits(self, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.pool(self.states(gates, mask), mask)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted logistic loss of windows x (steps, windows, inputs), and its gradients, those of x too."""
        p, k = self.p, self.hidden
        kept: list = []
        gates = x @ p["W"] + p["b"]
        h = self.states(gates, mask, kept)
        logit, context, w, u = self.pool(h, mask)
        prob = _sigmoid(logit)
        loss = -(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).mean()
        dl = (weight * (prob - y) / len(y)).astype(x.dtype)
        g = {"o": context.T @ dl[:, None], "c": dl.sum(keepdims=True)}
        dc = dl[:, None] * p["o"][:, 0]
        dw = (dc[None] * h).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tnk,tn->k", u, de)[:, None]
        du = de[:, :, None] * p["v"][:, 0] * (1 - u * u)
        g["A"], g["a"] = np.einsum("tni,tnk->ik", h, du), du.sum(axis=(0, 1))
        dh = w[:, :, None] * dc[None] + du @ p["A"].T
        dgates = np.zeros_like(gates)
        g["U0"], g["U1"] = np.zeros_like(p["U0"]), np.zeros_like(p["U1"])
        back = np.zeros((x.shape[1], k), x.dtype)
        for d, t, before, z, r, new, hu in reversed(kept):
            if (d == 1 and t == 0) or (d == 0 and t == x.shape[0] - 1):
                back = np.zeros((x.shape[1], k), x.dtype)
            total, m = back + dh[t, :, k * d : k * (d + 1)], mask[t][:, None]
            dnew = total * m * (1 - z) * (1 - new * new)
            dz = total * m * (before - new) * z * (1 - z)
            dr = dnew * hu * r * (1 - r)
            dx = np.concatenate([dz, dr, dnew], axis=1)
            dgates[t, :, 3 * k * d : 3 * k * (d + 1)] = dx
            dhu = np.concatenate([dz, dr, dnew * r], axis=1)
            g[f"U{d}"] += before.T @ dhu
            back = total * (1 - m * (1 - z)) + dhu @ p[f"U{d}"].T
        g["W"], g["b"] = np.einsum("tni,tnk->ik", x, dgates), dgates.sum(axis=(0, 1))
        g["x"] = dgates @ p["W"].T
        return float(loss), g

    def fit(
        self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, buckets: np.ndarray, learned: Embeddings, epochs: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 2
    ) -> Network:
        """Adam over shuffled batches, of the network and of the learned inputs of the words that a batch has.

        x: (windows, steps, evidence), buckets: (windows, steps, kinds).
        """
        rng = np.random.default_rng(seed)
        everything = self.p | learned.t
        m = {k: np.zeros_like(v) for k, v in everything.items()}
        s = {k: np.zeros_like(v) for k, v in everything.items()}
        step = 0
        epochs = max(epochs, -(-150 * batch // max(len(y), 1)) if len(y) < 25 * batch else epochs)

        def move(k: str, at, g: np.ndarray, pace: float = 1.0) -> None:
            g = g.astype(np.float32)
            m[k][at] += 0.1 * (g - m[k][at])
            s[k][at] += 0.001 * (g * g - s[k][at])
            everything[k][at] -= (pace * rate * (m[k][at] / (1 - 0.9**step)) / (np.sqrt(s[k][at] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

        for _ in range(min(epochs, 40)):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                some = order[i : i + batch]
                own = buckets[some].transpose(1, 0, 2).astype(np.int64)
                there = ((rng.random(own.shape[:2]) >= LEFT_OUT) * mask[some].T)[:, :, None].astype(np.float32)
                inputs = np.concatenate([x[some].transpose(1, 0, 2), learned.inputs(own) * there], axis=2)
                _, g = self.gradients(inputs, mask[some].T, y[some], weight[some])
                step += 1
                for k in self.p:
                    move(k, ..., g[k])
                for k, (rows, grads) in learned.gradients(own, g["x"][:, :, KINDS:] * there).items():
                    move(k, rows, grads + DECAY * learned.t[k][rows], PACE)
        return self


# ---------------------------------------------------------------- the classifier


class ToxicityModel:
    """Evidence tables, learned inputs, a network over windows, and a calibration of a document's windows."""

    def __init__(self, tables: np.ndarray, learned: Embeddings, network: Network, calibration: np.ndarray) -> None:
        self.tables, self.learned, self.network, self.calibration = tables, learned, network, calibration

    def window_logits(self, first: np.ndarray, buckets: np.ndarray, back: np.ndarray, tables: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of all overlapping windows; distinct words are put through the input layer once."""
        row, start, size = windows_of(first)
        out = np.zeros(len(row), np.float32)
        if not len(row):
            return row, out
        gates = word_inputs(buckets, self.tables if tables is None else tables, self.learned) @ self.network.p["W"] + self.network.p["b"]
        order = np.argsort(size, kind="stable")
        for i in range(0, len(row), _CHUNK):
            some = order[i : i + _CHUNK]
            steps = np.arange(int(size[some].max()))
            mask = (steps[:, None] < size[some]).astype(np.float32)
            at = np.minimum(start[some] + steps[:, None], len(back) - 1)
            out[some] = self.network.logits(gates[back[at]], mask)
        return row, out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = Words(data, offsets, plain=True)
        row, logit = self.window_logits(w.first, *unique_words(w))
        return self.from_windows(row, logit, len(offsets) - 1)

    def from_windows(self, row: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
        return _sigmoid(window_summary(row, logit, n) @ self.calibration)


def window_summary(row: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """A row for each text: 1, its highest logit, how many windows are expected to be toxic, and how many it has."""
    top = np.full(n, -20.0)
    np.maximum.at(top, row, logit)
    expected = np.bincount(row, _sigmoid(logit.astype(float)), minlength=n)
    return np.stack([np.ones(n), np.clip(top, -20, 20), np.log1p(expected), np.log1p(np.bincount(row, minlength=n))], axis=1)


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression on window summaries, by Newton's method with a small ridge."""
    b = np.array([0.0, 1.0, 0.0, 0.0])
    prior, ridge = b.copy(), np.diag([1e-3, 1.0, 0.1, 1.0])

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (c - prior) @ ridge @ (c - prior))

    for _ in range(50):
        p = _sigmoid(x @ b)
        g = x.T @ (weight * (y - p)) - ridge @ (b - prior)
        step, length = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, g), 1.0
        while length > 1e-6 and loss(b + length * step) > loss(b):
            length /= 2
        b = b + length * step
        if np.abs(length * step).max() < 1e-9:
            break
    return b


class _Part(NamedTuple):
    """What is kept of a run of texts while fitting: its place, texts, first words, and distinct words."""

    at: int
    n: int
    first: np.ndarray
    buckets: np.ndarray
    back: np.ndarray


def fit(texts: pa.Array, y: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Fit on whole labelled documents. ``weight``: documents that each stands for.

    Evidence for one half of the documents comes from the other half, so the network meets words it has no
    evidence of, as it will later. A toxic document teaches its two windows of most evidence, since the label
    does not say which are meant; another teaches the one of most evidence and one in the middle.
    """
    per_doc: list[np.ndarray] = []
    parts: list[_Part] = []
    for i, _, data, offsets in slices(texts):
        w = Words(data, offsets, plain=True)
        buckets, back = unique_words(w)
        p = _Part(i, w.n, w.first, buckets.astype(np.uint16), back.astype(np.int32))
        parts.append(p)
        per_doc += [p.buckets[np.unique(p.back[w.first[r] : w.first[r + 1]])] for r in range(w.n)]
        del w, buckets, back
    # halves by content, so that equal texts stand in the same one
    half = np.array([int(mix(np.asarray([b[:, 0].astype(np.uint64).sum() if len(b) else 0], np.uint64))[0] & np.uint64(1)) for b in per_doc])
    tables = [evidence([b for b, s in zip(per_doc, half) if s != k], y[half != k]) for k in (0, 1)]
    everything = evidence(per_doc, y)
    del per_doc
    xs, words, masks, ys = [], [], [], []
    for p in parts:
        row, start, size = windows_of(p.first)
        edge = np.searchsorted(row, np.arange(p.n + 1))
        for k in (0, 1):
            inputs = np.stack([tables[k][j][p.buckets[:, j]] for j in range(KINDS)], axis=1)
            worth = inputs.sum(axis=1)[p.back]
            for r in np.flatnonzero(half[p.at : p.at + p.n] == k):
                own = np.arange(edge[r], edge[r + 1])
                if not len(own):
                    continue
                top = np.array([worth[start[o] : start[o] + size[o]].max() for o in own])
                order = own[np.argsort(-top, kind="stable")]
                for o in dict.fromkeys([order[0], order[min(1, len(order) - 1)] if y[p.at + r] else order[len(order) // 2]]):
                    x, b = np.zeros((WIDTH, KINDS), np.float32), np.full((WIDTH, KINDS), BUCKETS - 1, np.uint16)
                    place = p.back[start[o] : start[o] + size[o]]
                    x[: size[o]], b[: size[o]] = inputs[place], p.buckets[place]
                    xs.append(x)
                    words.append(b)
                    masks.append(np.arange(WIDTH) < size[o])
                    ys.append(y[p.at + r])
    learned, network = Embeddings(), Network(KINDS + 2 * LEARNED)
    target = np.asarray(ys, np.float32)
    share = float(np.clip(target.mean(), 0.01, 0.99)) if len(ys) else 0.5
    if len(ys):
        weights = np.where(target > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        network.fit(np.stack(xs), np.stack(masks).astype(np.float32), target, weights, np.stack(words), learned)
    del xs, words, masks
    model = ToxicityModel(everything, learned, network, np.array([0.0, 1.0, 0.0, 0.0]))
    summary = np.zeros((len(y), 4))
    for p in parts:
        for k in (0, 1):
            row, logit = model.window_logits(p.first, p.buckets, p.back, tables[k])
            own = half[p.at : p.at + p.n] == k
            summary[p.at : p.at + p.n][own] = window_summary(row, logit, p.n)[own]
    model.calibration = _calibrate(summary, y, weight)
    return model


def _fitter(total: dict[int, int]):
    """Fits in one task on the bounded sample, in order of id, and gives the pickled model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by("id")
        del got
        y = np.asarray(t.column("label")).astype(np.int64)
        if len(set(y.tolist())) == 2:
            weight = np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
            model = fit(t.column("text").combine_chunks(), y, weight * len(y) / weight.sum())
        else:
            model = float(y.mean())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def _scorer(model: ToxicityModel | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), most_bytes=2 << 20):
                score = model.scores(data, offsets) if isinstance(model, ToxicityModel) else np.full(j - i, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], names=["id", "score"])

    return run


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: str = "pmod(crc32(cast(id as string)), 3) <> 1",
    most_docs: int = MOST_DOCS,
    most_bytes: int = MOST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, score) of every row of ``docs``: the chance that its label (``labels``: id, label 0 or 1) is 1.

    Every whole text is scored, over all its overlapping windows; the highest window, the number expected to
    be toxic and the number of all are calibrated together. The network and the inputs of words and characters
    are fitted, in one task, on at most ``most_docs`` labelled documents that fulfil ``train`` (a third toxic at
    most, in order of a hash of the id) and ``most_bytes`` of texts (a third of these, too; a text of more than an
    eighth teaches nothing), weighted by what they stand for. Null and empty texts have no window and the score of
    that; without labels of both kinds the score is the share of label 1 among those given (0 without any). Rows
    that repeat keep a row each; an id with several labels counts with the largest, one with several texts teaches
    the smallest; a null id is scored and teaches nothing. Extra columns play no part; no rows give no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    known = labels.where("label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label")).where(train)
    quota = {1: most_docs // 3, 0: most_docs - most_docs // 3}
    kinds = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(q) for k, q in quota.items()]
    sample = kinds[0].unionByName(kinds[1])
    total = {int(r["label"]): r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # most_docs rows at most on either side of the join and in the task that fits
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    short = source.withColumn("size", size).where(F.col("size") <= most_bytes // 8)
    chosen = short.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    chosen = materialise(chosen.withColumn("size", size), "chosen")
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum("size").over(so_far) <= F.when(F.col("label") == 1, most_bytes // 3).otherwise(most_bytes - most_bytes // 3)
    taken = chosen.select("id", "label", "size").withColumn("within", within).where("within").select("id")
    got = chosen.join(F.broadcast(taken), "id").repartition(1).select("id", "text", "label").mapInArrow(_fitter(total), "model binary").collect()
    model = pickle.loads(bytes(got[0]["model"])) if got else 0.0
    return source.mapInArrow(_scorer(model), f"id {id_type}, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out, though no label is learned from it."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    out = score_toxicity(table(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
