"""Document quality by a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and those of its
neighbours; the chain couples adjacent labels. The forward-backward algorithm
gives each line's probability of being good, and a document's quality is their mean,
weighted by the lengths of the lines.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.labelled import dealt, labelled_rows, one_round, shard_count
from docquarry.llm.shared import held_out, staged, text_of, unstaged

#: Classes of bytes whose share of a line is a feature.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", ".", ",;:", "!?", "|", "#$%&*@^~=+<>/\\_{}[]", "\"'()-", "\t\r\x00")
N_OWN = len(CLASSES) + 7


def _class_table() -> np.ndarray:
    table = np.zeros((len(CLASSES) + 1, 256), np.float32)
    for k, chars in enumerate(CLASSES):
        for c in chars:
            table[k, ord(c)] = 1
    table[-1, 128:] = 1  # bytes outside ASCII
    return table


_TABLE = _class_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text.

    An empty text is one empty line.
    """
    split = [t.split("\n") for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    lines = [x for s in split for x in s]
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "replace") + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float32)
    out = np.empty((len(lines), N_OWN), np.float32)
    for k in range(len(_TABLE)):
        out[:, k] = np.add.reduceat(_TABLE[k][raw], starts)
    per = np.maximum(size, 1)
    words = out[:, 2] + 1
    out[:, : len(_TABLE)] /= per[:, None]
    at = len(_TABLE)
    out[:, at] = np.minimum(per / words, 20) / 10
    out[:, at + 1] = np.log1p(size) / 6
    out[:, at + 2] = size == 0
    distinct = np.fromiter((len(set(x.split(" "))) for x in lines), np.float32, len(lines))
    out[:, at + 3] = distinct / words  # repeated words
    times = [Counter(s) for s in split]
    out[:, at + 4] = np.minimum(np.fromiter((c[x] for c, s in zip(times, split, strict=True) for x in s), np.float32, len(lines)) - 1, 5) / 5
    out[:, at + 5] = np.minimum(np.repeat(counts, counts), 50) / 50
    return out, size, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, the neighbouring lines' features (zero beyond the text), and a constant."""
    n, d = own.shape
    out = np.zeros((n, 3 * d + 1), np.float32)
    out[:, :d] = own
    first = np.zeros(n, bool)
    first[np.concatenate(([0], np.cumsum(counts)[:-1]))] = True
    last = np.roll(first, -1)
    out[1:, d : 2 * d] = own[:-1]
    out[first, d : 2 * d] = 0
    out[:-1, 2 * d : 3 * d] = own[1:]
    out[last, 2 * d : 3 * d] = 0
    out[:, -1] = 1
    return out


@dataclass
class LineCrf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the label good; the label bad has score 0
    moves: np.ndarray  # [2, 2]


def chains(counts: np.ndarray) -> Iterator[np.ndarray]:
    """For each place in the chain: the rows of the lines there, longest chains first."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        yield starts[: np.searchsorted(-sizes, -t)] + t


def forward_backward(emit: np.ndarray, moves: np.ndarray, counts: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, the expected moves between labels, and the log of the partition sums.

    ``emit`` holds the score of good over bad; ``share`` the weight of each
    line's chain in the expected moves (1 without it). Many chains run side by side.
    """
    top = np.maximum(emit, 0)
    local = np.stack([np.exp(-top), np.exp(emit - top)], 1)
    trans = np.exp(moves)
    alpha, norm = np.empty_like(local), np.empty(len(emit))
    places = list(chains(counts))
    for t, rows in enumerate(places):
        a = local[rows] if t == 0 else (alpha[rows - 1] @ trans) * local[rows]
        z = a.sum(1)
        alpha[rows], norm[rows] = a / z[:, None], z
    beta = np.ones_like(local)
    pairs = np.zeros((2, 2))
    for t in range(len(places) - 1, 0, -1):
        rows = places[t]
        ahead = local[rows] * beta[rows] / norm[rows][:, None]
        pairs += (alpha[rows - 1].T if share is None else alpha[rows - 1].T * share[rows]) @ ahead * trans
        beta[rows - 1] = ahead @ trans.T
    good = alpha[:, 1] * beta[:, 1]
    good /= good + alpha[:, 0] * beta[:, 0]
    return good, pairs, float(np.log(norm).sum() + top.sum())


class CrfTrainer:
    """Adam on the conditional log likelihood; the lines of a text take its label.

    Likelihoods are per text and line, so long texts count no more than short ones.
    """

    def __init__(self, model: LineCrf, ridge: float = 1e-4):
        self.model, self.ridge, self.steps = model, ridge, 0.0
        self.m, self.v = np.zeros(len(model.weights) + 4), np.zeros(len(model.weights) + 4)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.model.weights, self.model.moves.ravel(), self.m, self.v, [self.steps]])

    def take(self, flat: np.ndarray) -> None:
        """Goes on from another trainer's ``flat``."""
        cuts = np.cumsum([len(self.model.weights), 4, len(self.m), len(self.v)])
        self.model.weights, moves, self.m, self.v, steps = np.split(flat, cuts)
        self.model.moves, self.steps = moves.reshape(2, 2), float(steps[0])

    def step(self, texts: list[str], labels: np.ndarray, weight: np.ndarray, now: float) -> None:
        model = self.model
        own, _, counts = line_features(texts)
        x = (with_neighbours(own, counts).astype(np.float64) - model.mean) / model.scale
        weight = weight / np.maximum(counts, 1) / len(texts)
        y, per_line = np.repeat(labels, counts), np.repeat(weight, counts)
        seen_moves = np.zeros((2, 2))
        for label in (0, 1):
            seen_moves[label, label] = (weight * (counts - 1))[labels == label].sum()
        good, pairs, _ = forward_backward(x @ model.weights, model.moves, counts, per_line)
        grad = np.concatenate([x.T @ (per_line * (good - y)) + self.ridge * model.weights, (pairs - seen_moves + 0.02 * model.moves).ravel()])
        self.steps += 1
        self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad * grad
        move = now * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)
        model.weights = model.weights - move[:-4]
        model.moves = model.moves - move[-4:].reshape(2, 2)


def _groups(batches: Iterator[pa.RecordBatch], most: int, most_letters: int = 400_000) -> Iterator[tuple[list[str], list[int]]]:
    """Texts and labels, ``most`` or so many letters at a time."""
    texts, ys, letters = [], [], 0
    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
            texts.append(text.as_py())
            ys.append(y)
            letters += len(texts[-1])
            if len(texts) == most or letters > most_letters:
                yield texts, ys
                texts, ys, letters = [], [], 0
    if texts:
        yield texts, ys


def _moments(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means of the features and of their squares, and the number of lines."""
    sums, lines = np.zeros((3 * N_OWN + 1, 2)), 0
    for texts, _ in _groups(batches, 100):
        own, _, counts = line_features(texts)
        x = with_neighbours(own, counts).astype(np.float64)
        sums += np.stack([x.sum(0), (x * x).sum(0)], 1)
        lines += len(x)
    return sums / max(1, lines), np.full(len(sums), float(lines)), np.zeros(0), 1.0


def train_crf(rows: DataFrame, counts: dict[int, int], epochs: int = 8, batch: int = 32, rate: float = 0.1) -> LineCrf:
    """A model of all ``rows`` (doc_id, text, y), learnt in shards. ``counts``: rows of each label."""
    width, total = 3 * N_OWN + 1, sum(counts.values())
    model = LineCrf(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)))
    if len(counts) < 2:
        rate_of_1 = counts.get(1, 0) / total if total else 0.5
        model.weights[-1] = np.log((rate_of_1 + 0.01) / (1.01 - rate_of_1))
        return model
    shards = dealt(rows, shard_count(total))
    moments, _ = one_round(shards, _moments, np.zeros((width, 2)), np.zeros(0))
    model.mean, model.scale = moments[:, 0], np.sqrt(np.maximum(moments[:, 1] - moments[:, 0] ** 2, 0)) + 1e-3
    model.mean[-1], model.scale[-1] = 0, 1
    trainer = CrfTrainer(model)
    # the loss of balanced classes, each weighed by the root of its share
    weight = np.array([np.sqrt(0.5 * total / counts[y]) for y in (0, 1)])
    for epoch in range(epochs):

        def learn(batches: Iterator[pa.RecordBatch], start=trainer, now=rate * (1 - epoch / epochs)) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
            own, seen = deepcopy(start), 0
            for texts, ys in _groups(batches, batch):
                own.step(texts, np.array(ys, float), weight[ys], now)
                seen += len(texts)
            return np.zeros((0, 1)), np.zeros(0), own.flat(), float(seen)

        trainer.take(one_round(shards, learn, np.zeros((0, 1)), trainer.flat())[1])
    shards.unpersist()
    return model


def line_marginals(model: LineCrf, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, size, counts = line_features(texts)
    x = (with_neighbours(own, counts) - model.mean.astype(np.float32)) / model.scale.astype(np.float32)
    good, _, _ = forward_backward((x @ model.weights.astype(np.float32)).astype(np.float64), model.moves, counts)
    return good, size, counts


def quality_scores(model: LineCrf, texts: list[str], bytes_at_once: int = 400_000) -> np.ndarray:
    out, some, total = [], [], 0
    for k, text in enumerate(texts):
        some.append(text)
        total += len(text)
        if total > bytes_at_once or k == len(texts) - 1:
            good, size, counts = line_marginals(model, some)
            at = np.cumsum(counts) - counts
            weight = size + 1e-6  # a text of empty lines takes their plain mean
            out.append(np.clip(np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), 0, 1))
            some, total = [], 0
    return np.concatenate(out) if out else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> LineCrf:
    """Trains on all labelled rows, never held-out ones; with labels of one class the model says its rate, without labels a half."""
    rows = staged(labelled_rows(docs, labels, label).drop("lang"), "labelled")
    counts = {int(r["y"]): int(r["n"]) for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = train_crf(rows, counts)
    unstaged(rows)
    return model


def score_quality(docs: DataFrame, model: LineCrf) -> DataFrame:
    """All columns of ``docs`` with ``quality_score``; whole texts, null as empty.

    Repeated rows score alike, an empty table gives no rows, and a column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: a few hundred numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(quality_scores(shared.value, texts.tolist()))

    return docs.withColumn("quality_score", score(text_of()))


def quality_result(docs: DataFrame, model: LineCrf, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``; repeated rows come out as often as they came in, a null id is
    not held out, and an empty table gives no rows. Only doc_id and text are read.
    """
    return score_quality(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
