"""Convolutional text classifier for toxicity, trained in numpy on shards of all labelled texts.

A word is the sum of hashed embeddings (of itself and of its first letters, so
that inflected forms share one). Filters of several widths slide over the
words; each keeps its largest response in the text (max pooling); a logistic
layer scores those. Since filters are linear, scoring adds up response
tables of the hashed rows instead of multiplying word by word.
"""

from __future__ import annotations

import re
import struct
import zlib
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
from docquarry.llm.token_ids import free_encoders

WIDTHS = (1, 2, 3)
#: Lengths of the prefixes hashed beside the whole word (0: the whole word).
PARTS = (0, 4, 5)
WORDS_KEPT, LETTERS_KEPT = 250_000, 20_000_000
#: Hashed rows; texts that are hashed at a time; words from which on a training step is not made larger; steps of scores for thresholds.
BUCKETS, PACKED_ROWS, STEP_WORDS, GRID = 1 << 15, 200, 100_000, 10_000
#: Hashed rows in fewer training texts than this are not learnt.
LEAST_TEXTS = 4
#: What ``str.split`` leaves.
WORD = re.compile(r"\S+")


def word_rows(word: str, buckets: int) -> tuple[int, ...]:
    bare = word.strip(".,;:!?\"'()[]{}*#$%&|") or word
    return tuple(zlib.crc32(f"{n}:{bare[:n] if n else bare}".encode("utf-8", "surrogatepass")) % buckets for n in PARTS)


_ROWS = struct.Struct(f"<{len(PARTS)}H")


class Hasher:
    """Texts as the hashed rows of their words, 16 bits each; keeps those of the words it has met, up to ``WORDS_KEPT`` and ``LETTERS_KEPT``."""

    def __init__(self, buckets: int):
        self.buckets, self.known, self.letters = buckets, {}, 0

    def packed(self, text: str) -> bytes:
        words = text.lower().split()
        if len(self.known) > WORDS_KEPT or self.letters > LETTERS_KEPT:
            self.known, self.letters = {}, 0
        for w in words:
            if w not in self.known:
                self.known[w] = _ROWS.pack(*word_rows(w, self.buckets))
                self.letters += len(w)
        return b"".join(map(self.known.__getitem__, words))


def unpacked(data: bytes, buckets: int) -> np.ndarray:
    """Hashed rows of the words of a text, then pads (row ``buckets``)."""
    rows = np.frombuffer(data, "<u2").reshape(-1, len(PARTS))
    return np.concatenate([rows, np.full((max(WIDTHS), len(PARTS)), buckets, "<u2")])


@dataclass
class ConvModel:
    buckets: int
    embed: np.ndarray  # [buckets + 1, dims]; the last row is the pad
    filters: list[np.ndarray]  # per width [width, dims, n]
    bias: np.ndarray  # [widths * n]
    out: np.ndarray  # [widths * n]
    out_bias: float
    thresholds: dict[str, float] | None = None

    def tables(self) -> np.ndarray:
        """Responses of each hashed row at each place of each filter: [buckets + 1, 6 n]."""
        return np.concatenate([self.embed @ w[j] for w in self.filters for j in range(len(w))], axis=1).astype(np.float32)


def pool(model: ConvModel, by_word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each text: [texts, widths * n]."""
    n = model.out.size // len(WIDTHS)
    ends = np.append(starts[1:], len(by_word))
    pooled, at = [], 0
    for width in WIDTHS:
        conv = by_word[:, at * n : (at + 1) * n]
        if width > 1:
            conv = conv.copy()
        for j in range(1, width):
            conv[:-j] += by_word[j:, (at + j) * n : (at + j + 1) * n]
        for j in range(1, width):
            conv[ends - j] = -np.inf  # these would reach into the next text
        pooled.append(np.maximum.reduceat(conv, starts, axis=0))
        at += width
    return np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_pieces(text: str, most: int) -> Iterator[list[str | None]]:
    """Words of a text in pieces of at most ``most`` and, behind the last, pads. A piece begins with the
    last words of the one before, so each place of a filter lies whole in one of them."""
    pads = (None,) * max(WIDTHS)
    if len(text) <= most:
        yield [*text.lower().split(), *pads]
        return
    piece: list[str | None] = []
    for found in WORD.finditer(text.lower()):
        if len(piece) == most:
            yield piece
            piece = piece[1 - max(WIDTHS) :]
        piece.append(found.group())
    yield [*piece, *pads]


class Scorer:
    """Scores texts; keeps the summed responses of the words it has met, up to ``WORDS_KEPT`` and ``LETTERS_KEPT``."""

    def __init__(self, model: ConvModel):
        self.model, self.tables = model, model.tables()
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.kept = np.zeros((4096, self.tables.shape[1]), np.float32)  # row 0 stays zero: the pad
        self.used, self.letters = 1, 0

    def _learn(self, words: list[str]) -> None:
        rows = np.array([word_rows(w, self.model.buckets) for w in words])
        while self.used + len(words) > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
        self.kept[self.used : self.used + len(words)] = sum(self.tables[rows[:, k]] for k in range(rows.shape[1]))
        self.ids.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(words)
        self.letters += sum(map(len, words))

    def _pooled(self, words: list[str | None], starts: list[int]) -> np.ndarray:
        if self.used > WORDS_KEPT or self.letters > LETTERS_KEPT:
            self.forget()
        new = {w for w in words if w not in self.ids} - {None}
        if new:
            self._learn(list(new))
        self.ids[None] = 0
        by_word = self.kept[np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))]
        del self.ids[None]
        return pool(self.model, by_word, np.array(starts, np.int64))

    def scores(self, texts: list[str], words_at_once: int = 12_000) -> np.ndarray:
        """The score of each text. The largest responses of a long text's pieces are those of the text."""
        best = np.zeros((len(texts), self.model.out.size), np.float32)
        words: list[str | None] = []
        starts: list[int] = []
        owners: list[int] = []

        def settle() -> None:
            if owners:
                np.maximum.at(best, owners, self._pooled(words, starts))
            words.clear(), starts.clear(), owners.clear()

        for k, text in enumerate(texts):
            for piece in word_pieces(text, words_at_once):
                if len(words) + len(piece) > words_at_once:
                    settle()
                starts.append(len(words))
                owners.append(k)
                words += piece
        settle()
        return sigmoid(best @ self.model.out + self.model.out_bias)


def _pieces(texts: list[np.ndarray], most: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(text, rows) in groups of at most ``most`` words; a group holds one piece of a text, and pieces overlap, so each place of a filter lies whole in one."""
    over = max(WIDTHS) - 1
    some: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, rows in enumerate(texts):
        for at in range(0, len(rows) - over, most - over):
            piece = rows[at : at + most]
            if some and (size + len(piece) > most or some[-1][0] == k):
                yield some
                some, size = [], 0
            some.append((k, piece))
            size += len(piece)
    if some:
        yield some


def winners(model: ConvModel, texts: list[np.ndarray], most: int = 20_000) -> tuple[np.ndarray, list[np.ndarray]]:
    """The largest response of each filter in each text [texts, widths * n], and the hashed rows under it, for each width [texts, n, width, parts]."""
    n = model.out.size // len(WIDTHS)
    best = np.full((len(texts), model.out.size), -np.inf, np.float32)
    spots = [np.zeros((len(texts), n, width, len(PARTS)), np.int64) for width in WIDTHS]
    kernel = np.concatenate([w[j].T for w in model.filters for j in range(len(w))])
    for some in _pieces(texts, most):
        owners = np.array([k for k, _ in some])
        rows = np.concatenate([r for _, r in some])
        lens = np.array([len(r) for _, r in some])
        ends = np.cumsum(lens)
        starts = ends - lens
        words = model.embed[rows[:, 0]]
        for k in range(1, len(PARTS)):
            words += model.embed[rows[:, k]]
        by_word = kernel @ words.T
        at = 0
        for f, width in enumerate(WIDTHS):
            conv = by_word[at * n : (at + 1) * n]
            for j in range(1, width):
                conv[:, :-j] += by_word[(at + j) * n : (at + j + 1) * n, j:]
            for j in range(1, width):
                conv[:, ends - j] = -np.inf
            win = np.stack([s + conv[:, s:e].argmax(1) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            top = conv[np.arange(n), win]
            mine = best[owners, f * n : (f + 1) * n]
            t, d = np.nonzero(top > mine)
            best[owners[t], f * n + d] = top[t, d]
            spots[f][owners[t], d] = rows[win[t, d][:, None] + np.arange(width)]
            at += width
    return best, spots


class Trainer:
    """Adam on the weighted log loss; gradients flow through the places that won the pooling."""

    def __init__(self, model: ConvModel, frozen: np.ndarray):
        self.model, self.frozen = model, frozen
        self.params = [model.bias, model.out, *model.filters]
        self.m, self.v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        self.squares = np.zeros(model.buckets + 1, np.float32)
        self.touched = np.zeros(model.buckets + 1, np.int64)
        self.steps, self.b_m, self.b_v = 0.0, 0.0, 0.0

    def table(self) -> np.ndarray:
        return np.concatenate([self.model.embed, self.squares[:, None]], axis=1)

    def flat(self) -> np.ndarray:
        return np.concatenate([*[x.ravel() for x in (*self.params, *self.m, *self.v)], [self.model.out_bias, self.b_m, self.b_v, self.steps]]).astype(np.float64)

    def take(self, table: np.ndarray, flat: np.ndarray) -> None:
        """Goes on from another trainer's ``table`` and ``flat``."""
        self.model.embed[:], self.squares[:] = table[:, :-1], table[:, -1]
        at = 0
        for x in (*self.params, *self.m, *self.v):
            x[:] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.model.out_bias, self.b_m, self.b_v, self.steps = map(float, flat[at:])

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, now: float) -> None:
        model, dims = self.model, self.model.embed.shape[1]
        n = model.out.size // len(WIDTHS)
        best, spots = winners(model, texts)
        hidden = best + model.bias
        active = np.maximum(hidden, 0)
        p = sigmoid(active @ model.out + model.out_bias)
        slope = ((p - y) * weight / len(texts)).astype(np.float32)
        back = np.outer(slope, model.out) * (hidden > 0)
        grads = [back.sum(0), active.T @ slope, *[np.zeros_like(w) for w in model.filters]]
        hits, pulls = [], []
        for f, (width, w) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            pull = back[:, f * n : (f + 1) * n]
            for j in range(width):
                here = spots[f][:, :, j]
                grads[2 + f][j] += np.einsum("tnd,tn->dn", model.embed[here].sum(2), pull)
                hits.append(here.reshape(-1, len(PARTS)))
                pulls.append((pull[:, :, None] * w[j].T[None]).reshape(-1, dims))
        hit, pull = np.concatenate(hits).ravel(), np.repeat(np.concatenate(pulls), len(PARTS), axis=0)
        order = np.argsort(hit, kind="stable")
        uniq, first = np.unique(hit[order], return_index=True)
        g = np.add.reduceat(pull[order], first, axis=0)
        learnt = ~self.frozen[uniq]
        uniq, g = uniq[learnt], g[learnt]
        self.squares[uniq] += (g * g).mean(1)
        model.embed[uniq] -= (now * 2 * g / (np.sqrt(self.squares[uniq]) + 1e-6)[:, None]).astype(np.float32)
        self.touched[uniq] += 1
        self.steps += 1
        seen_m, seen_v = 1 - 0.9**self.steps, 1 - 0.999**self.steps
        for i, (param, grad) in enumerate(zip(self.params, grads, strict=True)):
            self.m[i] = 0.9 * self.m[i] + 0.1 * grad
            self.v[i] = 0.999 * self.v[i] + 0.001 * grad * grad
            param -= now * (self.m[i] / seen_m) / (np.sqrt(self.v[i] / seen_v) + 1e-7)
        g0 = float(slope.sum())
        self.b_m, self.b_v = 0.9 * self.b_m + 0.1 * g0, 0.999 * self.b_v + 0.001 * g0 * g0
        model.out_bias -= now * (self.b_m / seen_m) / (np.sqrt(self.b_v / seen_v) + 1e-7)


def new_model(buckets: int = BUCKETS, dims: int = 12, n: int = 6, seed: int = 5) -> ConvModel:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (buckets + 1, dims)).astype(np.float32)
    embed[buckets] = 0
    return ConvModel(buckets, embed, [rng.normal(0, 0.3, (w, dims, n)).astype(np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * n, np.float32), rng.normal(0, 0.3, len(WIDTHS) * n).astype(np.float32), 0.0)


def frozen_rows(model: ConvModel, in_texts: np.ndarray) -> np.ndarray:
    """Rows that fewer than ``LEAST_TEXTS`` training texts hold keep a zero embedding,
    so single texts cannot be learnt by heart and unknown words say nothing."""
    frozen = in_texts < LEAST_TEXTS
    frozen[model.buckets] = True
    model.embed[frozen] = 0
    return frozen


def say_rate(model: ConvModel, rate_of_1: float) -> ConvModel:
    """Nothing to tell apart: the base rate."""
    model.out[:] = 0
    model.out_bias = float(np.log((rate_of_1 + 0.01) / (1.01 - rate_of_1)))
    return model


def train(sample: pd.DataFrame, buckets: int = BUCKETS, epochs: int = 8, batch: int = 32, rate: float = 0.03, seed: int = 5) -> ConvModel:
    """A model of texts that are at hand (text, y, weight)."""
    model = new_model(buckets, seed=seed)
    if sample["y"].nunique() < 2:
        return say_rate(model, float(sample["y"].mean()) if len(sample) else 0.5)
    hasher = Hasher(buckets)
    texts, y, weight = [unpacked(hasher.packed(t), buckets) for t in sample["text"]], sample["y"].to_numpy(np.float32), np.sqrt(sample["weight"].to_numpy(np.float32))
    in_texts = np.zeros(buckets + 1, np.int64)
    for rows in texts:
        in_texts[np.unique(rows)] += 1
    trainer = Trainer(model, frozen_rows(model, in_texts))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            trainer.step([texts[i] for i in some], y[some], weight[some], rate * (1 - epoch / epochs))
    return model


def _hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """The labelled rows with ``words`` (packed) for the text; ``aside``: those that set the thresholds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        for batch in batches:
            for at in range(0, len(batch), PACKED_ROWS):
                part = batch.slice(at, PACKED_ROWS)
                words = pa.array([hasher.packed(t.as_py()) for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "lang", "y", "aside")], words], names=["doc_id", "lang", "y", "aside", "words"])

    aside = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":aside"))) % 5 == 0
    return rows.withColumn("aside", aside).mapInArrow(pack, "doc_id long, lang string, y int, aside boolean, words binary")


def _texts_with(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many of ``rows`` hold each hashed row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for words in batch.column("words"):
                found[np.unique(np.frombuffer(words.as_py(), "<u2"))] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["at", "n"])

    out = np.zeros(buckets + 1, np.int64)
    for r in rows.select("words").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most buckets + 1 rows
        out[r["at"]] = r["n"]
    return out


def _trained(rows: DataFrame, counts: dict[int, int], buckets: int, epochs: int, batch: int, rate: float) -> ConvModel:
    """A model of all ``rows``, learnt in shards."""
    model, total = new_model(buckets), sum(counts.values())
    if len(counts) < 2:
        return say_rate(model, counts.get(1, 0) / total if total else 0.5)
    trainer = Trainer(model, frozen_rows(model, _texts_with(rows, buckets)))
    # the loss of balanced classes, each weighed by the root of its share
    weight = np.array([np.sqrt(0.5 * total / counts[y]) for y in (0, 1)], np.float32)
    shards = dealt(rows, shard_count(total))
    for epoch in range(epochs):
        held = rows.sparkSession.sparkContext.broadcast(trainer)  # a fixed size: about 2 MB

        def learn(batches: Iterator[pa.RecordBatch], held=held, now=rate * (1 - epoch / epochs)) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
            own = deepcopy(held.value)  # a worker keeps what was broadcast for its next tasks
            own.touched[:] = 0
            texts, ys, seen, size = [], [], 0, 0
            for some in batches:
                for words, y in zip(some.column("words"), some.column("y").to_pylist(), strict=True):
                    texts.append(unpacked(words.as_py(), buckets))
                    ys.append(y)
                    size += len(texts[-1])
                    if len(texts) == batch or size > STEP_WORDS:
                        own.step(texts, np.array(ys, np.float32), weight[ys], now)
                        seen += len(texts)
                        texts, ys, size = [], [], 0
            if texts:
                own.step(texts, np.array(ys, np.float32), weight[ys], now)
                seen += len(texts)
            return own.table(), own.touched.astype(np.float64), own.flat(), float(seen)

        trainer.take(*one_round(shards, learn, trainer.table(), trainer.flat()))
        held.unpersist()
    shards.unpersist()
    return model


def best_threshold(rows: pd.DataFrame, least: int) -> float | None:
    """The middle of the widest gap of scores with the best F1; none with under ``least`` rows of a class.

    ``rows``: neighbouring scores put together, from ``low`` to ``high``, with how many are of class 1 (``ones``) and of both (``n``).
    """
    rows = rows.sort_values("low", ascending=False)
    ones, n = rows["ones"].sum(), rows["n"].sum()
    if ones < least or n - ones < least:
        return None
    f1 = 2 * rows["ones"].cumsum().to_numpy() / (rows["n"].cumsum().to_numpy() + ones)
    after = np.append(rows["high"].to_numpy()[1:], 0)
    gap = rows["low"].to_numpy() - after
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = int(best[gap[best].argmax()])
    return float((rows["low"].iloc[k] + after[k]) / 2)


def calibrate(model: ConvModel, rows: DataFrame, least: int = 20) -> dict[str, float]:
    """A threshold for each language, from the scores of all ``rows``; scores of one ``GRID``th are told apart no further."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PACKED_ROWS):
                part = batch.slice(at, PACKED_ROWS)
                best, _ = winners(held.value, [unpacked(w.as_py(), held.value.buckets) for w in part.column("words")])
                p = sigmoid(np.maximum(best + held.value.bias, 0) @ held.value.out + held.value.out_bias)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("y"), pa.array(p.astype(np.float64))], names=["lang", "y", "score"])

    def settle(of_lang: pd.DataFrame) -> pd.DataFrame:  # at most GRID + 1 rows
        at = best_threshold(of_lang, least)
        return pd.DataFrame({"lang": of_lang["lang"].iloc[:1], "at": [at]}).dropna()

    scored = rows.where("lang IS NOT NULL").select("lang", "y", "words").mapInArrow(score, "lang string, y int, score double")
    grid = scored.groupBy("lang", F.floor(F.col("score") * GRID).alias("step")).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("y").alias("ones"), F.count("*").alias("n"))
    found = grid.groupBy("lang").applyInPandas(settle, "lang string, at double").collect()
    return {r["lang"]: r["at"] for r in sorted(found, key=lambda r: r["lang"])}


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", epochs: int = 8, batch: int = 32, rate: float = 0.03) -> ConvModel:
    """Trains on all labelled rows (never held-out ones), but for a fifth that sets the thresholds.

    Null ids and labels take no part; of rows of one id the least text and the greatest label count. With labels of one class the
    model says that class's rate, without labels a half; languages with few rows get no threshold of their own.
    """
    rows = staged(_hashed(labelled_rows(docs, labels, label), BUCKETS), "labelled")
    counts = {int(r["y"]): int(r["n"]) for r in rows.where("NOT aside").groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = _trained(rows.where("NOT aside").select("doc_id", "y", "words"), counts, BUCKETS, epochs, batch, rate)
    model.thresholds = calibrate(model, rows.where("aside"))
    unstaged(rows)
    return model


def score_toxicity(docs: DataFrame, model: ConvModel, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``tox_score``, ``tox_predicted`` (at ``threshold``)
    and ``tox_rejected`` (at the threshold calibrated for the row's language).

    Whole texts are scored; a null text counts as empty. Languages without a
    calibrated threshold take ``threshold``. Columns of those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: about 2 MB

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        free_encoders()
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(texts.tolist()))

    limit = F.lit(float(threshold))
    if "lang" in docs.columns:
        for lang, at in (model.thresholds or {}).items():
            limit = F.when(F.col("lang") == lang, F.lit(at)).otherwise(limit)
    scored = docs.withColumn("tox_score", score(text_of()))
    return scored.withColumns({"tox_predicted": (F.col("tox_score") >= threshold).cast("int"), "tox_rejected": F.col("tox_score") >= limit})


def toxicity_result(docs: DataFrame, model: ConvModel) -> DataFrame:
    """``doc_id, held_out, score, predicted, rejected`` of each row of ``docs``; repeated rows come out as often as they came in, with equal scores.

    A null text scores as the empty one, a null id is not held out, and an empty table gives no rows. Only doc_id, text and lang are read.
    """
    scored = score_toxicity(docs, model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"), F.col("tox_rejected").alias("rejected"))
