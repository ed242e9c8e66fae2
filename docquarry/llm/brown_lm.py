"""Brown class-based n-grams: exchange clustering of words, and the probability of texts under the class model.

    P(w | v) = mix * P(class(w) | class(v)) * P(w | class(w)) + (1 - mix) * P(w)

Words and neighbouring pairs are counted over the whole training corpus. The most frequent words move
between classes: for each word every class is tried, with the exact change of the likelihood of the class bigrams, a
share of the words at a time in parallel (each word is one row with its neighbours, whose number the
size of the vocabulary bounds), and a round that lost likelihood is taken back. All other words share one class; the end of a text is a class of its own.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.frequent import most_frequent
from docquarry.llm.shared import arrow_batches, narrow, staged, unstaged
from docquarry.llm.token_blocks import parts_of, token_blocks

#: Words that move between classes; words whose counts workers hold, and the bytes that such a word may have.
CLASSED, HELD, HELD_BYTES = 65_536, 400_000, 64
#: Pairs of neighbours that are put together before they are sent; bytes of text that are held as words at a time.
PAIRS, BLOCK_BYTES = 2_000_000, 2_000_000
#: Words whose moves are computed at a time; neighbours that are summed by class at a time.
MOVED, NEIGHBOURS = 64, 500_000
#: Texts, or words with their neighbours, that are sent to Python at a time; counted pairs that it sends back at a time.
ROWS, SENT = 250, 100_000

_WHITE = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
#: The token at the end of a text; no word holds it.
END = b"\n"
_BLANK = re.compile(rb" ")


def _split(data: bytes) -> list[bytes]:
    return list(filter(None, data.replace(END, b" \n ").split(b" ")))


def _plain(text: str) -> bytes:
    return text.encode().lower().translate(_WHITE)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[bytes], int, int]]:
    return token_blocks(((0, _plain(t.as_py())) for batch in batches for t in batch.column("text")), _split, END, _BLANK, 1, BLOCK_BYTES)


def training_words(texts: DataFrame) -> DataFrame:
    """word, n over all ``texts``; the end of a text counts as the word of a line break."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, begin, end in _blocks(batches):
            found = Counter(tokens[begin:end])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Places(dict):
    """Places of held words by frequency; any other word is ``rest``."""

    def __init__(self, words: bytes):
        super().__init__(zip(words.split(END), range(len(words))) if words else ())
        self.rest = len(self)
        self[END] = self.rest + 1

    def __missing__(self, word: bytes) -> int:
        return self.rest


_places: dict[str, Places] = {}


def _places_of(key: str, words: bytes) -> Places:
    """The words in this Python worker."""
    if key not in _places:
        _places.clear()
        _places[key] = Places(words)
    return _places[key]


def neighbour_rows(texts: DataFrame, words: object, key: str, classed: int) -> DataFrame:
    """id, others, n: all neighbours of each word, packed: whether they stand before it (1) or after (0) and their id, as
    ``side * size + id`` in 32 bits, and how often, in 64 bits.

    Ids are 0 to ``classed`` - 1, then one for all other words, then the end: ``size`` of them. ``words`` is the broadcast list of held words.
    A row has at most 2 * size neighbours.
    """
    size = classed + 2

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _places_of(key, words.value)

        def send(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            for at in range(0, len(code), SENT):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + SENT].astype(np.int64)) for x in (code, n)], names=["code", "n"])

        waiting, held = [], 0
        for _, tokens, begin, end in _blocks(batches):
            ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
            ids = np.where(ids == known.rest + 1, classed + 1, np.minimum(ids, classed))
            before = np.concatenate(([classed + 1], ids[:-1]))  # the stream begins as a text does
            waiting.append(before[begin:end] * size + ids[begin:end])
            held += end - begin
            if held >= PAIRS:
                yield from send(waiting)
                waiting, held = [], 0
        if waiting:
            yield from send(waiting)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around = batch.column("around")
            flat = around.flatten()
            lengths = pa.compute.list_value_length(around).to_numpy()
            packed = [_as_binary(flat.field(k).to_numpy(), lengths, kind) for k, kind in ((0, "<i4"), (1, "<i8"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *packed], names=["id", "others", "n"])

    found = texts.mapInArrow(pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    prev, cur = F.expr(f"cast(code div {size} AS int)"), (F.col("code") % size).cast("int")
    ways = F.array(F.struct(prev.alias("id"), cur.alias("other"), "n"), F.struct(cur.alias("id"), (prev + size).alias("other"), "n"))
    return found.select(F.inline(ways)).groupBy("id").agg(F.collect_list(F.struct("other", "n")).alias("around")).mapInArrow(pack, "id int, others binary, n binary")


def _as_binary(values: np.ndarray, lengths: np.ndarray, kind: str) -> pa.Array:
    """A binary array of as many values each as ``lengths`` says."""
    data = values.astype(kind)
    ends = np.concatenate(([0], np.cumsum(lengths * data.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _values(column: pa.Array, kind: str) -> np.ndarray:
    """All values of a binary array, row after row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8)[ends[0] : ends[-1]].view(kind) if held is not None else np.zeros(0, kind)


def _bounded(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at most ``most`` neighbours (``NEIGHBOURS`` without it), or one row."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column("others")).to_numpy() // 4)
        at, before = 0, 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, before + (most or NEIGHBOURS), "right")))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def _class_counts(batch: pa.RecordBatch, classes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: its id, how often each class (side 0) follows and (side 1) stands before it, and itself."""
    others, n = _values(batch.column("others"), "<i4"), _values(batch.column("n"), "<i8")
    ids = batch.column("id").to_numpy()
    row = np.repeat(np.arange(len(batch)), pa.compute.binary_length(batch.column("others")).to_numpy() // 4)
    side = (others >= len(classes)).astype(np.int64)
    sums = np.bincount((row * 2 + side) * count + np.concatenate((classes, classes))[others], n, len(batch) * 2 * count).reshape(len(batch), 2, count)
    own = np.bincount(row, np.where(others == ids[row], n, 0), len(batch))
    return ids, sums, own


def _weighed(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_moves(classes: np.ndarray, sums: np.ndarray, own: np.ndarray, matrix: np.ndarray, movable: int) -> tuple[np.ndarray, np.ndarray]:
    """The best class of each word and by how much it raises the likelihood, all other words staying.

    ``classes``: of the words; ``sums`` and ``own``: their neighbours by class and themselves; ``matrix``: the counts of class bigrams.
    """
    row = np.arange(len(classes))
    out, into = sums[:, 0].copy(), sums[:, 1].copy()
    n = out.sum(axis=1)
    left = np.repeat(matrix[None], len(classes), axis=0)  # the counts without the word
    left[row, classes] -= out
    left[row, :, classes] -= into
    left[row, classes, classes] += own
    out[row, classes] -= own
    into[row, classes] -= own
    alone = _weighed(left)
    gain = _weighed(left + out[:, None, :]).sum(axis=2) - alone.sum(axis=2)
    gain += _weighed(left + into[:, :, None]).sum(axis=1) - alone.sum(axis=1)
    k = np.arange(matrix.shape[0])
    both = left[:, k, k]
    gain += _weighed(both + out + into + own[:, None]) - _weighed(both + out) - _weighed(both + into) + alone[:, k, k]
    size = np.repeat(matrix.sum(axis=1)[None], len(classes), axis=0)
    size[row, classes] -= n
    gain -= 2 * (_weighed(size + n[:, None]) - _weighed(size))
    gain = gain[:, :movable]
    best = gain.argmax(axis=1)
    return best, gain[row, best] - gain[row, classes]


def _matrix(rows: DataFrame, classes: np.ndarray, count: int) -> np.ndarray:
    """Counts of class bigrams: count x count numbers reach the driver."""
    held = rows.sparkSession.sparkContext.broadcast(classes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count))
        for batch in _bounded(batches):
            ids, sums, _ = _class_counts(batch, held.value, count)
            np.add.at(total, held.value[ids], sums[:, 0])
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b].astype(np.int64))], names=["a", "b", "n"])

    matrix = np.zeros((count, count))
    for r in rows.mapInArrow(add, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        matrix[r["a"], r["b"]] = r["n"]
    return matrix


def likelihood(matrix: np.ndarray) -> float:
    """The part of the log likelihood of class bigrams that depends on the classes."""
    return float(_weighed(matrix).sum() - _weighed(matrix.sum(axis=0)).sum() - _weighed(matrix.sum(axis=1)).sum())


def exchange(rows: DataFrame, classed: int, classes: int, rounds: int, shares: int = 2) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of every id, the class bigrams, and the likelihood before and after each round.

    Words start in classes by turns of frequency. Each round moves one of ``shares`` parts of the words; a round that
    loses likelihood is taken back, and later rounds move smaller parts.
    """
    count = classes + 2
    now = np.concatenate((np.arange(classed) % classes, [classes, classes + 1])).astype(np.int32)
    matrix = _matrix(rows, now, count)
    reached = [likelihood(matrix)]
    part = 0
    for _ in range(rounds if classed else 0):
        held = rows.sparkSession.sparkContext.broadcast((now, matrix, part % shares, shares))

        def move(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            current, counts, turn, parts = held.value
            for batch in _bounded(batches):
                ids, sums, own = _class_counts(batch, current, count)
                asked = np.flatnonzero((ids < classed) & (ids % parts == turn))
                for at in range(0, len(asked), MOVED):
                    some = asked[at : at + MOVED]
                    best, gain = best_moves(current[ids[some]], sums[some], own[some], counts, classes)
                    moves = gain > 1e-6
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][moves]), pa.array(best[moves])], names=["id", "best"])

        found = rows.mapInArrow(move, "id int, best long").toArrow()  # at most `classed` rows of two numbers
        after = now.copy()
        after[found.column("id").to_numpy()] = found.column("best").to_numpy()
        tried = _matrix(rows, after, count)
        if likelihood(tried) >= reached[-1]:
            now, matrix, part = after, tried, part + 1
            reached.append(likelihood(matrix))
        else:
            shares *= 2
        held.unpersist()
    return now, matrix, reached


@dataclass
class BrownModel:
    """What texts are scored with. ``words`` (a line break between them) and ``counts`` are of the held words, by frequency; ``known`` holds the counts of all training words."""

    words: bytes
    counts: np.ndarray
    classes: np.ndarray
    matrix: np.ndarray
    known: DataFrame
    tokens: int
    distinct: int
    ends: int
    reached: list[float]

    def share(self, count: np.ndarray | int) -> np.ndarray | float:
        """The smoothed share of a word among all tokens."""
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def rest_share(self) -> tuple[float, float]:
        """(a, b): a word of the class of all others that counts c has (c + 0.5) / (a + b) of it, an unknown one with c = 0."""
        movable = len(self.matrix) - 2
        here = self.classes[: len(self.counts)] < movable
        own = int(self.counts[: len(here)][here].sum())
        return self.tokens - self.ends - own, 0.5 * (max(0, self.distinct - int(here.sum()) - (self.ends > 0)) + 1)

    def transitions(self, weight: float = 10.0) -> np.ndarray:
        """P(class | class before), smoothed by the shares of classes."""
        into = self.matrix.sum(axis=0)
        sized = into + np.where(np.arange(len(into)) >= len(into) - 2, 0.5, 0.0)  # other words and the end are always possible
        prior = sized / sized.sum()
        return (self.matrix + weight * prior) / (self.matrix.sum(axis=1, keepdims=True) + weight)


def trains() -> Column:
    """Rows that the model learns from: crc32 of the id as text, modulo 5, is not 1 (a null id: learnt from)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True))


def fit_brown(docs: DataFrame, classes: int = 64, rounds: int = 8, classed: int | None = None) -> BrownModel:
    """Counts and classes from the training rows of ``docs``.

    Null texts are empty texts: one end. Repeated rows count each, other columns are not read. Without training rows every text has
    the probability of unknown words alone.
    """
    spark = docs.sparkSession
    texts = narrow(docs).where(trains()).select("text")
    with arrow_batches(spark, ROWS):
        known = staged(training_words(texts), "model-words")
    end = F.col("word") == END.decode()
    total = known.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct"), F.sum(F.when(end, F.col("n"))).alias("ends")).first()
    top, _ = most_frequent(known.where(~end), HELD, HELD_BYTES)
    words, counts = "\n".join(top.column("word").to_pylist()).encode(), top.column("n").to_numpy()
    classed = min(len(counts), CLASSED if classed is None else classed)
    with arrow_batches(spark, ROWS):
        rows = staged(neighbour_rows(texts, spark.sparkContext.broadcast(words), uuid.uuid4().hex, classed), "neighbours")
        found, matrix, reached = exchange(rows, classed, classes, rounds)
    unstaged(rows)
    every = np.full(len(counts) + 2, classes, np.int32)
    every[:classed], every[-1] = found[:classed], classes + 1
    return BrownModel(words, counts, every, matrix, known, int(total["tokens"] or 0), int(total["distinct"]), int(total["ends"] or 0), reached)


SCANNED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word string, before double, times long"
_SCANNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("word", pa.string()), ("before", pa.float64()), ("times", pa.int64())])


def score_texts(docs: DataFrame, model: BrownModel, mix: float = 0.95) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of each row of ``docs``.

    Words that workers do not hold are looked up in the counts of all training words by a join; what they add is summed up for each row. An
    empty text is its end alone; texts of any length are read in parts; repeated rows come out as often as they came in.
    """
    spark = docs.sparkSession
    key = uuid.uuid4().hex
    held, end = len(model.counts), len(model.classes) - 1
    steps = model.transitions()
    sizes = np.maximum(model.matrix.sum(axis=1), 1)
    other, other_kinds = model.rest_share()
    rest_class = len(sizes) - 2
    counts = np.concatenate((model.counts, [0, model.ends]))
    within = np.where(model.classes < rest_class, counts / sizes[model.classes], (counts + 0.5) / (other + other_kinds))
    within[end] = 1.0
    # bounded: HELD words and numbers, and the class bigrams
    table = spark.sparkContext.broadcast((model.words, model.classes, steps, within, model.share(counts), counts > 0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, step, own, base, seen = table.value
        known = _places_of(key, words)
        for batch in batches:
            n_tokens, n_known, base_score, score = (np.zeros(len(batch)) for _ in range(4))
            carried, waiting, size = end, [], 0

            def add(parts: list[tuple[int, list[bytes]]], carried: int) -> tuple[int, pa.RecordBatch | None]:
                tokens = [t for _, own_tokens in parts for t in own_tokens]
                at = np.repeat([r for r, _ in parts], [len(t) for _, t in parts])
                if not tokens:
                    return carried, None
                ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
                now = classes[ids]
                p = step[np.concatenate(([classes[carried]], now[:-1])), now]
                inside = ids != held
                n_tokens[:] += np.bincount(at, minlength=len(batch))
                n_known[:] += np.bincount(at, inside & seen[ids], len(batch))
                base_score[:] += np.bincount(at, np.where(inside, np.log10(base[ids]), 0), len(batch))
                score[:] += np.bincount(at, np.where(inside, np.log10(mix * p * own[ids] + (1 - mix) * base[ids]), 0), len(batch))
                out = np.flatnonzero(~inside)
                if not len(out):
                    return int(ids[-1]), None
                rest = pd.DataFrame({"row": at[out], "word": [tokens[k] for k in out], "before": p[out]}).groupby(["row", "word", "before"], sort=False).size().reset_index()
                rows = batch.column("row").take(pa.array(rest["row"].to_numpy()))
                none = [pa.nulls(len(rest), kind) for kind in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                text = pa.array(rest["word"].tolist(), pa.binary()).cast(pa.string())
                return int(ids[-1]), pa.RecordBatch.from_arrays([rows, *none, text, pa.array(rest["before"].to_numpy()), pa.array(rest[0].to_numpy())], schema=_SCANNED)

            for r, text in enumerate(batch.column("text")):
                parts = list(parts_of(_plain(text.as_py()), BLOCK_BYTES, _BLANK))
                for k, part in enumerate(parts):
                    waiting.append((r, _split(part) + ([END] if k == len(parts) - 1 else [])))
                    size += len(part)
                    if size >= BLOCK_BYTES:
                        carried, found = add(waiting, carried)
                        waiting, size = [], 0
                        if found is not None:
                            yield found
            _, found = add(waiting, carried)
            if found is not None:
                yield found
            whole = [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base_score), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*whole, pa.nulls(len(batch), pa.string()), pa.nulls(len(batch), pa.float64()), pa.nulls(len(batch), pa.int64())], schema=_SCANNED)

    rows = narrow(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", (~trains()).alias("held_out"), "text")
    with arrow_batches(spark, ROWS):
        scanned = staged(rows.mapInArrow(scan, SCANNED), "scored")
    c = F.coalesce(F.col("n"), F.lit(0))
    share = (c + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1))
    mixed = F.lit(mix) * F.col("before") * (c + 0.5) / F.lit(float(other + other_kinds)) + F.lit(1 - mix) * share
    asked = scanned.where("word IS NOT NULL").select("row", "word", "before", "times").join(model.known, "word", "left")
    added = asked.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.when(c > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * F.log10(share)).alias("base_score"), (F.col("times") * F.log10(mixed)).alias("score"))
    both = scanned.where("word IS NULL").select(*added.columns).unionByName(added)
    summed = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
