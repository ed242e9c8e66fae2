"""Phrase collocations, mined by pivot partitioning.

Every n-gram belongs to its rarest word, its pivot (of several occurrences, the first). Around each word of a
piece the neighbours that are more frequent are what its own n-grams can reach; that fragment, rewritten
to word ids with gaps for all else, is routed to the pivot's partition. There the
n-grams that hold the pivot are counted, bigrams first, and no other, so each n-gram is
counted in one place. Fragments of a frequent pivot are dealt to several partitions and their counts are added.

Ids follow frequency: the most frequent words have ranks from a table of bounded size, and others
have hashes beyond all ranks, which are checked to name one word each.
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
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.frequent import most_frequent
from docquarry.llm.shared import staged, text_of
from docquarry.llm.token_blocks import token_blocks

#: Words with a rank, and the bytes that such a word may have: what workers hold is bounded by both.
RANKED, RANKED_BYTES = 400_000, 64
#: Bits of the map that tells which hashed words are frequent; wrong only towards yes.
MAP_BITS = 1 << 25
#: Fragments of one pivot in one partition, about; a pivot with more is dealt to several.
FRAGMENTS = 1_000_000
#: Tokens whose fragments are put together before they are sent; fragments that are mined at a time.
TOKENS, MINED = 1_500_000, 300_000
GAP, HASHED = -1, 1 << 61
LONGEST = 3

_SEPARATORS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_DELIMITER = re.compile(rb"[ \t.]")


def _split(data: bytes) -> list[bytes]:
    """Words, and each boundary of a piece as the word ``.``."""
    return data.translate(_SEPARATORS).replace(b".", b" . ").split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = text.as_py().encode().lower()
            yield lang, data.translate(_SEPARATORS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int, int]]:
    return token_blocks(_texts(batches), _split, b".", _DELIMITER, LONGEST - 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n over all ``texts`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens, begin, end in _blocks(batches):
            found = Counter(tokens[begin:end])
            found.pop(b".", None)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed(lang: Column, word: Column, seed: int) -> Column:
    return F.xxhash64(F.concat(F.lit(f"{seed}."), lang, F.lit("."), word)).bitwiseAND(F.lit(HASHED - 1)) + F.lit(HASHED)


class WordIds(dict):
    """Ids of the words of one language; words that are not ranked get theirs from a hash, if they may be frequent."""

    def __init__(self, lang: str, ranked: tuple[bytes, np.ndarray], seed: int, frequent: np.ndarray):
        super().__init__(zip(ranked[0].split(b"\n"), ranked[1].tolist()) if len(ranked[1]) else ())
        self[b"."] = GAP
        self.start, self.frequent = f"{seed}.{lang}.".encode(), frequent

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(self.start + word, 42) & (HASHED - 1)
        place = h % MAP_BITS
        return HASHED + h if self.frequent[place >> 3] >> (place & 7) & 1 else GAP


@dataclass
class FrequentWords:
    """What tells words apart in tasks: at most RANKED words (with a line break between them, by language) with their ranks, their
    counts by rank, and MAP_BITS bits that mark the hashes of the other frequent words."""

    ranked: dict[str, tuple[bytes, np.ndarray]]
    counts: np.ndarray
    seed: int
    frequent: np.ndarray

    def ids(self, lang: str) -> WordIds:
        return WordIds(lang, self.ranked.get(lang, (b"", np.zeros(0, np.int64))), self.seed, self.frequent)


_tables: dict[str, dict[str, WordIds]] = {}


def _ids_of(key: str, words: FrequentWords, lang: str) -> WordIds:
    """The ids of a language, kept by this Python worker if it has ranked words."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = {}
    if lang not in words.ranked:
        return words.ids(lang)
    if lang not in _tables[key]:
        _tables[key][lang] = words.ids(lang)
    return _tables[key][lang]


def fragments_of(ids: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Rows (pivot, two words before, word before, word after, two after) of the tokens in [begin, end) that own n-grams.

    Words before must be more frequent than the pivot, words after at least as frequent: so
    of equal words the first is the pivot.
    """
    around = np.concatenate(([GAP, GAP], ids, [GAP, GAP]))
    at = np.arange(begin, end) + 2
    at = at[around[at] != GAP]
    pivot, l2, l1, r1, r2 = around[at], around[at - 2], around[at - 1], around[at + 1], around[at + 2]
    left, right = (l1 != GAP) & (l1 < pivot), (r1 != GAP) & (r1 <= pivot)
    left2, right2 = left & (l2 != GAP) & (l2 < pivot), right & (r2 != GAP) & (r2 <= pivot)
    rows = np.stack([pivot, np.where(left2, l2, GAP), np.where(left, l1, GAP), np.where(right, r1, GAP), np.where(right2, r2, GAP)], axis=1)
    return rows[left | right]


def _sums(codes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(codes, weights, size).astype(np.int64)  # exact below 2^53


def _distinct(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` and the sums of their weights."""
    codes = np.zeros(len(weights), np.int64)
    for column in columns:
        own, values = pd.factorize(column)
        codes = pd.factorize(codes * (len(values) + 1) + own)[0].astype(np.int64)  # at most rows x rows
    first = np.full(int(codes.max(initial=-1)) + 1, -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return [c[first] for c in columns], _sums(codes, weights, len(first))


FRAGMENT = "pivot long, l2 long, l1 long, r1 long, r2 long, n long, shares int, share int"
_FRAGMENT = pa.schema([(c, pa.int64()) for c in ("pivot", "l2", "l1", "r1", "r2", "n")] + [("shares", pa.int32()), ("share", pa.int32())])


def mine_rows(rows: np.ndarray, n: np.ndarray, alone: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of two and three words (GAP for a third that is not there) that own the pivots of fragments, and their counts.

    Where a pivot has all its fragments here (``alone``), n-grams of under ``least`` are left
    out, and longer ones are only tried around bigrams that reach it.
    """
    pivot, l2, l1, r1, r2 = rows.T
    size = len(rows)
    both = [np.concatenate(x) for x in ((l1, pivot), (pivot, r1), (n, n), (alone, alone))]
    there = np.flatnonzero((both[0] != GAP) & (both[1] != GAP))
    pair_of = np.full(2 * size, -1, np.int64)
    code, kinds = pd.factorize(both[0][there])
    code2, kinds2 = pd.factorize(both[1][there])
    codes, pairs = pd.factorize(code.astype(np.int64) * (len(kinds2) + 1) + code2)
    pair_of[there] = codes
    kept = _sums(codes, both[2][there], len(pairs)) >= least
    kept[codes[~both[3][there]]] = True
    ok = np.zeros(2 * size, bool)
    ok[there] = kept[codes]
    left, right = ok[:size], ok[size:]
    own = there[kept[codes]]
    found = [(both[0][own], both[1][own], np.full(len(own), GAP), both[2][own])]
    for use, a, b, c in ((left & (l2 != GAP), l2, l1, pivot), (left & right, l1, pivot, r1), (right & (r2 != GAP), pivot, r1, r2)):
        found.append((a[use], b[use], c[use], n[use]))
    w1, w2, w3, m = (np.concatenate(x) for x in zip(*found))
    grams, counts = _distinct([w1, w2, w3], m)
    return np.stack(grams, axis=1), counts


def phrase_counts(texts: DataFrame, words: FrequentWords, least: int) -> DataFrame:
    """w1, w2, w3 (GAP: none), a of every phrase of two and three words that occurs at least ``least`` times."""
    key = uuid.uuid4().hex
    table = texts.sparkSession.sparkContext.broadcast(words)  # of bounded size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares_of = np.minimum(1 + table.value.counts // FRAGMENTS, 1 << 30)

        def send(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts)
            columns, n = _distinct(list(rows.T), np.ones(len(rows), np.int64))
            shares = np.ones(len(n), np.int64)
            is_ranked = columns[0] < HASHED
            shares[is_ranked] = shares_of[columns[0][is_ranked]]
            share = np.arange(len(n)) % shares
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, n)] + [pa.array(shares, pa.int32()), pa.array(share, pa.int32())], schema=_FRAGMENT)

        waiting, held = [], 0
        for lang, tokens, begin, end in _blocks(batches):
            known = _ids_of(key, table.value, lang)
            rows = fragments_of(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), begin, end)
            if len(rows):
                waiting.append(rows)
                held += end - begin
            if held >= TOKENS:
                yield from send(waiting)
                waiting, held = [], 0
        if waiting:
            yield from send(waiting)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(rows: np.ndarray) -> pa.RecordBatch:
            grams, a = mine_rows(rows[:, :5], rows[:, 5], rows[:, 6] == 1, least)
            return pa.RecordBatch.from_arrays([pa.array(grams[:, 0]), pa.array(grams[:, 1]), pa.array(grams[:, 2]), pa.array(a)], names=["w1", "w2", "w3", "a"])

        waiting, held = [], 0
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(7)], axis=1)
            waiting.append(rows)
            held += len(rows)
            last, whole = rows[-1, 0], rows[-1, 6] == 1
            if held >= MINED and not (whole and waiting[0][0, 0] == last):
                rows = np.concatenate(waiting)
                # a pivot that is whole here waits for the rest of its fragments, FRAGMENTS at most
                upto = int(np.searchsorted(rows[:, 0], last)) if whole else len(rows)
                yield counted(rows[:upto])
                waiting, held = ([rows[upto:]], len(rows) - upto) if upto < len(rows) else ([], 0)
        if held:
            yield counted(np.concatenate(waiting))

    routed = texts.mapInArrow(cut, FRAGMENT).repartition("pivot", "share").sortWithinPartitions("pivot")
    # a partition may hold several shares of a pivot: they are mined together, and added up below
    local = routed.mapInArrow(mine, "w1 long, w2 long, w3 long, a long")
    return local.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _frequent_words(counts: DataFrame, least: int) -> tuple[DataFrame, FrequentWords]:
    """The words that occur ``least`` times (id, lang, word, f, ranked), and what tells them apart in tasks."""
    spark = counts.sparkSession
    top, floor = most_frequent(counts, RANKED, RANKED_BYTES, least)
    langs, texts, often = np.array(top.column("lang").to_pylist(), object), np.array(top.column("word").to_pylist(), object), top.column("n").to_numpy()
    ranked = {lang: ("\n".join(texts[at := np.flatnonzero(langs == lang)]).encode(), at) for lang in sorted(set(langs))}
    table = pa.table({"id": np.arange(len(top)), "lang": top.column("lang"), "word": top.column("word"), "f": top.column("n"), "ranked": np.ones(len(top), bool)})
    rows = spark.createDataFrame(table.to_pandas(), "id long, lang string, word string, f long, ranked boolean")
    is_ranked = (F.col("n") >= floor) & (F.octet_length("word") <= RANKED_BYTES) if floor is not None else F.lit(False)
    rest = counts.where(~is_ranked)
    for seed in range(64):
        named = rest.withColumn("id", _hashed(F.col("lang"), F.col("word"), seed))
        clash = named.groupBy("id").agg(F.count("*").alias("words"), F.max("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= least))
        if clash.isEmpty():
            break
    else:
        raise RuntimeError("no seed gives every frequent word a hash of its own")
    named = named.where(F.col("n") >= least)
    place = F.col("id") % F.lit(MAP_BITS)  # HASHED is a multiple of MAP_BITS
    held = named.select(place.alias("place")).groupBy(F.floor(F.col("place") / 32768).alias("bucket")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
    frequent = np.zeros(MAP_BITS // 8, np.uint8)
    for r in held.collect():  # MAP_BITS bits at most
        frequent[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    words = rows.unionByName(named.select("id", "lang", "word", F.col("n").alias("f"), F.lit(False).alias("ranked")))
    return words, FrequentWords(ranked, often, seed, frequent)


def _named(phrases: DataFrame, words: DataFrame, at: str) -> DataFrame:
    """``phrases`` with the word and the count of the id ``at``; ranked words are broadcast (bounded), others are joined by shuffle."""
    ranked = F.broadcast(words.where("ranked").select(F.col("id").alias(at), F.struct("lang", "word", "f").alias("known")))
    other = words.where("NOT ranked").select(F.col("id").alias(at), F.struct("lang", "word", "f").alias("other"))
    # a rare word has few phrases: no key of this join is hot
    joined = phrases.join(ranked, at, "left").join(other.hint("shuffle_hash"), at, "left")
    return joined.select(*phrases.columns, F.coalesce("known", "other").alias(f"{at}_word"))


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at blanks. A phrase
    that occurs ``least`` times scores a*a/(l*r) in millionths, by its worst cut into two parts, and goes if a
    longer such phrase holds it ``covered`` times of a hundred. Null texts are empty, a null language is ``und``; repeated rows count each, ids
    are not read; without a phrase, or without rows, no rows come out. Words may be of any length.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    texts = docs.select(lang.alias("lang"), text_of().alias("text")).where("text <> ''")
    counts = staged(word_counts(texts), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words, table = _frequent_words(counts, least)
    words = staged(words, "frequent-words")
    grams = staged(phrase_counts(texts, table, least), "phrases")

    pairs = grams.where(F.col("w3") == GAP).select("w1", "w2", "a")
    threes = grams.where(F.col("w3") != GAP)
    inside = threes.select("w1", "w2", "a").unionByName(threes.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("most"))
    free = pairs.join(inside, ["w1", "w2"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))
    two = _named(_named(free.select("w1", "w2", "a"), words, "w1"), words, "w2")
    two = two.select("w1_word.lang", F.concat_ws(" ", "w1_word.word", "w2_word.word").alias("phrase"), "a", F.array(F.struct(F.lit(1).alias("k"), F.col("w1_word.f").alias("l"), F.col("w2_word.f").alias("r"))).alias("cuts"))
    # every part of a phrase is at least as frequent, so both are found
    three = threes.join(pairs.select("w1", "w2", F.col("a").alias("head")), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail")), ["w2", "w3"])
    three = _named(_named(_named(three, words, "w1"), words, "w2"), words, "w3")
    cuts = F.array(F.struct(F.lit(1).alias("k"), F.col("w1_word.f").alias("l"), F.col("tail").alias("r")), F.struct(F.lit(2).alias("k"), F.col("head").alias("l"), F.col("w3_word.f").alias("r")))
    three = three.select("w1_word.lang", F.concat_ws(" ", "w1_word.word", "w2_word.word", "w3_word.word").alias("phrase"), "a", cuts.alias("cuts"))

    # whole division of 38 digits; at most a million, since a <= l, r
    exact = "(cast(a AS DECIMAL(18,0)) * cast(a AS DECIMAL(18,0)) * cast(1000000 AS DECIMAL(7,0))) div (cast(c.l AS DECIMAL(18,0)) * cast(c.r AS DECIMAL(18,0)))"
    scored = two.unionByName(three).withColumn("cuts", F.expr(f"transform(cuts, c -> struct({exact} AS score, c.k AS k, c.l AS l, c.r AS r))"))
    worst = scored.select("lang", "phrase", "a", F.array_min("cuts").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # each task keeps its own first `top` before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = worst.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")



ORACLE = """
WITH p AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), w AS (SELECT id, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3
  FROM w, generate_series(1, 3) AS s(k), generate_series(1, len(w)) AS t(i) WHERE i + k - 1 <= len(w)
), f AS (SELECT lang, k, phrase, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, count(*) AS a FROM g GROUP BY lang, k, phrase
), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT * FROM f WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, 1 AS cut, x.a AS l, y.a AS r FROM c JOIN f x ON x.lang = c.lang AND x.k = 1 AND x.phrase = c.w1
    JOIN f y ON y.lang = c.lang AND y.k = c.k - 1 AND y.phrase = CASE c.k WHEN 2 THEN c.w2 ELSE c.w2 || ' ' || c.w3 END
  UNION ALL
  SELECT c.lang, c.phrase, c.k, c.a, 2, x.a, y.a FROM c JOIN f x ON x.lang = c.lang AND x.k = 2 AND x.phrase = c.w1 || ' ' || c.w2
    JOIN f y ON y.lang = c.lang AND y.k = 1 AND y.phrase = c.w3 WHERE c.k = 3
), scored AS (
  SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), held AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE k = 3
), most AS (SELECT lang, phrase, max(a) AS a FROM held GROUP BY lang, phrase
), kept AS (
  SELECT worst.* FROM worst LEFT JOIN most m ON m.lang = worst.lang AND m.phrase = worst.phrase AND worst.k = 2 WHERE m.a IS NULL OR 100 * m.a < 50 * worst.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
