"""Near-duplicate lines within an edit distance, by segment partition; line removal.

A line is cut into tau + 1 segments. Of two lines within tau edits, at least
one segment of the shorter occurs unchanged in the longer, near its old place. So each
line is indexed under its segments and probes, for its own and the tau lower
lengths, the few substrings that position allows (multi-match-aware
selection). Lines that share a key are compared: first by the parity of their byte
counts (an edit changes at most two of 64 bits), then by banded bit-parallel
edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.chosen_path import contracted, whole_runs
from docquarry.llm.components import connected_components
from docquarry.llm.edit_distance import within
from docquarry.llm.rolling import RangeHash, mix, runs_of
from docquarry.llm.shared import broadcast_if_small, join_hot, staged, staged_alone, text_of
from docquarry.llm.shingles import WORDS

#: Rows of one key that are paired in one task; larger keys are cut into blocks, paired block by block.
KEY_ROWS = 2000
#: Rows of fixed width that are broadcast at most, and line numbers in all of them.
BROADCAST_ROWS = 500_000
#: Occurrences from which on a line counts as hot, and hot lines that are broadcast at most.
HOT_LINES, HOT_KEYS = 500, 200_000
#: Least shingle hashes that stand for a text, and the share of a text that lines must make up before it is compared.
SKETCH, LINE_SHARE = 512, 0.05

_parity_rng = np.random.default_rng(31)
_PARITY_BIT = np.uint64(1) << (_parity_rng.permutation(256).astype(np.uint64) % np.uint64(64))


def segments(length: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i (from 0) of lines of the given lengths; later segments take the rest."""
    short, longer = length // (tau + 1), length % (tau + 1)
    size = short + (i >= tau + 1 - longer)
    return i * short + np.maximum(0, i - (tau + 1 - longer)), size


def shifts(tau: int, delta: int, i: int) -> range:
    """Allowed shifts of segment i's start in a line longer by delta."""
    return range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1)


def line_keys(lines: list[bytes], tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys [lines, keys] of each line and which of the columns are index keys.

    A key hashes the segment number, the length of the indexed line and the bytes.
    For equal lengths the segment in place is both index key and probe, and of the
    shifted ones one direction is enough, since either line may probe the other.
    """
    raw = np.frombuffer(b"".join(lines), np.uint8)
    ends = np.cumsum([len(x) for x in lines])
    size = np.array([len(x) for x in lines], np.int64)
    start = ends - size
    hashes = RangeHash(raw)
    columns, index = [], []
    for delta in range(tau + 1):
        length = size - delta
        for i in range(tau + 1):
            at, seg = segments(np.maximum(length, 0), tau, i)
            for shift in shifts(tau, delta, i):
                if delta == 0 and shift < 0:
                    continue
                begin = start + at + shift
                fine = (length > tau) & (at + shift >= 0) & (begin + seg <= ends)
                begin = np.where(fine, begin, start)
                key = hashes.of(begin, np.where(fine, begin + seg, begin))
                salt = length.astype(np.uint64) * np.uint64(64) + np.uint64(i)
                columns.append(np.where(fine, mix(key + salt * np.uint64(0xC2B2AE3D27D4EB4F)), 0))
                index.append(delta == 0 and shift == 0)
    return np.stack(columns, 1) if columns else np.zeros((len(lines), 0), np.uint64), np.array(index)


def parities(lines: list[bytes]) -> np.ndarray:
    """64 bits: parity of the counts of the bytes dealt to each bit."""
    raw = np.frombuffer(b"".join(lines), np.uint8)
    size = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(size) - size
    return np.bitwise_xor.reduceat(_PARITY_BIT[raw], starts) if len(lines) else np.zeros(0, np.uint64)


def line_table(docs: DataFrame, min_bytes: int) -> DataFrame:
    """A row for each line of each text: ``doc_id``, ``thash`` (hash of the text), ``bytes`` (of the text), ``line_no``,
    ``lid`` and ``tag`` (two hashes of the trimmed line, null if under ``min_bytes``) and ``size`` (its bytes)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.when(F.octet_length(F.trim(x)) >= min_bytes, F.xxhash64(F.trim(x))).alias("lid"), F.when(F.octet_length(F.trim(x)) >= min_bytes, F.hash(F.trim(x))).alias("tag"), F.octet_length(F.trim(x)).alias("size")))
    whole = rows.select("doc_id", F.xxhash64("text").alias("thash"), F.octet_length("text").alias("bytes"), lines.alias("h"))
    return whole.select("doc_id", "thash", "bytes", F.posexplode("h").alias("line_no", "x")).select("doc_id", "thash", "bytes", "line_no", "x.lid", "x.tag", "x.size")


def _pairs(key: np.ndarray, lid: np.ndarray, parity: np.ndarray, indexed: np.ndarray, block: np.ndarray | None, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of equal keys, one of them an index row, whose parities allow tau edits.

    With ``block`` (0 and 1) only pairs across the two blocks.
    """
    starts = runs_of(key)
    sizes = np.diff(np.append(starts, len(key)))
    for step in range(1, int(sizes.max()) if len(sizes) else 1):
        starts, sizes = starts[sizes > step], sizes[sizes > step]
        ends = np.cumsum(sizes - step)
        left = np.arange(ends[-1]) + np.repeat(starts - (ends - (sizes - step)), sizes - step)
        right = left + step
        fine = (lid[left] != lid[right]) & (indexed[left] | indexed[right])
        fine &= np.bitwise_count(parity[left] ^ parity[right]) <= 2 * tau
        if block is not None:
            fine &= block[left] != block[right]
        if fine.any():
            yield left[fine], right[fine]


def _blocked(rows: DataFrame, key: str) -> DataFrame:
    """``task``, ``side`` for rows of a key: small keys are one task, larger ones a task for each pair of blocks."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    live = rows.join(sizes, key)
    small = live.where(F.col("n") <= KEY_ROWS).select("*", F.col(key).alias("task"), F.lit(-1).alias("side"))
    large = live.where(F.col("n") > KEY_ROWS).withColumn("blocks", F.ceil(F.col("n") / (KEY_ROWS // 2)).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(*small.columns[:-2], F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("task"), F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    return small.unionByName(large)


def similar_lines(docs: DataFrame, tau: int = 2, min_bytes: int = 20) -> DataFrame:
    """``lid, root, links`` for distinct lines with another distinct line within ``tau`` edits (of UTF-8 bytes).

    Lines are compared without outer white space; those under ``min_bytes`` bytes take
    no part. ``root`` names the connected component, ``links`` counts the lines
    within ``tau`` edits.
    """
    if min_bytes <= tau:
        raise ValueError("min_bytes must exceed tau")
    rows = docs.select(text_of().alias("text"))
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).where(F.octet_length("line") >= min_bytes).select(F.xxhash64("line").alias("lid"), "line")

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            frame = frame.drop_duplicates("lid")
            if len(seen) > 200_000:
                seen.clear()
            frame = frame[[x not in seen for x in frame["lid"]]]
            seen.update(frame["lid"])
            for at in range(0, len(frame), 2000):
                some = frame.iloc[at : at + 2000]
                raw = [x.encode() for x in some["line"]]
                keys, index = line_keys(raw, tau)
                flat = keys.ravel()
                keep = flat != 0
                yield pd.DataFrame({"key": flat[keep].view(np.int64), "lid": np.repeat(some["lid"].to_numpy(), keys.shape[1])[keep], "parity": np.repeat(parities(raw).view(np.int64), keys.shape[1])[keep], "indexed": np.tile(index, len(raw))[keep]})

    signed = lines.mapInPandas(sign, "key long, lid long, parity long, indexed boolean")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows that share a key with a line that may be near; a large key's rows all stay."""
        for frame in whole_small_runs(frames):
            key, lid = frame["key"].to_numpy(), frame["lid"].to_numpy()
            parity, indexed = frame["parity"].to_numpy().view(np.uint64), frame["indexed"].to_numpy()
            keep = frame["large"].to_numpy().copy()
            inside = np.flatnonzero(~keep)
            for left, right in _pairs(key[inside], lid[inside], parity[inside], indexed[inside], None, tau):
                keep[inside[left]] = keep[inside[right]] = True
            if keep.any():
                yield pd.DataFrame({"key": key[keep], "lid": lid[keep], "parity": parity[keep].view(np.int64), "indexed": indexed[keep]}).drop_duplicates(["key", "lid", "indexed"])

    met = staged(signed.repartition("key").sortWithinPartitions("key", "lid").mapInPandas(meet, "key long, lid long, parity long, indexed boolean"), "met-lines").dropDuplicates(["key", "lid", "indexed"])
    wanted = met.select("lid").distinct()
    texts = staged(lines.join(broadcast_if_small(wanted, BROADCAST_ROWS), "lid").dropDuplicates(["lid"]), "line-texts")
    tasks = _blocked(met, "key").join(texts, "lid").select("task", "side", "key", "lid", "parity", "indexed", "line")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_runs(frames, "task"):
            task, side, lid, key = (frame[c].to_numpy() for c in ("task", "side", "lid", "key"))
            raw = [x.encode() for x in frame["line"]]
            own_keys, index = line_keys(raw, tau)
            parity, indexed = frame["parity"].to_numpy().view(np.uint64), frame["indexed"].to_numpy()
            across = side >= 0
            links, roots = np.zeros(len(frame), np.int64), lid.copy()
            tied: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for which in (False, True):
                at = np.flatnonzero(across == which)
                found = list(_pairs(task[at], lid[at], parity[at], indexed[at], side[at] if which else None, tau))
                if not found:
                    continue
                left, right = at[np.concatenate([f[0] for f in found])], at[np.concatenate([f[1] for f in found])]
                for lo in range(0, len(left), 20_000):
                    a, b = left[lo : lo + 20_000], right[lo : lo + 20_000]
                    near = within([raw[i] for i in a], [raw[i] for i in b], tau) <= tau
                    a, b = a[near], b[near]
                    # a pair may meet under several keys: it counts under the least of them
                    same = (own_keys[a][:, :, None] == own_keys[b][:, None, :]) & (index[None, :, None] | index[None, None, :]) & (own_keys[a] != 0)[:, :, None]
                    least = np.where(same.any(2), own_keys[a], np.iinfo(np.uint64).max).min(1)
                    tied.append((a, b, least.view(np.int64) == key[a]))
            if not tied:
                continue
            # over all chunks: a root that one chunk overwrites would lose its ties
            a, b, first = (np.concatenate(x) for x in zip(*tied, strict=True))
            node, root = contracted(lid[a], lid[b])
            if len(node):
                place = np.minimum(np.searchsorted(node, lid), len(node) - 1)
                roots = np.where(node[place] == lid, root[place], lid)
            a, b = a[first], b[first]
            _, once = np.unique(np.stack([task[a], np.minimum(lid[a], lid[b]), np.maximum(lid[a], lid[b])], 1), axis=0, return_index=True)
            np.add.at(links, a[once], 1)
            np.add.at(links, b[once], 1)
            keep = (links > 0) | (roots != lid)
            yield pd.DataFrame({"lid": lid[keep], "links": links[keep], "root": roots[keep]})

    ready = tasks.repartition("task").sortWithinPartitions("task", "lid", "indexed")
    checked = staged(ready.mapInPandas(check, "lid long, links long, root long"), "checked-lines")
    classes = connected_components(checked.select(F.col("lid").alias("a"), F.col("root").alias("b")))
    return classes.withColumnRenamed("node", "lid").join(checked.groupBy("lid").agg(F.sum("links").alias("links")), "lid").select("lid", "root", "links")


def whole_small_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by key, cut between keys, with ``large`` marking rows of keys of over KEY_ROWS rows.

    The rows of a large key pass through as they come, so memory stays bounded.
    """
    held: pd.DataFrame | None = None
    large_key = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        keys = frame["key"].to_numpy()
        starts = runs_of(keys)
        sizes = np.diff(np.append(starts, len(keys)))
        large = np.repeat((sizes > KEY_ROWS) | (keys[starts] == large_key if large_key is not None else np.zeros(len(starts), bool)), sizes)
        tail = starts[-1]
        if large[tail]:
            large_key, held = keys[-1], None
            yield frame.assign(large=large)
        else:
            held = frame.iloc[tail:]
            if tail:
                yield frame.iloc[:tail].assign(large=large[:tail])
    if held is not None and len(held):
        yield held.assign(large=(held["key"] == large_key) if large_key is not None else False)


def sketch_of(text: str) -> np.ndarray:
    """The SKETCH least hashes of the text's distinct word shingles, sorted; a text of fewer words is one shingle."""
    raw = np.frombuffer(" ".join(re.findall(r"[^\W_]+", text.lower())).encode(), np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    last = ends[WORDS - 1 :] if len(ends) >= WORDS else ends[-1:]
    return np.unique(RangeHash(raw).of(starts[: len(last)], last))[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the shingles behind two sketches: exact if their union has at most SKETCH, else estimated from the least SKETCH of it."""
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(union, np.intersect1d(a, b)).mean())


def copied_texts(docs: DataFrame, pairs: DataFrame, alike: float) -> DataFrame:
    """The ``thash, other`` of pairs whose texts have at least ``alike`` of their word shingles in common."""
    wanted = pairs.select("thash").unionByName(pairs.select(F.col("other").alias("thash"))).distinct()
    texts = docs.select(text_of().alias("text")).select(F.xxhash64("text").alias("thash"), "text")

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.drop_duplicates("thash")
            yield pd.DataFrame({"thash": frame["thash"], "sketch": [sketch_of(x).tobytes() for x in frame["text"]]})

    some = texts.join(broadcast_if_small(wanted, BROADCAST_ROWS), "thash", "left_semi")
    sketches = staged(some.mapInPandas(sketch, "thash long, sketch binary").dropDuplicates(["thash"]), "text-sketches")
    both = pairs.join(sketches, "thash").join(sketches.select(F.col("thash").alias("other"), F.col("sketch").alias("other_sketch")), "other")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            like = [likeness(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(frame["sketch"], frame["other_sketch"], strict=True)]
            yield frame.loc[np.array(like, float) >= alike, ["thash", "other"]]

    return both.select("thash", "other", "sketch", "other_sketch").mapInPandas(compare, "thash long, other long")


def dedup_lines(docs: DataFrame, tau: int = 2, min_bytes: int = 20, alike: float = 0.5, counts: bool = True) -> DataFrame:
    """All columns of ``docs`` (text replaced) with ``n_lines``, ``n_repeated``, ``n_similar`` and ``n_removed``
    (which replace columns of those names; without ``counts`` nothing is added or replaced but the text).

    Lines of one class (equal, or tied by edits) are occurrences of one line.
    Removed are later occurrences within a text, and occurrences after the
    first in the corpus (by doc_id, nulls first, then text hash and line number), however
    many there are and whatever stands around them. Only lines that merely travel with a copied
    document stay: copies of documents are the business of document deduplication, which would no
    longer see them. That is decided for each text and the text of the first occurrence: they are
    equal, or the lines first seen there make up at least a LINE_SHARE of the larger text and
    the two have at least ``alike`` of their word shingles in common.

    Lines under ``min_bytes`` bytes and empty lines stay. A null text is an empty one, with one line. Rows
    equal in id and text are treated alike. Exact repeats are told by 96 bits of two hashes. An empty table gives no rows.
    """

    def decisions() -> DataFrame:
        lines = staged(line_table(docs, min_bytes), "lines")
        similar = staged(similar_lines(docs, tau, min_bytes), "line-classes")
        held = lines.where("lid IS NOT NULL")
        named = held.join(broadcast_if_small(similar.select("lid", "root", "links"), BROADCAST_ROWS), "lid", "left").withColumns({"cls": F.coalesce("root", "lid"), "tag": F.when(F.col("root").isNull(), F.col("tag")).otherwise(0)})
        many = named.groupBy("cls", "tag").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "thash", "line_no", "bytes")).alias("first")).where("n > 1")
        facts = many.select("cls", "tag", F.struct("n", "first").alias("fact"))
        marked = join_hot(named, facts, ["cls", "tag"], F.col("fact.n") > HOT_LINES, HOT_KEYS).withColumn("first", F.col("fact.first"))
        in_text = staged(marked.groupBy("doc_id", "thash", "cls", "tag").agg(F.min("line_no").alias("line_no"), F.max("links").alias("links"), F.collect_set("line_no").alias("all"), F.first("first").alias("first"), F.sum("size").alias("size"), F.first("bytes").alias("bytes")), "lines-in-texts")
        shared = in_text.where("thash <> first.thash").groupBy("doc_id", "thash", F.col("first.thash").alias("other")).agg(F.sum("size").alias("shared"), F.greatest(F.max("bytes"), F.max("first.bytes")).alias("larger"))
        pairs = staged(shared.where(F.col("shared") >= F.lit(LINE_SHARE) * F.col("larger")).select("thash", "other").distinct(), "text-pairs")
        copied = staged(copied_texts(docs, pairs, alike), "copied-texts").withColumn("copied", F.lit(True))
        in_text = in_text.withColumn("other", F.col("first.thash")).join(broadcast_if_small(copied, BROADCAST_ROWS), ["thash", "other"], "left")
        elsewhere = F.coalesce(F.col("thash") != F.col("other"), F.lit(False)) & F.col("copied").isNull()
        # sets of line numbers within one text: bounded by the text
        decided = in_text.select("doc_id", "thash", F.size("all").alias("k"), F.col("first").isNotNull().alias("repeated"), (F.coalesce("links", F.lit(0)) > 0).alias("similar"), F.when(elsewhere, F.col("all")).otherwise(F.array_remove("all", F.col("line_no"))).alias("gone"))
        per_text = decided.groupBy("doc_id", "thash").agg(
            F.sum(F.when(F.col("repeated"), F.col("k")).otherwise(0)).alias("n_repeated"),
            F.sum(F.when(F.col("similar"), F.col("k")).otherwise(0)).alias("n_similar"),
            F.flatten(F.collect_list(F.when(F.size("gone") > 0, F.col("gone")))).alias("gone"),
        ).where("n_repeated > 0 OR n_similar > 0")
        return per_text.select(F.col("doc_id").alias("_id"), F.col("thash").alias("_thash"), F.col("n_repeated").alias("_rep"), F.col("n_similar").alias("_sim"), F.col("gone").alias("_gone"))

    found = staged_alone(decisions, "line-decisions")
    held_rows = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_gone")), F.lit(0)).alias("numbers")).first()
    if max(held_rows["rows"], held_rows["numbers"]) <= BROADCAST_ROWS:
        found = F.broadcast(found)
    base = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), text_of().alias("text")).withColumn("thash", F.xxhash64("text"))
    joined = base.join(found, F.col("key").eqNullSafe(F.col("_id")) & (F.col("thash") == F.col("_thash")), "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    parts = F.split("text", "\n")
    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    added = {"n_lines": F.size(parts), "n_repeated": F.coalesce("_rep", F.lit(0)).cast("int"), "n_similar": F.coalesce("_sim", F.lit(0)).cast("int"), "n_removed": F.size(gone)} if counts else {}
    kept = [(text if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c.lower() not in added]
    return joined.select(*kept, *[column.alias(name) for name, column in added.items()])
