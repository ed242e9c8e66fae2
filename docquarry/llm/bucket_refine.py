"""Removal of repeated byte strings by refinement of suffix buckets.

A byte goes if it lies in a string of ``span`` bytes that also starts anywhere else. Every
such string holds an anchor: the place of the least hashed 16-gram of its first
``span - GRAM + 1`` places, so equal strings have their anchors at equal
offsets, and each string is owned by exactly one anchor. That thins suffixes to one in
about 70 bytes and splits the work:

1. Anchors fall into buckets by the GRAM bytes that follow. A bucket of one ends there.
2. Within a bucket, anchors whose whole stretch of owned strings is equal
   are settled: all those strings repeat.
3. What is left of a bucket is refined: its places start in buckets of 50-grams, and sorting
   by the pair of a place's bucket and the bucket 50 bytes on gives buckets of
   100-grams, whose identifiers, reused with an offset of 100, give those of
   200-grams. Places alone in a bucket drop out at every step. The last step of a bucket
   of very many rows is shared between tasks: its places are grouped by the pair of
   bucket identifiers (of the 100-grams at the place and 100 bytes on).

Texts are named by 64 and 32 bits of two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import rolling
from docquarry.llm.rolling import RangeHash, mix, runs_of
from docquarry.llm.shared import broadcast_if_small, staged, text_of

SPAN = 200
GRAM = 64
#: First places of a string among which its anchor is chosen.
CHOICE = SPAN - GRAM + 1
PICK = 16
#: Rows of a bucket whose refinement one task finishes; the last step of larger ones is a shuffle.
BUCKET_ROWS = 4096
#: Large buckets (one number each) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Bytes of text that are hashed, and of stretches that are refined, at once.
PIECE = 1 << 20
#: Anchors of a task among which equal stretches are combined before the shuffle, and rows of one frame out.
BATCH_ROWS, OUT_ROWS = 500_000, 100_000
#: Anchors of a bucket held at once while its equal stretches are sorted out.
SORT_ROWS = 200_000


def owners(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[RangeHash, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts raw[start:end], and the first and last start of the strings each owns."""
    hashes = RangeHash(raw)
    empty = np.zeros(0, np.int64)
    valid = np.concatenate([np.arange(a, b - SPAN + 1) for a, b in zip(starts, ends, strict=True) if b - a >= SPAN]) if len(starts) else empty
    if not len(valid):
        return hashes, empty, empty, empty
    plain = (hashes.sums[PICK:] - hashes.sums[:-PICK]) * rolling._inverses[: len(raw) - PICK + 1]
    low = ((plain * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) << np.uint64(32)) | np.arange(len(plain), dtype=np.uint64)
    k = 1
    while 2 * k <= CHOICE:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    rest = CHOICE - k
    low = np.minimum(low[: len(low) - rest], low[rest:])
    own = (low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = runs_of(own)
    last = np.append(first[1:], len(own)) - 1
    return hashes, own[first], valid[first], valid[last]


def refine(parts: list[bytes], groups: np.ndarray) -> list[np.ndarray]:
    """For each part, which of its SPAN-byte strings occur twice or more within its group."""
    step = SPAN // 4
    raw = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    hashes = RangeHash(raw)
    offset = np.repeat(np.arange(len(parts)), size)
    inside = np.arange(len(raw)) - begin[offset]
    ids = np.full(len(raw), -1, np.int64)
    at = np.flatnonzero(inside + step <= size[offset])
    tag = mix(groups.astype(np.uint64))
    _, ids[at] = np.unique(hashes.of(at, at + step) + tag[offset[at]], return_inverse=True)
    depth = step
    while True:
        counts = np.bincount(ids[at])
        at = at[counts[ids[at]] > 1]
        if depth == SPAN:
            break
        alive = np.zeros(len(raw) + 1, bool)
        alive[at] = True
        at = at[(inside[at] + 2 * depth <= size[offset[at]])]
        at = at[alive[at + depth]]
        # the bucket pointers of this depth order and name the buckets of twice the depth
        pair = ids[at] * (len(raw) + 1) + ids[at + depth]
        ids = np.full(len(raw), -1, np.int64)
        if len(at):
            _, ids[at] = np.unique(pair, return_inverse=True)
        depth *= 2
        if not len(at):
            break
    out = np.zeros(len(raw), bool)
    out[at] = True
    return [out[b : b + max(0, n - SPAN + 1)] for b, n in zip(begin, size, strict=True)]


def spans_of(flags: np.ndarray, base: int) -> list[tuple[int, int]]:
    """Byte ranges covered by strings that start at the flagged places, counted from base."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(base + int(a), base + int(b) - 1 + SPAN) for a, b in zip(edge[::2], edge[1::2], strict=True)]


ANCHORS = "gram long, stretch long, thash long, tag int, start int, bytes int, many boolean, done boolean"
NAME = ["thash", "tag"]


def with_name(docs: DataFrame) -> DataFrame:
    """``text`` (null: empty) with its name, ``thash`` and ``tag``."""
    return docs.withColumn("text", text_of()).withColumns({"thash": F.xxhash64(text_of()), "tag": F.hash(text_of())})


def pieces(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Texts in turn, in pieces of PIECE bytes: the bytes, the ends of the texts in them, their
    numbers and the place of each in its text, and whether its text goes on behind the piece.

    A long text is cut where a stretch begins, so that all its stretches stay whole.
    """
    at = 0
    while at < len(raws):
        if len(raws[at]) > PIECE:
            begin = 0
            while True:
                raw = np.frombuffer(raws[at], np.uint8, min(PIECE, len(raws[at]) - begin), begin)
                more = begin + PIECE < len(raws[at])
                cut = yield raw, np.array([len(raw)]), np.array([at]), np.array([begin]), more
                if not more:
                    break
                begin += cut
            at += 1
            continue
        stop, total = at, 0
        while stop < len(raws) and total + len(raws[stop]) <= PIECE:
            total += len(raws[stop])
            stop += 1
        yield np.frombuffer(b"".join(raws[at:stop]), np.uint8), np.cumsum([len(r) for r in raws[at:stop]]), np.arange(at, stop), np.zeros(stop - at, np.int64), False
        at = stop


def combined(rows: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Anchor rows of one task. Equal stretches in them are settled at once (done); one of
    them stands for all (many), so that a frequent passage sends a row per batch and not
    a row per copy."""
    gram, stretch, thash, tag, start, size = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((start, tag, thash, stretch, gram))
    same = np.ones(len(order) - 1, bool)
    for x in (gram, stretch):
        same &= x[order[1:]] == x[order[:-1]]
    again = same.copy()
    for x in (thash, tag, start):
        again &= x[order[1:]] == x[order[:-1]]
    fresh = np.concatenate(([True], ~again))  # copies of one text say the same
    begins = np.concatenate(([True], ~same))[fresh]
    order = order[fresh]
    twice = (np.bincount(np.cumsum(begins) - 1) > 1)[np.cumsum(begins) - 1]
    dealt = mix(start.astype(np.uint64) ^ thash.view(np.uint64)).view(np.int64)
    for at, key, many, done in ((order[~twice], gram, False, False), (order[twice & begins], gram, True, False), (order[twice], dealt, False, True)):
        for lo in range(0, len(at), OUT_ROWS):
            some = at[lo : lo + OUT_ROWS]
            yield pd.DataFrame({"gram": key[some], "stretch": stretch[some], "thash": thash[some], "tag": tag[some], "start": start[some], "bytes": size[some], "many": many, "done": done})


def anchor_rows(texts: DataFrame) -> DataFrame:
    """A row for each anchor: the bucket, the hash of its stretch of owned strings, and
    where that stretch lies."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0
        for frame in frames:
            thash, tag = frame["thash"].to_numpy(), frame["tag"].to_numpy()
            raws = [t.encode() for t in frame["text"]]
            turns, cut = pieces(raws), None
            while True:
                try:
                    raw, ends, number, base, more = turns.send(cut)
                except StopIteration:
                    break
                starts = np.concatenate(([0], ends[:-1]))
                hashes, anchor, first, last = owners(raw, starts, ends)
                cut = int(first[-1]) if more else None
                if more:  # the last stretch may go on
                    anchor, first, last = anchor[:-1], first[:-1], last[:-1]
                if not len(anchor):
                    continue
                doc = np.searchsorted(ends, anchor, "right")
                stretch = hashes.of(first, last + SPAN) ^ mix((anchor - first).astype(np.uint64))
                place = (base[doc] + first - starts[doc]).astype(np.int32)
                rows.append((hashes.of(anchor, anchor + GRAM).view(np.int64), stretch.view(np.int64), thash[number[doc]], tag[number[doc]], place, (last + SPAN - first).astype(np.int32)))
                held += len(anchor)
                if held > BATCH_ROWS:
                    yield from combined(rows)
                    rows, held = [], 0
        if rows:
            yield from combined(rows)

    return texts.mapInPandas(emit, ANCHORS)


def _held_runs(frames: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
    """Sorted frames cut between runs of keys[0]; a run of over ``most`` rows comes in
    parts cut between runs of all keys. With each: whether it is such a part, and the last of its run."""
    held: pd.DataFrame | None = None
    open_key = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        held = None
        key = frame[keys[0]].to_numpy()
        if open_key is not None:
            n = int(np.searchsorted(key != open_key, True)) if key[0] == open_key else 0
            if n == len(frame):
                fine = runs_of(frame[keys[1]].to_numpy())[-1]
                if fine:
                    yield frame.iloc[:fine], True, False
                held = frame.iloc[fine:]
                continue
            if n:
                yield frame.iloc[:n], True, True
            open_key, frame, key = None, frame.iloc[n:].reset_index(drop=True), key[n:]
        tail = runs_of(key)[-1]
        if tail:
            yield frame.iloc[:tail], False, True
        held = frame.iloc[tail:].reset_index(drop=True)
        if len(held) > most:
            open_key = key[-1]
            fine = runs_of(held[keys[1]].to_numpy())[-1]
            if fine:
                yield held.iloc[:fine], True, False
            held = held.iloc[fine:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, open_key is not None, True


PLACES = "gram long, thash long, tag int, start int, bytes int, kind int"
SETTLED, OPEN, WITNESS = 0, 1, 2


def sort_buckets(anchors: DataFrame) -> DataFrame:
    """Settles what it can: SETTLED stretches repeat whole, OPEN ones must be refined,
    and WITNESS ones (one for each settled stretch of a bucket with open ones) take part in that."""

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, large, _ in _held_runs(frames, ["gram", "stretch"], SORT_ROWS):
            ready = part[part["done"]]
            if len(ready):
                yield ready[["gram", *NAME, "start", "bytes"]].assign(kind=SETTLED)
            part = part[~part["done"]]
            if not len(part):
                continue
            gram = part["gram"].to_numpy()
            fine = np.stack([gram, part["stretch"].to_numpy(), *(part[c].to_numpy().astype(np.int64) for c in (*NAME, "start"))], 1)
            new = np.ones(len(part), bool)
            new[1:] = (fine[1:] != fine[:-1]).any(1)  # copies of one text say the same
            many = np.logical_or.reduceat(part["many"].to_numpy(), np.flatnonzero(new))
            part, fine, gram = part[new], fine[new], gram[new]
            begins = np.ones(len(part), bool)
            begins[1:] = (fine[1:, :2] != fine[:-1, :2]).any(1)
            run = np.cumsum(begins) - 1
            settled = ((np.bincount(run) > 1) | np.logical_or.reduceat(many, np.flatnonzero(begins)))[run]
            bucket = np.cumsum(np.concatenate(([True], gram[1:] != gram[:-1]))) - 1
            has_open = np.bincount(bucket, weights=~settled)[bucket] > 0
            alone = ((np.bincount(bucket) == 1)[bucket]) & ~settled & (not large)
            out = part[["gram", *NAME, "start", "bytes"]].assign(kind=np.where(settled, SETTLED, OPEN))[~alone]
            witness = settled & begins & (has_open | large)
            yield pd.concat([out, part[witness][["gram", *NAME, "start", "bytes"]].assign(kind=WITNESS)])

    return anchors.repartition("gram").sortWithinPartitions("gram", "stretch", *NAME, "start").mapInPandas(settle, PLACES)


def small_parts(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A sorted frame cut between buckets, in parts of about PIECE bytes."""
    starts = runs_of(part["gram"].to_numpy())
    ends = np.append(starts[1:], len(part))
    reach = np.cumsum(part["raw"].map(len).to_numpy())
    lo = 0
    while lo < len(starts):
        before = reach[starts[lo] - 1] if starts[lo] else 0
        hi = max(lo + 1, int(np.searchsorted(reach[ends - 1], before + PIECE, "right")))
        yield part.iloc[starts[lo] : ends[hi - 1]]
        lo = hi


def places_of(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A row for each place of stretches of large buckets, with the identifiers of its two halves' buckets.

    Places that repeat within the part are settled at once; one of them stands for all.
    """
    raw, half = part["raw"].tolist(), SPAN // 2
    hashes = RangeHash(np.frombuffer(b"".join(raw), np.uint8))
    size = np.array([len(r) for r in raw], np.int64)
    n = size - SPAN + 1
    row = np.repeat(np.arange(len(raw)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    spot = (np.cumsum(size) - size)[row] + inner
    ids = [hashes.of(spot + k, spot + k + half).view(np.int64) for k in (0, half)]
    out = pd.DataFrame({c: part[c].to_numpy()[row] for c in ("gram", *NAME, "start", "kind")}).assign(raw=None, bytes=SPAN, near=ids[0], far=ids[1])
    out["start"] += inner
    twice = out.duplicated(["near", "far"], keep=False).to_numpy()
    yield out[twice & (out["kind"] == OPEN)].assign(near=None, far=None)
    out.loc[twice, "kind"] = WITNESS
    yield out[~(twice & out.duplicated(["near", "far"]).to_numpy())]


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``thash, tag, ranges``: byte ranges (start * 2**31 + length, unsorted, maybe overlapping) covered by repeated strings of each text."""
    texts = with_name(docs.select("text")).where(F.octet_length("text") >= SPAN)
    places = staged(sort_buckets(anchor_rows(texts)), "places")
    open_places = places.where(F.col("kind") != SETTLED)
    # at most one row for each BUCKET_ROWS places
    large = open_places.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select("gram", F.lit(True).alias("large"))
    marked = open_places.join(broadcast_if_small(large, BROADCAST_ROWS), "gram", "left")
    wanted = marked.groupBy(*NAME).agg(F.collect_list(F.struct("gram", "start", "bytes", "kind", F.coalesce("large", F.lit(False)).alias("large"))).alias("want"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Stretches of small buckets, and the places of large ones."""
        columns = ["gram", *NAME, "start", "kind", "raw"]
        for frame in frames:
            rows: dict[bool, list[tuple]] = {False: [], True: []}
            for text, thash, tag, want in frame.drop_duplicates(NAME)[["text", *NAME, "want"]].itertuples(index=False):
                raw = text.encode()
                for w in want:
                    rows[w["large"]].append((w["gram"], thash, tag, w["start"], w["kind"], raw[w["start"] : w["start"] + w["bytes"]]))
                if len(rows[False]) > OUT_ROWS // 4:
                    yield pd.DataFrame(rows[False], columns=columns).assign(bytes=0, near=None, far=None)
                    rows[False] = []
                if len(rows[True]) > BUCKET_ROWS:
                    yield from places_of(pd.DataFrame(rows[True], columns=columns))
                    rows[True] = []
            yield pd.DataFrame(rows[False], columns=columns).assign(bytes=0, near=None, far=None)
            if rows[True]:
                yield from places_of(pd.DataFrame(rows[True], columns=columns))

    # copies of a text give equal rows, which count once below
    schema = "gram long, thash long, tag int, start int, kind int, raw binary, bytes int, near long, far long"
    stretches = staged(texts.join(wanted, NAME).mapInPandas(cut, schema), "stretches")

    def refined(part: pd.DataFrame) -> pd.DataFrame:
        """The repeated ranges of whole buckets."""
        found = []
        for flags, thash, tag, start, kind in zip(refine(part["raw"].tolist(), part["gram"].to_numpy()), part["thash"], part["tag"], part["start"], part["kind"], strict=True):
            if kind == OPEN and flags.any():
                found += [(thash, tag, a, b - a) for a, b in spans_of(flags, start)]
        return pd.DataFrame(found, columns=[*NAME, "start", "bytes"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, _ in _held_runs(frames, ["gram", "thash"], 1 << 62):
            for some in small_parts(part.drop_duplicates(["gram", *NAME, "start"])):
                yield refined(some)

    small = stretches.where("raw IS NOT NULL").select("gram", *NAME, "start", "kind", "raw")
    seen = small.repartition("gram").sortWithinPartitions("gram", *NAME, "start").mapInPandas(search, "thash long, tag int, start int, bytes int")
    single = stretches.where("near IS NOT NULL")
    # places of large buckets: a pair of identifiers met by two places repeats
    place = F.struct(*NAME, "start")
    pairs = single.groupBy("near", "far").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("near", "far")
    late = single.where(F.col("kind") == OPEN).join(pairs, ["near", "far"])
    columns = [*NAME, "start", "bytes"]
    ranges = places.where(F.col("kind") == SETTLED).select(*columns).unionByName(seen).unionByName(late.select(*columns))
    ranges = ranges.unionByName(stretches.where("raw IS NULL AND near IS NULL").select(*columns))
    return ranges.groupBy(*NAME).agg(F.collect_list(F.col("start").cast("long") * F.lit(1 << 31) + F.col("bytes")).alias("ranges"))


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, binary, if asked).

    Every text is taken as UTF-8 bytes, null as none; matches never cross
    documents, and strings are judged on the input. Texts that occur twice (repeated
    rows too) repeat whole if they have 200 bytes. An empty table gives no rows.
    """
    rows = with_name(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    copies = rows.where(F.octet_length("text") >= SPAN).groupBy(*NAME).agg(F.count("*").alias("n")).where("n > 1")
    found = staged(repeated_ranges(docs).join(copies, NAME, "full").select(*NAME, "ranges", F.col("n").isNotNull().alias("whole")), "repeats")

    def strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, ranges, whole in zip(frame["doc_id"], frame["text"], frame["ranges"], frame["whole"], strict=True):
                raw = text.encode()
                if whole is True or (whole is not None and bool(whole) and not pd.isna(whole)):
                    kept, removed, spans = b"", len(raw), 1
                elif ranges is None:
                    kept, removed, spans = raw, 0, 0
                else:
                    packed = np.sort(np.asarray(ranges, np.int64))
                    start, end = packed >> 31, (packed >> 31) + (packed & ((1 << 31) - 1))
                    reach = np.maximum.accumulate(end)
                    new = np.concatenate(([True], start[1:] > reach[:-1]))
                    a, b = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                    kept = b"".join(raw[x:y] for x, y in zip(np.concatenate(([0], b)).tolist(), np.concatenate((a, [len(raw)])).tolist(), strict=True))
                    removed, spans = int((b - a).sum()), len(a)
                out.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            done = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            done["doc_id"] = done["doc_id"].astype("Int64")
            yield done

    joined = rows.join(found, NAME, "left").select("doc_id", "text", "ranges", "whole")
    result = joined.mapInPandas(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return result if keep_text else result.drop("kept")
