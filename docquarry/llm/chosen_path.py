"""Chosen-path join: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Sets are represented by MinHash coordinates (equal in two sets with probability
their similarity). A run starts with all sets in one bucket; a bucket is split by
sampled coordinates, so that sets meet again where they share the sampled token.
Buckets of one set vanish; small ones are brute-forced; in larger ones a pivot is
compared with all others, what is very close to it leaves, and the rest is split
again. Runs repeat until the chance to miss a pair is below ``miss``.

Buckets give candidate links only. Texts tied by candidate links form candidate
groups, and within each the exact similarities are computed: every text goes
to one group, so no pair is verified twice and no list of pairs is ever written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.components import connected_components
from docquarry.llm.rolling import RangeHash, mix, runs_of
from docquarry.llm.shared import join_hot, staged, staged_alone, text_of, unstaged
from docquarry.llm.shingles import WORDS, clean_text

COORDS = 128
#: Children of a node, and coordinates sampled for each: sets must share all of them, which
#: similar ones do with probability 0.8**2 and sets with one common passage hardly ever.
SPLIT, TAKE = 3, 2
SMALL = 256
#: Estimated similarity from which two sets are candidates, and from which a set
#: leaves the bucket with its pivot. A set with J >= 0.8 to one that left (J about
#: 0.7 or more to the pivot) has J >= 0.5 to the pivot, above LINK.
LINK, LEAVE = 0.4, 0.7
#: Candidate texts up to this number are picked by a broadcast of their digests
#: (some 50 bytes each); beyond, by a shuffle join.
BROADCAST_TEXTS = 300_000
#: Shingles of one block in verification; larger groups are verified by pairs of blocks.
BLOCK_SHINGLES = 500_000
BLOCK_TEXTS = 1024
#: Copies from which on a text's facts are broadcast, if that is true of at most HOT_KEYS texts.
HOT_COPIES, HOT_KEYS = 200, 200_000

_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 62, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64)


def shingle_sets(cleans: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each clean text (words parted by one space)."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(cleans):
        stop, size = at, 0
        while stop < len(cleans) and (stop == at or size + len(cleans[stop]) < 1 << 18):
            size += len(cleans[stop])
            stop += 1
        raws = [c.encode("utf-8", "replace") for c in cleans[at:stop]]
        raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        hashes = RangeHash(raw)
        spaces = np.flatnonzero(raw == 32)
        starts = np.concatenate(([0], spaces[:-1] + 1))  # of words; empty texts are empty words
        begin = 0
        for r in raws:
            end = begin + len(r)
            first, last = np.searchsorted(starts, begin), np.searchsorted(spaces, end)  # last word's place
            n = last - first + 1 - (WORDS - 1)
            out.append(np.unique(hashes.of(starts[first : first + n], spaces[first + WORDS - 1 : last + 1])) if n > 0 and len(r) else np.zeros(0, np.uint64))
            begin = end + 1
        at = stop
    return out


def minhash(tokens: np.ndarray) -> np.ndarray:
    """COORDS coordinates of 32 bits."""
    best = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 2048):
        best = np.minimum(best, (tokens[at : at + 2048, None] * _MUL + _ADD).min(0))
    return (best >> np.uint64(32)).astype(np.uint32)


def chosen(path: np.ndarray, level: int, child: int) -> np.ndarray:
    """The coordinates sampled for a child of each node (path) of the tree: [nodes, TAKE], different ones."""
    h = mix(path + np.array([level * SPLIT + child + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    one = (h >> np.uint64(8)) % np.uint64(COORDS)
    two = (one + np.uint64(1) + (h >> np.uint64(36)) % np.uint64(COORDS - 1)) % np.uint64(COORDS)
    return np.stack([one, two], 1).astype(np.int64)


def children(path: np.ndarray, sigs: np.ndarray, level: int) -> np.ndarray:
    """The child buckets of each row: its path and the values of the sampled coordinates."""
    out = []
    for child in range(SPLIT):
        values = np.take_along_axis(sigs, chosen(path, level, child), 1).astype(np.uint64)
        below = path * np.uint64(0xD1342543DE82EF95) + np.uint64(child)
        for k in range(TAKE):
            below = mix(below + values[:, k])
        out.append(below)
    return np.stack(out, 1)


def runs_needed(similarity: float, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / (SPLIT * math.log(1 - similarity**TAKE))))


def _sigs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.tolist()), np.uint32).reshape(-1, COORDS)


def whole_runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Sorted frames cut anew so that no run of equal keys is split between two."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        cut = runs_of(keys)[-1]
        if cut == 0 and held and held[-1][key].iloc[-1] == keys[0]:
            held.append(frame)
            continue
        if cut:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = [frame.iloc[cut:]]
        else:
            if held:
                yield pd.concat(held, ignore_index=True)
            held = [frame]
    if held:
        yield pd.concat(held, ignore_index=True)


def pivot_links(path: np.ndarray, node: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links within small buckets: pivots in turn against what is left of their bucket."""
    a, b = [], []
    rows = np.arange(len(path))
    while len(rows):
        starts = runs_of(path[rows])
        pivot = rows[np.repeat(starts, np.diff(np.append(starts, len(rows))))]
        like = (sigs[rows] == sigs[pivot]).mean(1)
        link = (like >= LINK) & (rows != pivot)
        a.append(node[rows[link]])
        b.append(node[pivot[link]])
        rows = rows[(like < LEAVE) & (rows != pivot)]
    return np.concatenate(a) if a else node[:0], np.concatenate(b) if b else node[:0]


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least node that it reaches over the links a, b: they tie the same nodes."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    roots = np.arange(len(names))
    while True:
        low = np.minimum(roots[a], roots[b])
        new = roots.copy()
        for ends in (a, b, roots[a], roots[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == roots).all():
            break
        roots = new
    far = roots != np.arange(len(names))
    return names[far], names[roots[far]]


def candidate_links(sketches: DataFrame) -> DataFrame:
    """``a, b``: links that tie together all texts that may be similar.

    ``sketches`` has node, sig and paths (the buckets of the first split).
    """
    level = 1
    live = sketches.select(F.explode("paths").alias("path"), "node")
    sig = sketches.select("node", "sig")
    found: DataFrame | None = None

    def brute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_runs(frames, "path"):
            a, b = pivot_links(frame["path"].to_numpy(), frame["node"].to_numpy(), _sigs(frame["sig"]))
            node, root = contracted(a, b)
            yield pd.DataFrame({"a": node, "b": root})

    def by_pivot(here: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                sigs, node = _sigs(frame["sig"]), frame["node"].to_numpy()
                like = (sigs == _sigs(frame["pivot_sig"])).mean(1)
                link = (like >= LINK) & (node != frame["pivot"])
                stay = ((like < LEAVE) & (node != frame["pivot"])).to_numpy()
                many = frame["paths"].to_numpy()[stay]
                times = np.array([len(p) for p in many], np.int64)
                paths = np.concatenate(many) if len(many) else np.zeros(0, np.int64)
                below = children(paths.astype(np.uint64), np.repeat(sigs[stay], times, axis=0), here).astype(np.int64)
                yield pd.DataFrame({"path": below.ravel(), "node": np.repeat(np.repeat(node[stay], times), SPLIT), "pivot": None})
                yield pd.DataFrame({"path": 0, "node": node[link], "pivot": frame["pivot"][link]})

        return split

    while True:  # it ends: every split takes each bucket's pivot and all that is like it away
        sizes = live.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
        known = staged(live.join(sizes, "path"), f"buckets-{level}")
        small = known.where(F.col("n") <= SMALL).select("path", "node")
        links = small.join(sig, "node").repartition("path").sortWithinPartitions("path", "node").mapInPandas(brute, "a long, b long")
        found = links if found is None else found.unionByName(links)
        large = known.where(F.col("n") > SMALL)
        if not large.limit(1).count():
            return found
        pivots = large.select("pivot").distinct().join(sig.withColumnRenamed("node", "pivot"), "pivot").withColumnRenamed("sig", "pivot_sig")
        # a text often meets the same pivot in several buckets: they are compared once
        met = large.groupBy("pivot", "node").agg(F.collect_list("path").alias("paths"))
        parted = staged(met.join(sig, "node").join(pivots, "pivot").select("paths", "node", "sig", "pivot", "pivot_sig").mapInPandas(by_pivot(level), "path long, node long, pivot long"), f"split-{level}")
        found = found.unionByName(parted.where("pivot IS NOT NULL").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")))
        live = parted.where("pivot IS NULL").select("path", "node").distinct()
        level += 1


def similar(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least num / den: exact, by counting shared shingles."""
    sides = [left] if right is left else [left, right]
    tokens = np.concatenate([x for side in sides for x in side])
    rows = np.concatenate([np.repeat(np.arange(len(side)) + (len(left) if k else 0), [len(x) for x in side]) for k, side in enumerate(sides)])
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1  # a shingle of one text is in no intersection
    inverse, rows = inverse[shared], rows[shared]
    _, inverse = np.unique(inverse, return_inverse=True)
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(inverse, kind="stable")
    inverse, rows = inverse[order], rows[order]
    width = 2048
    for at in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, width):
        lo, hi = np.searchsorted(inverse, [at, at + width])
        table = np.zeros((len(left) + (0 if right is left else len(right)), width), np.float32)
        table[rows[lo:hi], inverse[lo:hi] - at] = 1
        common += table[: len(left)] @ (table if right is left else table[len(left) :]).T
    a = np.array([len(x) for x in left], np.float64)[:, None]
    b = np.array([len(x) for x in right], np.float64)[None]
    return (num + den) * common.astype(np.float64) >= num * (a + b)


def tied_roots(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least name that each row of ``left`` and of ``right`` reaches over the links between them."""

    def least(table: np.ndarray, names: np.ndarray) -> np.ndarray:
        return np.concatenate([np.where(table[at : at + 256], names, np.iinfo(np.int64).max).min(1) for at in range(0, len(table), 256)])

    while True:
        new_right = np.minimum(right, least(links.T, left))
        new_left = np.minimum(left, least(links, new_right))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def verify(texts: DataFrame, num: int, den: int) -> DataFrame:
    """``node, links, root, inner`` for the texts (node, grp, clean, copies, size) of candidate groups.

    ``links`` counts documents of other, similar texts; ``root`` ties similar texts.
    ``inner`` marks the one row of each node from the comparison of its own block.
    A group that fits one block is compared in one task; a larger one is cut into
    blocks by a hash of the node, and each pair of blocks is a task of bounded size.
    """
    sums = texts.groupBy("grp").agg(F.sum("size").alias("tokens"), F.count("*").alias("members"))
    blocks = F.greatest(F.ceil(F.col("tokens") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_TEXTS)).cast("int")
    cut = texts.join(sums.select("grp", blocks.alias("blocks")), "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = pairs.select("node", "clean", "copies", "own", "grp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    task = task.withColumn("task", F.xxhash64("grp", "low", "high"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_runs(frames, "task"):
            task_of = frame["task"].to_numpy()
            starts = runs_of(task_of)
            out = []
            for lo, hi in zip(starts, np.append(starts[1:], len(frame)), strict=True):
                part = frame.iloc[lo:hi]
                node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
                sets = shingle_sets(part["clean"].tolist())
                mine = (part["own"] == part["low"]).to_numpy()
                if mine.all() or not mine.any():
                    if part["low"].iloc[0] != part["high"].iloc[0]:
                        continue
                    like = similar(sets, sets, num, den)
                    np.fill_diagonal(like, False)
                    out.append(pd.DataFrame({"node": node, "links": like @ copies, "root": tied_roots(like, node, node)[0], "inner": True}))
                else:
                    left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
                    like = similar([sets[i] for i in left], [sets[i] for i in right], num, den)
                    roots = np.concatenate(tied_roots(like, node[left], node[right]))
                    out.append(pd.DataFrame({"node": node[np.concatenate([left, right])], "links": np.concatenate([like @ copies[right], like.T @ copies[left]]), "root": roots, "inner": False}))
            if out:
                yield pd.concat(out)

    ready = task.repartition("task").sortWithinPartitions("task", "node")
    return ready.mapInPandas(compare, "node long, links long, root long, inner boolean")


def block_ties(checked: DataFrame) -> DataFrame:
    """``a, b``: links with the components of verified texts.

    Texts are tied to their root within their own block; across blocks only
    those roots are tied, so a large group adds a few links for each pair of its
    blocks and not one for each text and block.
    """
    local = checked.where("inner").select("node", F.col("root").alias("local"))
    across = checked.where("NOT inner AND node <> root").join(local, "node").select(F.col("local").alias("a"), "root").distinct()
    across = across.join(local.withColumnRenamed("node", "root"), "root").select("a", F.col("local").alias("b")).where("a <> b").distinct()
    return local.where("node <> local").select(F.col("node").alias("a"), F.col("local").alias("b")).unionByName(across)


def similar_classes(docs: DataFrame, num: int = 4, den: int = 5, miss: float = 1e-10) -> DataFrame:
    """``doc_id, class_id, n_links, digest``: one row per document.

    Documents are linked if the Jaccard similarity of their shingle sets is at least
    ``num / den``, or if their words are equal (this is how texts under five words
    are linked, and empty or null ones). ``n_links`` counts the other
    documents linked to this one; classes are the connected components, named by
    their least doc_id (null only if all its ids are null). Repeated rows are copies
    of one another. An empty table gives no rows; other columns are not read.
    """
    runs = runs_needed(num / den, miss)
    # coordinates of a run's first split are drawn from all, so runs differ
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                some = frame.iloc[at : at + 1000]
                sets = shingle_sets(some["clean"].tolist())
                sigs = np.stack([minhash(s) for s in sets]) if sets else np.zeros((0, COORDS), np.uint32)
                paths = np.concatenate([children(np.full(len(sigs), r), sigs, 0) for r in roots], 1).astype(np.int64)
                sizes = [len(s) for s in sets]
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "digest": some["digest"].to_numpy(), "size": sizes, "sig": [s.tobytes() for s in sigs], "paths": [np.unique(p) if n else p[:0] for p, n in zip(paths, sizes, strict=True)]})

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text(text_of()).alias("clean"))
    with_digest = clean.select("doc_id", "clean", F.md5("clean").alias("digest"))
    sketched = staged(with_digest.mapInPandas(sketch, "doc_id long, digest string, size int, sig binary, paths array<long>"), "sketched")
    members = staged(sketched.select("doc_id", "digest"), "members")
    copies = members.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    distinct = sketched.where("size > 0").dropDuplicates(["digest"]).select("digest", "size", "sig", "paths", F.monotonically_increasing_id().alias("node"))
    sketches = staged(distinct, "sketches")
    unstaged(sketched)  # the largest table: what is left to do reads the distinct ones

    def grouped() -> DataFrame:
        groups = connected_components(candidate_links(sketches))
        return groups.select("node", F.col("root").alias("grp")).join(sketches.select("node", "digest", "size"), "node").join(copies, "digest")

    named = staged_alone(grouped, "groups")
    unstaged(sketches)
    # the texts of candidate groups only; equal ones count once
    wanted = named.select("digest")
    if wanted.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    # copies of a text are put together before the shuffle
    once = with_digest.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("clean").alias("clean"))
    texts = once.join(named, "digest").select("node", "grp", "clean", "copies", "size")

    def by_text() -> DataFrame:
        checked = staged(verify(texts, num, den), "verified")
        links = checked.groupBy("node").agg(F.sum("links").alias("links"))
        classes = connected_components(block_ties(checked))
        least = classes.join(named.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("class_id"))
        return named.select("node", "digest").join(links, "node").join(classes, "node", "left").join(least, "root", "left").select("digest", "links", "class_id", F.col("root").isNotNull().alias("tied"))

    by_digest = staged_alone(by_text, "classes")
    unstaged(named)
    facts = copies.join(by_digest, "digest", "left").select("digest", F.struct("copies", "first", "links", "class_id", "tied").alias("fact"))
    joined = join_hot(members, facts, ["digest"], F.col("fact.copies") > HOT_COPIES, HOT_KEYS).select("doc_id", "digest", "fact.*")
    return joined.select("doc_id", F.when(F.coalesce(F.col("tied"), F.lit(False)), F.col("class_id")).otherwise(F.col("first")).alias("class_id"), (F.coalesce(F.col("links"), F.lit(0)) + F.col("copies") - 1).alias("n_links"), "digest")


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS c FROM documents),
t AS MATERIALIZED (SELECT c, count(*) AS copies, min(doc_id) AS node, string_split(c, ' ') AS w FROM d GROUP BY c),
s AS MATERIALIZED (SELECT DISTINCT node, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT node, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
n AS MATERIALIZED (SELECT node, count(*) AS n FROM s GROUP BY node),
p AS MATERIALIZED (SELECT x.node AS a, y.node AS b FROM s x JOIN s y ON x.g = y.g AND x.node <> y.node JOIN n nx ON nx.node = x.node JOIN n ny ON ny.node = y.node
  GROUP BY x.node, y.node, nx.n, ny.n HAVING 9 * count(*) >= 4 * (nx.n + ny.n)),
r AS (SELECT node AS a, node AS b FROM t UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a AS node, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT p.a AS node, sum(t.copies) AS links FROM p JOIN t ON t.node = p.b GROUP BY p.a)
SELECT d.doc_id, k.class_id, CAST(coalesce(l.links, 0) + t.copies - 1 AS BIGINT) AS n_links
FROM d JOIN t ON t.c = d.c JOIN k ON k.node = t.node LEFT JOIN l ON l.node = t.node
"""
