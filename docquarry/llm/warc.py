"""WARC archives with a two-level capture index.

Records are gzip members of archive files in the shared folder. The index sorts
captures by their reversed-host URL key, packs the sorted lines into compressed
blocks, and keeps a sparse directory with the first key of each block. A lookup
goes from the first keys of the index files (one per file) to the directory of
one file, from there by binary search to one block, and reads only that range;
the captures found are range reads of the archives.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import broadcast_if_small, new_folder, staged, text_of

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads that are broadcast at most, so that pages are not shuffled by digest.
GROUPS = 500_000
CAPTURES = "surt string, page_id long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Reversed host, then the rest: ``http://www.a.com/b?c`` becomes ``com,a,www)/b?c``.

    Scheme, user, port and fragment are dropped, host and scheme ignore case; a
    null URL gives ``)/``.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"\s", "%20"), "^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^[^@]*@|:[0-9]*$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest)))


def with_record_types(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, html, digest, n_bytes, record_type, refers_to``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with
    the largest page_id is the response and the others revisit it (rows that
    share that largest id are all responses). A null html is an empty payload; a
    null page_id is below all others, and a group of null ids has only responses.
    """
    html = text_of("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    groups = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("last")).where("copies > 1").select("digest", "last")
    # a hundred bytes for each group; beyond GROUPS of them by shuffle
    joined = rows.join(broadcast_if_small(groups, GROUPS), "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", "digest", "n_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, date: str) -> bytes:
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    where = "".join(c if c > " " else "%%%02X" % ord(c) for c in (url or f"urn:page:{page_id}"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    more = "" if refers_to is None else f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {name(refers_to)}\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name(page_id)}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {where}\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; its payload's length and digest are taken from the payload where there is one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    ident = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])
    out = {"page_id": ident(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "refers_to": ident(fields.get("warc-refers-to"))}
    if out["record_type"] == "response":
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        if out["payload_digest"] != said:
            raise ValueError(f"the payload of {out['url']} does not match its digest")
    else:
        length = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
        out |= {"payload": b"", "payload_bytes": int(length[16:]), "payload_digest": said}
    return out


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(typed: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes one archive per task below ``folder``; gives a row per capture, staged.

    A task that runs again writes a file of another name; the staged rows name
    only files of tasks that were committed.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _opened(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for frame in frames:
            if out is None and len(frame):
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}", compression=None)
            places = []
            ids = [None if pd.isna(x) else int(x) for x in frame["page_id"]]
            refers = [None if pd.isna(x) else int(x) for x in frame["refers_to"]]
            for page, url, html, digest, n, refer in zip(ids, frame["url"], frame["html"], frame["digest"], frame["n_bytes"], refers, strict=True):
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(record(page, url if isinstance(url, str) else None, html.encode(), digest, int(n), refer, date)) + pack.flush()
                out.write(member)
                places.append((at, len(member)))
                at += len(member)
            yield pd.DataFrame({"surt": frame["surt"], "page_id": pd.array(ids, "Int64"), "file": name, "offset": [p[0] for p in places], "length": [p[1] for p in places]})
        if out is not None:
            out.close()

    rows = typed.withColumn("surt", url_key(F.col("url")))
    return staged(rows.mapInPandas(write, CAPTURES), "captures")


@dataclass
class CaptureIndex:
    folder: str
    archives: str
    files: list[tuple[str, str]]  # (first key, name) of each index file, sorted


def _line_key(surt: Column, page_id: Column) -> Column:
    return F.concat(surt, F.lit(" "), F.lpad(F.coalesce(page_id.cast("string"), F.lit("null")), 20, "0"))


def build_index(captures: DataFrame, archives: str, folder: str, block_lines: int = 1000, lines_per_file: int = 250_000) -> CaptureIndex:
    """Sorts captures by key over all tasks; each task writes one file of blocks and its directory.

    Only the first key of each file reaches the driver: one row per ``lines_per_file`` captures.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _opened(folder)
        name, out, at, held, blocks = uuid.uuid4().hex, None, 0, [], []

        def close_block() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(f"{k}\t{v}" for k, v in held).encode())
            out.write(raw)
            blocks.append([held[0][0], at, len(raw)])
            at += len(raw)
            held.clear()

        for frame in frames:
            if out is None and len(frame):
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}.blocks", compression=None)
            for key, file, offset, length in zip(frame["key"], frame["file"], frame["offset"], frame["length"], strict=True):
                held.append((key, f"{file}\t{offset}\t{length}"))
                if len(held) == block_lines:
                    close_block()
        if out is not None:
            if held:
                close_block()
            out.close()
            with store.open_output_stream(f"{top}/{name}.dir") as f:
                f.write(json.dumps(blocks).encode())
            yield pd.DataFrame({"first": [blocks[0][0]], "name": [name]})

    keyed = captures.select(_line_key(F.col("surt"), F.col("page_id")).alias("key"), "file", "offset", "length")
    parts = max(1, -(-captures.count() // lines_per_file))
    ordered = keyed.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    files = staged(ordered.mapInPandas(write, "first string, name string"), "index-files").collect()
    return CaptureIndex(folder, archives, sorted((r["first"], r["name"]) for r in files))


def lookup(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """``keys`` has one column ``key``: a URL key, alone (all its captures) or with a padded page id.

    Gives key, file, offset and length of every capture found.
    """
    files = index.files

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts = [f[0] for f in files]
        for frame in frames:
            rows = []
            for key in frame["key"]:
                low = max(0, bisect_left(firsts, key) - 1)
                high = max(low + 1, bisect_right(firsts, key + "!"))
                rows += [(key, k) for k in range(low, min(high, len(files)))]
            yield pd.DataFrame(rows, columns=["key", "nth"])

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _opened(index.folder)
        now, blocks, firsts, source, kept_at, kept = None, [], [], None, None, ([], [])
        for frame in frames:
            rows = []
            for key, nth in zip(frame["key"], frame["nth"], strict=True):
                if nth != now:
                    now = nth
                    with store.open_input_stream(f"{top}/{files[nth][1]}.dir") as f:
                        blocks = json.loads(f.read())
                    firsts, source, kept_at = [b[0] for b in blocks], store.open_input_file(f"{top}/{files[nth][1]}.blocks"), None
                b = max(0, bisect_left(firsts, key) - 1)
                while b < len(blocks) and (firsts[b] <= key or firsts[b].startswith(key + " ")):
                    if kept_at != b:
                        lines = zlib.decompress(source.read_at(blocks[b][2], blocks[b][1])).decode().split("\n")
                        split = [x.split("\t") for x in lines]
                        kept_at, kept = b, ([s[0] for s in split], split)
                    at = bisect_left(kept[0], key)
                    while at < len(kept[0]) and (kept[0][at] == key or kept[0][at].startswith(key + " ")):
                        _, file, offset, length = kept[1][at]
                        rows.append((kept[0][at], file, int(offset), int(length)))
                        at += 1
                    b += 1
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    if not files:
        return keys.select("key", F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length")).limit(0)
    routed = keys.select("key").dropDuplicates().mapInPandas(route, "key string, nth int")
    # one file's keys may be many: they are split by key as well, in order
    ordered = routed.repartitionByRange(F.col("nth"), F.col("key")).sortWithinPartitions("nth", "key")
    return ordered.mapInPandas(find, "key string, file string, offset long, length long")


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def read_records(places: DataFrame, archives: str, run_bytes: int = 4 << 20, payload: bool = True) -> DataFrame:
    """Reads the records at (file, offset, length); neighbouring ranges up to ``run_bytes`` in one read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _opened(archives)
        now, source = None, None
        for frame in frames:
            rows = []
            spots = list(zip(frame["file"], frame["offset"].tolist(), frame["length"].tolist(), strict=True))
            k = 0
            while k < len(spots):
                file, start, length = spots[k]
                last, end = k + 1, start + length
                while last < len(spots) and spots[last][0] == file and spots[last][1] == end and end - start < run_bytes:
                    end += spots[last][2]
                    last += 1
                if file != now:
                    now, source = file, store.open_input_file(f"{top}/{file}")
                raw = source.read_at(end - start, start)
                for _, offset, size in spots[k:last]:
                    rows.append(parse_record(zlib.decompress(raw[offset - start : offset - start + size], 31)))
                k = last
            out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
            out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
            out["payload"] = out["payload"].map(lambda b: b.decode("utf-8", "replace")) if payload else None
            yield out

    return places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInPandas(read, RECORDS)


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Writes every page to archives, indexes them, looks every page up and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Of equal payloads of ``least_bytes`` and more the greatest page_id is the response; smaller ones are all responses. An
    empty table gives no rows; only page_id, url and html are read.
    """
    spark = pages.sparkSession
    archives, folder = new_folder(spark, "warc"), new_folder(spark, "warc-index")
    captures = write_archives(with_record_types(pages, least_bytes), archives)
    index = build_index(captures, archives, folder)
    keys = captures.select(_line_key(F.col("surt"), F.col("page_id")).alias("key"))
    found = read_records(lookup(index, keys), archives, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
