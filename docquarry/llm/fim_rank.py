"""Fill-in-the-middle transformation by rank and select over character boundaries.

The UTF-8 bytes of a batch of texts are one bit string: a bit is set where a code point
begins. A directory holds the number of set bits before each block of 512. The
number of code points of a text is the difference of two ranks, and the byte at which its
k-th code point begins is one select, so texts are cut without being decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.shared import narrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())
#: Bytes of a block of the directory: 512 bits.
BLOCK = 64
#: Bytes of text whose bits are held at a time; a longer text is a batch of its own.
SLICE = 8_000_000

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: For each byte, the place of its k-th set bit.
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _NTH[_b, : len(_set)] = _set


class BoundaryBits:
    """Rank and select over the places at which code points begin in UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        self.length = len(data)
        bits = np.packbits((data & 0xC0) != 0x80, bitorder="little")
        self.blocks = np.zeros((len(bits) // BLOCK + 1, BLOCK), np.uint8)  # one byte at least is free
        self.blocks.reshape(-1)[: len(bits)] = bits
        self.before = np.concatenate(([0], np.cumsum(_ONES[self.blocks].sum(axis=1, dtype=np.int64))))
        self.total = int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Code points that begin before each place."""
        block, byte, bit = places >> 9, (places >> 3) & (BLOCK - 1), places & 7
        own = self.blocks[block]
        whole = (_ONES[own] * (np.arange(BLOCK) < byte[:, None])).sum(axis=1, dtype=np.int64)
        last = own[np.arange(len(own)), byte] & ((1 << bit) - 1).astype(np.uint8)
        return self.before[block] + whole + _ONES[last]

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The byte at which the code point of each rank (from 0) begins; the length for the rank after the last."""
        out = np.full(len(ranks), self.length, np.int64)
        inside = np.flatnonzero(ranks < self.total)
        block = np.searchsorted(self.before, ranks[inside], "right") - 1
        own = self.blocks[block]
        upto = np.cumsum(_ONES[own], axis=1, dtype=np.int64)
        left = ranks[inside] - self.before[block]
        byte = (upto <= left[:, None]).sum(axis=1)
        row = np.arange(len(own))
        left = left - np.where(byte > 0, upto[row, byte - 1], 0)
        out[inside] = block * 512 + byte * 8 + _NTH[own[row, byte], left]
        return out


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins (with the end)."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(part: pa.RecordBatch, plain_share: int, spm_share: int) -> pa.RecordBatch:
    data, ends = _text_bytes(part.column("text"))
    bits = BoundaryBits(data)
    ranks = bits.rank(ends)
    n = np.diff(ranks)
    h1, h2, h3, h4 = (part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
    one, two = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    cuts = (bits.select(ranks[:-1] + low).tolist(), bits.select(ranks[:-1] + high).tolist())
    is_plain, is_spm = ((n == 0) | (h3 % 100 >= 100 - plain_share)).tolist(), (h4 % 100 < spm_share).tolist()
    raw, forms, outputs = data.tobytes(), [], []
    for i, (start, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        text = raw[start:end]
        if is_plain[i] or any(m in text for m in MARKS):
            forms.append("plain")
            outputs.append(text)
            continue
        a, b = cuts[0][i] - start, cuts[1][i] - start
        prefix, suffix = MARKS[0] + text[:a], MARKS[1] + text[b:]
        forms.append("spm" if is_spm[i] else "psm")
        outputs.append((suffix + prefix if is_spm[i] else prefix + suffix) + MARKS[2] + text[a:b])
    cut = np.array([f == "plain" for f in forms], bool)
    columns = [part.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), pa.array(low, mask=cut), pa.array(high - low, mask=cut), pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """Each text as ``output``, rearranged for infilling: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    Two hashes of the id give the cuts, two more the form: ``plain`` (the text as it is; ``plain_share``
    of a hundred, every empty text, and every text that holds one of the marks), ``spm``
    (``spm_share`` of a hundred of the rest) or ``psm``. A null text is empty; a null id hashes as an empty one.
    Equal ids are cut at places of their own length; repeated rows come out as often as they came
    in, other columns are not read, and an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ends = _text_bytes(batch.column("text"))
            at = 0
            while at < len(batch):
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
                yield _transform(batch.slice(at, upto - at), plain_share, spm_share)
                at = upto

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return narrow(docs).withColumn("digest", digest).select("doc_id", "text", *hashes).mapInArrow(cut, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` rearranged, from its output and form alone.

    The text holds no mark, so the marks part the output; a null output stays null.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_digests(transformed: DataFrame) -> DataFrame:
    """The transformed texts as digests, with that of the text restored from each."""
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return transformed.select(*kept, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, substring(t, 1, least(x, y)) AS pre, substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substring(t, greatest(x, y) + 1) AS suf FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(least(x, y) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(greatest(x, y) - least(x, y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
