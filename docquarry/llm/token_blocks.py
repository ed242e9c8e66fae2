"""Words of a stream of texts, in blocks of bounded size that keep their neighbours."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Bytes of text that are held as words at a time.
BLOCK_BYTES = 4_000_000


def parts_of(data: bytes, size: int, delimiter: re.Pattern[bytes]) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, each but the last ending with a delimiter."""
    at = 0
    while len(data) - at > size:
        met = delimiter.search(data, at + size)
        if met is None:
            break
        yield data[at : met.end()]
        at = met.end()
    yield data[at:]


def token_blocks(texts: Iterator[tuple[object, bytes]], split: Callable[[bytes], list[bytes]], gap: bytes, delimiter: re.Pattern[bytes], reach: int, size: int | None = None) -> Iterator[tuple[object, list[bytes], int, int]]:
    """``key, tokens, begin, end``: the tokens of the texts of a key, in their order, each in one [begin, end).

    Up to ``reach`` tokens on either side of it are neighbours only. ``gap`` is what ``split``
    makes a token of its own and what stands between two texts. Texts of any length are held in parts.
    """
    size = size or BLOCK_BYTES
    held: dict[object, list[bytes]] = {}
    carried: dict[object, tuple[list[bytes], int]] = {}
    total = 0
    between = split(gap)

    def block(key: object, last: bool) -> tuple[object, list[bytes], int, int]:
        tokens, begin = carried.pop(key, ([], 0))
        tokens = tokens + split(b"".join(held.pop(key, [])))
        if last:
            tokens += between * reach
        end = max(begin, len(tokens) - reach)
        start = max(0, end - reach)
        carried[key] = (tokens[start:], end - start)
        return key, tokens, begin, end

    for key, data in texts:
        for part in parts_of(data, size, delimiter):
            held.setdefault(key, []).append(part)
            total += len(part)
            if total >= size:
                for k in list(held):
                    yield block(k, False)
                total = 0
        held.setdefault(key, []).append(gap)
    for k in list(carried.keys() | held.keys()):
        yield block(k, True)
