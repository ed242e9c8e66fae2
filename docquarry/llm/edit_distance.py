"""Banded bit-parallel edit distance of many pairs of byte strings at once."""

from __future__ import annotations

import numpy as np


def within(left: list[bytes], right: list[bytes], most: int, cells: int = 1 << 22) -> np.ndarray:
    """Edit distances of pairs, or ``most + 1`` where they are larger.

    Only the 2 * most + 1 diagonals about the main one matter; their vertical
    differences fit in one word per pair, and all pairs advance a column together.
    """
    a_len, b_len = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    out = np.full(len(left), most + 1, np.int64)
    order = np.flatnonzero(np.abs(a_len - b_len) <= most)
    order = order[np.argsort(b_len[order], kind="stable")]
    at = 0
    while at < len(order):
        stop = at + 1  # similar lengths share a batch; a long pair has one of its own
        while stop < len(order) and (stop - at + 1) * (int(b_len[order[stop]]) + 1) <= cells and b_len[order[stop]] <= 2 * b_len[order[at]] + 64:
            stop += 1
        some = order[at:stop]
        out[some] = _batch([left[i] for i in some], [right[i] for i in some], a_len[some], b_len[some], most)
        at = stop
    return out


def _batch(left: list[bytes], right: list[bytes], m: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    rows, width = len(left), int(max(m.max(), n.max())) + 2 * most + 2
    a = np.full((width, rows), 300, np.int16)  # a's byte r is in row r + most
    b = np.full((width, rows), 301, np.int16)
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        a[most : most + len(x), k] = np.frombuffer(x, np.uint8)
        b[: len(y), k] = np.frombuffer(y, np.uint8)
    bits = 2 * most + 1
    full = np.int64((1 << bits) - 1)
    top = 2 * most
    vp = np.full(rows, ((1 << (most + 1)) - 1) << most, np.int64)
    vn = np.zeros(rows, np.int64)
    dist = np.full(rows, most, np.int64)
    # a shorter than the band: the tracked row starts at its end
    short = m < most
    dist[short] = m[short]
    for i in range(int(n.max())):
        match = np.zeros(rows, np.int64)
        for t in range(bits):
            match |= (a[i + t] == b[i]).astype(np.int64) << t
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        slant = i < m - most
        # afterwards the last row of a moves down one bit each column
        place = np.where(slant, top, np.clip(top - 1 - (i - np.maximum(m - most, 0)) - np.maximum(most - m, 0), 0, top))
        live = i < n
        along = ((hp >> place) & 1) - ((hn >> place) & 1)
        dist += np.where(live, np.where(slant, 1 - ((d0 >> top) & 1), along), 0)
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & full
        vn = down & hp
    return np.minimum(dist, most + 1)
