"""Lines around hits as merged intervals, from the hits alone."""

from __future__ import annotations

import numpy as np


def around(first: np.ndarray, last: np.ndarray, n: int, before: int = 0, after: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (from 0, below n) in or near the intervals first to last, whether each is in one, its group (from 1), and whether a new interval shows there.

    Neither end of the intervals descends. Intervals that overlap or adjoin once they are widened are one group. An interval
    shows what the ones before it have left of it.
    """
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, bool)
    begin, end = np.maximum(first - before, 0), np.minimum(last + after, n - 1)
    shows = np.maximum(begin, np.r_[0, end[:-1] + 1])
    shows = shows[shows <= end]
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1] + 1
    cut = np.flatnonzero(new)
    begin, end = begin[cut], end[np.r_[cut[1:] - 1, len(end) - 1]]
    size = end - begin + 1
    places = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    own = np.searchsorted(first, places, side="right") - 1
    inside = (own >= 0) & (places <= last[np.maximum(own, 0)])
    opens = np.zeros(len(places), bool)
    opens[np.searchsorted(places, shows)] = True
    return places.astype(np.int32), inside, np.repeat(np.arange(1, len(size) + 1), size), opens


def lines_of_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The first and last line (from 0) of each byte span, by LF, and how many lines there are.

    A span that ends behind a terminator reaches the line that follows, where there is one.
    """
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    n = len(ends) + int(not data.endswith(b"\n") and bool(data))
    at = np.array(spans, np.int64).reshape(-1, 2)
    first, last = np.searchsorted(ends, at[:, 0], side="left"), np.searchsorted(ends, at[:, 1], side="left")
    return first, np.minimum(last, n - 1), n
