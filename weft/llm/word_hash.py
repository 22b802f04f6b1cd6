"""Words of a column of texts as 64-bit hashes, a batch at a time.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z in lower case. A hash is a sum of
byte values times powers of an odd number, finished by a mixer, so two different words share one with a
chance of about one in 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_random = np.random.default_rng(20240229)
_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z in lower case, white space as blanks; and masks of the first bytes of eight.
_LOWER = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: For words without the punctuation around them: every ASCII byte but letters and digits.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts (null: empty), one text after another, and how many each text has."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    if texts.null_count:
        lengths = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        if int(lengths.sum()) != int(offsets[-1] - offsets[0]):
            return words(texts.fill_null(b""), space)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = starts[starts < len(data)]
    first[begins] |= inside[begins]
    at = np.flatnonzero(first)
    per_text = np.diff(np.searchsorted(at, np.r_[starts, len(data)]))
    if not len(at):
        return np.zeros(0, np.uint64), per_text
    bytes_ = np.flatnonzero(inside)
    word_begins = np.searchsorted(bytes_, at)
    long = np.diff(np.r_[word_begins, len(bytes_)])
    powers = np.cumprod(np.full(int(long.max()), _BASE))
    values = _VALUES[data[bytes_]]
    values *= powers[np.arange(len(bytes_)) - np.repeat(word_begins, long)]
    return mix(np.add.reduceat(values, word_begins) ^ (long.astype(np.uint64) << np.uint64(48))), per_text


def quick_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``, with other hashes, from eight bytes at a time: a third of its time."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    starts, size = offsets[:-1] - offsets[0], int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    data = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]].tobytes().translate(_LOWER)
    space = np.ones(size + 2, bool)
    np.equal(np.frombuffer(data, np.uint8), 32, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    begins, ends = edges[::2], edges[1::2]
    # a text that begins where another's last word ends
    meet = starts[(starts > 0) & (starts < size)]
    meet = np.unique(meet[~space[meet] & ~space[meet + 1]])
    if len(meet):
        begins, ends = (np.sort(np.concatenate([x, meet]), kind="stable") for x in (begins, ends))
    per_text = np.diff(np.searchsorted(begins, np.r_[starts, size]))
    long = ends - begins
    eights = np.frombuffer(data + bytes(16 - size % 8), np.uint64)

    def load(at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place on."""
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        found = (eights[place] >> shift) | ((eights[place + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return found & _FIRST[np.minimum(most, 8)]

    hashes = load(begins, long)
    more = np.flatnonzero(long > 8)
    if len(more):
        pieces = (long[more] + 7) >> 3
        firsts = np.cumsum(pieces) - pieces
        at = (np.arange(int(pieces.sum())) - np.repeat(firsts, pieces)) << 3
        found = load(np.repeat(begins[more], pieces) + at, np.repeat(long[more], pieces) - at)
        hashes[more] = np.add.reduceat(mix(found + (at.astype(np.uint64) + np.uint64(1)) * _VALUES[0]), firsts)
    return mix(hashes + long.astype(np.uint64) * _BASE), per_text


def release() -> None:
    """Give freed memory back to the system; a worker lives on and waits for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of a column; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()
