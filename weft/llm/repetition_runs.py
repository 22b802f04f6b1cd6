"""Periodic runs of words in texts, found by Crochemore's partition refinement, and texts with runs collapsed.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least max(LEAST, TIMES * q) words.

Positions are in one class if equally many words from there on are the same words. Classes of factors of
length k + 1 come from those of length k: what stands before a small class is taken out of its own class. Of the parts
that a class falls into, all but the largest are small, so a position is in a small class only O(log n)
times. Members of a class are linked in order; a member whose next is exactly k words away, in a class of factors of
length k, begins a square with a primitive root of k words, and squares at neighbouring positions are one run.

All texts of a batch are refined together, a length at a time, with classes that never cross a text. Classes that
can't have a run any more are left: those with fewer than three members (a run of four periods has three at least
for each of its squares), those whose members are all k words apart (they are inside one run, which is known by
then), and texts of fewer than 4 * k words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.storage import table
from weft.llm.word_hash import release, slices

LEAST, TIMES = 6, 4
#: Bytes of texts that a task refines together; its arrays take some fifty times as many. A longer text is alone.
PORTION = 3_000_000
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    out = np.repeat(begin - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sorted_by(a: np.ndarray, b: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """An order by a, b, pos, all below 2**31; pos below n."""
    wide = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * wide * n < 1 << 62:
        return np.argsort((a.astype(np.int64) * wide + b) * n + pos)
    return np.lexsort((pos, b, a))


class Refinement:
    """Classes of equal factors of the words of several texts, one length after another."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        """words: numbers of the words, text after text; a word that two texts have may have one number."""
        n_docs = len(lengths)
        self.ends = np.cumsum(lengths + 1) - 1  # a place without a word ends each text
        self.n = n = int(self.ends[-1]) + 1 if n_docs else 0
        doc = np.repeat(np.arange(n_docs), lengths)
        pos = np.arange(len(words)) + doc
        self.limit = lengths // TIMES
        self.begins = self.ends - lengths
        self.cls = np.full(n, -1, np.int32)
        order = sorted_by(doc, words, pos, max(n, 1))
        cut = firsts(doc[order], words[order])
        self.size = np.zeros(2 * n + 2, np.int32)
        self.begin = np.zeros(2 * n + 2, np.int32)
        size = np.diff(np.r_[cut, len(order)])
        self.classes = len(cut)
        self.begin[: len(cut)], self.size[: len(cut)] = cut, size
        self.order = pos[order].astype(np.int32)
        self.where = np.zeros(n, np.int32)
        self.where[self.order] = np.arange(len(order), dtype=np.int32)
        self.cls[self.order] = np.repeat(np.arange(len(cut), dtype=np.int32), size)
        self.next, self.prev = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self._link(self.order, cut)
        self.taken = np.zeros(n, bool)
        self.level, self.until = 1, 1
        self.waiting: dict[int, list[np.ndarray]] = {}
        few = np.repeat(size < 3, size)
        self.dead = np.concatenate([self.order[few], self.ends.astype(np.int32)])
        self.cls[self.order[few]] = -1
        self.small = self.order[~few]
        by_limit = np.argsort(self.limit, kind="stable")
        self.leaving, self.left = by_limit, 0

    def _link(self, members: np.ndarray, cut: np.ndarray) -> None:
        """Link the sorted members of classes that begin at cut."""
        self.next[members[:-1]], self.prev[members[1:]] = members[1:], members[:-1]
        self.prev[members[cut]] = -1
        self.next[members[np.r_[cut[1:], len(members)] - 1] if len(cut) else members[:0]] = -1

    def _wait(self, pos: np.ndarray) -> None:
        """Have positions looked at when their distance to the next member is the length; far ones are found later."""
        gap = self.next[pos] - pos
        near = (gap >= self.level) & (gap < self.until)
        if not near.any():
            return
        pos, gap = pos[near], gap[near]
        by = np.argsort(gap, kind="stable")
        pos, gap = pos[by], gap[by]
        cut = firsts(gap)
        for k, a, b in zip(gap[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(pos)]):
            self.waiting.setdefault(k, []).append(pos[a:b])

    def squares(self) -> np.ndarray:
        """The sorted beginnings of squares with a primitive root of this length."""
        k = self.level
        if k >= self.until:
            self.until = 2 * k
            self._wait(np.flatnonzero(self.cls >= 0))
        found = self.waiting.pop(k, None)
        if not found:
            return np.zeros(0, np.int64)
        pos = np.unique(np.concatenate(found))
        pos = pos[(self.cls[pos] >= 0) & (self.next[pos] - pos == k)]
        if len(pos):
            own, n = np.unique(self.cls[pos], return_counts=True)
            own = own[n == self.size[own] - 1]
            inside = self.order[ranges(self.begin[own].astype(np.int64), self.size[own].astype(np.int64))]
            self.cls[inside] = -1
            self.dead = np.concatenate([self.dead, inside])
        return pos

    def refine(self) -> bool:
        """On to the next length; False if no class is left."""
        self.level += 1
        while self.left < len(self.leaving) and self.limit[self.leaving[self.left]] < self.level:
            d = self.leaving[self.left]
            self.cls[self.begins[d] : self.ends[d]] = -1
            self.left += 1
        if self.left == len(self.leaving):
            return False
        gone = self.dead[self.dead > 0] - 1
        gone = gone[self.cls[gone] >= 0]
        small = self.small[(self.cls[self.small] >= 0) & (self.small > 0)]
        before = small - 1
        known = self.cls[before] >= 0
        small, before = small[known], before[known]
        if not len(gone) and not len(before):
            self.dead = self.small = gone
            return False
        taken = np.concatenate([before, gone])
        after = np.concatenate([self.cls[small], np.full(len(gone), self.classes, np.int32)])
        by = sorted_by(self.cls[taken], after, taken, self.n)
        taken, after = taken[by], after[by]
        own = self.cls[taken]
        # out of the lists of their classes: neighbours in a list that both go are bridged together
        listed = taken[np.argsort(own.astype(np.int64) * self.n + taken)] if len(before) else taken
        first = np.ones(len(listed), bool)
        first[1:] = self.prev[listed[1:]] != listed[:-1]
        first = np.flatnonzero(first)
        left, right = self.prev[listed[first]], self.next[listed[np.r_[first[1:], len(listed)] - 1]]
        self.next[left[left >= 0]] = right[left >= 0]
        self.prev[right[right >= 0]] = left[right >= 0]
        bridged = left[(left >= 0) & (right >= 0)]
        # to the end of the places of their classes
        cut = firsts(own)
        parents, n_taken = own[cut], np.diff(np.r_[cut, len(own)])
        rest = self.size[parents] - n_taken
        tail = (self.begin[parents] + rest).astype(np.int64)
        slots = ranges(tail, n_taken)
        self.taken[taken] = True
        staying = self.order[slots]
        staying = staying[~self.taken[staying]]
        self.taken[taken] = False
        holes = self.where[taken]
        holes = holes[holes < np.repeat(tail, n_taken)]
        self.order[holes], self.where[staying] = staying, holes
        self.order[slots], self.where[taken] = taken, slots
        # what each class falls into: groups by the class behind, and the rest
        group = firsts(own, after)
        g_size = np.diff(np.r_[group, len(own)])
        dying = after[group] == self.classes
        g_parent = np.searchsorted(cut, group, side="right") - 1
        live = np.flatnonzero(~dying)
        largest = np.zeros(len(parents), np.int64)
        np.maximum.at(largest, g_parent[live], g_size[live])
        # the largest group of a class keeps its name if no rest does, and isn't small unless the rest is larger
        heir = np.zeros(len(group), bool)
        candidates = live[(g_size[live] == largest[g_parent[live]]) & (largest[g_parent[live]] > rest[g_parent[live]])]
        heir[candidates[firsts(g_parent[candidates])]] = True
        named = heir & (rest[g_parent] == 0)
        fresh = ~dying & ~named & (g_size >= 3)
        number = np.zeros(len(group), np.int32)
        number[fresh] = self.classes + np.arange(int(fresh.sum()), dtype=np.int32)
        self.classes += int(fresh.sum())
        number[named] = parents[g_parent[named]]
        ended = dying | (g_size < 3)
        number[ended] = -1
        holds = fresh | (named & ~ended)
        self.begin[number[holds]], self.size[number[holds]] = slots[group[holds]], g_size[holds]
        self.cls[taken] = np.repeat(number, g_size)
        # members of groups that live on are linked anew
        kept = np.repeat(holds, g_size)
        members = taken[kept]
        if len(members):
            self._link(members, np.cumsum(np.r_[0, g_size[holds][:-1]]))
        # the rest
        self.size[parents[rest > 0]] = rest[rest > 0]
        lost = parents[(rest > 0) & (rest < 3)]
        lost = self.order[ranges(self.begin[lost].astype(np.int64), self.size[lost].astype(np.int64))]
        self.cls[lost] = -1
        beaten = (rest >= 3) & (largest > rest)
        smaller = parents[beaten]
        smaller = self.order[ranges(self.begin[smaller].astype(np.int64), self.size[smaller].astype(np.int64))]
        self.dead = np.concatenate([taken[np.repeat(ended, g_size)], lost])
        self.small = np.concatenate([taken[np.repeat(fresh & ~heir, g_size)], smaller])
        self._wait(np.concatenate([bridged[self.cls[bridged] >= 0], members]))
        return True


def runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length, period of every run of texts with these words (numbers), by text, start and period."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none, none
    state, begin, length, period = Refinement(words, lengths), [none], [none], [none]
    more = True
    while more:
        pos, q = state.squares(), state.level
        if len(pos):
            cut = np.flatnonzero(np.r_[True, np.diff(pos) != 1])
            long = np.diff(np.r_[cut, len(pos)]) - 1 + 2 * q
            enough = long >= max(LEAST, TIMES * q)
            begin.append(pos[cut][enough])
            length.append(long[enough])
            period.append(np.full(int(enough.sum()), q))
        more = state.refine()
    begin, length, period = map(np.concatenate, (begin, length, period))
    doc = np.searchsorted(state.ends, begin)
    order = np.lexsort((period, begin, doc))
    return doc[order], (begin - state.begins[doc])[order], length[order], period[order]


def planted(n: int, crc: int) -> np.ndarray | None:
    """Which original word each of n words becomes in a text whose id has this CRC-32, where that isn't itself."""
    if crc % 10 or not n:
        return None
    g = crc // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def numbers(texts: list[list[bytes]]) -> np.ndarray:
    """The words of texts as numbers, equal ones alike."""
    known = set()
    for words in texts:
        known.update(words)
    known = {w: k for k, w in enumerate(known)}
    parts = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def without_runs(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those that no run has after its own first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:n]) == 0


def _told(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t.split() for t in batch.column("text").to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    found, bounds = numbers(texts), np.cumsum(lengths) - lengths
    for k, crc in enumerate(batch.column("crc").to_pylist()):
        at = planted(len(texts[k]), crc) if crc is not None else None
        if at is not None:
            texts[k] = list(map(texts[k].__getitem__, at.tolist()))
            found[bounds[k] : bounds[k] + len(at)] = found[bounds[k] + at]
    doc, start, length, period = runs(found, lengths)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    rows = []
    for k, words in enumerate(texts):
        s, n, q = (x[cut[k] : cut[k + 1]] for x in (start, length, period))
        if len(s):
            best = min(range(len(s)), key=lambda i: (-n[i], s[i], q[i]))
            most = (int(s[best]), int(n[best]), int(q[best]), int(1000 * n[best] // q[best]))
            stay = without_runs(len(words), s, n, q)
            words = [words[i] for i in np.flatnonzero(stay).tolist()]
        else:
            most = (None,) * 4
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist()))
        rows.append((len(s), *most, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
    columns = zip(*rows) if rows else [()] * 7
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Of each row of docs (doc_id, text): n_runs, the longest run and its exponent, digests of all runs and of the collapsed text.

    A null text has no words. With ``plant`` texts whose id's CRC-32 ends in 0 are made periodic first; a null id
    has none. Rows that repeat are told each; other columns are ignored. Every text is whole in one task, texts don't meet.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) if plant else F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), crc.alias("crc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PORTION):
            yield _told(batch)
        release()

    return rows.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), plant=True)
