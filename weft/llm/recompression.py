"""Removal of long passages that also stand elsewhere, by recompression of texts into symbols.

Every window of WINDOW words that starts a second time anywhere is found, and each word it covers goes.

A text is a sequence of symbols, at first its words. In each of ROUNDS rounds runs of one symbol become one
symbol, then each pair of a left symbol and a right one. Sides and names are functions of what a symbol stands for,
so that all tasks give equal pairs and runs one name without meeting. With a symbol goes the stretch of words
that decided it: in equal windows, symbols decided inside are equal. So a window has an anchor: of the symbols of
the highest round that were decided inside it, that with the least name, the first of them. Equal windows have
anchors with equal names, and neighbouring windows mostly have the same anchor: they are a block.

Spark counts names over all texts. Only blocks whose anchor's name is there twice are looked at again: their
windows get strong digests. Blocks with the same digests are one, and all their windows are repeated if
two of them exist; only where blocks differ below one name are windows counted singly.

Equal texts are one text with a number of copies, so a group of copies is as dear as one of them. Names of 64
bits only tell which windows to compare; equal windows have equal names and equal digests of 64 bits, both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.storage import Scratch, table
from weft.llm.word_hash import mix, release, slices, words

WINDOW, ROUNDS = 35, 3
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Bytes of texts that a task looks at together.
BYTES = 400_000


def rounds(name: np.ndarray, edge: np.ndarray, n_rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each round with the first and last place that decided them; round 0 is what is given.

    Places in ``edge`` stand between texts: they never join, and a symbol that looked at one was decided there too.
    """
    first = np.arange(len(name), dtype=np.int32)
    last = first.copy()
    yield name, first, last
    for k in range(n_rounds):
        # runs; that a run ends was decided by the symbols beside it
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | edge[1:] | edge[:-1]
        at = np.flatnonzero(new)
        times = np.diff(np.r_[at, len(name)])
        end = np.minimum(at + times, len(name) - 1)
        first, last = np.where(edge[at], first[at], first[np.maximum(at - 1, 0)]), np.where(edge[at], last[at], last[end])
        name, edge = name[at], edge[at]
        long = np.flatnonzero(times > 1)
        name[long] = mix(name[long] * _LEFT + times[long].astype(np.uint64))
        # pairs; a symbol alone was decided by the one that it might have joined
        right = ((name >> np.uint64(11 * k + 5)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~edge[:-1] & ~edge[1:]
        keep = np.ones(len(name), bool)
        keep[1:] = ~joins[:-1]
        keep = np.flatnonzero(keep)
        pair, after = joins[keep], np.minimum(keep + 1, len(name) - 1)
        asks_right, asks_left = ~edge[keep] & ~right[keep], ~edge[keep] & right[keep]
        first, last = np.where(asks_left, first[np.maximum(keep - 1, 0)], first[keep]), np.where(asks_right, last[after], last[keep])
        joined = name[keep]
        joined[pair] = mix(joined[pair] * _LEFT + name[after[pair]] * _RIGHT + np.uint64(k))
        name, edge = joined, edge[keep]
        yield name, first, last


def least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first place of the least key in each of the ranges lo to hi, that end before hi and aren't empty."""
    power = np.log2(hi - lo).astype(np.int64)
    power -= (1 << power) > hi - lo
    found, best, step = np.empty(len(lo), np.int64), np.arange(len(key)), 1
    for k in range(int(power.max(initial=-1)) + 1):
        own = np.flatnonzero(power == k)
        x, y = best[lo[own]], best[hi[own] - step]
        found[own] = np.where(key[x] <= key[y], x, y)
        other = np.concatenate([best[step:], np.repeat(best[-1:], min(step, len(best)))])[: len(best)]
        best = np.where(key[best] <= key[other], best, other)
        step *= 2
    return found


def blocks(name: np.ndarray, per_text: np.ndarray, window: int = WINDOW, n_rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """text, first window, number of windows and name of the anchor, of every block of texts with these words (hashes)."""
    n = len(name) + len(per_text) + 1
    edge = np.zeros(n, bool)
    ends = np.cumsum(per_text + 1)
    edge[0] = edge[ends] = True
    at = np.zeros(n, np.uint64)
    at[~edge] = name
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    power, back = np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(at * power)])
    inside = np.concatenate([[0], np.cumsum(edge)])
    valid = inside[window:] == inside[: n - window + 1]
    anchor, names = np.full(len(valid), -1, np.int64), np.zeros(len(valid), np.uint64)
    levels, todo, above = list(rounds(at, edge, n_rounds)), np.flatnonzero(valid), 0
    while len(todo):
        _, first, last = levels.pop()
        lo, hi = np.searchsorted(first, todo), np.searchsorted(last, todo + window - 1, side="right")
        has = hi > lo
        own, lo, hi = todo[has], lo[has], hi[has]
        todo = todo[~has]
        # a symbol is named by all words that decided it
        key = mix((sums[last + 1] - sums[first]) * back[first])
        best = least(key, lo, hi)
        anchor[own], names[own] = best + above, key[best]
        above += len(first)
    change = np.ones(len(anchor), bool)
    change[1:] = anchor[1:] != anchor[:-1]
    cut = np.flatnonzero(change)
    size = np.diff(np.r_[cut, len(anchor)])
    cut, size = cut[anchor[cut] >= 0], size[anchor[cut] >= 0]
    text = np.searchsorted(ends, cut)
    return text, cut - (ends - per_text)[text], size, names[cut]


def key_of(text: Column) -> Column:
    return F.substring(F.sha2(text, 256).cast("binary"), 1, 32)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of every text, with how many words it has and the digest that it has as it is."""
    for batch in slices(batches, "text", BYTES):
        texts = batch.column("text")
        name, per_text = words(texts)
        text, first, n, anchor = blocks(name, per_text)
        cut = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (anchor.view(np.int64), first.astype(np.int32), n.astype(np.int32))]
        raw = texts.to_pylist()
        keys = [hashlib.sha256(t).hexdigest()[:32].encode() for t in raw]
        plain = [hashlib.sha256(b" ".join(t.split())).digest() for t in raw]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(per_text.astype(np.int64)), pa.array(plain, pa.binary()), *lists], ["key", "n_words", "plain", "anchor", "first", "n"])
    release()


class _Words:
    """A text's words joined by single spaces, and where each begins."""

    def __init__(self, text: bytes):
        self.text = b" ".join(text.split())
        self.begin = np.concatenate([[0], np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32) + 1, [len(self.text) + 1]])

    def block(self, first: int, n: int) -> bytes:
        """A digest of all words of n windows: blocks with equal ones have equal windows."""
        return hashlib.blake2b(self.text[self.begin[first] : self.begin[first + n - 1 + WINDOW] - 1], digest_size=16).digest()

    def windows(self, first: int, n: int) -> bytes:
        """Digests of n windows, eight bytes each."""
        at, to = self.begin[first : first + n].tolist(), (self.begin[first + WINDOW : first + WINDOW + n] - 1).tolist()
        return b"".join([hashlib.blake2b(self.text[a:b], digest_size=8).digest() for a, b in zip(at, to)])

    def without(self, covered: np.ndarray) -> bytes:
        """The text without the words that are covered."""
        n = len(self.begin) - 1
        cut = np.flatnonzero(np.diff(np.concatenate([[1], covered.astype(np.int8), [1]])))
        return b" ".join([self.text[self.begin[a] : self.begin[b] - 1] for a, b in zip(cut[::2].tolist(), cut[1::2].tolist())]) if n else b""


def _digests(places: bool):
    """For each block that a text is asked for: its anchor, a digest of its words, and either where it is or the windows' digests."""
    names = ["anchor", "block", *(["key", "first"] if places else ["copies", "windows"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BYTES):
            rows = []
            for key, copies, text, asked in zip(*(batch.column(c).to_pylist() for c in ("key", "copies", "text", "asked"))):
                own = _Words(text)
                for b in asked:
                    block = own.block(b["first"], b["n"])
                    rows.append((b["anchor"], block, key, b["first"]) if places else (b["anchor"], block, copies, own.windows(b["first"], b["n"])))
            kinds = [pa.int64(), pa.binary(), *([pa.binary(), pa.int32()] if places else [pa.int64(), pa.binary()])]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 20_000]), kinds)], names)
        release()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_removed and the digest of what is left of texts with repeated windows."""
    for batch in slices(batches, "text", BYTES):
        removed, kept = [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            own = _Words(text)
            step = np.zeros(len(own.begin), np.int64)
            for b in found:
                at = b["first"] + np.array(b["places"], np.int64)
                step[at] += 1
                step[at + WINDOW] -= 1
            covered = np.cumsum(step)[:-1] > 0
            removed.append(int(covered.sum()))
            kept.append(hashlib.sha256(own.without(covered)).digest())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_removed", "kept"])
    release()


def repeated(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of docs (text): key, n_words, plain (digest) of all; key, text, found (blocks with their repeated windows) of some."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    told = texts.mapInArrow(_anchors, "key binary, n_words bigint, plain binary, anchor array<bigint>, first array<int>, n array<int>")
    every = told.groupBy("key").agg(F.first(F.struct("n_words", "plain", "anchor", "first", "n")).alias("own"), F.count("*").alias("copies"))
    every = scratch.keep(every.select("key", "copies", "own.*"), "texts")
    # tables that are joined are written first, so that a name that very many texts have can be split in the join
    twice = scratch.keep(every.select("copies", F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.sum("copies").alias("times")).filter("times > 1").select("anchor"), "twice")
    listed = every.select("key", "copies", F.inline(F.arrays_zip("anchor", "first", "n")))
    asked = listed.join(twice, "anchor", "left_semi").groupBy("key").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("anchor", "first", "n")).alias("asked"))
    own = texts.groupBy(key_of(F.col("text")).alias("key")).agg(F.first("text").alias("text"))
    suspects = scratch.keep(asked.join(own, "key"), "suspects")
    # blocks with the same windows are one
    found = suspects.mapInArrow(_digests(False), "anchor bigint, block binary, copies bigint, windows binary")
    same = scratch.keep(found.groupBy("anchor", "block").agg(F.sum("copies").alias("times"), F.first("windows").alias("windows")), "blocks")
    mixed = scratch.keep(same.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor"), "mixed")
    size = (F.octet_length("windows") / 8).cast("int")
    whole = same.filter("times > 1").select("anchor", "block", F.sequence(F.lit(0), size - 1).alias("places"))
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(k.alias("place"), F.substring("windows", k * 8 + 1, F.lit(8)).alias("window")))
    single = scratch.keep(same.join(mixed, "anchor", "left_semi").select("anchor", "block", "times", F.inline(cut)), "windows")
    again = scratch.keep(single.groupBy("anchor", "window").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor", "window"), "again")
    parts = single.filter("times = 1").join(again, ["anchor", "window"], "left_semi").groupBy("anchor", "block").agg(F.collect_list("place").alias("places"))
    there = scratch.keep(whole.unionByName(parts), "repeated")
    placed = suspects.mapInArrow(_digests(True), "anchor bigint, block binary, key binary, first int")
    by_text = placed.join(there, ["anchor", "block"]).groupBy("key").agg(F.collect_list(F.struct("first", "places")).alias("found"))
    return every, suspects.select("key", "text").join(by_text, "key")


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text).

    Null texts have no words. Rows that repeat, with equal ids or not, are copies of one another: what they say in
    WINDOW words or more goes from all. Windows are judged on what is given. No rows give no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "recompression")
    every, some = repeated(scratch, docs)
    gone = some.mapInArrow(_remove, "key binary, n_removed bigint, kept binary")
    results = every.select("key", "n_words", "plain").join(gone, "key", "left")
    results = scratch.keep(results.select("key", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "plain"))).alias("kept_sha256")), "results")
    scratch.only(results)
    rows = docs.select(F.col("doc_id").cast("long"), key_of(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("key"))
    return rows.join(results, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, table(spark, sf_dir, "documents"))
