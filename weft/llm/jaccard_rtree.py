"""Documents linked by the Jaccard similarity of their word 5-grams, through R-trees over group counts.

A document's distinct shingles are hashed into GROUPS groups; how many fall into each is its point. The
summed minima of two points bound the shingles that two documents share, and the summed minima of a point
and the maxima of a tree's node bound those it shares with all below. What passes the bound meets a finer
one, of more groups where there are more shingles, and is then verified on the shingles themselves.

Trees of one or two levels, which are nearly all, are searched many at once.

Trees hold what can meet. Under an order of all shingles, two linked documents have one in common among the
first n - ceil(0.8 n) + 1 of each; so a document goes under the keys of those first shingles, and a tree is
what one key holds. Shingles that many documents put first come last in the order of a second round, which
keeps trees small. Only keys with two different sets matter, keys that hold the same sets are one tree, and
equal sets are one class throughout.

What is found are links enough to hold every component together, never all pairs of a group:

1. In ROUNDS rounds each class is compared with one class of its keys, at first with the one that shares most
   keys: the original of near copies shares more than a copy does. What links is one component.
2. Trees search between components that a key still holds. A tree tells its pairs only if they are no more
   than its rows that have a partner, and else these rows.
3. Rows of such trees meet again with their whole sets; links that join nothing new aren't looked for.

A key of many rows is dealt out in blocks, so that any two rows of different components meet in some task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.storage import Scratch
from weft.llm.word_hash import mix, quick_words, slices

WORDS = 5
GROUPS = 128
#: Two documents link when DEN * shared >= NUM * united.
NUM, DEN = 80, 100
#: Keys of more rows go last in the second round's order.
OFTEN = 40
#: Rounds of comparing every class with one other before trees search.
ROUNDS = 2
#: A deal of a key has about so many rows, and so many shingles, of each of two sides.
LIMIT, SHINGLES = 2048, 800_000
LEAF = 16
#: Keys that a task holds before it sends them.
HELD = 1_500_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Ascending hashes of the distinct shingles of each text; of fewer words than WORDS, of all of them as one."""
    hashes, per_text = quick_words(texts)
    ends = np.cumsum(per_text)
    full = hashes[:0]
    if len(hashes) >= WORDS:
        full = hashes[: len(hashes) - WORDS + 1] * _ODD[0]
        for k in range(1, WORDS):
            full += hashes[k : len(hashes) - WORDS + 1 + k] * _ODD[k]
        full = mix(full)
    out = []
    for n, end in zip(per_text.tolist(), ends.tolist()):
        if n >= WORDS:
            own = np.sort(full[end - n : end - WORDS + 1])
            out.append(own if (new := own[1:] != own[:-1]).all() else own[np.r_[True, new]])
        elif n:
            few = (hashes[end - n : end] * _ODD[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(mix(few) ^ (_ODD[4:] * np.uint64(n))))
        else:
            out.append(full[:0])
    return out


def _names(sets: list[np.ndarray], again: np.ndarray = _ODD[:0]) -> np.ndarray:
    """Two 64-bit names of each set. The first is the class of equal sets, the second tells if it is one.

    Different sets with one first name are in ``again``: theirs is made of both names.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sets), 2), np.uint64)
    with np.errstate(over="ignore"):
        if len(some):
            every, begins = np.concatenate(sets), (np.cumsum(sizes) - sizes)[some]
            out[some, 0] = np.add.reduceat(mix(every * _ODD[1]), begins) + sizes[some].astype(np.uint64) * _ODD[0]
            out[some, 1] = np.add.reduceat(mix(every ^ _ODD[2]), begins)
        hit = np.isin(out[:, 0], again)
        out[hit, 0] = mix(out[hit, 0] * _ODD[3] + mix(out[hit, 1] ^ _ODD[4]))
    return out


def fine_point(own: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles, in so many groups that a few fall into each and none holds over 255."""
    groups = GROUPS
    while 2 * len(own) > 3 * groups:
        groups *= 2
    while True:
        counts = np.bincount((own >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The point of fewer groups: the sum of halves, quarters and so on."""
    return point.reshape(-1, groups).sum(0, dtype=np.uint32)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """At most so many shingles are in both sets of two fine points."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum(dtype=np.int64))


class Bits:
    """A set of 64-bit numbers by their first bits: false members, never false strangers. Its size is bounded."""

    def __init__(self, bits: int, words_: np.ndarray):
        self.bits, self.words, self.none = bits, words_, not words_.any()

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers.view(np.uint64) >> np.uint64(64 - self.bits)
        return ((self.words[(at >> np.uint64(6)).astype(np.intp)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)

    @staticmethod
    def of(df: DataFrame, number: str, most: int = 26) -> Bits:
        """Of a column, in 8 to 16 bits a row up to 2**most in all (8 MB); a mask that fills up sends more rows on."""
        bits = int(min(most, max(10, np.ceil(np.log2(8 * max(1, df.count()))))))
        place = F.shiftrightunsigned(number, 64 - bits)
        found = df.select(place.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).toPandas()
        out = np.zeros(1 << (bits - 6), np.uint64)
        out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
        return Bits(bits, out)


NOTHING = Bits(10, np.zeros(16, np.uint64))


def prefix(own: np.ndarray, late: Bits) -> np.ndarray:
    """The shingles of an ascending set under which it is to be found; those that late has come last."""
    n = len(own)
    first = n - (NUM * n + DEN - 1) // DEN + 1
    if late.none:
        return own[:first]
    behind = late.has(own)
    return np.concatenate([own[~behind][:first], own[behind][: max(0, first - int((~behind).sum()))]])


def may_link(shared, a, b):
    """Whether sizes a and b allow a link if at most ``shared`` shingles are in both."""
    return (NUM + DEN) * shared >= NUM * (a + b)


class RTree:
    """Points in leaves of LEAF, nodes of LEAF children; a node has the largest coordinates and the range of sizes below it."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        # by size, then by the groups that differ most, so that a leaf holds what is alike
        spread = np.argsort(-counts.var(0), kind="stable")[:3]
        self.order = np.lexsort((*counts[:, spread].T, sizes))
        counts, sizes = counts[self.order], sizes[self.order].astype(np.int64)
        self.levels = [(counts, sizes, sizes)]
        while len(counts) > LEAF:
            cut = np.arange(0, len(counts), LEAF)
            counts = np.maximum.reduceat(counts, cut, axis=0)
            self.levels.append((counts, np.minimum.reduceat(self.levels[-1][1], cut), np.maximum.reduceat(self.levels[-1][2], cut)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places of all points that the bound leaves for a document."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            counts, small, large = (x[at] for x in self.levels[depth])
            good = (DEN * large >= NUM * size) & (DEN * size >= NUM * small)
            at, counts, small = at[good], counts[good], small[good]
            at = at[may_link(np.minimum(counts, point).sum(1, dtype=np.int64), small, size)]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def tree_pairs(labels: np.ndarray, sizes: np.ndarray, fine: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different labels that the tree's bound and then the finer one leave together.

    Their pairs (2, n) if these are no more than the rows in them, else none; and the rows.
    """
    values, place, n = np.unique(labels, return_inverse=True, return_counts=True)
    none = np.zeros(0, np.int64)
    if len(values) < 2:
        return np.zeros((2, 0), np.int64), none
    met_one, found = np.zeros(len(fine), bool), 0
    counts = np.stack([folded(p, GROUPS) for p in fine])
    tree, left, right = RTree(counts, sizes), [none], [none]
    long = np.array([len(p) for p in fine])
    at = np.zeros(len(fine), np.int64)
    stacks = {}
    for width in np.unique(long):
        rows = np.flatnonzero(long == width)
        at[rows] = np.arange(len(rows))
        stacks[int(width)] = np.stack([fine[k] for k in rows])
    for k in np.flatnonzero(place != np.argmax(n)):
        met = tree.search(counts[k], int(sizes[k]))
        met = met[labels[met] != labels[k]]
        for width in np.unique(long[met]):
            some = met[long[met] == width]
            groups = min(int(width), len(fine[k]))
            points = stacks[int(width)][at[some]].reshape(len(some), -1, groups).sum(1, dtype=np.uint32)
            shared = np.minimum(points, folded(fine[k], groups)).sum(1, dtype=np.int64)
            some = some[may_link(shared, int(sizes[k]), sizes[some])]
            if len(some):
                met_one[some] = met_one[k] = True
                found += len(some)
            # a pair comes twice at most, so there are more pairs than rows from here on
            if found <= 2 * len(fine):
                left.append(np.full(len(some), k))
                right.append(some)
    rows = np.flatnonzero(met_one)
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.minimum(a, b) * len(fine) + np.maximum(a, b))
    if found > 2 * len(fine) or len(pairs) > len(rows):
        return np.zeros((2, 0), np.int64), rows
    return np.stack([pairs // len(fine), pairs % len(fine)]), rows


def _folded_all(fine: list[np.ndarray], rows: np.ndarray, groups: int, kind: type) -> np.ndarray:
    """The points of these rows in so many groups, one below another."""
    out = np.empty((len(rows), groups), kind)
    long = np.array([len(fine[k]) for k in rows])
    for width in np.unique(long):
        at = np.flatnonzero(long == width)
        out[at] = np.concatenate([fine[k] for k in rows[at]]).reshape(len(at), -1, groups).sum(1, dtype=kind)
    return out


def _bounds(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed minima of points by their places, a few at a time."""
    out, step = np.zeros(len(a), np.int64), max(16, (1 << 18) // left.shape[1])
    for at in range(0, len(a), step):
        out[at : at + step] = np.minimum(left[a[at : at + step]], right[b[at : at + step]]).sum(1, dtype=left.dtype)
    return out


def _after(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges, the number of the range and the place, for every place in them."""
    n = end - first
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)


def forest_pairs(tree: np.ndarray, labels: np.ndarray, sizes: np.ndarray, fine: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``tree_pairs`` of many trees of one or two levels at once; rows stand by tree, numbered from 0.

    All rows go down at once: from a row to the leaves behind its own that the bound leaves, to their rows, to the
    finer bound. The pairs (2, n) of the trees that have no more of them than rows with a partner, and such rows of
    the others.
    """
    order = np.lexsort((labels, sizes, tree))
    tree, labels, sizes, fine = tree[order], labels[order], sizes[order].astype(np.int64), [fine[k] for k in order]
    rows, ends = np.arange(len(tree)), np.cumsum(np.bincount(tree))
    # sums are at most the size of a set
    kind = np.uint16 if sizes.max() < 1 << 16 else np.uint32
    counts = _folded_all(fine, rows, GROUPS, kind)
    within = rows - np.r_[0, ends[:-1]][tree]
    begins = np.flatnonzero(within % LEAF == 0)
    leaf, leaf_end = np.cumsum(within % LEAF == 0) - 1, np.r_[begins[1:], len(rows)]
    largest, small = np.maximum.reduceat(counts, begins), np.minimum.reduceat(sizes, begins)
    low, high = np.minimum.reduceat(labels, begins), np.maximum.reduceat(labels, begins)
    row, to = _after(leaf + 1, leaf[ends - 1][tree] + 1)
    good = (DEN * sizes[row] >= NUM * small[to]) & ((low[to] != labels[row]) | (high[to] != labels[row]))
    row, to = row[good], to[good]
    good = may_link(_bounds(counts, row, largest, to), sizes[row], small[to])
    row, to = row[good], to[good]
    near, far = _after(np.r_[rows + 1, begins[to]], np.r_[leaf_end[leaf], leaf_end[to]])
    a, b = np.r_[rows, row][near], far
    good = (labels[a] != labels[b]) & (DEN * sizes[a] >= NUM * sizes[b])
    a, b = a[good], b[good]
    good = may_link(_bounds(counts, a, counts, b), sizes[a], sizes[b])
    a, b = a[good], b[good]
    long = np.array([len(p) for p in fine])
    left, least = np.ones(len(a), bool), np.minimum(long[a], long[b])
    for groups in np.unique(least[least > GROUPS]):
        # the larger point is folded to the groups of the smaller one
        some = np.flatnonzero(least == groups)
        own, at = np.unique(np.r_[a[some], b[some]], return_inverse=True)
        points = _folded_all(fine, own, int(groups), kind)
        left[some] = may_link(_bounds(points, at[: len(some)], points, at[len(some) :]), sizes[a[some]], sizes[b[some]])
    a, b = a[left], b[left]
    met = np.zeros(len(tree), bool)
    met[a] = met[b] = True
    few = np.bincount(tree[a], minlength=len(ends)) <= np.bincount(tree[met], minlength=len(ends))
    told = few[tree[a]]
    return order[np.stack([a[told], b[told]])], order[met & ~few[tree]]


def spanning_links(labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Rows that link, one pair for every two components that links join; rows of one label are one from the start.

    Shingles stand in an inverted index, so a row's shared shingles with all others are counted at once. Rows
    with the most common shingles come first, as they link with most; a row is left when no other is apart.
    """
    _, component = np.unique(labels, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by = np.argsort(shingle, kind="stable")
    owners, begin = owner[by], np.r_[0, np.cumsum(often)]
    own_begin = np.r_[0, np.cumsum(sizes)]
    out: list[tuple[int, int]] = []
    for k in np.argsort(-np.bincount(owner, often[shingle], len(sets)) / np.maximum(sizes, 1), kind="stable"):
        apart = component != component[k]
        if not apart.any():
            break
        own = shingle[own_begin[k] : own_begin[k + 1]]
        size = often[own]
        ends = np.cumsum(size)
        places = np.repeat(begin[own] - (ends - size), size) + np.arange(int(size.sum()))
        shared = np.bincount(owners[places], minlength=len(sets))
        for j in np.flatnonzero(apart & may_link(shared, sizes[k], sizes)):
            if component[j] != component[k]:
                out.append((int(k), int(j)))
                component[component == component[j]] = component[k]
    return out


def _documents(docs: DataFrame, again: np.ndarray) -> DataFrame:
    """doc_id, n, the class's two names and the point of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            names, fine = _names(sets, again).view(np.int64), [fine_point(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([p.tobytes() for p in fine], pa.binary())], ["doc_id", "n", "name", "check", "point"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, name bigint, check bigint, point binary")


def _rows(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by key."""
    order = np.argsort(keys)
    keys, names = keys[order], names[order]
    same = keys[1:] == keys[:-1]
    many = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    names[many] = names[many[np.lexsort((names[many], keys[many]))]]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])][: len(keys)]
    return keys[new], names[new]


def _shared_keys(docs: DataFrame, late: Bits, again: np.ndarray, parts: int) -> DataFrame:
    """(key, name) of every key that two classes at least have in their prefixes; a row may come twice.

    Tasks send packed keys by part. A key that a task itself finds in two classes is known to be shared; its
    rows go anywhere, and one of them stands for the task under the key's own part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(late)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            keys, names = _rows(*(np.concatenate(x) for x in zip(*held)))
            first = np.r_[True, keys[1:] != keys[:-1]]
            many = ~(first & np.r_[first[1:], True])
            rows = []
            for at in range(0, int(many.sum()), 100_000):
                rows.append(((turn * 7919) % parts, True, keys[many][at : at + 100_000].tobytes(), names[many][at : at + 100_000].tobytes()))
                turn += 1
            keys, names = keys[first], names[first]
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[p] : cuts[p + 1]]
                rows.append((int(p), False, keys[own].tobytes(), names[own].tobytes()))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["part", "known", "keys", "names"])

        size = 0
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            names = _names(sets, again)[:, 0]
            firsts = [prefix(s, sent.value) if len(s) else s for s in sets]
            if any(map(len, firsts)):
                held.append((np.concatenate(firsts), np.repeat(names, [len(f) for f in firsts])))
                size += len(held[-1][0])
            if size > HELD:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for known, keys, names in zip(*(batch.column(c).to_pylist() for c in ("known", "keys", "names"))):
                keys, names = np.frombuffer(keys, np.uint64), np.frombuffer(names, np.uint64)
                if known:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(names.view(np.int64))], ["key", "name"])
                else:
                    held.append((keys, names))
        if held:
            keys, names = _rows(*(np.concatenate(x) for x in zip(*held)))
            first = np.r_[True, keys[1:] != keys[:-1]]
            many = ~(first & np.r_[first[1:], True])
            keys, names = keys[many], names[many]
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(names[at : at + 100_000].view(np.int64))], ["key", "name"])

    packed = docs.select("text").mapInArrow(deal, "part bigint, known boolean, keys binary, names binary")
    return packed.repartition(parts, "part").mapInArrow(meet, "key bigint, name bigint")


def _places(classes: DataFrame, names: DataFrame) -> DataFrame:
    """place: hashes of the documents that stand for the classes named (name)."""
    return names.distinct().join(classes.select("name", "doc_id"), "name").select(F.xxhash64("doc_id").alias("place"))


def _sets(scratch: Scratch, docs: DataFrame, classes: DataFrame, names: DataFrame, again: np.ndarray) -> DataFrame:
    """name, set of the classes named (name); by chance of a few more. A pass over the texts shingles those alone."""
    places = scratch.keep(_places(classes, names), "places")
    mask = docs.sparkSession.sparkContext.broadcast(Bits.of(places, "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(mask.value.has(batch.column("place").to_numpy())))
            if batch.num_rows:
                sets = shingle_sets(batch.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(_names(sets, again)[:, 0].view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["name", "set"])

    found = docs.select("text", F.xxhash64("doc_id").alias("place")).mapInArrow(run, "name bigint, set binary")
    # rows that repeat an id, or share its hash, may be copies: one set a class
    kept = scratch.keep(found.filter(F.octet_length("set") > 0).dropDuplicates(["name"]), "sets")
    scratch.drop(places)
    return kept


def _linked(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, again: np.ndarray) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, as (u, v): first those that their points allow, then by their shingles."""
    side = lambda s: classes.select(F.col("name").alias(s), F.col("n").alias(f"n{s}"), F.col("point").alias(f"p{s}"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist())
                shared = [bound(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) for a, b in points]
                good = may_link(np.array(shared), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])

    near = (F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM)
    left = pairs.join(side("a"), "a").join(side("b"), "b").filter(near)
    left = scratch.keep(left.mapInArrow(bounded, "a bigint, b bigint, na bigint, nb bigint"), "bounded")
    sets = _sets(scratch, docs, classes, left.select(F.col("a").alias("name")).unionAll(left.select(F.col("b"))), again)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
                # each is ascending and has no number twice
                shared = [len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True)) for a, b in both]
                good = pa.array(may_link(np.array(shared), batch.column("na").to_numpy(), batch.column("nb").to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["u", "v"])

    full = left.join(sets.select(F.col("name").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("name").alias("a"), F.col("set").alias("sa")), "a")
    out = scratch.keep(full.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(verified, "u bigint, v bigint"), "links")
    scratch.drop(left)
    scratch.drop(sets)
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows sorted by key and deal, those of one tree at a time; a tree may come in many batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, deal = batch.column("key").to_numpy(), batch.column("deal").to_numpy()
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (deal[1:] != deal[:-1]), True])
        for a, b in zip(cuts, cuts[1:]):
            if last is not None and last != (key[a], deal[a]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = (key[a], deal[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each tree, or where they are more than its rows with a partner, these rows (b null)."""
    out: list[np.ndarray] = []
    small: list[pa.Table] = []
    held = told = 0

    def tell(rows: pa.Table, pairs: np.ndarray, alone: np.ndarray) -> None:
        nonlocal told
        key, deal, name = (rows.column(c).to_numpy() for c in ("key", "deal", "name"))
        for at, found, pair in ((pairs[0], np.sort(name[pairs], axis=0), 1), (alone, np.stack([name[alone], name[alone]]), 0)):
            if len(at):
                told += len(at)
                out.append(np.stack([key[at], deal[at], *found, np.full(len(at), pair)]))

    def read(rows: pa.Table) -> tuple:
        return rows.column("label").to_numpy(), rows.column("n").to_numpy(), [np.frombuffer(p, np.uint8) for p in rows.column("point").to_pylist()]

    def search_small() -> None:
        rows = pa.concat_tables(small).combine_chunks()
        tree = np.repeat(np.arange(len(small)), [t.num_rows for t in small])
        tell(rows, *forest_pairs(tree, *read(rows)))
        small.clear()

    def send() -> pa.RecordBatch:
        key, deal, a, b, pair = np.concatenate(out, 1)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(deal), pa.array(a), pa.array(b, mask=pair == 0)], ["key", "deal", "a", "b"])

    for t in _trees(batches):
        if t.num_rows <= LEAF * LEAF:
            small.append(t)
            held += t.nbytes
            if held > 2_000_000:
                search_small()
                held = 0
        else:
            pairs, rows = tree_pairs(*read(t))
            tell(t, pairs, rows if not pairs.shape[1] else rows[:0])
        if told > 50_000:
            yield send()
            told = 0
    if small:
        search_small()
    if out:
        yield send()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that join components of each tree, whose rows have their sets."""
    for t in _trees(batches):
        name = t.column("name").to_numpy()
        found = spanning_links(t.column("label").to_numpy(), [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()])
        if found:
            at = np.array(found)
            yield pa.RecordBatch.from_arrays([pa.array(name[at[:, 0]]), pa.array(name[at[:, 1]])], ["u", "v"])


def _dealt(scratch: Scratch, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """key, deal, label, name, n, point: the rows (key, name, label, n) of keys with several labels, in deals of bounded size.

    The rows of a key's most common label are cut into parts and the others into blocks. Every part meets every
    block, and every block each other, so any two rows of different labels meet.
    """
    per_label = rows.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("w"))
    every = [F.sum("rows").alias("rows"), F.sum("w").alias("w"), F.count("*").alias("labels"), F.max(F.struct("rows", "label", "w")).alias("main")]
    per_key = per_label.groupBy("key").agg(*every).filter("labels > 1")
    cut = lambda r, w: F.greatest(F.lit(1), F.ceil(r / LIMIT), F.ceil(w / SHINGLES)).cast("int")
    per_key = per_key.select("key", F.col("main.label").alias("main"), cut(F.col("main.rows"), F.col("main.w")).alias("parts"), cut(F.col("rows") - F.col("main.rows"), F.col("w") - F.col("main.w")).alias("blocks"))
    per_key = scratch.keep(per_key, "per_key")
    met = rows.join(per_key, "key")
    part = F.pmod(F.xxhash64("name"), F.col("parts")).cast("long")
    block = F.pmod(F.xxhash64("name", F.lit(1)), F.col("blocks")).cast("long")
    wide, last = 1 << 30, 1 << 60
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    of_main = F.transform(upto(F.col("blocks")), lambda q: part * wide + q)
    with_main = F.transform(upto(F.col("parts")), lambda p: p * wide + block)
    with_blocks = F.when(F.col("blocks") > 1, F.transform(upto(F.col("blocks")), lambda q: F.lit(last) + F.least(block, q) * wide + F.greatest(block, q))).otherwise(F.array().cast("array<bigint>"))
    deals = F.when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(with_main, with_blocks))
    met = met.select("key", "label", "name", F.explode(deals).alias("deal"))
    return met.join(classes.select("name", "n", "point"), "name").select("key", "deal", "label", "name", "n", "point")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their class (name); a class that no link has labels itself."""
    found = rows.join(labels.select(F.col("node").alias("name"), "label"), "name", "left")
    return found.select(*rows.columns, F.coalesce("label", "name").alias("label"))


def _mixed(scratch: Scratch, rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose group still has two labels."""
    some = rows.groupBy(*by).agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2").select(*by)
    # written first, so that a join of a group of many rows can be split
    return scratch.keep(rows.join(scratch.keep(some, "mixed"), by, "left_semi"), "open")


def class_links(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, name of the class), labels (node, label) of linked classes, and links (u, v) of classes.

    The links are verified and hold every component together; those that join nothing new aren't among them.
    """
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    again = np.zeros(0, np.uint64)
    while True:
        own = scratch.keep(_documents(texts, again), "documents")
        classes = own.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("point").alias("point"), F.min("check").alias("c1"), F.max("check").alias("c2"))
        classes = scratch.keep(classes, "classes")
        # of n sets about n * n / 2**65: none at 10**9, some tens at 10**11
        same = classes.filter("c1 <> c2").select("name").toPandas()["name"].to_numpy(np.int64).view(np.uint64)
        if not len(same):
            break
        again = np.union1d(again, same)
    classes = classes.drop("c1", "c2")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = scratch.keep(_shared_keys(texts, NOTHING, again, parts), "keys")
    often = scratch.keep(shared.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > OFTEN), "often")
    if not often.isEmpty():
        scratch.drop(shared)
        shared = scratch.keep(_shared_keys(texts, Bits.of(often, "key", 24), again, parts), "keys2")
    # of keys that hold the same classes one is enough
    held = shared.distinct().withColumn("h", F.xxhash64("name"))
    rows = scratch.keep(held, "held")
    scratch.drop(shared)
    kinds = rows.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"))
    trees = scratch.keep(kinds.groupBy("k", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("keys")).filter("k > 1").select("key", "keys"), "trees")
    old, rows = rows, scratch.keep(rows.join(trees, "key").select("key", "name", "keys"), "rows")
    scratch.drop(old)

    # a class that links with a star takes its label: equal labels are one component, though one may have several yet
    popular = rows.groupBy("name").agg(F.sum("keys").alias("popular")).join(classes.select("name", "n"), "name")
    open_rows, links = scratch.keep(rows.join(popular, "name").withColumn("label", F.col("name")), "open"), None
    scratch.drop(rows)
    for turn in range(ROUNDS):
        # each class meets one class of its keys: of each key's chosen one, that of most keys
        choice = F.struct(*([F.col("popular")] if turn == 0 else []), F.xxhash64("name", F.lit(turn)))
        stars = scratch.keep(open_rows.groupBy("key").agg(F.max_by(F.struct("name", "label"), choice).alias("star")), "stars")
        met = open_rows.join(stars, "key").filter("label <> star.label").groupBy("name", "label", "star").agg(F.sum("keys").alias("keys"))
        pairs = met.groupBy(F.col("name").alias("b"), F.col("label").alias("old")).agg(F.max_by("star", F.struct("keys", "star")).alias("star"))
        pairs = scratch.keep(pairs.select("b", "old", F.col("star.name").alias("a"), F.col("star.label").alias("new")), "pairs")
        linked = _linked(scratch, texts, classes, pairs.select("a", "b"), again)
        links = linked if links is None else links.unionAll(linked)
        moved = pairs.join(linked.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"]).groupBy(F.col("old").alias("label")).agg(F.min("new").alias("new"))
        moved = scratch.keep(moved, "moved")
        # what a star itself moved to is its members' label too; twice, for stars of stars
        onward, target = moved, moved.select(F.col("label").alias("new"), F.col("new").alias("next"))
        for _ in range(2):
            onward = onward.join(target, "new", "left").select("label", F.coalesce("next", "new").alias("new"))
        named = open_rows.join(scratch.keep(onward, "onward"), "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
        old, open_rows = open_rows, _mixed(scratch, scratch.keep(named, "named"), ["key"])
        scratch.drop(old)

    dealt = _dealt(scratch, open_rows, classes).repartition(parts, "key", "deal").sortWithinPartitions("key", "deal")
    found = scratch.keep(dealt.mapInArrow(_searched, "key bigint, deal bigint, a bigint, b bigint"), "found")
    pairs = scratch.keep(found.filter("b is not null").select("a", "b").distinct(), "pairs")
    if not pairs.isEmpty():
        links = links.unionAll(_linked(scratch, texts, classes, pairs, again))
    links = scratch.keep(links, "links")
    labels = scratch.keep(components(scratch, links), "labels")
    # trees with more pairs than rows, as far as they still hold several components
    rest = found.filter("b is null").select("key", "deal", F.col("a").alias("name")).distinct()
    if not rest.isEmpty():
        rest = _mixed(scratch, scratch.keep(_labelled(rest, labels), "rest"), ["key", "deal"])
        sets = _sets(scratch, texts, classes, rest.select("name"), again)
        whole = rest.join(sets, "name").select("key", "deal", "label", "name", "set").repartition(parts, "key", "deal").sortWithinPartitions("key", "deal")
        links = scratch.keep(links.unionAll(whole.mapInArrow(_joined, "u bigint, v bigint")), "links")
        labels = scratch.keep(components(scratch, links), "labels")
    scratch.only(own, labels, links)
    return own, labels, links


def link(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row of docs (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable by links, class_id that of the documents with equal sets. A text
    without words, an empty and a null one have no shingles and are linked with nothing. Rows that repeat an id
    are documents of their own, and link as their texts do. A null id can't name a component unless all its ids
    are null. No rows give none.
    """
    own, labels, _ = class_links(spark, docs)
    scratch = Scratch(spark, "jaccard-ids")
    classes = own.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(labels.withColumnRenamed("node", "name"), "name", "left").select("name", "class_id", F.coalesce("label", "name").alias("label"))
    classes = scratch.keep(classes, "classes")
    least = scratch.keep(classes.groupBy("label").agg(F.min("class_id").alias("component_id")), "least")
    named = scratch.keep(classes.join(least, "label").select("name", "class_id", "component_id"), "named")
    result = own.filter("n > 0").join(named, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    return result.unionAll(own.filter("n = 0").select("doc_id", F.col("n"), F.col("doc_id"), F.col("doc_id")))


def links(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """class_a, class_b: verified links between classes of equal sets, by their smallest doc_ids, that hold each component together.

    With class_id of ``link`` as membership they say who is joined with whom, and by what. Null ids and rows
    without shingles as there.
    """
    own, _, found = class_links(spark, docs)
    ids = Scratch(spark, "jaccard-links").keep(own.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("class_id")), "ids")
    side = lambda c: ids.select(F.col("name").alias(c), F.col("class_id").alias(f"class_{'a' if c == 'u' else 'b'}"))
    return found.join(side("u"), "u").join(side("v"), "v").select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
