"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are at most EXAMPLES labelled rows outside the held-out fold, those with the smallest hashes of
their ids. Vectors have all words of the examples. A word's weight is (1 + log of its times) * idf * relevance:
idf counts all documents, relevance is LEAST plus the lower bound of the word's log odds for label 1 where
that is above 0. Without relevance, neighbours are those on the same topic, whatever their label. Odds count
a word once for each pair of neighbouring words it has, so that copies of one text count once.

The examples' vectors are in an inverted index in blocks of alike examples; a block knows its largest weight
of each word, and a search leaves the blocks that can't reach its k-th best. Votes weigh by nearness. What
votes mean is fitted (a logistic curve) on the examples themselves, each judged by the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.storage import Scratch
from weft.llm.word_hash import NOT_LETTERS, mix, release, slices, words

EXAMPLES = 8000
NEIGHBOURS = 30
BLOCK = 64
#: Blocks that a search reads first; of more than one in WHOLE of all that are left it reads all postings of its words.
FIRST, WHOLE = 8, 8
#: Words of one example in COMMON are scored by a matrix, for TOGETHER texts at once.
COMMON, TOGETHER = 12, 64
#: Bytes of texts that a task looks at together; its arrays are many times as large.
PORTION = 400_000
FOLDS = 5
#: Weight of a word that tells nothing of the label, beside log odds of words that do; their deviations below the estimate.
LEAST, DEVIATIONS = 0.1, 2.0
#: A vote weighs one by (NEAREST + the cosine's distance from 1).
NEAREST = 0.1


def relevance(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of words with n places, ``ones`` of them toxic."""
    a, b = ones + 0.5, n - ones + 0.5
    base = math.log((ones.sum() + 0.5) / ((n - ones).sum() + 0.5)) if len(n) else 0.0
    return LEAST + np.maximum(0.0, np.log(a / b) - base - DEVIATIONS * np.sqrt(1 / a + 1 / b))


def ragged(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    ends = np.cumsum(size)
    out = np.repeat(starts - (ends - size), size)
    out += np.arange(len(out))
    return out


def alike_order(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """An order of n sparse vectors in which neighbours are alike: halves along the main direction, again and again."""
    dense = np.zeros((n, 64))
    np.add.at(dense, (rows, (cols.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(26)), weights)
    out, todo = [], [np.arange(n)]
    while todo:
        own = todo.pop()
        if len(own) <= BLOCK:
            out.append(own)
            continue
        x = dense[own] - dense[own].mean(0)
        direction = np.ones(64)
        for _ in range(8):
            direction = x.T @ (x @ direction) + 1e-12
            direction /= np.linalg.norm(direction)
        order = own[np.argsort(np.round(x @ direction, 9), kind="stable")]
        # whole blocks on the left, so that at most the last block isn't full
        half = max(1, round(len(own) / 2 / BLOCK)) * BLOCK
        todo += [order[half:], order[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Unit vectors of examples by word: ``search`` is exact, whatever the order in blocks.

    rows, words, weights: the entries of all vectors; ids and labels: of the examples. Words of one example in
    COMMON at least have a column of a matrix, which scores many texts at once; the others have postings in
    blocks, and a block can reach no more than its best common part and its largest weights of the others.
    """

    def __init__(self, rows: np.ndarray, word: np.ndarray, weights: np.ndarray, ids: np.ndarray, labels: np.ndarray, n_words: int):
        order = alike_order(rows, word, weights, len(ids))
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        self.ids, self.labels, self.n_blocks = ids[order], labels[order].astype(np.int32), -(-len(ids) // BLOCK)
        at = place[rows]
        by = np.lexsort((at, word))
        self.sent = np.bincount(word, minlength=n_words).astype(np.uint32), at[by], weights[by].astype(np.float32)
        self.column, self.scored = None, 0

    def _open(self) -> None:
        """Make what a search reads from the size of each word's postings, their examples and weights; once in a process that searches."""
        if self.column is not None:
            return
        size, at, weights = self.sent
        size, at = size.astype(np.int64), at.astype(np.int32)
        common = np.flatnonzero(size * COMMON >= max(COMMON, len(self.ids)))
        self.column = np.full(len(size), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((self.n_blocks * BLOCK, len(common)))
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        dense = self.column[word] >= 0
        self.matrix[at[dense], self.column[word[dense]]] = weights[dense]
        # every worker keeps these, so they take few bytes
        few = np.uint16 if len(self.ids) <= 1 << 16 else np.int32
        word, self.example, self.weight = word[~dense], at[~dense].astype(few), weights[~dense]
        block = self.example // few(BLOCK)
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])][: len(word)])
        #: entries (word, block) with where their postings begin, how many they are and their largest weight, and where a word's entries begin
        self.begin = first.astype(np.int32)
        self.size = np.diff(np.r_[first, len(word)]).astype(np.int32)
        self.block = block[first]
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.word_begin = np.searchsorted(word[first], np.arange(len(size) + 1, dtype=np.int32)).astype(np.int32)
        #: where a word's postings begin
        self.posting_begin = np.r_[self.begin, np.int32(len(word))][self.word_begin]

    def __getstate__(self):
        # tasks are sent the postings alone, in few bytes
        sizes, example, weight = self.sent
        return self.ids, self.labels, sizes, example.astype(np.uint16 if len(self.ids) <= 1 << 16 else np.uint32), weight

    def __setstate__(self, state):
        self.ids, self.labels, *sent = state
        self.n_blocks, self.sent, self.column, self.scored = -(-len(self.ids) // BLOCK), tuple(sent), None, 0

    def common_parts(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common words give to the cosine of each text with each example."""
        self._open()
        texts = np.zeros((len(vectors), self.matrix.shape[1]))
        for row, (word, weights) in zip(texts, vectors):
            column = self.column[word]
            row[column[column >= 0]] = weights[column >= 0]
        return texts @ self.matrix.T

    def search(self, word: np.ndarray, weights: np.ndarray, k: int, part: np.ndarray | None = None, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest with a cosine above 0, nearest first, ties to the smaller id.

        ``part`` is the text's row of ``common_parts``. With ``but``, the id of an example, it and all copies of the text take no part.
        """
        self._open()
        part = self.common_parts([(word, weights)])[0] if part is None else part
        rare = self.column[word] < 0
        word, weights = word[rare], weights[rare]
        begin = self.word_begin[word]
        size = self.word_begin[word + 1] - begin
        entry, own = ragged(begin, size), np.repeat(weights, size)
        block = self.block.take(entry, mode="clip")
        bound = part.reshape(-1, BLOCK).max(1) + np.bincount(block, self.most.take(entry, mode="clip") * own, self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        cosines, places, step = np.zeros(0), np.zeros(0, np.int64), FIRST
        while len(order):
            # picking many blocks' postings costs more than reading those of the other blocks along
            many = len(order) > max(step, self.n_blocks // WHOLE) and step > FIRST
            now, order = (order, order[:0]) if many else (order[:step], order[step:])
            wanted = np.zeros(self.n_blocks, bool)
            wanted[now] = True
            if many:
                begin, given = self.posting_begin[word], weights
                size = self.posting_begin[word + 1] - begin
            else:
                some = np.flatnonzero(wanted.take(block))
                meant, given = entry.take(some), own.take(some)
                begin, size = self.begin.take(meant), self.size.take(meant)
            at, given = ragged(begin, size), np.repeat(given, size)
            given *= self.weight.take(at, mode="clip")
            sums = part + np.bincount(self.example.take(at, mode="clip"), given, len(part))
            # what can't be among the nearest needn't be looked at
            near = np.flatnonzero(sums >= (max(1e-12, cosines[-1] - 1e-11) if len(cosines) == k else 1e-12))
            new = near[wanted[near // BLOCK] & (sums[near] > 1e-12)]
            if but is not None:
                new = new[(self.ids[new] != but) & (sums[new] < 1 - 1e-6)]
            cosines, places = np.concatenate([cosines, np.round(sums[new], 12)]), np.concatenate([places, new])
            if len(cosines) > 4 * k:
                near = np.flatnonzero(cosines >= np.partition(cosines, -k)[-k])
                cosines, places = cosines[near], places[near]
            best = np.lexsort((self.ids[places], -cosines))[:k]
            cosines, places = cosines[best], places[best]
            self.scored += len(now)
            step *= 4
            if len(cosines) == k:
                order = order[bound[order] >= cosines[-1] - 1e-9]
        return cosines, places


class Model:
    """The words' ascending hashes and weights, the index of examples, and what votes mean."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, index: BlockMaxIndex | None, prior: float, k: int):
        self.hashes, self.weights, self.index, self.prior, self.k = hashes, weights, index, prior, k
        self.slope, self.shift = 1.0, 0.0
        self.sent = None

    def __getstate__(self):
        return self.hashes, self.weights, self.index, self.prior, self.k

    def __setstate__(self, state):
        self.__init__(*state)

    def send(self, spark: SparkSession):
        """The model as a broadcast, once; its curve isn't part of it."""
        self.sent = self.sent or spark.sparkContext.broadcast(self)
        return self.sent

    def vector(self, word: np.ndarray, times: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(times)) * self.weights[word]
        norm = math.sqrt(float(raw @ raw))
        return raw / norm if norm else raw

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> Iterator[tuple]:
        """For each text (words, times) the toxic part of the nearest examples' votes, and these as (id, cosine, label).

        None without neighbours. ``but`` has the id of an example for each text; it takes no part, nor do its copies.
        """
        for at in range(0, len(texts), TOGETHER):
            vectors = [(word, self.vector(word, times)) for word, times in texts[at : at + TOGETHER]]
            parts = self.index.common_parts(vectors) if self.index is not None else vectors
            for n, ((word, weights), part) in enumerate(zip(vectors, parts), at):
                if not len(word) or self.index is None:
                    yield None, []
                    continue
                cosines, places = self.index.search(word, weights, self.k, part, None if but is None else but[n])
                if not len(places):
                    yield None, []
                    continue
                weighed = 1 / (NEAREST + 1 - cosines)
                toxic = float(weighed @ self.index.labels[places] / weighed.sum())
                yield toxic, list(zip(self.index.ids[places[:3]].tolist(), cosines[:3].tolist(), self.index.labels[places[:3]].tolist()))

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]], curve: tuple[float, float]) -> Iterator[tuple[float, list]]:
        """Score and evidence of each text (words, times)."""
        for toxic, near in self.votes(texts):
            yield (self.prior, []) if toxic is None else (calibrated(toxic, curve), near)


def calibrated(toxic: float, curve: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-min(700.0, max(-700.0, curve[0] * logit(toxic) + curve[1]))))


def logit(toxic):
    return np.log((toxic + 0.02) / (1.02 - toxic))


def fit_curve(toxic: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from votes to labels, by Newton's method; a weak prior keeps both finite."""
    x = np.stack([logit(toxic), np.ones(len(toxic))], 1)
    w, hold = np.array([1.0, 0.0]), np.diag([1.0, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (labels - p) - hold @ (w - [1.0, 0.0]))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    # votes for label 1 never lower a score
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def counts_of(texts: pa.Array, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its words, as places in the ascending hashes, and how often each is there."""
    found, per_text = words(texts, NOT_LETTERS)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(hashes) or not len(found):
        return [none] * len(texts)
    # in ascending order neighbours are looked up side by side
    order = np.argsort(found)
    at = np.empty(len(found), np.int64)
    at[order] = np.minimum(np.searchsorted(hashes, found[order]), len(hashes) - 1)
    hit = np.flatnonzero(hashes[at] == found)
    text = np.repeat(np.arange(len(per_text)), per_text)[hit]
    keys, n = np.unique(text * len(hashes) + at[hit], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * len(hashes))
    return [(keys[a:b] - t * len(hashes), n[a:b]) for t, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _frequencies(texts: DataFrame, sent, n_words: int) -> np.ndarray:
    """In how many of all texts each of the words sent to the tasks is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(sent.value), np.int64)
        for batch in slices(batches, "text", PORTION):
            for word, _ in counts_of(batch.column("text"), sent.value):
                held[word] += 1
        at = np.flatnonzero(held)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(held[at[k : k + 100_000]])], ["word", "n"])

    # a row for each word of the examples at most
    found = texts.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_words)
    out[found["word"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Model:
    """The model of docs (doc_id, text) with labels (doc_id, toxic), of which rows in the held-out fold aren't read.

    Null labels and ids, and labels of no document, take no part. A document with two labels is toxic if
    one of them says so; rows that repeat an id are examples each, copies of one another. Without examples
    every score is the same. What reaches the driver are the words of at most ``examples`` texts.
    """
    scratch = Scratch(spark, "toxic")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    named = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    # at most ``examples`` rows of two numbers
    sample = scratch.keep(texts.join(F.broadcast(named), "doc_id"), "sample")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PORTION):
            found, per_text = words(batch.column("text"), NOT_LETTERS)
            # a text begins and ends with nothing beside it, whatever comes with it in a batch
            before, after = np.r_[np.uint64(0), found[:-1]][: len(found)], np.r_[found[1:], np.uint64(0)][: len(found)]
            ends = np.cumsum(per_text)[per_text > 0]
            before[np.r_[0, ends[:-1]][: len(ends)]] = 0
            after[ends - 1] = 0
            pair = mix(before * np.uint64(3) + after)
            toxic = np.repeat(batch.column("toxic").to_numpy(), per_text)
            rows = np.unique(np.stack([found, pair, toxic.astype(np.uint64)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].view(np.int64)), pa.array(rows[:, 1].view(np.int64)), pa.array(rows[:, 2].astype(np.int32))], ["word", "place", "toxic"])

    # a place that both labels have is a toxic one no more
    once = sample.mapInArrow(places, "word bigint, place bigint, toxic int").groupBy("word", "place").agg(F.min("toxic").alias("toxic"))
    per_word = once.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("ones")).toPandas()
    found = per_word["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    hashes, relevant = found[order], relevance(per_word["n"].to_numpy(float)[order], per_word["ones"].to_numpy(float)[order])
    del per_word, found, order
    n_docs = docs.count()
    sent = spark.sparkContext.broadcast(hashes)
    idf = np.log((n_docs + 1) / (_frequencies(texts, sent, len(hashes)) + 1)) + 1
    weights = idf * relevant

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PORTION):
            found = counts_of(batch.column("text"), sent.value)
            packed = [pa.array([x[c].astype("<i4").tobytes() for x in found], pa.binary()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *packed], ["doc_id", "toxic", "words", "times"])

    counted = scratch.keep(sample.mapInArrow(count, "doc_id bigint, toxic int, words binary, times binary"), "counted")
    sent.unpersist()
    rows = counted.toPandas().sort_values(["doc_id", "words"], kind="stable")
    ids, toxic = rows["doc_id"].to_numpy(np.int64), rows["toxic"].to_numpy(np.int64)
    word, times = ([np.frombuffer(x, "<i4") for x in rows[c]] for c in ("words", "times"))
    model = Model(hashes, weights, None, (float(toxic.sum()) + 0.05) / (len(rows) + 1), k)
    vectors = [model.vector(w, n).astype(np.float32) for w, n in zip(word, times)]
    del rows, times
    if any(map(len, vectors)):
        at = np.repeat(np.arange(len(ids), dtype=np.int32), [len(w) for w in word])
        model.index = BlockMaxIndex(at, np.concatenate(word), np.concatenate(vectors), ids, toxic, len(hashes))
        del at, word, vectors
        release()
        model.slope, model.shift = _curve(spark, counted, model)
    return model


def _curve(spark: SparkSession, counted: DataFrame, model: Model) -> tuple[float, float]:
    """The curve that the examples' own votes ask for, each example and its copies left out of its own."""
    sent = model.send(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [tuple(np.frombuffer(x, "<i4") for x in both) for both in zip(*(batch.column(c).to_pylist() for c in ("words", "times")))]
            votes = [v for v, _ in sent.value.votes(texts, batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column("toxic")], ["vote", "toxic"])

    parts = spark.sparkContext.defaultParallelism
    found = counted.repartition(parts, "doc_id").mapInArrow(run, "vote double, toxic int").filter("vote is not null").toPandas()
    found = found.sort_values(["vote", "toxic"])
    return fit_curve(found["vote"].to_numpy(float), found["toxic"].to_numpy(float)) if len(found) else (1.0, 0.0)


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (up to three examples) of all rows of docs (doc_id, text).

    A null text is empty; a text without any of the examples' words gets the share of toxic examples. A
    null id isn't held out. Rows that repeat are scored each, all alike. No rows give no rows. Other columns
    of docs are ignored, whatever their names.
    """
    sent, curve = model.send(spark), (model.slope, model.shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PORTION):
            found = list(sent.value.scores(counts_of(batch.column("text"), sent.value.hashes), curve))
            why = [[{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in e] for _, e in found]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([s for s, _ in found], pa.float64()), pa.array(why, kind)], ["doc_id", "held_out", "score", "evidence"])

    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long"), (rest == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't call toxic."""
    sent, curve = model.send(spark), (model.slope, model.shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PORTION):
            good = [score < 0.5 for score, _ in sent.value.scores(counts_of(batch.column("text"), sent.value.hashes), curve)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(spark, docs, fit(spark, docs, labels)).drop("evidence")
