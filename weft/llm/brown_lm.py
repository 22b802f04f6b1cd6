"""Language-model scores by class-based n-grams of Brown classes.

Words get classes by exchange clustering: the most frequent words (the core) are moved one by one to the
class that raises the likelihood of the class bigrams most, until none moves; then every other training word
goes, in one exchange step, to the class that its own contexts make likeliest. The model of a text is
P(class | class before) * P(word | class). Words that the training rows don't have are a class of their own,
which the next word looks through: its history is the last known word.

Counts and classes are of all training words, by 64-bit hash. What is sent to every task is bounded: the core,
its bigrams and TABLE_WORDS words at most. Counts and classes of rarer words stay in a table and meet the rarer
words of the texts, and the words beside them, in a join; the scores are the same whatever the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.storage import Scratch
from weft.llm.word_hash import slices, words

CLASSES = 32
CORE_WORDS = 1024
TABLE_WORDS = 1 << 19
PASSES = 6
ALPHA = 0.1
FOLDS, HELD_OUT = 7, 2
CHUNK = 4_000_000
RARE, NONE = -1, -2


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a batch with a 0 after every text, and where each text's 0 is."""
    hashes, per_text = words(batch.column("text"))
    ends = np.cumsum(per_text + 1) - 1
    out = np.zeros(len(hashes) + len(per_text), np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    # 0 is the end alone
    out[inside] = np.where(hashes == 0, 1, hashes)
    return out, ends


def _numbers(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of hashes in the ascending known; RARE where they aren't there."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, RARE)


def _history(ids: np.ndarray, start: int) -> np.ndarray:
    """For each place the last id before it that isn't negative; start before the first."""
    at = np.maximum.accumulate(np.where(ids >= 0, np.arange(len(ids)), -1))
    at = np.r_[-1, at[:-1]]
    return np.where(at >= 0, ids[at], start)


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate(parts), return_counts=True)
    return found, n


def _gathered(df: DataFrame, keys_of) -> DataFrame:
    """(key, n): how often keys_of(tokens) gives each 64-bit key over all texts, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found, n = _counted(held)
            for at in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000].astype(np.int64))], ["key", "n"])

        for batch in slices(batches, "text"):
            held.append(keys_of(_tokens(batch)[0]))
            size += len(held[-1])
            if size > CHUNK:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return df.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _contexts(df: DataFrame, of) -> DataFrame:
    """(key, before, n): the words of all texts with the class before each, counted in each task; a pair may come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, before = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((before, keys))
            keys, before = keys[order], before[order]
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (before[1:] != before[:-1])][: len(keys)])
            n = np.diff(np.r_[new, len(keys)])
            for at in range(0, len(new), 100_000):
                own = new[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array(before[own].astype(np.int32)), pa.array(n[at : at + 100_000].astype(np.int64))], ["key", "before", "n"])

        for batch in slices(batches, "text"):
            keys, before = of(_tokens(batch)[0])
            held.append((keys, before.astype(np.int16)))
            size += len(keys)
            if size > CHUNK // 2:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return df.select("text").mapInArrow(run, "key bigint, before int, n bigint")


def exchange(bigrams: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Class of each word by exchange clustering; bigrams[a, b]: how often b follows a. The last word keeps a class of its own."""
    n = len(bigrams)
    own = np.r_[np.arange(n - 1) % classes, classes]
    flat = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    one = np.eye(classes + 1)[own]
    grid = one.T @ bigrams @ one
    every = np.arange(classes + 1)
    for _ in range(passes):
        moved = 0
        after, before = bigrams @ one, bigrams.T @ one
        for w in range(n - 1):
            right, left, self_ = after[w].copy(), before[w].copy(), bigrams[w, w]
            old = own[w]
            right[old] -= self_
            left[old] -= self_
            grid[old, :] -= right
            grid[:, old] -= left
            grid[old, old] -= self_
            f = flat(grid)
            gain = (flat(grid + right) - f).sum(1) + (flat(grid.T + left) - f.T).sum(1)
            d = grid.diagonal()
            gain += flat(d + right + left + self_) - flat(d + right) - flat(d + left) + flat(d)
            # whatever its class, the word's neighbours keep these sums
            rows, cols = grid.sum(1) + left, grid.sum(0) + right
            r, c = right.sum() + self_, left.sum() + self_
            gain -= flat(rows + r) - flat(rows) + flat(cols + c) - flat(cols)
            gain[classes] = -np.inf
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else int(old)
            grid[new, :] += right
            grid[:, new] += left
            grid[new, new] += self_
            if new != old:
                moved += 1
                own[w] = new
                one[w] = every == new
                after[:, old] -= bigrams[:, w]
                after[:, new] += bigrams[:, w]
                before[:, old] -= bigrams[w]
                before[:, new] += bigrams[w]
        if not moved:
            break
    return own


def _matrix(counted: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """A matrix of (key, n): no more rows than it has places."""
    found = counted.toPandas()
    return np.bincount(found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64), shape[0] * shape[1]).reshape(shape)


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words have or pass."""
    # a row for each count, of which a corpus of n words has fewer than 2 * sqrt(n)
    rows = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most + 1).collect()
    held, least = 0, 1 << 62
    for r in rows:
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    return least


def word_classes(spark: SparkSession, scratch: Scratch, training: DataFrame, classes: int = CLASSES, core_words: int = CORE_WORDS) -> tuple[DataFrame, DataFrame]:
    """Counts (key, n) of all tokens of training (text), the end's key 0; and (key, n, class) of every word."""
    counts = scratch.keep(_gathered(training, lambda t: t), "counts")

    def known_words(most: int) -> tuple[np.ndarray, np.ndarray]:
        pdf = counts.filter((F.col("n") >= _least_count(counts, most)) & (F.col("key") != 0)).toPandas()
        key, n = pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64)
        order = np.argsort(key)
        return key[order], n[order]

    core, _ = known_words(core_words)
    core = np.r_[core, np.uint64(2**64 - 1)]  # a last word that no text has, so that a search always ends
    send = spark.sparkContext.broadcast
    core_b, k_core = send(core), len(core) - 1

    def core_ids(tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens == 0, k_core, _numbers(tokens, core_b.value))

    def core_pairs(tokens: np.ndarray) -> np.ndarray:
        ids = core_ids(tokens)
        hit = ids >= 0
        return (_history(ids, k_core)[hit] * (k_core + 1) + ids[hit]).astype(np.uint64)

    own = exchange(_matrix(_gathered(training, core_pairs), (k_core + 1, k_core + 1)), classes)
    core_class = send(own)

    def contexts(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = tokens != 0
        return tokens[hit], core_class.value[_history(core_ids(tokens), k_core)][hit]

    # how often each class precedes the words of each class, so far of the core alone
    width = classes + 1
    seen = scratch.keep(_contexts(training, contexts), "contexts")
    grid = np.zeros((width, width))
    of_core = spark.createDataFrame([(int(a), int(c)) for a, c in zip(core[:-1].view(np.int64), own[:-1])], "key bigint, core int")
    for r in seen.join(F.broadcast(of_core), "key").groupBy("before", "core").agg(F.sum("n").alias("n")).collect():
        grid[r["before"], r["core"]] = r["n"]
    by_history = (grid[:, :classes] + 0.5) / (grid[:, :classes] + 0.5).sum(1, keepdims=True)
    overall = (grid[:, :classes].sum(0) + 0.5) / (grid[:, :classes] + 0.5).sum()
    # the likelihood gained by each class from a word after each history, in whole numbers, so that a tie is one
    # whatever the order of the sums; a tie goes to the first class
    gains = np.round(np.log(by_history / overall) * 1e6).astype(np.int64)

    def likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key, each key's count and class; a key may go on in the next batch."""
        last, last_seen = np.zeros(0, np.int64), np.zeros((0, width), np.int64)

        def out(keys: np.ndarray, counts_: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts_.sum(1)), pa.array((counts_ @ gains).argmax(1).astype(np.int32))], ["key", "n", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, place = np.unique(np.r_[last, batch.column("key").to_numpy()], return_inverse=True)
            place = place[len(last) :]
            own = np.bincount(place * width + batch.column("before").to_numpy(), batch.column("n").to_numpy(), len(keys) * width)
            own = own.astype(np.int64).reshape(-1, width)
            if len(last):
                own[np.searchsorted(keys, last)] += last_seen
            last, last_seen = keys[-1:], own[-1:]
            if len(keys) > 1:
                yield out(keys[:-1], own[:-1])
        if len(last):
            yield out(last, last_seen)

    best = seen.repartition("key").sortWithinPartitions("key").mapInArrow(likeliest, "key bigint, n bigint, class int")
    lexicon = scratch.keep(best.join(F.broadcast(of_core), "key", "left").select("key", "n", F.coalesce("core", "class").alias("class")), "lexicon")
    scratch.drop(seen)
    return counts, lexicon


def score_texts(spark: SparkSession, docs: DataFrame, classes: int = CLASSES, core_words: int = CORE_WORDS, table_words: int = TABLE_WORDS) -> DataFrame:
    """Scores of all rows of docs (doc_id, text; other columns are ignored) by a model of the rows not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of a token). A null text is empty, and
    an empty one has the end as its only token. A null id is not held out. Rows that repeat an id are scored
    each. Without training rows every token is unknown. No rows give no rows.
    """
    scratch = Scratch(spark, "brown")
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long"), (rest == HELD_OUT).alias("held_out"), F.col("text").cast("binary").alias("text"))
    training = texts.filter(~F.col("held_out"))

    counts, lexicon = word_classes(spark, scratch, training, classes, core_words)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    send = spark.sparkContext.broadcast

    least = _least_count(counts, table_words)
    pdf = lexicon.filter(F.col("n") >= least).toPandas().sort_values("key", key=lambda k: k.to_numpy(np.int64).view(np.uint64))
    table = np.r_[pdf["key"].to_numpy(np.int64).view(np.uint64), np.uint64(2**64 - 1)]
    table_n, word_class = pdf["n"].to_numpy(np.int64), np.r_[pdf["class"].to_numpy(np.int64), 0]
    in_class = np.zeros(classes)
    for r in lexicon.groupBy("class").agg(F.sum("n").alias("n")).collect():
        in_class[r["class"]] = r["n"]
    class_logs = np.log10(np.maximum(in_class, 1))
    table_b, class_b = send(table), send(word_class)
    emit_b = send(np.r_[np.log10(table_n) - class_logs[word_class[:-1]], 0.0])
    plus_b = send(np.r_[np.log10(table_n + 1.0), 0.0])
    # classes, then the end, then the words that aren't known
    end_class, new_class = classes, classes + 1
    ends_seen = int(counts.filter("key = 0").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    end_plus = float(np.log10(ends_seen + 1.0))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text the moves between words of the table, and the tokens that are outside it or beside one that is."""
        part, row = TaskContext.get().partitionId(), 0
        kind = pa.struct([("at", pa.int32()), ("key", pa.int64()), ("class", pa.int32()), ("counts", pa.bool_())])
        for batch in slices(batches, "text"):
            tokens, ends = _tokens(batch)
            ids = _numbers(tokens, table_b.value)
            own_class = np.where(tokens == 0, end_class, np.where(ids >= 0, class_b.value[ids], RARE))
            hit = ids >= 0
            begins = np.r_[0, ends[:-1] + 1]
            out = own_class < 0
            after = np.r_[False, out[:-1]]
            plain = ~out & ~after
            before = np.r_[end_class, own_class[:-1]]
            moves = (before * (classes + 2) + own_class)[plain].astype("<u4")
            # a place before a token outside the table only gives its class; no text reaches into the next, as the end is in the table
            beside = np.flatnonzero(out | after | np.r_[out[1:], False])
            size = lambda at: np.searchsorted(at, np.r_[begins, len(tokens)]).astype(np.int32)
            cuts = size(beside)
            fields = [beside - np.repeat(begins, np.diff(np.r_[begins, len(tokens)]))[beside], np.where(out, tokens.view(np.int64), 0)[beside], own_class[beside], (out | after)[beside]]
            entries = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(f, t.type) for f, t in zip(fields, kind)], fields=list(kind)))
            move_cuts = 4 * size(np.flatnonzero(plain))
            packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(move_cuts.astype(np.int32).tobytes()), pa.py_buffer(moves.tobytes())])
            plus = np.where(hit, plus_b.value[ids], np.where(tokens == 0, end_plus, 0.0))
            known = np.add.reduceat((hit | ((tokens == 0) & (ends_seen > 0))).astype(np.int64), begins)
            emit = np.add.reduceat(np.where(hit, emit_b.value[ids], 0.0), begins)
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("held_out"), pa.array(ends - begins + 1), pa.array(known), pa.array(np.add.reduceat(plus, begins)), pa.array(emit), packed, entries],
                ["part", "row", "doc_id", "held_out", "n_tokens", "n_known", "plus", "emit", "moves", "entries"],
            )
            row += n

    schema = "part bigint, row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, plus double, emit double, moves binary, entries array<struct<at: int, key: bigint, class: int, counts: boolean>>"
    coded = scratch.keep(texts.mapInArrow(code, schema), "coded")
    rare = lexicon.filter(F.col("n") < least).select("key", F.col("n").alias("times"), F.col("class").alias("rare"))
    rare_rows = coded.select("part", "row", "held_out", F.inline("entries"))
    is_out = F.col("class") < 0
    # only tokens outside the table meet the rarer words
    met = rare_rows.filter(is_out).join(rare, "key", "left").unionByName(rare_rows.filter(~is_out), allowMissingColumns=True)
    met = met.withColumn("own", F.when(is_out, F.col("rare")).otherwise(F.col("class")))
    history = F.last("own", ignorenulls=True).over(Window.partitionBy("part", "row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("history", F.coalesce(history, F.lit(end_class))).filter("counts")
    met = met.select("part", "row", "held_out", "history", F.coalesce("own", F.lit(new_class)).alias("own"), "times")
    met = scratch.keep(met, "met")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((classes + 1) * (classes + 2), np.int64)
        for batch in batches:
            for m in batch.column("moves").to_pylist():
                held += np.bincount(np.frombuffer(m, "<u4"), minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["key", "n"])

    of_table = coded.filter(~F.col("held_out")).select("moves").mapInArrow(counted, "key bigint, n bigint")
    of_rare = met.filter(~F.col("held_out")).groupBy((F.col("history") * (classes + 2) + F.col("own")).cast("bigint").alias("key")).agg(F.count("*").alias("n"))
    step = _matrix(of_table.unionAll(of_rare).groupBy("key").agg(F.sum("n").alias("n")), (classes + 1, classes + 2)) + ALPHA
    logs = np.log10(step / step.sum(1, keepdims=True))
    step_b = send(logs.ravel())
    base_room = float(np.log10(n_all + (v_all + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [float(step_b.value[np.frombuffer(m, "<u4")].sum()) for m in batch.column("moves").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("part", "row", "doc_id", "held_out", "n_tokens", "n_known", "plus", "emit")], pa.array(own, pa.float64())], ["part", "row", "doc_id", "held_out", "n_tokens", "n_known", "plus", "emit", "logs"])

    # a row for each class, and for each move
    of_class = F.array(*[F.lit(float(x)) for x in [*class_logs, 0.0, 0.0]])
    of_move = spark.createDataFrame([(h, c, float(logs[h, c])) for h in range(classes + 1) for c in range(classes + 2)], "history int, own int, log double")
    # a word counts one more than it was seen; unseen ones add log10(1)
    one = F.when(F.col("times").isNull(), 0.0).otherwise(F.log10("times") - of_class[F.col("own")])
    others = met.join(F.broadcast(of_move), ["history", "own"]).groupBy("part", "row").agg(F.count("times").alias("more"), F.sum(F.coalesce(F.log10(F.col("times") + 1.0), F.lit(0.0))).alias("rare_plus"), F.sum(F.col("log") + one).alias("rare_logs"))
    # emissions of words of the table that stand beside others are in emit
    scored = coded.drop("entries").mapInArrow(run, "part bigint, row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, plus double, emit double, logs double")
    all_rows = scored.join(others, ["part", "row"], "left").na.fill(0, ["more"]).na.fill(0.0, ["rare_plus", "rare_logs"])
    return all_rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("plus") + F.col("rare_plus") - F.col("n_tokens") * F.lit(base_room)).alias("base_score"), (F.col("logs") + F.col("emit") + F.col("rare_logs")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
