"""Packing token pieces into sequences by minimum bin slack.

Only lengths matter to the packing, and there are at most as many as a sequence has tokens. So the driver
gets one number for each length: how many pieces have it. For one bin after another it takes the longest
piece left and finds, by dynamic programming over a bitset of reachable sums, the fullest combination of
lengths left that still fits; that combination is removed as often as its lengths last. Then every piece
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.storage import Scratch
from weft.llm.tokens import WordEncoder, encoder, portions

CAPACITY = 2048

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
PIECES_SQL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of lengths (length: how many there are), the combination with the largest sum up to room."""
    reached, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, reached before
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            many = min(many, left)
            steps.append((length, many, reached))
            reached |= (reached << (length * many)) & mask
            left -= many
            many *= 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + many
            total -= length * many
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: pieces in each}) in the order of their making."""
    left, bins = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        inside = fullest({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        inside[longest] = inside.get(longest, 0) + 1
        times = min(left[k] // n for k, n in inside.items())
        bins.append((times, dict(sorted(inside.items(), reverse=True))))
        for k, n in inside.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of every document, with their rank among the pieces of their length in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(WordEncoder, tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            keys, rows = iter(batch.column("doc_id").to_pylist()), []
            for some in portions(x.as_py() for x in batch.column("text")):
                ids, ends = enc.coded(some, end_id)
                flat, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
                for end, key in zip(ends.tolist(), keys):
                    for k, at in enumerate(range(begin, end, capacity)):
                        n = min(capacity, end - at)
                        rows.append((key, k, at - begin, n, zlib.crc32(flat[4 * at : 4 * (at + n)]), part, seen[n]))
                        seen[n] += 1
                    begin = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), PIECES)], schema=PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES_SQL)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every row of docs (doc_id, text; other columns are ignored) in pieces, packed into sequences.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty, and an empty
    one is a piece that holds the end id alone. Rows that repeat an id are documents of their own; a null id
    stays null. No rows give no rows.
    """
    pieces = Scratch(spark, "packing").keep(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most one row for each length
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, slots, first, used = [], [], 0, dict.fromkeys(counts, 0)
    for times, inside in plan_bins(counts, capacity):
        at = 0
        for length, n in inside.items():
            keys.append((length, used[length]))
            slots.append((used[length], n, first, at))
            used[length] += n * times
            at += length * n
        first += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    lengths = np.array([keys[k][0] for k in order], np.int64)
    table = np.array([slots[k] for k in order], np.int64).reshape(-1, 4)
    bounds = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            row = np.zeros(len(length), np.int64)
            for one in np.unique(length):
                mine, a, b = length == one, bounds[one], bounds[one + 1]
                row[mine] = a + np.searchsorted(table[a:b, 0], rank[mine], side="right") - 1
            begin, n, base, at = table[row].T
            inside = rank - begin
            more = [pa.array(base + inside // n), pa.array(at + inside % n * length)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in PIECES.names[:5]] + more, PIECES.names[:5] + ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"])
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
