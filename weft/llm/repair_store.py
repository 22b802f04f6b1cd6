"""Token ids in binary shards, compressed by a Re-Pair grammar, with random access by document.

A shard holds the ids of neighbouring documents in ascending doc_id order. Re-Pair replaces frequent pairs
of neighbouring symbols by new symbols (nonterminals), again and again; here a round replaces many of the pairs
that are frequent enough at once, the most frequent first, left to right, and counts anew. It ends when no pair
that is left pays for its rule, or, where the vocabulary fits 16 bits, when these have no symbol left: a wider
symbol would double the whole shard for pairs of a few places. No pair crosses a document's end, so the
symbols of one document decode alone: ``body[body_start[k] : body_start[k + 1]]``, expanded by the rules.

File format: a Parquet table with a row for each shard. part, seq: place among the shards, ascending;
first_symbol: symbols from here on are nonterminals; doc_ids, n_tokens, body_start: of its documents;
rules: pairs of symbols; round_ends: rules known after each round; lengths: expansion length of each rule,
unsigned 32-bit; body: symbols. Rules and body are little-endian, ``width`` bytes each.
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
from weft.llm.tokens import SpacedEncoder, encoder, portions

SHARD_IDS = 1_000_000
#: A rule costs two symbols and a length and saves one symbol each time: in 16 bits five times pay for it, in 32 four.
LEAST_COUNT = {2: 5, 4: 4}
SLOT_BITS = 20

SHARDS = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("width", pa.int32()), ("first_symbol", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("body_start", pa.list_(pa.int64())),
    ("rules", pa.binary()), ("round_ends", pa.list_(pa.int32())), ("lengths", pa.binary()), ("body", pa.binary()),
])
SHARDS_SQL = "part int, seq int, width int, first_symbol bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<bigint>, body_start array<bigint>, rules binary, round_ends array<int>, lengths binary, body binary"


def _slot(codes: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint32:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def compress(ids: np.ndarray, ends: np.ndarray, first_symbol: int):
    """Grammar of ids, whose documents end before the positions ``ends``: rules, round_ends, body, body_start."""
    narrow = first_symbol < 0x10000
    most_rules, least = (0x10000 - first_symbol, LEAST_COUNT[2]) if narrow else (1 << 30, LEAST_COUNT[4])
    seq = ids.astype(np.uint32)
    # where the last symbol of each document stands
    last = np.unique(ends[ends > 0]) - 1
    rules: list[np.ndarray] = []
    round_ends: list[int] = []
    known = 0
    while True:
        room = most_rules - known
        if room <= 0 or len(seq) < 2:
            break
        wide = int(seq.max()) > 0xFFFF
        codes = (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]) if wide else (seq[:-1] << np.uint32(16) | seq[1:])
        # what crosses a document's end is no pair; the largest code stands for it
        none = codes.dtype.type(-1 & (1 << 8 * codes.itemsize) - 1)
        codes[last[:-1]] = none
        found = np.sort(codes)
        found = found[: np.searchsorted(found, none)]
        if not len(found):
            break
        starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        counts = np.diff(np.r_[starts, len(found)])
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        # the most frequent first, so that the room goes to them; ties by the pair's own order
        good = np.sort(good[np.argsort(-counts[good], kind="stable")[: max(1, min(room, most_rules // 2))]])
        chosen = found[starts[good]]
        # a slot for each chosen pair; where two share one, the other waits for the next round
        slots = np.full(1 << SLOT_BITS, -1, np.int16 if narrow and most_rules < 1 << 15 else np.int32)
        slots[_slot(chosen)] = np.arange(len(chosen))
        chosen = chosen[slots[_slot(chosen)] == np.arange(len(chosen))]
        slots[_slot(chosen)] = np.arange(len(chosen))
        shift = np.uint64(32) if wide else np.uint32(16)
        left, right = (chosen >> shift).astype(np.uint32), (chosen & chosen.dtype.type((1 << int(shift)) - 1)).astype(np.uint32)
        at = slots[_slot(codes)]
        may = np.flatnonzero(at >= 0)
        at = at[may]
        hit = chosen[at] == codes[may]
        may, at = may[hit], at[hit].astype(np.int64)
        # of hits that overlap one another, every second one from the left
        runs = np.flatnonzero(np.r_[True, may[1:] != may[:-1] + 1])
        take = (np.arange(len(may)) - np.repeat(runs, np.diff(runs, append=len(may)))) & 1 == 0
        may, at = may[take], at[take]
        # of pairs that overlap, one may have lost all its places
        used = np.bincount(at, minlength=len(chosen)) > 0
        left, right, at = left[used], right[used], (np.cumsum(used) - 1)[at]
        seq[may] = first_symbol + known + at
        stay = np.ones(len(seq), bool)
        stay[may + 1] = False
        seq = seq[stay]
        last -= np.searchsorted(may, last)
        rules.append(np.stack([left, right], 1))
        known += len(left)
        round_ends.append(known)
    at_end = last + 1
    empty = np.r_[0, ends[:-1]] == ends
    body_start = np.zeros(len(ends) + 1, np.int64)
    body_start[1:][~empty] = at_end
    body_start = np.maximum.accumulate(body_start)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), round_ends, seq, body_start


def _gather(symbols: np.ndarray, first_symbol: int, table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for; table holds the expansions of the rules known."""
    rule = symbols >= first_symbol
    if not rule.any():
        return symbols
    which = symbols[rule].astype(np.int64) - first_symbol
    long = np.ones(len(symbols), np.int64)
    long[rule] = lengths[which]
    ends = np.cumsum(long)
    out = np.repeat(symbols, long)
    spread = np.repeat(starts[which] - (ends - long)[rule], lengths[which])
    inside = np.flatnonzero(np.repeat(rule, long))
    out[inside] = table[inside + spread]
    return out


def expansions(rules: np.ndarray, round_ends: list[int], first_symbol: int):
    """For all rules, one after another: their ids, where each begins, how long each is."""
    table, starts, lengths, at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for end in round_ends:
        pairs = rules[at:end]
        each = np.where(pairs >= first_symbol, lengths[np.minimum(np.maximum(pairs.astype(np.int64) - first_symbol, 0), max(0, at - 1))] if at else 1, 1).sum(1)
        more = _gather(pairs.reshape(-1), first_symbol, table, starts, lengths)
        starts = np.r_[starts, len(table) + np.cumsum(each) - each]
        table, lengths, at = np.r_[table, more], np.r_[lengths, each], end
    return table, starts, lengths


def decode_document(shard: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of a shard; no other document is decoded."""
    kind = "<u2" if shard["width"] == 2 else "<u4"
    rules = np.frombuffer(shard["rules"], kind).reshape(-1, 2).astype(np.uint32)
    a, b = shard["body_start"][k], shard["body_start"][k + 1]
    body = np.frombuffer(shard["body"], kind)[a:b].astype(np.uint32)
    return _gather(body, shard["first_symbol"], *expansions(rules, list(shard["round_ends"]), shard["first_symbol"]))


def _shard(part: int, seq: int, flat: np.ndarray, n: np.ndarray, doc_ids: list, vocabulary: int) -> dict:
    first = max(vocabulary, int(flat.max(initial=0)) + 1)
    rules, round_ends, body, body_start = compress(flat, np.cumsum(n), first)
    width = 2 if first + len(rules) <= 0x10000 else 4
    kind = "<u2" if width == 2 else "<u4"
    lengths = expansions(rules, round_ends, first)[2]
    return dict(part=part, seq=seq, width=width, first_symbol=first, n_ids=int(n.sum()), doc_ids=doc_ids, n_tokens=n.tolist(), body_start=body_start.tolist(), rules=rules.astype(kind).tobytes(), round_ends=round_ends, lengths=lengths.astype("<u4").tobytes(), body=body.astype(kind).tobytes())


def encode_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of docs (doc_id, text; other columns are ignored): see the module's text for the columns.

    Every text is encoded whole, a null text as an empty one, and end_id follows. Null ids come first; rows
    that repeat an id stand side by side, in the order of their texts. No rows give no shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SpacedEncoder, tokenizer_path)
        vocabulary = enc.tokenizer.get_vocab_size()
        part, seq, held, names, sizes, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard(part, seq, np.concatenate(held), np.array(sizes, np.int64), names, vocabulary)], SHARDS)

        for batch in batches:
            keys = iter(batch.column("doc_id").to_pylist())
            for some in portions(batch.column("text").to_pylist()):
                ids, ends = enc.coded(some, end_id)
                first = begin = 0
                for end, key in zip(ends.tolist(), keys):
                    if names and size + end - begin > shard_ids:
                        held.append(ids[first:begin])
                        yield out()
                        seq, held, names, sizes, size, first = seq + 1, [], [], [], 0, begin
                    names.append(key)
                    sizes.append(end - begin)
                    size, begin = size + end - begin, end
                held.append(ids[first:])
        if names:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SHARDS_SQL)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from its shard.

    start counts the ids of all documents before. Two sums find it: over the parts, of which there are as
    many as tasks, and over the shards in a part.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "seq", "n_ids").withColumn("in_part", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    places = places.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = batch.slice(k, 1).to_pylist()[0]
                kind = "<u2" if s["width"] == 2 else "<u4"
                rules = np.frombuffer(s["rules"], kind).reshape(-1, 2).astype(np.uint32)
                table = expansions(rules, s["round_ends"], s["first_symbol"])
                body, at = np.frombuffer(s["body"], kind).astype(np.uint32), s["body_start"]
                ids = _gather(body, s["first_symbol"], *table).astype("<u4").tobytes()
                ends = np.cumsum(s["n_tokens"])
                if len(ids) != 4 * s["n_ids"] or not (np.frombuffer(s["lengths"], "<u4") == table[2]).all() or at[-1] != len(body):
                    raise ValueError(f"shard {s['part']}-{s['seq']} is damaged")
                starts = ends - np.array(s["n_tokens"])
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([s["part"]] * len(crc), pa.int32()), pa.array([s["seq"]] * len(crc), pa.int32()), pa.array(s["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(s["n_tokens"], pa.int64()), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])

    read = shards.mapInArrow(run, "part int, seq int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(places, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = Scratch(spark, "repair").keep(encode_shards(docs, public_tokenizers.path("byte_bpe_50k.json")), "shards")
    return read_documents(shards)
