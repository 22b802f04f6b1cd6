"""Nearest neighbours by cosine through cross-polytope hashing.

A hash function turns a unit vector by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and takes the nearest signed axis. A table joins the axes of several functions to a bucket; it
has as many buckets as the number of vectors asks for. A query probes the buckets that are nearest to it in
each of TABLES tables, and what they hold is ranked by the exact cosine. The probes grow with the square root
of the number of vectors, as a fixed number finds less and less of a growing table.

Queries are searched in rounds, each of as many as probe AT_ONCE buckets together.

Equal vectors are one class, searched once: its first members stand for it, as no more can be in a result.
Candidates are scored where their vectors are: a query's vector goes to each block of vectors once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.storage import Scratch

TABLES = 32
#: Probes of a table of STEADY vectors or fewer.
PROBES, STEADY = 40, 25_000
NEIGHBOURS = 5
EVERY = 50
SEED = 20
BLOCK = 5000
#: Probed buckets of the queries that are searched at once; the others follow in further rounds.
AT_ONCE = 8_000_000


def axes_for(n: int, dims: int) -> list[int]:
    """Axes that each function of a table looks at, so that a table has about n / 4 buckets, and a bucket a few vectors.

    Functions look at all axes, but the last one at as many as are needed, a power of two.
    """
    left, out = 1 << max(1, (max(1, n) // 4 - 1).bit_length()), []
    while left > 1:
        out.append(min(dims, max(1, left // 2)))
        left //= 2 * out[-1]
    return out


def probes_for(n: int) -> int:
    """Buckets that a query probes in each of the tables for n vectors."""
    return math.ceil(PROBES * math.sqrt(max(1.0, n / STEADY)))


def rotate(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """Pseudo-rotation of the rows of x, whose length is a power of two."""
    n, dims = x.shape
    for r in range(3):
        x = x * np.random.default_rng([SEED, table, function, r]).choice([-1.0, 1.0], dims)
        h = 1
        while h < dims:
            y = x.reshape(n, -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, dims)
            h *= 2
        x = x / np.sqrt(dims)
    return x


@functools.lru_cache(maxsize=256)
def _turning(table: int, function: int, dims: int) -> np.ndarray:
    """The pseudo-rotation as a matrix, for vectors short enough."""
    return rotate(np.eye(dims), table, function)


def _turned(x: np.ndarray, table: int, function: int, most: int) -> np.ndarray:
    """The first ``most`` components of the rows of x when rotated."""
    return x @ _turning(table, function, x.shape[1])[:, :most] if x.shape[1] <= 256 else rotate(x, table, function)[:, :most]


@functools.lru_cache(maxsize=64)
def _pairs(first: int, second: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two falling lists whose sums can be among the ``probes`` largest: (i + 1) * (j + 1) sums are no smaller than that of i and j."""
    many = np.minimum(second, probes // np.arange(1, min(first, probes) + 1))
    return np.repeat(np.arange(len(many)), many), np.concatenate([np.arange(n) for n in many])


def _scaled(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, divided by their largest component where squares would leave the range; their norms."""
    x = np.array(vectors, np.float64)
    with np.errstate(over="ignore"):
        square = np.einsum("ij,ij->i", x, x)
    odd = ~((square > 1e-280) & (square < 1e280))
    if odd.any():
        x[odd] /= np.abs(x[odd]).max(1, keepdims=True)
        square = np.einsum("ij,ij->i", x, x)
    return x, np.sqrt(square)


def buckets(vectors: list, n: int, probes: int) -> np.ndarray:
    """For each vector and table the ``probes`` nearest buckets of tables for n vectors, nearest first."""
    x, norms = _scaled(vectors)
    dims = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x / norms[:, None], ((0, 0), (0, dims - x.shape[1])))
    out, rows = [], np.arange(len(x))[:, None]
    for table in range(TABLES):
        codes, sums = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for f, most in enumerate(axes_for(n, dims)):
            axes = 2 * most
            turned = _turned(x, table, f, most)
            near = np.concatenate([turned, -turned], 1)
            best = np.argsort(-near, 1, kind="stable")[:, : min(probes, axes)] if probes > 1 else near.argmax(1)[:, None]
            i, j = _pairs(codes.shape[1], best.shape[1], probes)
            total = sums[:, i] + near[rows, best][:, j]
            every = codes[:, i] * axes + best[:, j]
            keep = np.argsort(-total, 1, kind="stable")[:, :probes]
            codes, sums = every[rows, keep], total[rows, keep]
        out.append(codes + (np.int64(x.shape[1] % 1024 * TABLES + table) << np.int64(48)))
    return np.concatenate(out, 1)


def _hashed(df: DataFrame, key: str, n: int, probes: int) -> DataFrame:
    """(key, code) of the buckets of df's embeddings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 16384 // probes)
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                vectors, ids = some.column("embedding").to_pylist(), some.column(key).to_pylist()
                for size in sorted({len(v) for v in vectors}):
                    mine = [k for k, v in enumerate(vectors) if len(v) == size]
                    codes = buckets([vectors[k] for k in mine], n, probes)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in mine], pa.int64()), pa.array(list(codes), pa.list_(pa.int64()))], [key, "codes"])

    return df.select(key, "embedding").mapInArrow(run, f"{key} bigint, codes array<bigint>").select(key, F.explode("codes").alias("code"))


def _best(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: query, vector and candidates in this block; right: classes of this block."""
        out = {"query": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            vectors, members, ids = right.column("embedding").to_pylist(), right.column("members").to_pylist(), right.column("class_id").to_pylist()
            place, found = {}, {}
            for size in {len(v) for v in vectors}:
                own = [n for n, v in enumerate(vectors) if len(v) == size]
                found[size] = _scaled([vectors[n] for n in own])
                place |= {ids[n]: (size, i, n) for i, n in enumerate(own)}
            for batch in left.to_batches(max_chunksize=256):
                for row in batch.to_pylist():
                    q, qn = _scaled([row["embedding"]])
                    at = [place[c] for c in row["candidates"]]
                    x, norms = found[q.shape[1]]
                    which = np.array([i for _, i, _ in at])
                    score = x[which] @ q[0] / (norms[which] * qn[0])
                    few = np.argsort(-score, kind="stable")[:k] if len(score) <= k else np.flatnonzero(score >= np.partition(score, -k)[-k])
                    best = sorted((-float(score[j]), m) for j in few for m in members[at[j][2]])[:k]
                    out["query"] += [row["query"]] * len(best)
                    out["vec_id"] += [m for _, m in best]
                    out["score"] += [-s for s, _ in best]
        return pa.table({"query": pa.array(out["query"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Nearest of vectors to each of queries; both have vec_id and embedding, other columns are ignored.

    Returns query_id, rank, vec_id, score: of each query its ``neighbours`` nearest found, by cosine, ties to
    the smaller vec_id, never its own vec_id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, on either side, nor do null ids; vectors of different lengths don't meet. Rows
    that repeat an id with the same vector are one. A query that finds nothing gives no rows.
    """
    scratch = Scratch(spark, "neighbours")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
        return df.filter(F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))

    order = Window.partitionBy("embedding").orderBy("vec_id")
    firsts = sound(vectors).withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= neighbours + 1)
    classes = firsts.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("members"))
    classes = scratch.keep(classes.select(F.col("members")[0].alias("class_id"), "embedding", "members").withColumn("class_id", F.xxhash64("embedding", "class_id")), "classes")
    asked = sound(queries).distinct()
    named = asked.join(classes.select("embedding", F.col("class_id").alias("known")), "embedding", "left")
    # a query that isn't among the vectors has no class; it is searched by its own name
    named = scratch.keep(named.select(F.col("vec_id").alias("query_id"), F.coalesce("known", F.xxhash64("embedding", F.lit("query"))).alias("query"), "embedding"), "queries")
    # equal queries are searched once; a task keeps one of them before the shuffle
    distinct = scratch.keep(named.groupBy("query").agg(F.first("embedding").alias("embedding")), "distinct")

    n = classes.count()
    blocks = max(1, n // BLOCK)
    entries = _hashed(classes, "class_id", n, 1)
    # pairs of queries and candidates outnumber all else, so only some queries meet theirs at once
    rounds = max(1, math.ceil(distinct.count() * TABLES * probes_for(n) / AT_ONCE))
    if rounds > 1:
        entries = scratch.keep(entries, "entries")
    block = F.pmod(F.xxhash64("class_id"), F.lit(blocks))
    right = classes.select(block.alias("block"), "class_id", "embedding", "members")

    def found(some: DataFrame) -> DataFrame:
        # queries are few bytes that many buckets come of
        probes = _hashed(some.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "query", n, probes_for(n))
        met = entries.join(probes, "code").groupBy("query", block.alias("block")).agg(F.collect_set("class_id").alias("candidates"))
        met = met.join(some, "query").select("block", "query", "embedding", "candidates")
        best = met.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_best(neighbours + 1), "query bigint, vec_id bigint, score double")
        top = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= neighbours + 1)
        return top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))

    if rounds > 1:
        turn = F.pmod(F.xxhash64("query"), F.lit(rounds))
        parts = [scratch.keep(found(distinct.filter(turn == k)), f"found{k}") for k in range(rounds)]
        top = functools.reduce(DataFrame.unionAll, parts)
    else:
        top = found(distinct)
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours)
    result = named.select("query_id", "query").join(top, "query").select("query_id", F.posexplode(own).alias("at", "hit"))
    return result.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(spark, vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
