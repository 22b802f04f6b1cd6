"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of fixed size. The distinct blocks are sorted and get integers, so that equal
blocks, and only they, have equal names. Then adjacent names are paired, the distinct pairs are sorted and
named in turn, and so on, until a text has one name: its identity. No two texts can share one, whatever
hash function exists, as names come from comparing contents.

A text whose (byte length, 64-bit hash) no other row has equals no other text; it is its own class and
isn't named. So the shuffles after the first hold only texts that very likely are copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.storage import Scratch

BLOCK_BYTES = 512
ROW = ["doc_id", "n_bytes", "h"]


def _same(a: DataFrame, b: DataFrame, cols: list[str]):
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def _sorted_names(scratch: Scratch, rows: DataFrame, cols: list[str], label: str) -> DataFrame:
    """An integer for each distinct value of cols, ascending in each partition; written, so that it stays.

    The partitions are those that found the distinct values: a range partitioning would send samples of
    whole blocks to the driver.
    """
    ordered = rows.select(*cols).distinct().sortWithinPartitions(*cols)
    return scratch.keep(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def exact_classes(spark: SparkSession, docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Class of equal texts of every row of docs (doc_id, text; other columns are ignored).

    Returns doc_id, keep_id (largest doc_id of the class), group_size (rows of the class), kept,
    text_sha256. A null text counts as empty; empty texts are equal to one another. Rows that repeat a
    doc_id with the same text each count and all carry the same values. A null doc_id stands below every
    other; a class with nothing but null ids keeps null. An empty table gives no rows.
    """
    scratch = Scratch(spark, "naming")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("h"), "text")
    keys = scratch.keep(keyed.select(*ROW, F.unhex(F.sha2("text", 256)).alias("sha")), "keys")
    repeated = scratch.keep(keys.groupBy("n_bytes", "h").agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "repeated")

    last = F.greatest(F.lit(0), ((F.col("n_bytes") - 1) / block_bytes).cast("long"))
    copies = keyed.join(repeated, ["n_bytes", "h"], "left_semi").withColumn("bin", F.col("text").cast("binary"))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring("bin", (i * block_bytes + 1).cast("int"), F.lit(block_bytes)))
    blocks = scratch.keep(copies.select(*ROW, (last + 1).alias("left_over"), F.posexplode(cut).alias("at", "block")), "blocks")

    names = _sorted_names(scratch, blocks, ["block"], "names")
    named = scratch.keep(blocks.join(names, "block").select(*ROW, "left_over", "at", "name"), "named")
    scratch.drop(blocks)
    scratch.drop(names)
    # a text of m blocks has one name after ceil(log2 m) rounds; the rounds follow the longest text
    most = named.agg(F.max("left_over")).first()[0] or 1
    level, done = 0, [named.filter("left_over = 1").select(*ROW, F.lit(0).alias("level"), "name")]
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        half = F.col("at").cast("long")
        pairs = (
            named.filter("left_over > 1")
            .groupBy(*ROW, F.floor((F.col("left_over") + 1) / 2).alias("left_over"), F.floor(half / 2).alias("at"))
            .agg(F.max(F.when(half % 2 == 0, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(half % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"))
        )
        pairs = scratch.keep(pairs, f"pairs{level}")
        names = _sorted_names(scratch, pairs, ["first", "second"], f"names{level}")
        named = scratch.keep(pairs.join(names, ["first", "second"]).select(*ROW, "left_over", "at", "name"), f"named{level}")
        done.append(named.filter("left_over = 1").select(*ROW, F.lit(level).alias("level"), "name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionAll(more)
    identity = identity.distinct()

    members = keys.join(identity, _same(keys, identity, ROW)).select(keys["doc_id"], keys["sha"], "level", "name")
    members = scratch.keep(members, "members")
    classes = members.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    copied = members.join(classes, ["level", "name"]).select("doc_id", "sha", "keep_id", "group_size")
    single = keys.join(repeated, ["n_bytes", "h"], "left_anti").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return copied.unionAll(single).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
