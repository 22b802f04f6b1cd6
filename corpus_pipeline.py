"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Toxic documents go, one of each exact text stays, one of each group of near copies stays, sources are
brought to their target weights (a document taken twice is there twice), and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import block_naming, jaccard_rtree, nearest_toxic, pareto_mix, slack_packing, storage
from weft.llm.storage import Scratch

TOKENIZER = "word_bpe_49k.json"


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with an id in ids; null is an id. With text_sha256 in ids, only those with its text."""
    same = docs["doc_id"].eqNullSafe(ids["doc_id"])
    if "text_sha256" in ids.columns:
        same = same & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == ids["text_sha256"])
    return docs.join(ids, same, "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the nearest labelled examples don't call toxic, whatever their ids; without labels all stay."""
    model = nearest_toxic.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nearest_toxic.without_toxic(spark, docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest id. Rows with one id and different texts are told apart by their texts."""
    found = Scratch(spark, "stage-copies").keep(block_naming.exact_classes(spark, docs).filter("kept").select("doc_id", "text_sha256"), "kept")
    # a row that repeats an id with its text is one text
    repeated = not found.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty()
    kept = _only(docs, found)
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies; rows without words are no copies of one another here.

    Where ids repeat, rows are told apart by id and text, the least digest of a text goes first among equal
    ids, and rows that repeat both are one.
    """
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        own = jaccard_rtree.link(spark, docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
        return _only(docs, own)
    scratch = Scratch(spark, "stage-near-copies")
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    rows = scratch.keep(docs.select("doc_id", digest.alias("text_sha256"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", digest).alias("row")).dropDuplicates(["doc_id", "text_sha256"]), "rows")
    found = jaccard_rtree.link(spark, rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")
    first = rows.join(found, "row").groupBy("component_id").agg(F.min_by(F.struct("doc_id", "text_sha256"), order).alias("own"))
    return _only(docs, scratch.keep(first.select("own.*"), "first")).dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which may be never; rows that share an id are taken alike."""
    taken = pareto_mix.mix(spark, docs).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies"))
    times = F.explode(F.sequence(F.lit(1), taken["copies"])).alias("copy of the mix")
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["doc_id"])).select(*[docs[c] for c in docs.columns], times).drop("copy of the mix")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 ids."""
    import public_tokenizers

    return slack_packing.pack(spark, docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("mix_sources", mix_sources), ("pack", pack)]
#: Similarity joins, tokenizers and nearest neighbours aren't SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage wrote is removed once the next has read it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        begun, before = storage.opened(), docs
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        storage.sweep(spark, begun, (scratch,))
        if hasattr(before, "weft_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
