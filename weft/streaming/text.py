"""The operators that need no order, over streams of documents; those that need one refuse a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.folding import fold
from weft.functions.lines import LF, lines
from weft.operators import cols, count, find, replace


def read_text(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """doc, text of each LF line of the files that arrive under path."""
    stream = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).text(path)
    return stream.select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def find_stream(docs: DataFrame, search: find.Search) -> DataFrame:
    return find.hits(docs, search)


def replace_stream(docs: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return replace.replace(docs, pattern, replacement)


def columns_stream(docs: DataFrame, wanted: str, delimiter: str) -> DataFrame:
    return cols.columns(docs, wanted, delimiter)


def count_stream(docs: DataFrame, mode: str = count.ASCII) -> DataFrame:
    """Running totals over all documents so far (output mode complete)."""
    return count.totals(count.count(docs, mode=mode))


def dedup_stream(docs: DataFrame, ignore_case: bool = False, event_time: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Lines not seen before. The state grows with the distinct lines, unless an event time bounds it.

    Which of equal lines comes first is the first that a batch sees; the order of the input isn't kept.
    """
    if event_time:
        rows = docs.withWatermark(event_time, watermark).select("doc", event_time, F.explode(F.split("text", "\n")).alias("body"))
        rows = rows.withColumn("key", fold("body") if ignore_case else F.col("body"))
        return rows.dropDuplicatesWithinWatermark(["key"]).drop("key")
    rows = lines(docs, LF)
    rows = rows.withColumn("key", fold("body") if ignore_case else F.col("body"))
    return rows.dropDuplicates(["key"]).drop("key")


def refuse_stream(docs: DataFrame, what: str) -> None:
    """For operators whose result depends on the order of all rows."""
    if docs.isStreaming:
        raise ValueError(f"{what} needs the order of all rows; a stream has none")
