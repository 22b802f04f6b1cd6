"""Documents inside archives, notebooks and databases; each row keeps where it came from."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def unpack(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(member, content) of zip and tar archives, or of one compressed file, by what the bytes are."""
    import bz2
    import gzip
    import lzma
    import tarfile
    import zipfile

    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, z.read(m)
        return
    plain = data
    if data[:2] == b"\x1f\x8b":
        plain = gzip.decompress(data)
    elif data[:3] == b"BZh":
        plain = bz2.decompress(data)
    elif data[:6] == b"\xfd7zXZ\x00":
        plain = lzma.decompress(data)
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    if plain[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(plain)) as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
        return
    yield "", plain


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """doc, member, content, text of what archives and compressed files under path hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, content in zip(frame["path"], frame["content"]):
                for member, data in unpack(doc, bytes(content)):
                    yield pd.DataFrame({"doc": [doc], "member": [member], "content": [data]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "doc string, member string, content binary").withColumn("text", F.col("content").cast("string"))


def notebook_cells(files: DataFrame, kind: str | None = None) -> DataFrame:
    """doc, cell, cell_type, text of the cells of notebooks (doc, text: their JSON)."""
    shape = "struct<cells: array<struct<cell_type: string, source: string>>>"
    cells = F.from_json("text", shape)
    rows = files.select("doc", F.posexplode(cells["cells"]).alias("cell", "c"))
    # a source is a text or a list of lines
    source = F.coalesce(F.array_join(F.from_json("c.source", "array<string>"), ""), F.col("c.source"))
    rows = rows.select("doc", "cell", F.col("c.cell_type").alias("cell_type"), source.alias("text"))
    return rows.filter(F.col("cell_type") == kind) if kind else rows


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_text").option("path", …).option("table", …).option("column", …)``: rowid, text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_text"

    def schema(self) -> str:
        return "rowid bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table, self.column, self.parts = options["path"], options["table"], options["column"], int(options.get("parts", 4))

    def _ask(self, what: str, where: str = "", values: tuple = ()):
        import sqlite3

        quoted = lambda x: '"' + x.replace('"', '""') + '"'
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {what.format(column=quoted(self.column))} FROM {quoted(self.table)} {where.format(column=quoted(self.column))}", values)

    def partitions(self):
        # ranges of the table's own key, so that each is read from its place on
        (first, last), *_ = self._ask("min(rowid), max(rowid)")
        if first is None:
            return [InputPartition((1, 0))]
        step = (last - first) // self.parts + 1
        return [InputPartition((a, min(last, a + step - 1))) for a in range(first, last + 1, step)]

    def read(self, partition):
        yield from self._ask("rowid, {column}", "WHERE typeof({column}) = 'text' AND rowid BETWEEN ? AND ?", partition.value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
