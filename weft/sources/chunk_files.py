"""Chunks as files, one each and named as asked, that are there all or none.

Tasks write into folders of their own below a staging folder; a commit moves the files of the tasks that succeeded to their
names and removes the rest, an abort removes all. The folder is one that driver and executors share as a file system.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = ".weft-staging-"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if "path" not in options:
            raise ValueError("chunks need a path")
        self.path, self.overwrite = options["path"].removeprefix("file://"), overwrite
        self.staging = os.path.join(self.path, STAGING + uuid.uuid4().hex)

    def write(self, batches: Iterator) -> Written:
        folder, names = os.path.join(self.staging, uuid.uuid4().hex), []
        os.makedirs(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                if not name or os.path.basename(name) != name or name.startswith("."):
                    raise ValueError(f"no name of a chunk: {name!r}")
                with open(os.path.join(folder, name), "xb") as f:
                    f.write(content or b"")
                    f.flush()
                    os.fsync(f.fileno())
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        taken = [n for n in names if os.path.exists(os.path.join(self.path, n))]
        if len(set(names)) < len(names) or (taken and not self.overwrite):
            self.abort(messages)
            raise ValueError("two chunks have one name" if not taken else f"there already: {sorted(taken)[:3]}")
        os.makedirs(self.path, exist_ok=True)
        for m in done:
            for n in m.names:
                os.replace(os.path.join(m.folder, n), os.path.join(self.path, n))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ChunkFiles(DataSource):
    """Format ``chunk_files``: rows of name and content (binary) to files of these names under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        if schema.fieldNames() != ["name", "content"]:
            raise ValueError("chunk files are of name and content")
        return ChunkWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkFiles)


def write_chunk_files(chunks: DataFrame, path: str, name: Column, overwrite: bool = False) -> None:
    """Write the texts of chunks (chunk.chunks) to a file each, none of which is seen before all are there."""
    register(chunks.sparkSession)
    rows = chunks.select(name.alias("name"), chunks["text"].cast("binary").alias("content"))
    rows.write.format("chunk_files").mode("overwrite" if overwrite else "append").save(path)
