"""Where operators keep what must outlive a task: tables in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir``. A session on one machine (a local master) without it gets a temporary
folder of its own, the first time one is needed; on a cluster that setting has to be there.

An operator's result is read lazily, so the tables behind it stay until it is consumed. ``sweep`` then removes
them, and an operator itself drops what its result doesn't read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Folders of this driver's operators that still have tables, in the order in which they were begun.
_ROOTS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; set here only where it is unset, and only for a local master."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} names no folder that all executors and the driver share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def opened() -> int:
    """How many folders have been begun so far, for ``sweep``."""
    return len(_ROOTS)


def sweep(spark: SparkSession, since: int = 0, but: tuple[Scratch, ...] = ()) -> None:
    """Remove the tables of operators begun since then; their results can't be read any more."""
    kept = {s.root for s in but}
    for root in [r for r in _ROOTS[since:] if r not in kept]:
        _remove(spark, root)
        _ROOTS.remove(root)


class Scratch:
    """Tables written for one run of an operator, each in a folder that nothing else uses."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: list[str] = []
        _ROOTS.append(self.root)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df and read it back, so that what follows has no lineage and sees fixed values.

        With ``by`` its rows lie in as many buckets of that column as a shuffle has partitions, and a join on
        the column doesn't shuffle them again. Only tables of the catalogue have buckets: the name is there for
        a moment, and as its files are in a folder of ours, they stay when it goes.
        """
        path = f"{self.root}/{len(self._paths) + 1:02d}-{name}"
        self._paths.append(path)
        out = df.write.option("compression", "zstd")
        if by is None:
            out.parquet(path)
            back = self.spark.read.schema(df.schema).parquet(path)
        else:
            table = f"weft_{name}_{uuid.uuid4().hex}"
            out.format("parquet").bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
            back = self.spark.table(table)
            self.spark.sql(f"DROP TABLE {table}")
        back.weft_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Remove a kept table that nothing reads any more."""
        _remove(self.spark, df.weft_path)

    def only(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        kept = {t.weft_path for t in tables}
        for path in [p for p in self._paths if p not in kept]:
            _remove(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
