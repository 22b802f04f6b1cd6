"""Lines of files too large to be one value: numbers, offsets, ends and context across the splits of a file.

A file is read in splits, as the file system cuts it; a line belongs to the split in which it begins. One pass counts the lines
and bytes of each split, a running sum over the splits of a file (a row for each) tells where a split begins, and a second
pass numbers the lines where they are. Lines never move: only what stands at the seams of splits is exchanged for context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.lines import BYTES, TEXT, form_of, without_cr
from weft.operators.find import Search

#: A table of splits of at most so many rows is sent to all tasks (some 200 MB, for 250 TB in splits of 128 MB); a larger one is joined by shuffle.
FEW_SPLITS = 2_000_000


def _read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    at = [F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size")]
    return rows.select(*at, F.col("value").cast("binary").alias("as_cut"))


def _cuts(batch: pa.RecordBatch) -> list[tuple[str, int, int, int]]:
    """doc, split and the range of rows of each split in a batch; the rows of one stand together."""
    if not batch.num_rows:
        return []
    doc, split = batch.column("doc").dictionary_encode(), batch.column("split").to_numpy()
    codes = doc.indices.to_numpy()
    cut = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (split[1:] != split[:-1])])
    return [(doc.dictionary[int(codes[a])].as_py(), int(split[a]), int(a), int(b)) for a, b in zip(cut, np.r_[cut[1:], batch.num_rows])]


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.binary_length(batch.column("as_cut")).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def splits(spark: SparkSession, path: str) -> DataFrame:
    """doc, split (its first byte), lines and bytes of each split, lines and bytes before it, and of the file n_lines and ended.

    ended: whether the last line of the file has a terminator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(_sizes(batch))])
            full = batch.column("size").to_numpy()
            for doc, split, a, b in _cuts(batch):
                own = found.setdefault((doc, split), [0, 0, int(full[a])])
                own[0] += b - a
                own[1] += int(sizes[b] - sizes[a])
        rows = [(*k, *v) for k, v in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["doc", "split", "lines", "bytes", "size"])

    counted = _read(spark, path).mapInArrow(run, "doc string, split bigint, lines bigint, bytes bigint, size bigint")
    before = Window.partitionBy("doc").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc")
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "bytes")]
    # every line counts one byte for its terminator, which the last may lack; a compressed file doesn't tell
    return counted.select("doc", "split", "lines", "bytes", *sums, F.sum("lines").over(whole).alias("n_lines"), (F.sum("bytes").over(whole) != F.col("size") + 1).alias("ended"))


def numbered(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """doc, split, line_no, byte_offset, as_cut, body, terminator, n_lines of every line of the files under path.

    Number and offset are those in the whole file, whatever its splits; n_lines is the file's. With ``as_bytes`` lines are binary.
    """
    known = splits(spark, path).cache()
    few = known.count() <= FEW_SPLITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lines, size = None, 0, 0
        for batch in batches:
            sizes = _sizes(batch)
            place, offset = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for doc, split, a, b in _cuts(batch):
                if (doc, split) != last:
                    last, lines, size = (doc, split), 0, 0
                place[a:b] = lines + np.arange(1, b - a + 1)
                offset[a:b] = size + np.cumsum(sizes[a:b]) - sizes[a:b]
                lines, size = lines + b - a, size + int(sizes[a:b].sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("split"), pa.array(place), pa.array(offset), batch.column("as_cut")], ["doc", "split", "place", "offset", "as_cut"])

    rows = _read(spark, path).mapInArrow(run, "doc string, split bigint, place bigint, offset bigint, as_cut binary")
    base = known.select("doc", "split", "lines_before", "bytes_before", "n_lines", "ended")
    rows = rows.join(F.broadcast(base) if few else base, ["doc", "split"])
    form = BYTES if as_bytes else TEXT
    line = F.col("as_cut").cast(form.type)
    number = F.col("place") + F.col("lines_before")
    terminator = F.when((number < F.col("n_lines")) | F.col("ended"), form.lit("\n")).otherwise(form.lit(""))
    return rows.select("doc", "split", number.alias("line_no"), (F.col("offset") + F.col("bytes_before")).alias("byte_offset"), line.alias("as_cut"), without_cr(line, form).alias("body"), terminator.alias("terminator"), "n_lines")


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n lines of each file of ``numbered`` lines."""
    if n < 1:
        raise ValueError("tail is at least 1")
    return rows.filter(F.col("line_no") > F.col("n_lines") - n)


def every(rows: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("every is at least 1")
    return rows.filter(F.col("line_no") % n == 0)


def context(rows: DataFrame, search: Search, before: int = 0, after: int = 0) -> DataFrame:
    """doc, line_no, is_match, line of selected lines of ``numbered`` lines and those around them, as find.context tells of a whole file.

    Inside a split lines are chosen in one pass that holds ``before`` of them. Each split also gives its first ``after`` lines and
    its last ``before``; hits as near to an end of their split choose among these, of any number of splits.
    """
    if search.multiline:
        raise ValueError("a match over several lines needs its document whole")
    if min(before, after) < 0:
        raise ValueError("context isn't negative")
    form = form_of(rows, "as_cut")
    hit = search.matches("as_cut", form)
    told = rows.select("doc", "split", "line_no", (~hit if search.invert else hit).alias("is_match"), F.col("body").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, first_no, reach = None, None, 0, -1

        def choose(part: pa.RecordBatch, begins: int, ends: bool, reach: int) -> tuple[pa.RecordBatch, int]:
            """Rows of a part of a split that are shown or stand at a seam; the split begins at line ``begins``, and ends with the part or not."""
            no, match = part.column("line_no").to_numpy(), part.column("is_match").to_numpy(zero_copy_only=False).astype(bool)
            step = np.zeros(len(no) + 1, np.int64)
            at = np.flatnonzero(match)
            np.add.at(step, np.maximum(at - before, 0), 1)
            np.add.at(step, np.minimum(at + after + 1, len(no)), -1)
            near = (np.cumsum(step[:-1]) > 0) | (no <= reach)
            final = int(no[-1]) if ends else 1 << 62
            seam = (no < begins + after) | (no > final - before)
            # a hit that near to an end of its split reaches beyond it
            beyond = match & ((no < begins + before) | (no > final - after))
            take = pa.array(np.flatnonzero(near | seam | beyond))
            out = pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("doc", "line_no", "is_match", "line")), pa.array(near).take(take), pa.array(beyond).take(take)], ["doc", "line_no", "is_match", "line", "near", "beyond"])
            return out, max(reach, int(no[at[-1]]) + after if len(at) else -1)

        def finish(ends: bool):
            """Tell of what is held but its last rows, which lines to come may choose."""
            nonlocal held, reach, first_no
            keep = 0 if ends else min(held.num_rows, before + after + 1)
            whole = held
            out, reached = choose(whole, first_no, ends, reach)
            gone = whole.num_rows - keep
            if not ends:
                last_told = whole.column("line_no")[gone - 1].as_py() if gone else -1
                out = out.filter(pc.less_equal(out.column("line_no"), last_told))
                held = whole.slice(gone)
                # what is held is judged again, with what comes
                some = whole.slice(max(0, gone - after - 1), min(gone, after + 1))
                reach = max(reach, max([n + after for n, m in zip(some.column("line_no").to_pylist(), some.column("is_match").to_pylist()) if m], default=-1))
            else:
                held, reach = None, -1
            return out

        for batch in batches:
            for doc, split, a, b in _cuts(batch):
                part = batch.slice(a, b - a)
                if (doc, split) != last:
                    if held is not None:
                        yield finish(True)
                    last, held, reach = (doc, split), part, -1
                    first_no = part.column("line_no")[0].as_py()
                else:
                    held = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0] if held.num_rows else part
                yield finish(False)
        if held is not None:
            yield finish(True)

    found = told.mapInArrow(run, f"doc string, line_no bigint, is_match boolean, line {form.type}, near boolean, beyond boolean")
    if not (before or after):
        return found.filter("near").select("doc", "line_no", "is_match", "line")
    # a hit at a seam asks for the lines around it by number
    asked = found.filter("beyond").select("doc", F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("line_no")).distinct().withColumn("asked", F.lit(True))
    inside, seams = found.filter("near"), found.filter("not near")
    return inside.select("doc", "line_no", "is_match", "line").unionByName(seams.join(asked, ["doc", "line_no"], "left_semi").select("doc", "line_no", "is_match", "line"))
