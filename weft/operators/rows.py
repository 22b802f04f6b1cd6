"""Rows of documents by number, from the end, or at a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.lines import LF, form_of, numbered_lines, whole
from weft.functions.names import DEFAULT, content_name


def parse_rows(text: str) -> list[tuple[int, int | None]]:
    """``3,1,7-9,20-`` as ranges from 1, sorted and merged; None ends at the last row."""
    found = []
    for part in text.split(","):
        first, dash, last = part.strip().partition("-")
        if not first.isdigit() or (last and not last.isdigit()):
            raise ValueError(f"not a row or a range: {part!r}")
        a, b = int(first), int(last) if last else (None if dash else int(first))
        if a < 1 or (b is not None and b < a):
            raise ValueError(f"rows begin at 1 and ranges ascend: {part!r}")
        found.append((a, b))
    out: list[tuple[int, int | None]] = []
    for a, b in sorted(found, key=lambda x: (x[0], x[1] is None, x[1])):
        if out and (out[-1][1] is None or a <= out[-1][1] + 1):
            out[-1] = (out[-1][0], None if b is None or out[-1][1] is None else max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def select_rows(docs: DataFrame, rows: str | None = None, tail: int | None = None, every: int | None = None, newlines: str = LF, hash_width: int = DEFAULT) -> DataFrame:
    """doc, line_no, line, line_hash by exactly one of: ranges, the last ``tail`` rows, each ``every``-th row.

    A line's hash covers its terminator too, in ``hash_width`` characters.
    A document's number of lines comes with each line, so the last ones need no shuffle.
    """
    if sum(x is not None for x in (rows, tail, every)) != 1:
        raise ValueError("exactly one of rows, tail and every")
    if tail is not None:
        if tail < 1:
            raise ValueError("tail is at least 1")
        return _shown(numbered_lines(docs, newlines).filter(F.col("line_no") > F.col("n_lines") - tail), hash_width)
    found = numbered_lines(docs, newlines)
    if every is not None:
        if every < 1:
            raise ValueError("every is at least 1")
        return _shown(found.filter(F.col("line_no") % every == 0), hash_width)
    keep = F.lit(False)
    for a, b in parse_rows(rows):
        keep = keep | ((F.col("line_no") >= a) & (F.lit(True) if b is None else F.col("line_no") <= b))
    return _shown(found.filter(keep), hash_width)


def _shown(found: DataFrame, hash_width: int) -> DataFrame:
    return found.select("doc", "line_no", F.col("body").alias("line"), content_name(whole(), hash_width).alias("line_hash"))


def told(selected: DataFrame, numbers: bool = False, hashes: bool = False) -> DataFrame:
    """doc, line_no, text of selected rows: number and hash before the line, each with a colon."""
    form = form_of(selected, "line")
    lead = [F.concat(F.col(c).cast("string"), F.lit(":")).cast(form.type) for c, asked in (("line_no", numbers), ("line_hash", hashes)) if asked]
    return selected.select("doc", "line_no", F.concat(*lead, "line").alias("text"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each document of scored (doc, line_no, score), ties to the earlier line."""
    if k < 1:
        raise ValueError("k is at least 1")
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "line_no")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
