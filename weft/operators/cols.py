"""Columns of lines, cut at a literal delimiter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.lines import LF, form_of, lines, quoted


def parse_columns(text: str) -> list[int]:
    """``3,1,5-7`` as column numbers from 1, in the order named, repeats kept."""
    out = []
    for part in text.split(","):
        first, dash, last = part.strip().partition("-")
        if not first.isdigit() or (dash and not last.isdigit()):
            raise ValueError(f"not a column or a range: {part!r}")
        a, b = int(first), int(last) if dash else int(first)
        if a < 1 or b < a:
            raise ValueError(f"columns begin at 1 and ranges ascend: {part!r}")
        out += range(a, b + 1)
    return out


def fields(line: Column | str, delimiter: str, most: int = -1) -> Column:
    """The fields of a line; an empty line has none. With ``most`` the last one holds the rest."""
    if not delimiter:
        raise ValueError("an empty delimiter cuts nowhere")
    line = F.col(line) if isinstance(line, str) else line
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, quoted(delimiter), most))


def columns(docs: DataFrame, wanted: str, delimiter: str = "\t", output_delimiter: str | None = None, min_columns: int = 0, newlines: str = LF) -> DataFrame:
    """doc, line_no, columns (array), line: the columns named, absent ones empty, joined by the output delimiter.

    Lines with fewer than ``min_columns`` fields go. Lines are cut no further than the furthest column needs.
    """
    places, form = parse_columns(wanted), form_of(docs)
    cut = fields(form.opened("body"), form.literal(delimiter), -1 if min_columns > max(places) else max(places) + 1)
    rows = lines(docs, newlines).withColumn("f", cut)
    if min_columns:
        rows = rows.filter(F.size("f") >= min_columns)
    found = F.array(*[F.coalesce(F.try_element_at("f", F.lit(k)), F.lit("")) for k in places])
    line = F.array_join(found, form.literal(delimiter if output_delimiter is None else output_delimiter))
    return rows.select("doc", "line_no", (F.transform(found, form.closed) if form.binary else found).alias("columns"), form.closed(line).alias("line"))
