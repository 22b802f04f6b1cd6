"""Rendering of results: JSON records, text prefixes, tables of counts, and what a run reports.

Everything here is a projection; order is imposed where a result is written.
"""

from __future__ import annotations

import enum
import os
import shutil
import stat
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.find import Search, context, hits, matches, summary


class Status(enum.IntEnum):
    """How a run ended: something found, nothing found, an error, an edit refused."""

    FOUND, NONE, ERROR, REFUSED = range(4)


class Refused(ValueError):
    """An edit that its guards don't allow."""


class Stale(Refused):
    pass


class Ambiguous(Refused):
    pass


class Unresolved(Refused):
    pass


def status_of(found: DataFrame) -> Status:
    """For quiet runs: whether there is a row; stops at the first."""
    return Status.NONE if found.isEmpty() else Status.FOUND


def raise_refused(edited: DataFrame) -> None:
    """Raise for the first document of a guarded edit that was refused."""
    kinds = {"stale": Stale, "ambiguous": Ambiguous, "unresolved": Unresolved}
    bad = edited.filter(F.col("status").isin(*kinds)).orderBy("doc").first()
    if bad:
        raise kinds[bad["status"]](f"{bad['doc']}: {bad['status']} ({bad['found']} found)")


def record(kind: str, *columns: Column | str) -> Column:
    """The envelope {"type": kind, "data": {…}} of a JSON line."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*columns).alias("data")))


def text_field(content: Column | str) -> Column:
    """{"text": …} of valid UTF-8, {"bytes": base64} of anything else."""
    c = F.col(content) if isinstance(content, str) else content
    valid = F.is_valid_utf8(c.cast("string"))
    # in one line, where Spark's own base64 breaks lines
    coded = F.regexp_replace(F.base64(c.cast("binary")), r"\s", "")
    return F.struct(F.when(valid, c.cast("string")).alias("text"), F.when(~valid, coded).alias("bytes"))


def summary_record(docs: DataFrame, search: Search) -> DataFrame:
    return summary(docs, search).select(record("summary", "files_searched", "files_matched", "lines", "matches", "bytes").alias("record"))


def text_lines(docs: DataFrame, search: Search, before: int = 0, after: int = 0, many: bool = True, numbers: bool = True) -> DataFrame:
    """doc, line_no, text: lines with context behind path:number:, with - for context lines."""
    rows = context(docs, search, before, after)
    sep = F.when(F.col("is_match"), ":").otherwise("-")
    lead = [F.col("doc").cast("string"), sep] * many + [F.col("line_no").cast("string"), sep] * numbers
    return rows.select("doc", "line_no", "group_id", F.concat(*lead, "line").alias("text"))


def vimgrep(docs: DataFrame, search: Search) -> DataFrame:
    """doc, line_no, text: path:line:column:text for each match; an inverted search prints column 1."""
    if search.invert:
        rows = hits(docs, search).withColumn("column", F.lit(1).cast("long"))
    else:
        rows = matches(docs, search, body=True)
    return rows.select("doc", "line_no", F.concat_ws(":", F.col("doc").cast("string"), "line_no", "column", "body").alias("text"))


def headings(rows: DataFrame) -> DataFrame:
    """Rows of ``text_lines`` with the path once above each document's: doc, line_no, text."""
    heads = rows.select("doc").distinct().select("doc", F.lit(0).cast("long").alias("line_no"), F.col("doc").cast("string").alias("text"))
    return rows.select("doc", "line_no", "text").unionAll(heads)


def trimmed(line: Column | str, most: int, unicode: bool = True) -> Column:
    """A line of at most ``most`` characters, or bytes on a character's edge, and then [...]."""
    c = F.col(line) if isinstance(line, str) else line
    if unicode:
        return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(" [...]"))).otherwise(c)
    # a cut inside a character leaves broken bytes at the end, which go
    cut = F.substring(c.cast("binary"), 1, most)
    fit = F.coalesce(*[F.when(F.is_valid_utf8(F.substring(cut, F.lit(1), F.greatest(F.lit(0), F.octet_length(cut) - k)).cast("string")), F.substring(cut, F.lit(1), F.greatest(F.lit(0), F.octet_length(cut) - k)).cast("string")) for k in range(4)], F.lit(""))
    return F.when(F.octet_length(c) > most, F.concat(fit, F.lit(" [...]"))).otherwise(c)


def grouped(n: Column | str) -> Column:
    return F.format_number(n, 0)


def human(n: Column | str) -> Column:
    """A number with one decimal and K, M, G or T."""
    c = F.col(n) if isinstance(n, str) else n
    out = c.cast("string")
    for k, unit in enumerate("KMGT", 1):
        out = F.when(c >= 1000**k, F.concat(F.format_number(c / 1000**k, 1), F.lit(unit))).otherwise(out)
    return out


def count_records(counts: DataFrame) -> DataFrame:
    """doc and a JSON record of its counts."""
    have = [c for c in counts.columns if c != "doc"]
    return counts.select("doc", record("count", F.col("doc").cast("string").alias("path"), *have).alias("record"))


def count_table(counts: DataFrame, form: str = "table") -> DataFrame:
    """doc and one text of its counts: table (grouped digits), plain or human."""
    shows = {"table": grouped, "plain": lambda c: F.col(c).cast("string"), "human": human}
    if form not in shows:
        raise ValueError(f"a form is one of {sorted(shows)}")
    have = [c for c in counts.columns if c != "doc"]
    return counts.select("doc", F.concat_ws("\t", *[shows[form](c) for c in have], F.col("doc").cast("string")).alias("text"))


def write_text(rows: DataFrame, path: str, column: str = "text", null: bool = False, order: list[str] | None = None) -> None:
    """Text files of a column, in order if one is given; records end with LF or NUL."""
    (rows.orderBy(*order) if order else rows).select(column).write.option("lineSep", "\0" if null else "\n").text(path)


def write_chunks(chunks: DataFrame, path: str, suffix: Column) -> None:
    """A folder of text for each chunk, named by its suffix."""
    chunks.select(suffix.alias("suffix"), F.col("text").alias("value")).write.partitionBy("suffix").text(path)


def _temporary(path: str, data: bytes) -> str:
    """A file beside path that only its owner can read, with data on the disk."""
    handle, other = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".weft-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
    except BaseException:
        os.unlink(other)
        raise
    return other


def replace_file(path: str, data: bytes) -> None:
    """Write a local file so that a reader sees it whole, old or new: through links, keeping its mode.

    A file with several names is copied back into, so that all of them see the new content; what is no
    regular file is written as it is.
    """
    path = os.path.realpath(path)
    found = os.stat(path) if os.path.exists(path) else None
    if found and not stat.S_ISREG(found.st_mode):
        with open(path, "wb") as f:
            f.write(data)
        return
    other = _temporary(path, data)
    try:
        if found and found.st_nlink > 1:
            shutil.copyfile(other, path)
            os.unlink(other)
            return
        os.chmod(other, found.st_mode & 0o7777 if found else 0o666 & ~_umask())
        os.replace(other, path)
    except BaseException:
        if os.path.exists(other):
            os.unlink(other)
        raise


def create_file(path: str, data: bytes) -> None:
    """Write a new local file whole; one that is there is refused with FileExistsError."""
    other = _temporary(os.path.abspath(path), data)
    try:
        os.chmod(other, 0o666 & ~_umask())
        os.link(other, path)
    finally:
        os.unlink(other)


def discard(rows: DataFrame) -> None:
    """Compute all rows and keep none."""
    rows.write.format("noop").mode("overwrite").save()


def _umask() -> int:
    now = os.umask(0)
    os.umask(now)
    return now
