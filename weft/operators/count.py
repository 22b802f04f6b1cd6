"""Lines, words, bytes, characters and the longest line of documents, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.lines import LF, TEXT, UNICODE, Form, form_of, line_array

#: How lines and words are told: ascii counts an unterminated last line, posix only line feeds.
ASCII, POSIX, UNICODE_MODE = "ascii", "posix", "unicode"
FIELDS = ("lines", "words", "bytes", "chars", "max_line_length")
#: Runs that are no white space: C's isspace, and the White_Space property.
WORD = {ASCII: r"[^ \t\n\x0B\f\r]+", UNICODE_MODE: r"[^\s\x0B\x{85}\p{Z}]+"}


def _modes(mode: str) -> str:
    if mode not in (ASCII, POSIX, UNICODE_MODE):
        raise ValueError(f"mode is {ASCII}, {POSIX} or {UNICODE_MODE}, not {mode!r}")
    return mode


def expressions(mode: str = ASCII, text: str = "text", form: Form = TEXT) -> dict[str, Column]:
    """Of bytes, words by Unicode and characters are those of the text with U+FFFD for what is no UTF-8; the rest is counted as it is."""
    t = F.col(text)
    opened, decoded = form.opened(t), F.decode(t, "UTF-8") if form.binary else t
    lines = F.transform(line_array(t, UNICODE if mode == UNICODE_MODE else LF, form), form.opened) if form.binary else line_array(t, UNICODE if mode == UNICODE_MODE else LF)
    if _modes(mode) == POSIX:
        n_lines = form.size(opened) - form.size(F.replace(opened, F.lit("\n"), F.lit("")))
    else:
        n_lines = F.size(lines)
    body = lambda x: form.size(F.regexp_replace(x, r"\r\z", ""))
    found = {
        "lines": n_lines,
        "words": F.regexp_count(decoded if mode == UNICODE_MODE else opened, F.lit(WORD[UNICODE_MODE if mode == UNICODE_MODE else ASCII])),
        "bytes": F.octet_length(t),
        "chars": F.char_length(decoded),
        "max_line_length": F.coalesce(F.array_max(F.transform(lines, body)), F.lit(0)),
    }
    return {k: v.cast("long") for k, v in found.items()}


def _wanted(fields) -> list[str]:
    if unknown := set(fields) - set(FIELDS):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return [f for f in FIELDS if f in fields]


def count(docs: DataFrame, fields=FIELDS, mode: str = ASCII) -> DataFrame:
    """doc and the fields asked for, in the fixed order; what isn't asked for isn't computed."""
    found = expressions(mode, form=form_of(docs))
    return docs.select("doc", *[found[f].alias(f) for f in _wanted(fields)])


def totals(counts: DataFrame) -> DataFrame:
    """One row over counts: sums, the longest line's maximum, and how many inputs."""
    have = [c for c in FIELDS if c in counts.columns]
    total = [(F.max if c == "max_line_length" else F.sum)(c) for c in have]
    return counts.agg(*[F.coalesce(t, F.lit(0)).alias(c) for t, c in zip(total, have)], F.count("*").alias("files"))


def with_total(counts: DataFrame) -> DataFrame:
    """The rows of counts and one more, of doc null, that sums them."""
    have = [c for c in FIELDS if c in counts.columns]
    total = [(F.max if c == "max_line_length" else F.sum)(c).alias(c) for c in have]
    return counts.rollup("doc").agg(*total)


def file_sizes(spark, path: str) -> DataFrame:
    """doc and bytes of files, from the listing alone; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc"), F.col("length").alias("bytes"))
