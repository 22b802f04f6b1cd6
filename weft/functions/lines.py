"""Lines of documents.

A documents frame has ``doc`` and ``text``; other columns are dropped. A text is a string, or binary: then lines,
terminators and all that is made of them are binary too, and bytes that aren't UTF-8 stay what they are. Two sets of terminators exist: ``lf``
is the line feed alone, and a CR before it stays on the line that is searched; ``unicode`` is LF, VT, FF,
CR, NEL, LS and PS, with CR LF as one. A terminator at the end begins no further line.

Everything here takes time in proportion to a text: a text is cut once, and what belongs to its lines is
zipped with them. An expression over the whole text must not stand inside a function of one line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

LF, UNICODE = "lf", "unicode"
#: Patterns of one terminator in Java's syntax, for characters and for UTF-8 with a character for each byte.
TERMINATOR = {LF: r"\n", UNICODE: r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"}
BYTE_TERMINATOR = {LF: r"\n", UNICODE: r"\r\n|[\n\x0B\f\r]|\x{C2}\x{85}|\x{E2}\x{80}[\x{A8}\x{A9}]"}
LATIN = "ISO-8859-1"


@dataclass(frozen=True)
class Form:
    """How a text is held: as characters, or as bytes that needn't be UTF-8 and stay what they are.

    Bytes are opened as one character each while they are cut, and closed again; nothing decodes and encodes them.
    """

    binary: bool = False

    def opened(self, text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return F.decode(text, LATIN) if self.binary else text

    def closed(self, text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return F.encode(text, LATIN) if self.binary else text

    def size(self, text: Column | str) -> Column:
        """Bytes of an opened text."""
        return F.char_length(text) if self.binary else F.octet_length(text)

    def literal(self, text: str) -> str:
        """A text as it is in opened ones."""
        return self.raw(text).decode("latin-1") if self.binary else text

    def lit(self, text: str) -> Column:
        """A text as it is in closed ones."""
        return F.lit(self.raw(text)) if self.binary else F.lit(text)

    def joined(self, parts: Column) -> Column:
        """An array of closed texts one after another."""
        return F.encode(F.array_join(F.transform(parts, lambda x: F.decode(x, LATIN)), ""), LATIN) if self.binary else F.array_join(parts, "")

    @staticmethod
    def raw(text: str) -> bytes:
        return text.encode("utf-8", "surrogateescape")

    @staticmethod
    def text(value: str | bytes | None) -> str:
        """What a task sees of a closed text; bytes that are no UTF-8 stand as they are for themselves."""
        return value if isinstance(value, str) else bytes(value or b"").decode("utf-8", "surrogateescape")

    @property
    def terminator(self) -> dict[str, str]:
        return BYTE_TERMINATOR if self.binary else TERMINATOR

    @property
    def type(self) -> str:
        return "binary" if self.binary else "string"


TEXT, BYTES = Form(), Form(True)


def form_of(docs: DataFrame, column: str = "text") -> Form:
    return BYTES if isinstance(docs.schema[column].dataType, BinaryType) else TEXT


def _check(newlines: str) -> str:
    if newlines not in TERMINATOR:
        raise ValueError(f"newlines is {LF} or {UNICODE}, not {newlines!r}")
    return newlines


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole_ends(parts: Column) -> Column:
    """What a text is cut into, without the empty last part of a text that ends with a terminator."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_array(text: Column | str, newlines: str = LF, form: Form = TEXT) -> Column:
    """The lines of a text, without terminators; an empty text has none."""
    found = once(F.split(form.opened(text), form.terminator[_check(newlines)], -1), whole_ends)
    return F.transform(found, form.closed) if form.binary else found


def terminators(text: Column | str, parts: Column, newlines: str = LF, form: Form = TEXT) -> Column:
    """The terminator of each of the parts that an opened text is cut into; the last has none."""
    if newlines == LF:
        return F.concat(F.array_repeat(F.lit("\n"), F.size(parts) - 1), F.array(F.lit("")))
    return F.concat(F.regexp_extract_all(text, F.lit(form.terminator[newlines]), 0), F.array(F.lit("")))


def line_structs(text: Column | str, newlines: str = LF, form: Form = TEXT) -> Column:
    """Structs (as_cut, terminator) of a text; only an unterminated last line has an empty terminator."""
    opened = form.opened(text)

    def zipped(parts: Column) -> Column:
        both = F.arrays_zip(parts.alias("as_cut"), terminators(opened, parts, newlines, form).alias("terminator"))
        return F.when(F.element_at(parts, -1) == "", F.slice(both, 1, F.size(parts) - 1)).otherwise(both)

    found = once(F.split(opened, form.terminator[_check(newlines)], -1), zipped).cast("array<struct<as_cut: string, terminator: string>>")
    return F.transform(found, lambda s: F.struct(form.closed(s["as_cut"]).alias("as_cut"), form.closed(s["terminator"]).alias("terminator"))) if form.binary else found


def without_cr(line: Column | str, form: Form = TEXT) -> Column:
    """A line without a CR at its end."""
    line = F.col(line) if isinstance(line, str) else line
    if form.binary:
        return F.when(F.endswith(line, F.lit(b"\r")), F.substring(line, F.lit(1), F.octet_length(line) - 1)).otherwise(line)
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.char_length(line) - 1)).otherwise(line)


def begins(sizes: Column) -> Column:
    """The sums of all sizes before each of an array; Spark's own running sum would take a window over lines."""

    def run(every: pd.Series) -> pd.Series:
        return every.map(lambda own: None if own is None else own.cumsum() - own)

    return F.pandas_udf(run, "array<long>")(sizes)


def numbered_lines(docs: DataFrame, newlines: str = LF, offsets: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """As ``lines``, with the columns of docs that ``carry`` names and n_lines of the document, without a shuffle."""
    form = form_of(docs)
    cut = docs.select("doc", *carry, form.opened("text").alias("text"))
    cut = cut.select("doc", *carry, "text", F.split("text", form.terminator[_check(newlines)], -1).alias("parts"))
    # told before the parts become rows: a row that needs them carries all of its document
    cut = cut.withColumn("n_parts", F.size("parts")).withColumn("ended", F.element_at("parts", -1) == "")
    plain = newlines == LF and not offsets
    if plain:
        rows = cut.select("doc", *carry, "n_parts", "ended", F.posexplode("parts").alias("at", "as_cut"))
        rows = rows.withColumn("terminator", F.when(F.col("at") < F.col("n_parts") - 1, F.lit("\n")).otherwise(F.lit("")))
    else:
        cut = cut.withColumn("ends", terminators("text", F.col("parts"), newlines, form))
        zipped = [F.col("parts").alias("as_cut"), F.col("ends").alias("terminator")]
        if offsets:
            sizes = F.transform(F.arrays_zip("parts", "ends"), lambda z: (form.size(z["parts"]) + form.size(z["ends"])).cast("long"))
            cut = cut.withColumn("begins", begins(sizes))
            zipped.append(F.col("begins").alias("byte_offset"))
        rows = cut.select("doc", *carry, "n_parts", "ended", F.posexplode(F.arrays_zip(*zipped)).alias("at", "z"))
        rows = rows.select("doc", *carry, "n_parts", "ended", "at", "z.*")
    rows = rows.filter((F.col("at") < F.col("n_parts") - 1) | (F.col("as_cut") != ""))
    own = [form.closed("as_cut").alias("as_cut"), form.closed(without_cr("as_cut")).alias("body"), form.closed("terminator").alias("terminator"), *(["byte_offset"] if offsets else [])]
    return rows.select("doc", *carry, (F.col("at") + 1).cast("long").alias("line_no"), *own, (F.col("n_parts") - F.col("ended").cast("int")).cast("long").alias("n_lines"))


def lines(docs: DataFrame, newlines: str = LF, offsets: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc, line_no (from 1), as_cut, body (without a CR at its end), terminator, and with offsets byte_offset."""
    return numbered_lines(docs, newlines, offsets, carry).drop("n_lines")


def whole() -> Column:
    """A line with its terminator, as names cover it."""
    return F.concat("as_cut", "terminator")


def quoted(literal: str) -> str:
    """A Java pattern of exactly this text."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"
