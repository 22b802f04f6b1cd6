"""Lines that hold a literal, their matches, context and counts.

Patterns are literals, never regular expressions. A search is decided inside a document: hits, their context,
regions over several lines, caps and offsets come from one pass without a shuffle. Texts may be strings or binary;
what a pattern means in bytes is its UTF-8.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import folding
from weft.functions.intervals import around, lines_of_spans
from weft.functions.lines import LF, TEXT, UNICODE, Form, begins, form_of, line_array, lines, once, quoted, whole, whole_ends, without_cr
from weft.functions.names import DEFAULT, content_name

SPAN = "array<struct<start: long, end: long, column: long, match: {}>>"
#: Lines of a document that are shown: their places from 0, whether each is a hit, its group.
AROUND = "struct<at: array<int>, is_match: array<boolean>, group_id: array<long>, opens: array<boolean>, found: int, line_feeds: int>"


@dataclass(frozen=True)
class Search:
    """What to look for. ``ignore_case`` folds fully and splits lines at all Unicode terminators."""

    pattern: str
    ignore_case: bool = False
    word: bool = False
    invert: bool = False
    unicode: bool = False
    multiline: bool = False

    def __post_init__(self) -> None:
        if not self.pattern:
            raise ValueError("an empty pattern matches everywhere")
        if self.multiline and self.invert:
            raise ValueError("multiline and invert exclude each other")
        if not self.multiline and "\n" in self.pattern:
            raise ValueError("a pattern with a line feed needs multiline")

    @property
    def newlines(self) -> str:
        return UNICODE if self.unicode or self.ignore_case else LF

    @property
    def _edge(self) -> str:
        return r"\p{IsAlphabetic}\p{N}_" if self.newlines == UNICODE else "A-Za-z0-9_"

    def matches(self, line: Column | str, form: Form = TEXT) -> Column:
        """Whether a line holds the pattern, before inversion."""
        if not self.word:
            return folding.contains(line, self.pattern, self.ignore_case, form)
        if form.binary:
            return self._holds(form)(line)
        text = folding.fold(line) if self.ignore_case else (F.col(line) if isinstance(line, str) else line)
        literal = self.pattern.casefold() if self.ignore_case else self.pattern
        return F.rlike(text, F.lit(f"(?<![{self._edge}]){quoted(literal)}(?![{self._edge}])"))

    def possible(self, text: Column | str, form: Form = TEXT) -> Column:
        """Whether a text can hold a match: whether the literal is there, whatever its edges."""
        return folding.contains(text, self.pattern, self.ignore_case, form)

    def _holds(self, form: Form):
        return F.pandas_udf(lambda lines: pd.Series([bool(self.spans(form.text(x))) for x in lines], dtype=bool), "boolean")

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not self.word:
            return folding.spans(text, self.pattern, self.ignore_case)
        inside = (lambda c: c == "_" or c.isalpha() or c.isnumeric()) if self.newlines == UNICODE else (lambda c: c == "_" or (c.isascii() and c.isalnum()))
        found, free = [], 0
        for a, b in folding.spans(text, self.pattern, self.ignore_case, overlapping=True):
            if a >= free and not (a and inside(text[a - 1])) and not (b < len(text) and inside(text[b])):
                found.append((a, b))
                free = b
        return found

    def byte_spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """Where each match begins and ends in bytes and in characters."""
        if not self.word and not self.ignore_case and text.isascii():
            return [(a, b, a, b) for a, b in self.spans(text)]
        out, at, start = [], 0, 0
        for a, b in self.spans(text):
            start += len(Form.raw(text[at:a]))
            at = a
            out.append((start, start + len(Form.raw(text[a:b])), a, b))
        return out

    def spans_udf(self, form: Form = TEXT):
        """Byte spans, column (from 1: characters, or bytes in byte mode) and text of the matches of a line."""
        chars = self.newlines == UNICODE

        @F.pandas_udf(SPAN.format(form.type))
        def run(text: pd.Series) -> pd.Series:
            out = []
            for t in text:
                t = form.text(t)
                out.append([{"start": x, "end": y, "column": (a if chars else x) + 1, "match": form.raw(t[a:b]) if form.binary else t[a:b]} for x, y, a, b in self.byte_spans(t)])
            return pd.Series(out)

        return run

    def no_spans(self, form: Form = TEXT) -> Column:
        return F.array().cast(SPAN.format(form.type))


def hits(docs: DataFrame, search: Search, offsets: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Selected lines: doc, line_no, as_cut, body, terminator (and byte_offset), with the columns that carry names.

    A document without the literal has no selected line, so it isn't split at all; not so when inverted.
    """
    form = form_of(docs)
    if not search.invert:
        docs = docs.filter(search.possible("text", form))
    hit = search.matches("as_cut", form)
    return lines(docs, search.newlines, offsets, carry).filter(~hit if search.invert else hit)


def matches(docs: DataFrame, search: Search, offsets: bool = False, body: bool = False) -> DataFrame:
    """One row for each match: doc, line_no, start, end (bytes in the line), column, match, and with body the line; none when inverted."""
    if search.invert:
        raise ValueError("an inverted search has no matches to show")
    found = hits(docs, search, offsets)
    keep = ["doc", "line_no", *(["body"] if body else []), *(["byte_offset"] if offsets else [])]
    return found.select(*keep, F.explode(search.spans_udf(form_of(docs))("as_cut")).alias("m")).select(*keep, "m.start", "m.end", "m.column", "m.match")


def _line_hits(search: Search, form: Form) -> Column:
    """Places (from 0) of the selected lines in ``parts``."""
    if search.ignore_case or (search.word and form.binary):

        @F.pandas_udf("array<int>")
        def run(parts: pd.Series) -> pd.Series:
            out = []
            for own in parts:
                own = [x.encode("latin-1") for x in own] if form.binary else own
                if search.word:
                    hit = [bool(search.spans(form.text(x))) for x in own]
                else:
                    needle = search.pattern.casefold()
                    hit = [needle in form.text(x).casefold() for x in own]
                out.append(np.flatnonzero(np.array(hit, bool) != search.invert).astype(np.int32))
            return pd.Series(out)

        return run("parts")
    # opened lines are strings, whatever they were
    literal = form.literal(search.pattern)
    test = (lambda x: F.rlike(x, F.lit(f"(?<![{search._edge}]){quoted(literal)}(?![{search._edge}])"))) if search.word else (lambda x: F.contains(x, F.lit(literal)))
    return F.array_compact(F.transform("parts", lambda x, k: F.when(~test(x) if search.invert else test(x), k)))


def document_hits(docs: DataFrame, search: Search, before: int = 0, after: int = 0, most: int | None = None, offsets: bool = False, carry: tuple[str, ...] = (), grouped: bool = False) -> DataFrame:
    """doc, carried columns, matches, lines_searched and ``shown`` of each document with a hit; nothing is shuffled.

    shown: structs of first (of the document), gap (a further group begins), at (from 0), is_match, group_id, opens (a region begins), as_cut and terminator (opened), byte_offset, of selected lines and those
    around them, in order. matches counts selected lines, or matches of a multiline search, ``most`` at most; the walk
    through a document ends once it has these, at the line behind the last. Without context, groups are told if ``grouped``.
    """
    if min(before, after) < 0:
        raise ValueError("context isn't negative")
    if most is not None and most < 1:
        raise ValueError("a cap is at least 1")
    form, newlines = form_of(docs), LF if search.multiline else search.newlines
    if not search.invert:
        docs = docs.filter(search.possible("text", form))
    cut = docs.select("doc", *carry, form.opened("text").alias("text"))
    cut = cut.select("doc", *carry, "text", once(F.split("text", form.terminator[newlines], -1), whole_ends).alias("parts")).withColumn("n_lines", F.size("parts"))
    long = lambda c: c.cast("long")
    if search.multiline:

        @F.pandas_udf(AROUND)
        def regions(text: pd.Series) -> pd.DataFrame:
            out = []
            for t in text:
                t = form.text(t.encode("latin-1")) if form.binary else t
                found = search.byte_spans(t)
                found = found if most is None else found[:most]
                data = form.raw(t)
                out.append((*around(*lines_of_spans(data, [x[:2] for x in found]), before, after), len(found), data.count(b"\n")))
            return pd.DataFrame(out, columns=["at", "is_match", "group_id", "opens", "found", "line_feeds"])

        cut = cut.withColumn("near", regions("text"))
        n, searched = long(F.col("near.found")), long(F.col("near.line_feeds") + 1)
    else:
        cut = cut.withColumn("places", _line_hits(search, form))
        n, searched = long(F.size("places")), long(F.col("n_lines"))
        if most is not None:
            ends = F.try_element_at("places", F.lit(most)) + 2
            searched = long(F.coalesce(F.least(ends, F.col("n_lines")), F.col("n_lines")))
            cut = cut.withColumn("searched", searched).withColumn("places", F.slice("places", 1, most))
            searched = F.col("searched")
        if before or after or grouped:

            @F.pandas_udf(AROUND)
            def widened(places: pd.Series, n_lines: pd.Series) -> pd.DataFrame:
                found = [(*around(np.asarray(p, np.int64), np.asarray(p, np.int64), k, before, after), 0, 0) for p, k in zip(places, n_lines)]
                return pd.DataFrame(found, columns=["at", "is_match", "group_id", "opens", "found", "line_feeds"])

            cut = cut.withColumn("near", widened("places", "n_lines"))
    if search.multiline or before or after or grouped:
        chosen = F.arrays_zip(F.col("near.at").alias("at"), F.col("near.is_match").alias("is_match"), F.col("near.group_id").alias("group_id"), F.col("near.opens").alias("opens"))
    else:
        chosen = F.transform("places", lambda k: F.struct(k.alias("at"), F.lit(True).alias("is_match"), F.lit(None).cast("long").alias("group_id"), F.lit(True).alias("opens")))
    # what belongs to the whole text is bound once, so that nothing of it is computed for each line
    bound = [F.col("parts").alias("parts"), chosen.alias("chosen"), F.size("parts").alias("n"), F.endswith("text", F.lit("\n")).alias("ended")]
    if newlines != LF:
        bound.append(F.concat(F.regexp_extract_all("text", F.lit(form.terminator[newlines]), 0), F.array(F.lit(""))).alias("ends"))
    if offsets:
        # a line begins behind all before it and their terminators; only the last may have none
        if newlines == LF:
            sizes = F.transform("parts", lambda x: (form.size(x) + 1).cast("long"))
        else:
            ends = F.regexp_extract_all("text", F.lit(form.terminator[newlines]), 0)
            sizes = F.zip_with("parts", ends, lambda x, e: (form.size(x) + F.coalesce(form.size(e), F.lit(0))).cast("long"))
        cut = cut.withColumn("begins", begins(sizes))
        bound.append(F.col("begins").alias("begins"))

    def told(x: Column, c: Column, k: Column) -> Column:
        last = F.when((c["at"] < x["n"] - 1) | x["ended"], F.lit("\n")).otherwise(F.lit("")) if newlines == LF else F.get(x["ends"], c["at"])
        offset = F.get(x["begins"], c["at"]) if offsets else F.lit(None).cast("long")
        gap = (k > 0) & (c["group_id"] > F.get(x["chosen"], k - 1)["group_id"])
        return F.struct((k == 0).alias("first"), F.coalesce(gap, F.lit(False)).alias("gap"), c["at"].alias("at"), c["is_match"].alias("is_match"), c["group_id"].alias("group_id"), c["opens"].alias("opens"), F.get(x["parts"], c["at"]).alias("as_cut"), last.alias("terminator"), offset.alias("byte_offset"))

    shown = once(F.struct(*bound), lambda x: F.transform(x["chosen"], lambda c, k: told(x, c, k)))
    return cut.select("doc", *carry, n.alias("matches"), searched.alias("lines_searched"), shown.alias("shown"), "n_lines")


def shown_lines(found: DataFrame, form: Form = TEXT, carry: tuple[str, ...] = ()) -> DataFrame:
    """The lines of ``document_hits`` as rows: doc, carried columns, line_no, is_match, group_id, byte_offset, as_cut, body, terminator."""
    # an outer one asks nothing of the array before it is made; a document without lines is one row then
    rows = found.select("doc", *carry, F.inline_outer("shown")).filter(F.col("at").isNotNull())
    return rows.select("doc", *carry, (F.col("at") + 1).cast("long").alias("line_no"), "is_match", "group_id", "first", "gap", "opens", "byte_offset", form.closed("as_cut").alias("as_cut"), form.closed(without_cr("as_cut")).alias("body"), form.closed("terminator").alias("terminator"))


def occurrences(text: Column | str, pattern: str, form: Form = TEXT) -> Column:
    """How often a literal is in a text without overlaps; native."""
    text = form.opened(text) if form.binary else F.col(text) if isinstance(text, str) else text
    less = form.size(text) - form.size(F.replace(text, F.lit(form.literal(pattern)), F.lit("")))
    return (less / len(form.raw(pattern))).cast("long")


def count_lines(docs: DataFrame, search: Search, zeros: bool = False, most: int | None = None) -> DataFrame:
    """doc, count of selected lines; under multiline of matches. Documents without any are listed with zeros alone.

    With ``most`` a document counts no further.
    """
    form = form_of(docs)
    if most is not None and most < 1:
        raise ValueError("a cap is at least 1")
    upto = (lambda n: F.least(n, F.lit(most).cast("long"))) if most is not None else (lambda n: n)
    if search.multiline:
        n = F.size(search.spans_udf(form)("text")).cast("long") if search.ignore_case or search.word else occurrences("text", search.pattern, form)
        found = docs.select("doc", upto(n).alias("count"))
        return found if zeros else found.filter("count > 0")
    # counted in the array, without a row for each line
    if not search.ignore_case and not (search.word and form.binary):
        if not search.invert and not zeros:
            docs = docs.filter(search.possible("text", form))
        test = (lambda line: ~search.matches(line, form)) if search.invert else (lambda line: search.matches(line, form))
        found = docs.select("doc", upto(F.size(F.filter(line_array("text", search.newlines, form), test)).cast("long")).alias("count"))
        return found if zeros else found.filter("count > 0")
    n = F.col("matches").alias("count")
    if not zeros:
        return document_hits(docs, search, most=most).select("doc", n).filter("count > 0")
    # those without the literal aren't cut
    some = document_hits(docs, search, most=most).select("doc", n)
    return some if search.invert else some.unionAll(docs.filter(~search.possible("text", form)).select("doc", F.lit(0).cast("long")))


def files(docs: DataFrame, search: Search) -> DataFrame:
    """Documents with a selected line."""
    return count_lines(docs, search).select("doc")


def files_without(docs: DataFrame, search: Search) -> DataFrame:
    """Documents without a selected line."""
    return count_lines(docs, search, zeros=True).filter("count = 0").select("doc")


def exists(docs: DataFrame, search: Search) -> bool:
    """Whether any line is selected; stops at the first."""
    return not hits(docs, search).isEmpty()


def capped(docs: DataFrame, search: Search, most: int) -> DataFrame:
    """The first ``most`` selected lines of each document; the walk ends at the first document that has more to read.

    Documents go in the order of ``doc``. One that reaches the cap before its last line ends the walk.
    """
    form = form_of(docs)
    found = document_hits(docs, search, most=most)
    # one row
    unread = (F.col("matches") >= most) & (F.try_element_at("shown", F.lit(-1))["at"] + 1 < F.col("n_lines"))
    ends = found.filter(unread).agg(F.min("doc").alias("last"))
    found = found.crossJoin(F.broadcast(ends)).filter(F.col("last").isNull() | (F.col("doc") <= F.col("last")))
    return shown_lines(found, form).select("doc", "line_no", "as_cut", "body", "terminator")


def context(docs: DataFrame, search: Search, before: int = 0, after: int = 0) -> DataFrame:
    """Selected lines and those around them: doc, line_no, is_match, group_id (from 1), line.

    A line in two contexts comes once; groups that adjoin are one. A multiline search shows the lines that its matches
    touch. Contexts are merged as intervals of the hits alone, in the document's own row.
    """
    rows = shown_lines(document_hits(docs, search, before, after, grouped=True), form_of(docs))
    return rows.select("doc", "line_no", "is_match", "group_id", F.col("body").alias("line"))


def multiline(docs: DataFrame, search: Search, before: int = 0, after: int = 0) -> DataFrame:
    """Lines that matches over the whole text touch, with context: as ``context``. Lines end at LF."""
    return context(docs, search if search.multiline else replace(search, multiline=True), before, after)


def fields(docs: DataFrame, search: Search, hash_width: int = DEFAULT) -> DataFrame:
    """Selected lines with every field: line_no, column of the first match, byte_offset, line_hash, file_hash, line."""
    found = hits(docs.withColumn("file_hash", content_name("text")), search, offsets=True, carry=("file_hash",))
    first = F.lit(None).cast("long") if search.invert else search.spans_udf(form_of(docs))("as_cut")[0]["column"]
    return found.select("doc", "line_no", first.alias("column"), "byte_offset", content_name(whole(), hash_width).alias("line_hash"), "file_hash", F.col("body").alias("line"))


def summary(docs: DataFrame, search: Search) -> DataFrame:
    """One row: files_searched, files_matched, lines, matches, bytes."""
    form = form_of(docs)
    size = F.octet_length("text").cast("long").alias("size")
    if search.ignore_case or search.word:
        # lines and their matches are told in the tasks that fold or look at the edges
        hit = search.matches("as_cut", form)
        rows = lines(docs, search.newlines).withColumn("hit", ~hit if search.invert else hit)
        times = F.lit(0) if search.invert else F.when(F.col("hit"), F.size(search.spans_udf(form)("as_cut"))).otherwise(0)
        found = rows.withColumn("times", times).groupBy("doc").agg(F.count_if("hit").alias("count"), F.sum("times").alias("times"))
        rows = found.select("doc", "count", "times", F.lit(0).cast("long").alias("size"), F.lit(0).alias("one")).unionAll(docs.select("doc", F.lit(0).cast("long"), F.lit(0).cast("long"), size, F.lit(1)))
    else:
        every = line_array("text", search.newlines, form)
        test = (lambda line: ~search.matches(line, form)) if search.invert else (lambda line: search.matches(line, form))
        times = F.lit(0) if search.invert else F.aggregate(every, F.lit(0).cast("long"), lambda a, line: a + occurrences(line, search.pattern, form))
        rows = docs.select("doc", F.size(F.filter(every, test)).cast("long").alias("count"), times.cast("long").alias("times"), size, F.lit(1).alias("one"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(total("one").alias("files_searched"), F.count_if(F.col("count") > 0).alias("files_matched"), total("count").alias("lines"), total("times").alias("matches"), total("size").alias("bytes"))


def is_binary(content: Column | str) -> Column:
    """A NUL among the first 8 KiB."""
    return F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00")))
