"""How the results of a search, of rows, columns, outlines, chunks and digests are told: text with prefixes, or JSON records.

A Report says what is shown and how. What can't go together is refused when it is made or first used, never
ignored. Rendering is a projection; ``part`` orders the rows of one line. A document's records, from begin to end, are made
in its own row: a report reads its documents once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.lines import UNICODE, Form, form_of, once, whole
from weft.functions.names import DEFAULT, content_name
from weft.operators.find import Search, count_lines, document_hits, files_without, shown_lines
from weft.plans.render import record, text_field, trimmed

LINES, MATCHES, COUNT, FILES, FILES_WITHOUT = "lines", "matches", "count", "files", "files_without"
TEXT, JSON, VIMGREP = "text", "json", "vimgrep"
NUMBERS, COLUMNS, OFFSETS, LINE_HASHES, FILE_HASH = "line_numbers", "column_numbers", "byte_offset", "line_hashes", "file_hash"
#: Fields in the order in which they stand before a line.
FIELDS = (NUMBERS, COLUMNS, OFFSETS, LINE_HASHES, FILE_HASH)
#: Escape codes of a report in colour.
RED, PLAIN = "\x1b[1;31m", "\x1b[0m"
PATH_COLOUR, GAP_COLOUR = "\x1b[1;35m", "\x1b[36m"
FIELD_COLOURS = {NUMBERS: "\x1b[32m", COLUMNS: "\x1b[32m", OFFSETS: "\x1b[36m", LINE_HASHES: "\x1b[33m", FILE_HASH: "\x1b[33m"}


@dataclass(frozen=True)
class Report:
    """What a search shows of each document, in which form, with which fields before a line."""

    show: str = LINES
    form: str = TEXT
    fields: tuple[str, ...] = ()
    paths: bool = True
    heading: bool = False
    before: int = 0
    after: int = 0
    trim: int | None = None
    hash_width: int | None = None
    colour: bool = False
    most: int | None = None
    quiet: bool = False
    summary: bool = False

    def __post_init__(self) -> None:
        for value, known, what in ((self.show, (LINES, MATCHES, COUNT, FILES, FILES_WITHOUT), "show"), (self.form, (TEXT, JSON, VIMGREP), "form")):
            if value not in known:
                raise ValueError(f"{what} is one of {known}, not {value!r}")
        if unknown := set(self.fields) - set(FIELDS):
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if min(self.before, self.after) < 0 or (self.most is not None and self.most < 1) or (self.trim is not None and self.trim < 1):
            raise ValueError("context isn't negative; caps and widths are at least 1")
        has = {"fields": bool(self.fields), "heading": self.heading, "trim": self.trim is not None, "context": bool(self.before or self.after), "colour": self.colour}
        refused = {
            "one record a document has no line": (self.show in (COUNT, FILES, FILES_WITHOUT), ("fields", "heading", "trim", "context", "colour")),
            "a JSON record has whole lines and names its document": (self.form == JSON, ("heading", "trim", "colour")),
            "vimgrep has its own four columns": (self.form == VIMGREP, ("fields", "heading", "colour")),
        }
        for why, (applies, which) in refused.items():
            if applies and (bad := [x for x in which if has[x]]):
                raise ValueError(f"{why}, so {', '.join(bad)} can't be asked for")
        if self.form == JSON and set(self.fields) & {NUMBERS, COLUMNS, OFFSETS}:
            raise ValueError("JSON records have numbers, columns and offsets anyway")
        if FILE_HASH in self.fields and not (self.form == JSON or self.heading):
            raise ValueError("a file's hash needs a place that names the file once: JSON or a heading")
        if self.hash_width is not None and LINE_HASHES not in self.fields:
            raise ValueError("a hash width without line hashes does nothing")
        if self.quiet and self.most is not None and not self.summary:
            raise ValueError("a quiet search ends at the first hit, so a cap does nothing")
        if self.quiet and (bad := [x for x in has if has[x]]):
            raise ValueError(f"a quiet search shows nothing, so {', '.join(bad)} can't be asked for")

    def check(self, search: Search) -> None:
        """What the search itself excludes."""
        if search.invert and self.show == MATCHES:
            raise ValueError("an inverted search has no matches to show")
        if search.multiline and COLUMNS in self.fields:
            raise ValueError("a match over several lines has no column in one")


def selected(docs: DataFrame, search: Search, report: Report, watch: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """Documents with a hit and the lines that are shown of each (find.document_hits), with file_hash and bytes.

    All lines of a multiline search's regions are told as matches; ``most`` counts matches then.
    """
    docs = docs.withColumn("file_hash", content_name("text")).withColumn("bytes", F.octet_length("text").cast("long"))
    found = document_hits(docs, search, report.before, report.after, report.most, offsets=True, carry=("file_hash", "bytes"))
    if search.multiline:
        shown = F.transform("shown", lambda s: s.withField("is_match", F.lit(True)))
        found = found.withColumn("shown", shown)
    return watch(found)


def _in(colour: str, text: Column, report: Report) -> Column:
    return F.concat(F.lit(colour), text, F.lit(PLAIN)) if report.colour else text


def _prefix(report: Report, column: Column, first: Column) -> list[Column]:
    sep = F.when(F.col("is_match"), ":").otherwise("-")
    parts = {NUMBERS: F.col("line_no").cast("string"), COLUMNS: column.cast("string"), OFFSETS: F.col("byte_offset").cast("string"), LINE_HASHES: content_name(whole(), report.hash_width or DEFAULT)}
    path = F.concat(_in(PATH_COLOUR, F.col("doc").cast("string"), report), sep)
    out = [F.when(first, path).otherwise("")] if report.paths and not report.heading else []
    for name in FIELDS:
        if name in report.fields and name in parts:
            told = _in(FIELD_COLOURS[name], parts[name], report)
            # a context line has no match to point at
            out += [F.when(F.col("is_match"), F.concat(told, sep)).otherwise("")] if name == COLUMNS else [told, sep]
    return out


def text_report(docs: DataFrame, search: Search, report: Report, watch: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """doc, line_no, part, text: lines behind path, number, column, offset and hash; the text of a match or a line.

    Where context is asked for, -- stands before each group of lines but a document's first, as part -1 of the group's
    first line. A multiline search without fields names the path once a region. Text of bytes is binary.
    """
    report.check(search)
    if report.show in (COUNT, FILES, FILES_WITHOUT):
        return _per_file(docs, search, report)
    form = form_of(docs)
    found = selected(docs, search, report, watch)
    rows = shown_lines(found, form, ("file_hash",))
    spans = search.no_spans(form) if search.invert or search.multiline else F.when(F.col("is_match"), search.spans_udf(form)("as_cut")).otherwise(search.no_spans(form))
    rows = rows.withColumn("spans", spans)
    column = F.coalesce(F.try_element_at("spans", F.lit(1))["column"], F.lit(1).cast("long"))
    part = F.lit(0)
    if report.show == MATCHES and not search.multiline:
        rows = rows.filter("is_match").select("*", F.posexplode("spans").alias("at", "m"))
        column, part = F.col("m.column"), F.col("at")
        shown = F.concat(form.lit(RED), F.col("m.match"), form.lit(PLAIN)) if report.colour else F.col("m.match")
        if report.trim is not None:
            shown = _trimmed(shown, report.trim, search, form)
    else:
        shown = _body(report, search, form)
    first = F.col("opens") if search.multiline and not report.fields else F.lit(True)
    lead = [x.cast("binary") if form.binary else x for x in _prefix(report, column, first)]
    own = lambda line_no, part, text: F.struct(line_no.cast("long").alias("line_no"), part.cast("int").alias("part"), (text.cast("binary") if form.binary else text).alias("text"))
    told = [own(F.col("line_no"), part, F.concat(*lead, shown))]
    if report.before or report.after:
        told.insert(0, F.when(F.col("gap") & (part == 0), own(F.col("line_no"), F.lit(-1), _in(GAP_COLOUR, F.lit("--"), report))))
    if report.heading:
        name = _in(PATH_COLOUR, F.col("doc").cast("string"), report)
        if FILE_HASH in report.fields:
            name = F.concat(name, F.lit("  "), _in(FIELD_COLOURS[FILE_HASH], F.col("file_hash"), report))
        told.insert(0, F.when(F.col("first") & (part == 0), own(F.lit(0), F.lit(0), name)))
    if len(told) == 1:
        return rows.select("doc", told[0].alias("t")).select("doc", "t.*")
    return rows.select("doc", F.inline_outer(F.array_compact(F.array(*told))))


def _trimmed(line: Column, most: int, search: Search, form: Form) -> Column:
    if form.binary:
        return F.when(F.octet_length(line) > most, F.concat(F.substring(line, 1, most), form.lit(" [...]"))).otherwise(line)
    return trimmed(line, most, search.newlines == UNICODE)


def _body(report: Report, search: Search, form: Form) -> Column:
    """A line as it is shown: cut to the width asked for, its matches in colour; codes spend none of the width."""
    body, mark = F.col("body"), form.lit("")
    if report.trim is not None:
        cut = _trimmed(body, report.trim, search, form)
        was_cut = F.octet_length(body) > F.octet_length(cut) - 6
        was_cut = was_cut & (cut != body)
        size = F.octet_length(cut) - 6
        body = F.when(was_cut, F.substring(cut.cast("binary"), F.lit(1), size).cast(form.type)).otherwise(body)
        mark = F.when(was_cut, form.lit(" [...]")).otherwise(form.lit(""))
    if not report.colour:
        return F.concat(body, mark)
    size = F.octet_length(body).cast("long")
    inside = F.transform(F.filter("spans", lambda s: s["start"] < size), lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], size).alias("end")))
    return F.concat(coloured_spans(body, inside, form), mark)


def coloured_spans(line: Column, spans: Column, form: Form | None = None) -> Column:
    """A line with the bytes of its spans in bold red, whatever their case."""
    form = form or Form()
    raw = line.cast("binary")
    cut = lambda a, b: F.substring(raw, a + 1, b - a)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("text"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["text"], cut(acc["at"].cast("int"), s["start"].cast("int")), F.lit(RED.encode()), cut(s["start"].cast("int"), s["end"].cast("int")), F.lit(PLAIN.encode())).alias("text"))
    done = F.aggregate(spans, start, step)
    return F.concat(done["text"], cut(done["at"].cast("int"), F.octet_length(line))).cast(form.type)


def _per_file(docs: DataFrame, search: Search, report: Report) -> DataFrame:
    own = lambda rows, *text: rows.select("doc", F.lit(0).cast("long").alias("line_no"), F.lit(0).alias("part"), F.concat(*text).alias("text"))
    path = _in(PATH_COLOUR, F.col("doc").cast("string"), report)
    if report.show == COUNT:
        return own(count_lines(docs, search, most=report.most), *([path, F.lit(":")] if report.paths else []), F.col("count").cast("string"))
    found = files_without(docs, search) if report.show == FILES_WITHOUT else count_lines(docs, search)
    return own(found, path)


def _path() -> Column:
    return F.struct(F.col("doc").cast("string").alias("text")).alias("path")


def json_report(docs: DataFrame, search: Search, report: Report, watch: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """doc, phase, line_no, record: begin, match and context records by line, end; or one count or file record.

    Lines, and matches in them, are {"text": …}, or {"bytes": base64} where they are no UTF-8. An end tells the document's matches
    and how many of its lines the walk had looked at when it ended.
    """
    report.check(search)
    if report.show in (FILES, FILES_WITHOUT):
        found = files_without(docs, search) if report.show == FILES_WITHOUT else count_lines(docs, search)
        return found.select("doc", F.lit(0).alias("phase"), F.lit(0).cast("long").alias("line_no"), record("file", _path()).alias("record"))
    if report.show == COUNT:
        return count_lines(docs, search, most=report.most).select("doc", F.lit(0).alias("phase"), F.lit(0).cast("long").alias("line_no"), record("count", _path(), "count").alias("record"))
    form = form_of(docs)
    found = selected(docs, search, report, watch)
    # the first and the last record stand around a document's lines in one array
    kind = found.schema["shown"].dataType.elementType
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    phased = lambda k, s: F.struct(F.lit(k).alias("phase"), s.alias("s"))
    around = lambda lines: F.when(F.size(lines) > 0, F.concat(F.array(phased(0, empty)), F.transform(lines, lambda s: phased(1, s)), F.array(phased(2, empty))))
    rows = found.select("doc", "file_hash", "matches", "lines_searched", F.inline_outer(once(F.col("shown"), around))).filter(F.col("phase").isNotNull())
    rows = rows.select("doc", "file_hash", "matches", "lines_searched", "phase", "s.*")
    rows = rows.select("doc", "file_hash", "matches", "lines_searched", "phase", "is_match", "byte_offset", F.coalesce(F.col("at") + 1, F.lit(0)).cast("long").alias("line_no"), form.closed("as_cut").alias("as_cut"), form.closed("terminator").alias("terminator"))
    shows = F.col("is_match") & ~F.lit(search.invert or search.multiline)
    spans = F.when(shows, search.spans_udf(form)("as_cut")).otherwise(search.no_spans(form)) if not (search.invert or search.multiline) else search.no_spans(form)
    rows = rows.withColumn("spans", spans)
    subs = F.transform("spans", lambda s: F.struct(text_field(s["match"]).alias("match"), s["start"].alias("start"), s["end"].alias("end")))
    names = [content_name(whole(), report.hash_width or DEFAULT).alias("line_hash")] if LINE_HASHES in report.fields else []
    own = [_path(), text_field("as_cut").alias("lines"), F.col("line_no").alias("line_number"), F.col("byte_offset").alias("absolute_offset"), *names]
    stats = F.struct("matches", "lines_searched").alias("stats")
    told = F.when(F.col("phase") == 0, record("begin", _path())).when(F.col("phase") == 2, record("end", _path(), *(["file_hash"] if FILE_HASH in report.fields else []), stats))
    told = told.when(F.col("is_match"), record("match", *own, subs.alias("submatches"))).otherwise(record("context", *own))
    return rows.select("doc", "phase", F.when(F.col("phase") == 1, F.col("line_no")).otherwise(F.lit(0)).cast("long").alias("line_no"), told.alias("record"))


# records of the other operators


def row_records(found: DataFrame) -> DataFrame:
    """doc, line_no, record of rows (rows.select_rows): the line with its number and name."""
    return found.select("doc", "line_no", record("row", _path(), F.col("line_no").alias("line_number"), "line_hash", F.col("line").alias("text")).alias("record"))


def row_names(docs: DataFrame) -> DataFrame:
    """doc, text: the header of a document's rows, its path and name."""
    return docs.select("doc", F.concat(F.col("doc").cast("string"), F.lit("  "), content_name("text")).alias("text"))


def column_records(found: DataFrame) -> DataFrame:
    """doc, line_no, record of columns (cols.columns)."""
    return found.select("doc", "line_no", record("columns", _path(), F.col("line_no").alias("line_number"), "columns").alias("record"))


def distinct_records(found: DataFrame) -> DataFrame:
    """doc, line_no, record of distinct lines (distinct.dedup): where a line was first, how often it is there."""
    return found.select("doc", "line_no", record("line", _path(), F.col("line_no").alias("line_number"), F.col("line").alias("text"), "times").alias("record"))


def outline_records(found: DataFrame) -> DataFrame:
    """doc, byte_offset, record of elements (outline.outline), flat, each with the line of its parent."""
    own = [c for c in found.columns if c != "doc"]
    return found.select("doc", "byte_offset", record("element", _path(), *own).alias("record"))


def outline_text(found: DataFrame) -> DataFrame:
    """doc, line_number, text: elements indented by level, kinds as wide as the longest of the document."""
    wide = F.max(F.char_length("kind")).over(Window.partitionBy("doc"))
    lead = F.concat(F.rpad(F.col("kind"), wide, F.lit(" ")), F.lit("  "), F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.coalesce("text", F.lit("")))
    return found.select("doc", "line_number", F.concat(F.col("line_number").cast("string"), F.lit(":"), F.rtrim(lead)).alias("text"))


def chunk_manifest(found: DataFrame, suffix: Column, prefix: str = "x", form: str = "paths") -> DataFrame:
    """doc, chunk, text of chunks (chunk.chunks): the file of each, or a JSON record of what is in it."""
    if form not in ("paths", "json"):
        raise ValueError("a manifest is of paths or json")
    name = F.concat(F.lit(prefix), suffix)
    told = name if form == "paths" else record("chunk", name.alias("path"), "lines", "bytes", "header_lines")
    return found.select("doc", "chunk", told.alias("text"))


def digest_records(found: DataFrame) -> DataFrame:
    """path, record of digests (path, digest, bytes)."""
    return found.select("path", record("digest", "path", "digest", "bytes").alias("record"))


def totals_record(total: DataFrame, kind: str) -> DataFrame:
    """One record of a one-row table of totals."""
    return total.select(record(kind, *total.columns).alias("record"))


def count_tree(counts: DataFrame, separator: str = "/") -> DataFrame:
    """path, depth, text of counts (doc: paths): every folder with the totals below it, every file, in aligned columns.

    The widths are those of the whole table; a table of one number and one path is that number alone.
    """
    have = [c for c in counts.columns if c != "doc"]
    parts = F.split(F.col("doc").cast("string"), F.lit(separator))
    ends = F.sequence(F.lit(1), F.size("parts"))
    upto = F.transform(ends, lambda k: F.struct(F.array_join(F.slice("parts", F.lit(1), k), separator).alias("path"), (k - 1).alias("depth"), (k < F.size("parts")).alias("folder")))
    every = counts.withColumn("parts", parts).select(*have, F.inline(upto))
    total = [(F.max if c == "max_line_length" else F.sum)(c).alias(c) for c in have]
    rows = every.groupBy("path", "depth", "folder").agg(*total)
    # one row, of one width a column
    widths = rows.agg(*[F.max(F.char_length(F.format_number(c, 0))).alias(f"w_{c}") for c in have], F.count("*").alias("n_rows"))
    rows = rows.crossJoin(F.broadcast(widths))
    cells = [F.lpad(F.format_number(c, 0), F.col(f"w_{c}"), F.lit(" ")) for c in have]
    label = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.element_at(F.split("path", F.lit(separator)), -1), F.when(F.col("folder"), separator).otherwise(""))
    text = F.concat_ws("  ", *cells, label)
    if len(have) == 1:
        text = F.when(F.col("n_rows") == 1, F.col(have[0]).cast("string")).otherwise(text)
    return rows.select("path", "depth", text.alias("text"))
