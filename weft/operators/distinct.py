"""Distinct lines and sorted lines over all documents, with the order of the input carried as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.folding import fold
from weft.functions.lines import LF, UNICODE, form_of, line_array, lines, once, without_cr


def _keyed(docs: DataFrame, ignore_case: bool, newlines: str | None) -> DataFrame:
    rows = lines(docs, newlines or (UNICODE if ignore_case else LF))
    return rows.withColumn("key", fold("body", form_of(docs)) if ignore_case else F.col("body"))


def dedup(docs: DataFrame, ignore_case: bool = False, newlines: str | None = None) -> DataFrame:
    """The first of equal lines, by document and line: doc, line_no, line, terminator, times.

    An aggregate with a partial one in each task, so a very common line is one row for each task.
    """
    rows = _keyed(docs, ignore_case, newlines)
    first = F.min(F.struct("doc", "line_no", "body", "terminator")).alias("first")
    found = rows.groupBy("key").agg(first, F.count("*").alias("times"))
    return found.select("first.doc", "first.line_no", F.col("first.body").alias("line"), "first.terminator", "times")


def written(docs: DataFrame, terminator: str | None = "\n", ignore_case: bool = False, newlines: str | None = None) -> DataFrame:
    """doc, line_no, text of the first of equal lines as they are written: with this terminator, LF or NUL, whatever they had.

    None writes a line as it was found, its own terminator and a CR before it included, as an edit in place has to.
    """
    if terminator not in ("\n", "\0", None):
        raise ValueError("a written line ends with LF, NUL or as it did")
    form = form_of(docs)
    rows = _keyed(docs, ignore_case, newlines).groupBy("key").agg(F.min(F.struct("doc", "line_no", "as_cut", "body", "terminator")).alias("first"))
    text = F.concat("first.as_cut", "first.terminator") if terminator is None else F.concat(F.col("first.body"), form.lit(terminator))
    return rows.select("first.doc", "first.line_no", text.alias("text"))


def dedup_totals(docs: DataFrame, ignore_case: bool = False) -> DataFrame:
    """One row: unique, total."""
    return dedup(docs, ignore_case).agg(F.count("*").alias("unique"), F.coalesce(F.sum("times"), F.lit(0)).alias("total"))


def sort_order(ignore_case: bool = False, reverse: bool = False) -> list[Column]:
    """Order of lines by code points, equal keys in the order of the input either way."""
    return [F.col("key").desc() if reverse else F.col("key").asc(), F.col("doc").asc(), F.col("line_no").asc()]


def sort(docs: DataFrame, reverse: bool = False, unique: bool = False, ignore_case: bool = False, newlines: str | None = None) -> DataFrame:
    """All lines in order: doc, line_no, line. ``unique`` keeps the first of equal keys."""
    rows = _keyed(docs, ignore_case, newlines)
    if unique:
        rows = rows.groupBy("key").agg(F.min(F.struct("doc", "line_no", "body")).alias("first")).select("key", "first.*")
    return rows.orderBy(*sort_order(ignore_case, reverse)).select("doc", "line_no", F.col("body").alias("line"))


def sort_totals(docs: DataFrame, unique: bool = False, ignore_case: bool = False) -> DataFrame:
    """One row: written, total. Only a unique sort writes fewer lines than there are."""
    if unique:
        return dedup_totals(docs, ignore_case).select(F.col("unique").alias("written"), "total")
    rows = _keyed(docs, ignore_case, None)
    return rows.agg(F.count("*").alias("written"), F.count("*").alias("total"))


def _keys(docs: DataFrame, ignore_case: bool) -> DataFrame:
    """doc and the array of its lines' keys."""
    form = form_of(docs)
    newlines = UNICODE if ignore_case else LF
    text = fold("text", form) if ignore_case else F.col("text")
    # folding changes no terminator, so a text is folded whole
    return docs.select("doc", text.alias("text")).select("doc", F.transform(line_array("text", newlines, form), lambda x: without_cr(x, form)).alias("keys"))


def _wrong(last: Column, now: Column, reverse: bool, unique: bool) -> Column:
    wrong = (now > last) if reverse else (now < last)
    return wrong | (now == last) if unique else wrong


def _disorder(keys: Column, reverse: bool, unique: bool) -> Column:
    """The number of the first line that is out of order among its document's; null if none is."""

    def found(k: Column) -> Column:
        pairs = F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1), lambda a, b: _wrong(a, b, reverse, unique))
        at = F.when(F.size(k) > 1, F.array_position(pairs, F.lit(True)))
        return F.when(at > 0, at + 1).cast("long")

    return once(keys, found)


def first_disorder(docs: DataFrame, reverse: bool = False, unique: bool = False, ignore_case: bool = False) -> DataFrame:
    """doc and the first line_no that is out of order in it; documents in order have none. Told in a document's own row."""
    rows = _keys(docs, ignore_case).select("doc", _disorder(F.col("keys"), reverse, unique).alias("line_no"))
    return rows.filter("line_no is not null")


def disorder(docs: DataFrame, reverse: bool = False, unique: bool = False, ignore_case: bool = False) -> DataFrame:
    """At most one row, doc and line_no: the first line of all documents, one after another by ``doc``, that is out of order.

    A document is its first key, its last and its own first disorder; these are dealt in ranges of ``doc`` and each range is folded to
    the same, so that a row for each range is left to be compared. Documents without lines are skipped.
    """
    form = form_of(docs)
    rows = _keys(docs, ignore_case).filter(F.size("keys") > 0)
    ends = rows.select("doc", F.get("keys", F.lit(0)).alias("head"), F.element_at("keys", -1).alias("last"), _disorder(F.col("keys"), reverse, unique).alias("line_no"))
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        head = last = first_doc = bad = None
        for batch in batches:
            for doc, h, z, n in zip(*(batch.column(c).to_pylist() for c in ("doc", "head", "last", "line_no"))):
                if first_doc is None:
                    head, first_doc = h, doc
                elif bad is None:
                    a, b = form.raw(form.text(last)), form.raw(form.text(h))
                    if (b > a if reverse else b < a) or (unique and a == b):
                        bad = (doc, 1)
                if bad is None and n is not None:
                    bad = (doc, n)
                last = z
        if first_doc is not None:
            import pyarrow as pa

            bad_doc, bad_line = bad or (None, None)
            columns = {"first_doc": first_doc, "head": head, "last": last, "bad_doc": bad_doc, "bad_line": bad_line}
            types = {"first_doc": doc_type(batch), "head": batch.column("head").type, "last": batch.column("last").type, "bad_doc": doc_type(batch), "bad_line": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([v], types[k]) for k, v in columns.items()], list(columns))

    def doc_type(batch):
        return batch.column("doc").type

    ranges = ends.repartitionByRange("doc").sortWithinPartitions("doc").mapInArrow(run, f"first_doc {kind}, head {form.type}, last {form.type}, bad_doc {kind}, bad_line bigint")
    # a row for each range
    before = F.lag("last").over(Window.orderBy("first_doc"))
    seam = _wrong(before, F.col("head"), reverse, unique)
    told = ranges.withColumn("seam", F.coalesce(seam, F.lit(False)))
    told = told.select(F.when(F.col("seam"), F.col("first_doc")).otherwise(F.col("bad_doc")).alias("doc"), F.when(F.col("seam"), F.lit(1)).otherwise(F.col("bad_line")).cast("long").alias("line_no"), "first_doc")
    return told.filter("doc is not null").orderBy("first_doc").limit(1).select("doc", "line_no")
