"""What a run did, told by the pass that did it: rows with observed totals, no second scan.

A Run has the rows of an operator and totals that Spark gathers while they are computed. The totals are there once an
action has read all rows; a run that shows nothing (``quiet``) is read by ``finish``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weft.operators import checksum, chunk, segment
from weft.operators import replace as edits
from weft.operators.find import Search, exists
from weft.plans import report as reports
from weft.plans.render import Status
from weft.plans.report import Report


def total(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


@dataclass
class Run:
    rows: DataFrame
    watched: list[Observation] = field(default_factory=list)

    def watch(self, df: DataFrame, **totals: Column) -> DataFrame:
        """df, whose totals belong to this run."""
        seen = Observation()
        self.watched.append(seen)
        return df.observe(seen, *[c.alias(name) for name, c in totals.items()])

    def totals(self) -> dict[str, int]:
        """The totals, once the rows have been read; waits for that."""
        return {k: v for w in self.watched for k, v in w.get.items()}

    def finish(self, action: Callable[[DataFrame], None] | None = None) -> dict[str, float]:
        """Read all rows, by an action (writing them, say) or for nothing else; the totals, seconds, and bytes a second where bytes are counted."""
        began = time.monotonic()
        if action is None:
            self.rows.write.format("noop").mode("overwrite").save()
        else:
            action(self.rows)
        seconds = time.monotonic() - began
        found = self.totals()
        return found | {"seconds": seconds} | ({"bytes_per_second": found["bytes"] / seconds} if "bytes" in found else {})


def searched(docs: DataFrame, search: Search, report: Report) -> Run:
    """A search's report, with files_searched, bytes, files_matched, matches and lines_searched.

    lines_searched counts those of files with a match; under ``quiet`` rows tell nothing and only the totals count.
    """
    run = Run(docs)
    docs = run.watch(docs, files_searched=F.count(F.lit(1)), bytes=total(F.octet_length("text")))

    def watch(found: DataFrame) -> DataFrame:
        some = F.col("matches") > 0
        return run.watch(found, files_matched=F.count_if(some), matches=total("matches"), lines_searched=total(F.when(some, F.col("lines_searched"))))

    if report.quiet or report.show not in (reports.LINES, reports.MATCHES):
        # a count a file is the document's own total of matches
        found = reports.selected(docs, search, report, watch)
        run.rows = found.select("doc", "matches").filter("matches > 0")
    else:
        run.rows = (reports.json_report if report.form == reports.JSON else reports.text_report)(docs, search, report, watch)
    return run


def status(docs: DataFrame, search: Search, report: Report) -> Status:
    """How a quiet search ends: at the first hit, unless totals are asked for."""
    if report.quiet and not report.summary:
        return Status.FOUND if exists(docs, search) else Status.NONE
    return Status.FOUND if searched(docs, search, report).finish()["matches"] else Status.NONE


def replaced(edited: DataFrame) -> Run:
    """The rows of replace.replace, with files, changed, replacements and refusals by reason."""
    run = Run(edited)
    refused = {s: F.count_if(F.col("status") == s) for s in (edits.UNRESOLVED, edits.AMBIGUOUS, edits.STALE)}
    run.rows = run.watch(edited, files=F.count(F.lit(1)), changed=F.count_if(F.col("hash_before") != F.col("hash_after")), replacements=total("replacements"), **refused)
    return run


def digested(docs: DataFrame) -> Run:
    """checksum.digests, with files and bytes; ``finish`` tells the throughput."""
    run = Run(docs)
    run.rows = run.watch(checksum.digests(docs), files=F.count(F.lit(1)), bytes=total("bytes"))
    return run


def segmented(docs: DataFrame, by: str) -> Run:
    """segment.segments, with files, bytes and segments."""
    run = Run(docs)
    docs = run.watch(docs, files=F.count(F.lit(1)), bytes=total(F.octet_length("text")))
    run.rows = run.watch(segment.segments(docs, by), segments=F.count(F.lit(1)))
    return run


def chunked(cut: DataFrame, count: int | None = None) -> Run:
    """chunk.chunks, with chunks, lines and bytes; what a repeated header adds is counted too."""
    run = Run(cut)
    run.rows = run.watch(chunk.chunks(cut, count), chunks=F.count(F.lit(1)), lines=total(F.col("lines") + F.col("header_lines")), bytes=total("bytes"))
    return run


def record_of(spark, run: Run, kind: str = "summary") -> DataFrame:
    """One JSON record of a run's totals; reads its rows."""
    run.finish()
    totals = {k: v for k, v in run.totals().items()}
    row = spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in totals.items()])
    return reports.totals_record(row, kind)
