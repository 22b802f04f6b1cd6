"""Totals that come from the pass that makes the rows."""

from weft.operators import chunk, replace
from weft.operators.find import Search
from weft.plans import summaries
from weft.plans.render import Status
from weft.plans.report import Report

TEXTS = ("a k\nb\nk k\n", "none\n", "k")


def test_a_search_tells_its_totals(frame):
    docs = frame(*TEXTS)
    for kw in (dict(form="json"), dict(before=1, heading=True), dict(show="count"), dict(quiet=True, summary=True)):
        run = summaries.searched(docs, Search("k"), Report(**kw))
        found = run.finish()
        assert {k: found[k] for k in ("files_searched", "bytes", "files_matched", "matches", "lines_searched")} == {"files_searched": 3, "bytes": 16, "files_matched": 2, "matches": 3, "lines_searched": 4}
        assert found["bytes_per_second"] > 0
    capped = summaries.searched(docs, Search("k"), Report(most=1)).finish()
    assert (capped["matches"], capped["lines_searched"]) == (2, 3)
    kept = []
    run = summaries.searched(docs, Search("k"), Report())
    run.finish(lambda rows: kept.extend(rows.collect()))
    assert len(kept) == 3 and run.totals()["matches"] == 3


def test_totals_need_no_second_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a k\nb\n")], "doc bigint, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for run in (summaries.searched(docs, Search("k"), Report(form="json")), summaries.searched(docs, Search("k"), Report(before=1, heading=True)), summaries.digested(docs), summaries.segmented(docs, "words")):
        assert run.rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_status(frame):
    docs = frame(*TEXTS)
    assert summaries.status(docs, Search("k"), Report(quiet=True)) == Status.FOUND
    assert summaries.status(docs, Search("z"), Report(quiet=True)) == Status.NONE
    assert summaries.status(docs, Search("z"), Report(quiet=True, summary=True)) == Status.NONE


def test_other_tools(frame, spark):
    docs = frame(*TEXTS)
    found = summaries.replaced(replace.replace(docs, "k", "xy")).finish()
    assert {k: found[k] for k in ("files", "changed", "replacements", "unresolved", "stale")} == {"files": 3, "changed": 2, "replacements": 4, "unresolved": 1, "stale": 0}
    found = summaries.digested(docs).finish()
    assert (found["files"], found["bytes"]) == (3, 16) and found["bytes_per_second"] > 0
    found = summaries.segmented(docs, "whitespace").finish()
    assert (found["files"], found["bytes"], found["segments"]) == (3, 16, 7)
    found = summaries.chunked(chunk.by_lines(docs, 2)).finish()
    assert (found["chunks"], found["lines"], found["bytes"]) == (4, 5, 16)
    assert summaries.record_of(spark, summaries.digested(docs)).first()["record"] == '{"type":"summary","data":{"files":3,"bytes":16}}'
    none = summaries.searched(frame("x").limit(0), Search("k"), Report()).finish()
    assert none["matches"] == 0 and none["files_searched"] == 0
