"""Reports of regions, context, caps, colours and bytes, and plans of searches inside a document."""

import base64
import json
import random
import time

import numpy as np
import pytest

from weft.functions.intervals import around, lines_of_spans
from weft.operators import find
from weft.operators.find import Search
from weft.plans import report
from weft.plans.report import Report


def told(docs, search, **kw):
    return [(r.text if isinstance(r.text, str) else bytes(r.text)) for r in report.text_report(docs, search, Report(**kw)).orderBy("doc", "line_no", "part").collect()]


def records(docs, search, **kw):
    return [json.loads(r.record) for r in report.json_report(docs, search, Report(form="json", **kw)).orderBy("doc", "phase", "line_no").collect()]


def test_around_is_the_union_of_widened_intervals():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 30)
        first = sorted(rng.randint(0, n - 1) for _ in range(rng.randint(0, 6)))
        last = np.maximum.accumulate([min(n - 1, f + rng.randint(0, 3)) for f in first]).tolist()
        before, after = rng.randint(0, 3), rng.randint(0, 3)
        places, inside, group, opens = around(np.array(first, np.int64), np.array(last, np.int64), n, before, after)
        near = sorted({k for a, b in zip(first, last) for k in range(max(0, a - before), min(n, b + after + 1))})
        assert places.tolist() == near
        assert inside.tolist() == [any(a <= k <= b for a, b in zip(first, last)) for k in near]
        assert group.tolist() == np.cumsum([k - 1 not in near for k in near]).tolist() if near else True
        shown, starts = -1, []
        for a, b in zip(first, last):
            a, b = max(shown + 1, a - before, 0), min(n - 1, b + after)
            if a <= b:
                starts.append(a)
                shown = b
        assert places[opens].tolist() == starts


def test_lines_of_spans():
    data = b"alpha\nbeta\n\ngamma"
    first, last, n = lines_of_spans(data, [(0, 5), (4, 8), (0, 6), (10, 12), (12, 17), (17, 17)])
    assert n == 4 and list(zip(first.tolist(), last.tolist())) == [(0, 0), (0, 1), (0, 1), (1, 3), (3, 3), (3, 3)]
    assert lines_of_spans(b"a\n", [(0, 2)])[1].tolist() == [0] and lines_of_spans(b"", [])[2] == 0


REGIONS = "zero\nalpha\nbeta\none\n\ntwo\nalpha\nbeta\nalpha\nbeta"
ACROSS = Search("alpha\nbeta", multiline=True)


def test_multiline_regions_in_text(frame):
    docs = frame(REGIONS, "nothing")
    assert told(docs, ACROSS) == ["0:alpha", "beta", "0:alpha", "beta", "0:alpha", "beta"]
    assert told(docs, ACROSS, fields=("line_numbers", "byte_offset")) == ["0:2:5:alpha", "0:3:11:beta", "0:7:25:alpha", "0:8:31:beta", "0:9:36:alpha", "0:10:42:beta"]
    assert told(docs, ACROSS, paths=False, before=1) == ["zero", "alpha", "beta", "--", "two", "alpha", "beta", "alpha", "beta"]
    assert told(docs, ACROSS, paths=False, after=1, most=1) == ["alpha", "beta", "one"]
    assert told(docs, ACROSS, show="count") == ["0:3"] and told(docs, ACROSS, show="count", most=2) == ["0:2"]
    # a match that ends behind a line reaches the next
    assert told(frame("a\nb\nc\n"), Search("a\n", multiline=True), paths=False) == ["a", "b"]


def test_multiline_regions_in_json(frame):
    got = records(frame(REGIONS), ACROSS, fields=("file_hash",))
    assert [r["type"] for r in got] == ["begin"] + ["match"] * 6 + ["end"]
    assert [(r["data"]["line_number"], r["data"]["absolute_offset"], r["data"]["lines"]["text"], r["data"]["submatches"]) for r in got[1:3]] == [(2, 5, "alpha", []), (3, 11, "beta", [])]
    assert got[-1]["data"]["stats"] == {"matches": 3, "lines_searched": 10} and len(got[-1]["data"]["file_hash"]) == 13


def test_caps_end_the_walk_through_a_document(frame):
    docs = frame("k\nx\nk\ny\nk\nz\n", "k\n", "x\n")
    assert [r["data"]["stats"] for r in records(docs, Search("k"), most=2) if r["type"] == "end"] == [{"matches": 2, "lines_searched": 4}, {"matches": 1, "lines_searched": 1}]
    assert [r["data"]["stats"] for r in records(docs, Search("k")) if r["type"] == "end"] == [{"matches": 3, "lines_searched": 6}, {"matches": 1, "lines_searched": 1}]
    assert told(docs, Search("k"), show="count", most=2) == ["0:2", "1:1"]
    assert [(r["data"]["path"]["text"], r["data"]["count"]) for r in records(docs, Search("k"), show="count", most=1)] == [("0", 1), ("1", 1)]
    assert told(docs, Search("k"), most=1, after=1, paths=False) == ["k", "x", "k"]


def test_context_records_and_groups(frame):
    docs = frame("a\nb k\nc\nd\ne k k\nf\n")
    got = records(docs, Search("k"), before=1)
    assert [(r["type"], r["data"].get("line_number")) for r in got] == [("begin", None), ("context", 1), ("match", 2), ("context", 4), ("match", 5), ("end", None)]
    assert "submatches" not in got[1]["data"] and [(m["start"], m["end"]) for m in got[4]["data"]["submatches"]] == [(2, 3), (4, 5)]
    assert told(docs, Search("k"), before=1, fields=("line_numbers",)) == ["0-1-a", "0:2:b k", "--", "0-4-d", "0:5:e k k"]
    assert told(docs, Search("k"), before=1, after=1, paths=False) == ["a", "b k", "c", "d", "e k k", "f"]


def test_colours_of_every_part(frame):
    docs = frame("x\nxx key yy key\n\n\nkey\n")
    path, number, gap = "\x1b[1;35m0\x1b[0m", "\x1b[32m{}\x1b[0m", "\x1b[36m--\x1b[0m"
    red = "\x1b[1;31mkey\x1b[0m"
    assert told(docs, Search("key"), colour=True, fields=("line_numbers",), before=1) == [f"{path}-{number.format(1)}-x", f"{path}:{number.format(2)}:xx {red} yy {red}", gap, f"{path}-{number.format(4)}-", f"{path}:{number.format(5)}:{red}"]
    # codes spend none of the width, and a match that is cut keeps its colour's end
    assert told(docs, Search("key"), colour=True, paths=False, trim=5)[0] == "xx \x1b[1;31mke\x1b[0m [...]"
    assert told(docs, Search("key"), colour=True, paths=False, trim=99)[0] == f"xx {red} yy {red}"
    assert told(docs, Search("key"), colour=True, show="matches", paths=False) == [red] * 3
    assert told(docs, Search("key"), colour=True, heading=True, fields=("file_hash",))[0].startswith(f"{path}  \x1b[33m")


def test_bytes_in_reports(spark):
    docs = spark.createDataFrame([(0, b"a\xffkey\nok key\n")], "doc bigint, text binary")
    got = records(docs, Search("key"))
    assert base64.b64decode(got[1]["data"]["lines"]["bytes"]) == b"a\xffkey" and got[1]["data"]["submatches"][0]["match"] == {"text": "key"}
    assert got[2]["data"]["lines"] == {"text": "ok key"} and got[2]["data"]["absolute_offset"] == 6
    long = spark.createDataFrame([(0, b"\xffkey" * 40)], "doc bigint, text binary")
    assert base64.b64decode(records(long, Search("key"))[1]["data"]["lines"]["bytes"]) == b"\xffkey" * 40
    assert told(docs, Search("key"), fields=("line_numbers",)) == [b"0:1:a\xffkey", b"0:2:ok key"]
    assert told(docs, Search("key"), colour=True, paths=False)[0] == b"a\xff\x1b[1;31mkey\x1b[0m"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_searches_inside_documents_shuffle_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "a k\nb\n")], "doc bigint, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for df in (
        find.context(docs, Search("k")), find.context(docs, Search("k"), 1, 1), find.context(docs, Search("K", ignore_case=True), 0, 2), find.multiline(docs, Search("k\nb", multiline=True), 1), report.json_report(docs, Search("k"), Report(form="json", before=2, most=3, fields=("file_hash",))),
        report.text_report(docs, Search("k"), Report(most=2)), report.json_report(docs, Search("k\nb", multiline=True), Report(form="json")),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_regions_and_context_take_time_in_proportion(spark):
    def seconds(n, run):
        docs = spark.createDataFrame([(1, "some words of a line\nand more\n" * n)], "doc bigint, text string").repartition(1).cache()
        docs.count()
        began = time.perf_counter()
        assert run(docs).count() == 2 * n
        took = time.perf_counter() - began
        docs.unpersist()
        return took

    for run in (lambda d: find.multiline(d, Search("line\nand", multiline=True)), lambda d: find.context(d, Search("words"), 0, 1)):
        seconds(500, run)
        small, large = seconds(25_000, run), seconds(200_000, run)
        assert large < 30 and large < 16 * max(small, 0.5)


@pytest.mark.parametrize("bad", [dict(quiet=True, heading=True), dict(quiet=True, fields=("line_numbers",)), dict(quiet=True, before=1)])
def test_quiet_reports_refuse_what_they_would_not_show(bad):
    with pytest.raises(ValueError):
        Report(**bad)
