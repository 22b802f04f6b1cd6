"""Line operators over texts that needn't be UTF-8, against the same done with Python's bytes."""

import random
import re

import pytest

from weft.functions.lines import UNICODE, lines
from weft.functions.names import content_name
from weft.operators import chunk, cols, count, distinct, find, replace, rows
from weft.operators.find import Search
from weft.sources import files

ODD = [b"a\xffb\nsecond\n", b"", b"\xfe", b"\n\xc3\n\xc3\xa9 key\r\nx\xffkey", b"key\xe2\x80\xa8\xe2\x80line\xc2\x85\xc2", b"\xffKEY \xffkey\xff\nkey key\n", b"\xed\xa0\x80 key \xf4\x90\x80\x80\n" * 3, b"\0\x01 key\0\n"]


@pytest.fixture(scope="module")
def raw(spark):
    rng = random.Random(3)
    more = [b"".join(rng.choice([b"key", b"\n", b"\r\n", b"\xff", b"\xc3\xa9", b"\xc3", b" ", b"x", b"\xe2\x80\xa8", b"\x85"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    made = [(k, t) for k, t in enumerate(ODD + more)]
    return spark.createDataFrame(made, "doc bigint, text binary"), made


def cut(text: bytes, pattern=rb"\n") -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    for m in re.finditer(pattern, text):
        out.append((text[at : m.start()], m[0]))
        at = m.end()
    return out + ([(text[at:], b"")] if at < len(text) else [])


UNICODE_END = rb"\r\n|[\n\x0b\x0c\r]|\xc2\x85|\xe2\x80[\xa8\xa9]"


@pytest.mark.parametrize(("newlines", "pattern"), [("lf", rb"\n"), (UNICODE, UNICODE_END)])
def test_lines_keep_bytes_and_offsets(raw, newlines, pattern):
    docs, made = raw
    want = []
    for d, t in made:
        at = 0
        for k, (line, end) in enumerate(cut(t, pattern), 1):
            want.append((d, k, line, end, at))
            at += len(line) + len(end)
    got = lines(docs, newlines, offsets=True).select("doc", "line_no", "as_cut", "terminator", "byte_offset").orderBy("doc", "line_no").collect()
    assert [(r.doc, r.line_no, bytes(r.as_cut), bytes(r.terminator), r.byte_offset) for r in got] == want
    plain = lines(docs, newlines).select("doc", "line_no", "body").orderBy("doc", "line_no").collect()
    assert [bytes(r.body) for r in plain] == [w[2].removesuffix(b"\r") for w in want]


def test_the_second_line_begins_where_it_does(spark):
    docs = spark.createDataFrame([(1, b"a\xffb\nsecond\n")], "doc bigint, text binary")
    assert [(r.byte_offset, len(r.as_cut)) for r in lines(docs, offsets=True).orderBy("line_no").collect()] == [(0, 3), (4, 6)]
    name = lines(docs).filter("line_no = 2").select(content_name(b_whole()).alias("n")).first()["n"]
    edited = replace.edit_lines(docs, name, "new").first()
    assert (edited.status, bytes(edited.text)) == ("done", b"a\xffb\nnew\n")
    made = chunk.chunks(chunk.by_lines(docs, 1)).orderBy("chunk").collect()
    assert [bytes(r.text) for r in made] == [b"a\xffb\n", b"second\n"] and [r.bytes for r in made] == [4, 7]


def b_whole():
    from pyspark.sql import functions as F

    return F.concat("as_cut", "terminator")


@pytest.mark.parametrize("search", [Search("key"), Search("key", word=True), Search("KEY", ignore_case=True), Search("key", invert=True), Search("é"), Search("É", ignore_case=True, word=True)])
def test_searches(raw, search):
    docs, made = raw
    pattern = UNICODE_END if search.newlines == UNICODE else rb"\n"
    want, spans = [], []
    for d, t in made:
        for k, (line, _) in enumerate(cut(t, pattern), 1):
            text = line.decode("utf-8", "surrogateescape")
            found = search.spans(text)
            if bool(found) != search.invert:
                want.append((d, k, line))
                spans += [(d, k, len(text[:a].encode("utf-8", "surrogateescape")), text[a:b].encode("utf-8", "surrogateescape")) for a, b in found]
    got = find.hits(docs, search).select("doc", "line_no", "as_cut").orderBy("doc", "line_no").collect()
    assert [(r.doc, r.line_no, bytes(r.as_cut)) for r in got] == want
    shown = find.context(docs, search).filter("is_match").orderBy("doc", "line_no").collect()
    assert [(r.doc, r.line_no, bytes(r.line)) for r in shown] == [(d, k, x.removesuffix(b"\r")) for d, k, x in want]
    counts = {r.doc: r["count"] for r in find.count_lines(docs, search, zeros=True).collect()}
    assert counts == {d: sum(w[0] == d for w in want) for d, _ in made}
    if not search.invert:
        got = find.matches(docs, search).orderBy("doc", "line_no", "start").collect()
        assert [(r.doc, r.line_no, r.start, bytes(r.match)) for r in got] == spans


def test_rows_columns_distinct_and_counts(raw):
    docs, made = raw
    got = rows.select_rows(docs, tail=2).orderBy("doc", "line_no").collect()
    assert [bytes(r.line) for r in got] == [x[0].removesuffix(b"\r") for _, t in made for x in cut(t)[-2:]]
    got = cols.columns(docs, "2,1", " ").orderBy("doc", "line_no").collect()
    assert [bytes(r.line) for r in got] == [b" ".join((f + [b""] * 2)[k] for k in (1, 0)) for _, t in made for x in cut(t) for f in [x[0].removesuffix(b"\r").split(b" ") if x[0].removesuffix(b"\r") else []]]
    every = [x[0].removesuffix(b"\r") for _, t in made for x in cut(t)]
    assert {bytes(r.line): r.times for r in distinct.dedup(docs).collect()} == {x: every.count(x) for x in every}
    assert [bytes(r.line) for r in distinct.sort(docs).collect()] == sorted(every)
    got = count.count(docs, ("lines", "words", "bytes", "max_line_length")).orderBy("doc").collect()
    assert [(r.lines, r.words, r.bytes, r.max_line_length) for r in got] == [(len(cut(t)), len(re.findall(rb"[^ \t\n\x0b\x0c\r]+", t)), len(t), max([len(x[0].removesuffix(b"\r")) for x in cut(t)], default=0)) for _, t in made]


def test_replacing_keeps_what_it_does_not_name(raw):
    docs, made = raw
    got = replace.replace(docs, "key", "é").orderBy("doc").collect()
    assert [(bytes(r.text), r.replacements) for r in got] == [(t.replace(b"key", "é".encode()), t.count(b"key")) for _, t in made]
    got = replace.replace(docs, "key", "", occurrences_="first").orderBy("doc").collect()
    assert [bytes(r.text) for r in got] == [t.replace(b"key", b"", 1) for _, t in made]
    got = replace.replace(docs, "KEY", "<>", ignore_case=True).orderBy("doc").collect()
    assert [bytes(r.text) for r in got] == [re.sub(rb"(?i)key", b"<>", t) for _, t in made]


@pytest.mark.parametrize("cut_by", [lambda d: chunk.by_lines(d, 2), lambda d: chunk.by_bytes(d, 9), lambda d: chunk.by_pattern(d, "key"), lambda d: chunk.with_header(d.filter("doc = 6"), 1, lambda x: chunk.by_lines(x, 1))])
def test_chunks_together_are_the_document(raw, cut_by):
    docs, made = raw
    found = {}
    for r in chunk.chunks(cut_by(docs)).orderBy("doc", "chunk").collect():
        found[r.doc] = found.get(r.doc, b"") + bytes(r.text)
    header = made[6][1].split(b"\n")[0] + b"\n"
    if len(found) == 1:
        assert found == {6: header * 2 + header * 2}
    else:
        assert found == {d: t for d, t in made if t}


def test_files_as_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(ODD[0])
    docs = files.read_files(spark, f"file://{tmp_path}", as_bytes=True)
    assert bytes(find.hits(docs, Search("b")).first().as_cut) == b"a\xffb"


def test_written_lines_and_told_rows(spark, frame):
    docs = frame("a\r\nb\na", "b\nc")
    got = lambda df: [r.text for r in df.orderBy("doc", "line_no").collect()]
    assert got(distinct.written(docs)) == ["a\n", "b\n", "c\n"] and got(distinct.written(docs, "\0")) == ["a\0", "b\0", "c\0"]
    assert got(distinct.written(docs, None)) == ["a\r\n", "b\n", "c"]
    raw = spark.createDataFrame([(0, b"\xff\r\n\xff\nx")], "doc bigint, text binary")
    assert [bytes(x) for x in got(distinct.written(raw, None))] == [b"\xff\r\n", b"x"]
    some = rows.select_rows(raw, rows="2-", hash_width=4)
    assert [bytes(x) for x in got(rows.told(some, numbers=True))] == [b"2:\xff", b"3:x"] and {len(r.line_hash) for r in some.collect()} == {4}
    assert got(rows.told(rows.select_rows(docs, tail=1), hashes=True))[0][8:] == ":a"
    with pytest.raises(ValueError):
        distinct.written(docs, "\r")
