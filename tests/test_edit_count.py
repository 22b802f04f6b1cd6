import pytest

from weft.functions.sizes import parse_size
from weft.operators import chunk, cols, count, distinct, replace, rows
from weft.plans import render


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(
    ("text", "pattern", "new", "fold", "result", "n"),
    [("a\r\nb", "a\nb", "X", False, "a\r\nb", 0), ("groẞ maẞ", "SS", ".", True, "gro. ma.", 2), ("Gasse", "ß", ".", True, "Ga.e", 1), ("Aİ bİ", "i", ".", True, "A. b.", 2), ("proﬁt", "FI", ".", True, "pro.t", 1), ("aaa", "aa", "b", False, "ba", 1)],
)
def test_replace(frame, text, pattern, new, fold, result, n):
    r = replace.replace(frame(text), pattern, new, ignore_case=fold).first()
    assert (r.text, r.replacements) == (result, n)


def test_replace_first_one_and_guards(frame):
    docs = frame("oak oak\noak oak\n", "one oak", "none")
    assert [r.text for r in replace.replace(docs, "oak", "elm", "first").orderBy("doc").collect()] == ["elm oak\noak oak\n", "one elm", "none"]
    one = replace.replace(docs, "oak", "elm", "one").orderBy("doc").collect()
    assert [r.status for r in one] == ["ambiguous", "done", "unresolved"] and one[0].text == "oak oak\noak oak\n"
    from pyspark.sql import functions as F

    stale = replace.replace(docs, "oak", "x", expect_hash=F.lit("0000000000000")).collect()
    assert {r.status for r in stale} == {"stale"}
    with pytest.raises(render.Ambiguous):
        render.raise_refused(replace.replace(docs, "oak", "elm", "one"))


def test_chained_edits_are_guarded(frame):
    from pyspark.sql import functions as F

    from weft.functions.names import content_name

    docs = frame("oak oak", "oak", "ash").withColumn("expected", F.when(F.col("doc") == 1, F.lit("0123456789abc")).otherwise(content_name("text")))
    found = replace.chained(docs, [("oak", "elm"), ("elm", "fir")]).orderBy("doc").collect()
    assert [(r.text, r.status) for r in found] == [("fir fir", "done"), ("oak", "stale"), ("ash", "done")]
    want = frame("fir fir", "oak", "ash").orderBy("doc").select(content_name("text")).collect()
    assert [r.hash_after for r in found] == [r[0] for r in want]
    with pytest.raises(ValueError):
        replace.replace(docs, "oak", "elm", expect_hash="0123")
    with pytest.raises(ValueError):
        replace.edit_lines(docs, "0000", "x", occurrences_="first")


def test_edit_lines(frame):
    from weft.functions.lines import lines, whole
    from weft.functions.names import content_name

    docs = frame("a\nb\nc")
    names = [r[0] for r in lines(docs).orderBy("line_no").select(content_name(whole())).collect()]
    edit = lambda k, new, **kw: replace.edit_lines(docs, names[k], new, **kw).first()
    assert edit(1, "B").text == "a\nB\nc"
    assert edit(1, "").text == "a\nc"
    assert edit(2, "d", placement="after").text == "a\nb\nc\nd"
    assert edit(0, "z", placement="before").text == "z\na\nb\nc"
    assert replace.edit_lines(docs, "0000", "x").first().status == "unresolved"
    twice = frame("a\na\n")
    assert replace.edit_lines(twice, names[0], "x").first().status == "ambiguous"
    assert replace.edit_lines(twice, names[0], "x", occurrences_="all").first().text == "x\nx\n"


@pytest.mark.parametrize(
    ("text", "mode", "field", "n"),
    [
        ("a b\né\n", "unicode", "chars", 6), ("a b\né\n", "unicode", "bytes", 7), ("a\x0bb\x0cc\rd e\n", "ascii", "words", 5), ("a\nb", "posix", "lines", 1),
        ("a\nb", "ascii", "lines", 2), ("a\nb\n", "posix", "lines", 2), ("abc", "posix", "lines", 0), ("", "posix", "lines", 0), ("", "ascii", "max_line_length", 0),
        ("a\x0bb\x0cc\rd\x85e f g\n", "unicode", "lines", 7), ("a\x0bb\x0cc\rd\x85e f g\n", "posix", "lines", 1),
        ("a b c", "unicode", "words", 3), ("a b c", "ascii", "words", 2), ("ab\nabcd\nabc\n", "ascii", "max_line_length", 4),
    ],
)
def test_count(frame, text, mode, field, n):
    assert count.count(frame(text), (field,), mode).first()[field] == n


def test_totals_and_forms(frame):
    c = count.count(frame("a b\n", "longer line\nx\n"))
    t = count.totals(c).first()
    assert (t.lines, t.words, t.bytes, t.max_line_length, t.files) == (3, 5, 18, 11, 2)
    assert count.with_total(c).count() == 3
    assert render.count_table(c, "plain").orderBy("doc").first().text == "1\t2\t4\t4\t3\t0"
    with pytest.raises(ValueError):
        count.count(frame(""), ("nothing",))


@pytest.mark.parametrize("text", ["", "\n", "\n\n", "open end", "p1\np2\np3\n", "p1\np2\np3", "a\n\nb\n\n", "\nfirst\nis empty\n"])
def test_tail(frame, text):
    every = text.split("\n")
    every = every[:-1] if every[-1] == "" else every
    numbered = list(enumerate(every, 1))
    for n in range(1, len(every) + 3):
        assert got(rows.select_rows(frame(text), tail=n).select("line_no", "line"), "line_no") == numbered[-n:]


def test_rows_and_columns(frame):
    assert rows.parse_rows("3,1") == [(1, 1), (3, 3)] and rows.parse_rows("5-7,6-9,10") == [(5, 10)] and rows.parse_rows("4-,9") == [(4, None)]
    for bad in ("0", "5-3", "a", ""):
        with pytest.raises(ValueError):
            rows.parse_rows(bad)
    docs = frame("1\n2\n3\n4\n5\n6\n")
    assert [r.line for r in rows.select_rows(docs, "3,1").orderBy("line_no").collect()] == ["1", "3"]
    assert [r.line for r in rows.select_rows(docs, every=2).orderBy("line_no").collect()] == ["2", "4", "6"]
    with pytest.raises(ValueError):
        rows.select_rows(docs)
    pick = lambda text, *a, **kw: [r.line for r in cols.columns(frame(text), *a, **kw).orderBy("line_no").collect()]
    assert pick("a\tb\tc\n1\t2\t3\n", "2") == ["b", "2"]
    assert pick("a\tb\tc\td\n", "1,3", output_delimiter=",") == ["a,c"]
    assert pick("a\tb\n", "1,3") == ["a\t"]
    assert pick("a\tb\tc\na\n1\t2\t3\n", "2", min_columns=3) == ["b", "2"]
    assert pick("a::b::c\n\n", "3,1", "::") == ["c::a", "::"]
    assert cols.parse_columns("3,1,5-7") == [3, 1, 5, 6, 7]


def test_dedup_and_sort(frame):
    one = lambda df: [r.line for r in df.orderBy("line_no").collect()]
    assert one(distinct.dedup(frame("fir\nyew\nfir\nash\n"))) == ["fir", "yew", "ash"]
    assert one(distinct.dedup(frame("Fir\nfir\nFIR\nash\n"), True)) == ["Fir", "ash"]
    order = lambda df: [r.line for r in df.collect()]
    assert order(distinct.sort(frame("oak\nash\nyew\n"))) == ["ash", "oak", "yew"]
    assert order(distinct.sort(frame("oak\nash\nyew\n"), reverse=True)) == ["yew", "oak", "ash"]
    assert order(distinct.sort(frame("b\na\nb\nc\na\n"), unique=True)) == ["a", "b", "c"]
    assert order(distinct.sort(frame("yew\nAsh\nOAK\n"), ignore_case=True)) == ["Ash", "OAK", "yew"]
    assert order(distinct.sort(frame("Fir\nfir\nYEW\nyew\n"), ignore_case=True, unique=True)) == ["Fir", "YEW"]
    assert got(distinct.first_disorder(frame("a\nb\n", "b\na\n")), "doc") == [(1, 2)]


def test_chunks(frame):
    text = "ab\na line that no budget holds\ncd\n"
    found = chunk.chunks(chunk.by_bytes(frame(text), 5)).orderBy("chunk").collect()
    assert [r.text for r in found] == ["ab\n", "a line that no budget holds\n", "cd\n"]
    for n in (1, 2, 4):
        found = chunk.chunks(chunk.by_count(frame("x\ny\n"), n), n).orderBy("chunk").collect()
        assert len(found) == n and "".join(r.text for r in found) == "x\ny\n"
    with pytest.raises(Exception, match="shares of fewer bytes"):
        chunk.by_count(frame("x\ny\n"), 600).collect()
    found = chunk.chunks(chunk.with_header(frame("key,tree\n1,oak\n2,ash\n3,yew\n4,fir\n"), 1, lambda d: chunk.by_lines(d, 2))).orderBy("chunk").collect()
    assert [r.text for r in found] == ["key,tree\n1,oak\n2,ash\n", "key,tree\n3,yew\n4,fir\n"]
    assert [(r.lines, r.header_lines) for r in found] == [(2, 1), (2, 1)]
    # a header that is all there is, or leaves no room, is refused and not lost
    for docs, budget, why in ((frame("a\nb\n", "only\n"), None, "1: no line follows"), (frame(""), None, "0: no line follows"), (frame("a long header\nx\n"), 10, "leaves no room")):
        with pytest.raises(ValueError, match=why):
            chunk.with_header(docs, 1, lambda d: chunk.by_lines(d, 2), budget)
    with pytest.raises(ValueError):
        chunk.by_count(frame("x\n"), 677)
    found = chunk.chunks(chunk.by_pattern(frame(">a\n1\n>b\n2\n"), ">")).orderBy("chunk").collect()
    assert [r.text for r in found] == [">a\n1\n", ">b\n2\n"]
    assert chunk.suffix(27) == "bb"
    with pytest.raises(ValueError):
        chunk.suffix(26, 1)


@pytest.mark.parametrize(("text", "n"), [("10", 10), ("4K", 4000), ("2MiB", 2 << 20), ("1Ti", 1 << 40), ("3gb", 3 * 10**9)])
def test_sizes(text, n):
    assert parse_size(text) == n


def test_bad_sizes():
    for bad in ("", "0", "x", "1Q", "-1"):
        with pytest.raises(ValueError):
            parse_size(bad)
