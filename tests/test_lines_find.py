import pytest
from pyspark.sql import functions as F

from weft.functions import folding, names
from weft.functions.lines import LF, UNICODE, lines
from weft.operators import find
from weft.operators.find import Search


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(
    ("text", "newlines", "bodies"),
    [
        ("", LF, []),
        ("\n", LF, [""]),
        ("a\nb", LF, ["a", "b"]),
        ("a\r\nb\n", LF, ["a", "b"]),
        ("a\r\r\n", LF, ["a\r"]),
        ("a\x0bb\x0cc\rd\x85e f g\n", UNICODE, list("abcdefg")),
        ("first row\r\nsecond row\r\n", UNICODE, ["first row", "second row"]),
        ("a\n\nb\n\n", LF, ["a", "", "b", ""]),
    ],
)
def test_lines(frame, text, newlines, bodies):
    found = lines(frame(text), newlines, offsets=True).orderBy("line_no").collect()
    assert [r.body for r in found] == bodies
    assert "".join(r.as_cut + r.terminator for r in found) == text
    plain = lines(frame(text), newlines).orderBy("line_no").collect()
    assert [(r.line_no, r.as_cut, r.terminator, r.body) for r in plain] == [(r.line_no, r.as_cut, r.terminator, r.body) for r in found]
    at = 0
    for r in found:
        assert r.byte_offset == at
        at += len((r.as_cut + r.terminator).encode())


#: Context groups: how many lines, which of them match, lines before and after, line numbers by group.
GROUPS = [
    (5, {2, 4}, 1, 0, [[1, 2, 3, 4]]), (5, {2, 4}, 0, 1, [[2, 3, 4, 5]]), (6, {2, 5}, 1, 1, [[1, 2, 3, 4, 5, 6]]), (5, {1, 4}, 1, 1, [[1, 2, 3, 4, 5]]), (4, {2, 3}, 2, 2, [[1, 2, 3, 4]]),
    (6, {2, 5}, 1, 0, [[1, 2], [4, 5]]), (7, {2, 6}, 1, 1, [[1, 2, 3], [5, 6, 7]]), (5, {1, 4}, 1, 0, [[1], [3, 4]]), (5, {1, 4}, 0, 1, [[1, 2], [4, 5]]), (9, {9}, 3, 3, [[6, 7, 8, 9]]), (3, set(), 1, 1, []),
]


@pytest.mark.parametrize(("n", "hits", "before", "after", "groups"), GROUPS)
def test_context(frame, n, hits, before, after, groups):
    text = "".join(f"row {k}{' KEY' if k in hits else ''}\n" for k in range(1, n + 1))
    found = find.context(frame(text), Search("KEY"), before, after).orderBy("line_no").collect()
    got = {}
    for r in found:
        got.setdefault(r.group_id, []).append(r.line_no)
    assert list(got.values()) == groups


def test_word_and_invert(frame):
    docs = frame("cat\nconcat\ncat_\na cat!\n")
    assert [r[0] for r in rows(find.hits(docs, Search("cat", word=True)).select("line_no"), "line_no")] == [1, 4]
    assert [r[0] for r in rows(find.hits(docs, Search("cat", invert=True)).select("line_no"), "line_no")] == []
    assert Search("cat", word=True).spans("concat cat") == [(7, 10)]


@pytest.mark.parametrize(
    ("text", "literal", "spans"),
    [("groẞ maẞ", "SS", [(3, 4), (7, 8)]), ("Gasse", "ß", [(2, 4)]), ("Aİ bİ", "i", [(1, 2), (4, 5)]), ("proﬁt", "FI", [(3, 4)]), ("DIŞARI", "şarı", []), ("GROSSE Maße", "große", [(0, 6)])],
)
def test_folded_spans(text, literal, spans):
    assert folding.spans(text, literal, True) == spans


def test_counts_files_and_caps(frame):
    docs = frame("a\nb a a\n", "b\n", "a\na\na\n")
    assert rows(find.count_lines(docs, Search("a")), "doc") == [(0, 2), (2, 3)]
    assert rows(find.count_lines(docs, Search("a"), zeros=True), "doc") == [(0, 2), (1, 0), (2, 3)]
    assert rows(find.count_lines(docs, Search("a", multiline=True)), "doc") == [(0, 3), (2, 3)]
    assert rows(find.files(docs, Search("a")), "doc") == [(0,), (2,)]
    assert rows(find.files_without(docs, Search("a")), "doc") == [(1,)]
    # a document that reaches the cap on its last line doesn't end the walk
    assert rows(find.capped(docs, Search("a"), 2).select("doc", "line_no"), "doc", "line_no") == [(0, 1), (0, 2), (2, 1), (2, 2)]
    assert rows(find.capped(docs, Search("a"), 1).select("doc", "line_no"), "doc", "line_no") == [(0, 1)]
    assert find.exists(docs, Search("b a")) and not find.exists(docs, Search("zz"))
    s = find.summary(docs, Search("a")).first()
    assert (s.files_searched, s.files_matched, s.lines, s.matches, s.bytes) == (3, 2, 5, 6, 16)


def test_multiline(frame):
    found = rows(find.multiline(frame("x\na b\nc d\ny\n"), Search("b\nc", multiline=True)).select("line_no", "is_match"), "line_no")
    assert found == [(2, True), (3, True)]


def test_fields(frame):
    r = find.fields(frame("é\nxé MATCH\n"), Search("MATCH", unicode=True)).first()
    assert (r.line_no, r.column, r.byte_offset) == (2, 4, 3)
    r = find.fields(frame("é\nxé MATCH\n"), Search("MATCH")).first()
    assert r.column == 5


def test_refusals():
    for bad in (dict(pattern=""), dict(pattern="a\nb"), dict(pattern="a", multiline=True, invert=True)):
        with pytest.raises(ValueError):
            Search(**bad)


def test_names(frame):
    name = frame("abc").select(names.content_name("text")).first()[0]
    assert name == "q9w1dfwf077ym"
    assert names.parse_name("Q9W1") == "q9w1"
    for bad in ("abc", "abci", "q9w1dfwf077yn", "q9w1dfwf077ymm"):
        with pytest.raises(ValueError):
            names.parse_name(bad)
    with pytest.raises(ValueError):
        names.parse_name("q9w1", whole=True)
    assert frame("abc").filter(names.has_name("text", "q9w1d")).count() == 1


def test_same_at_any_partitioning(frame):
    docs = frame(*[f"line {k}\nMATCH {k}\nend" for k in range(20)])
    want = rows(find.context(docs, Search("MATCH"), 1, 0), "doc", "line_no")
    for n in (1, 4, 50):
        assert rows(find.context(docs.repartition(n), Search("MATCH"), 1, 0), "doc", "line_no") == want


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "x")], "doc bigint, text string, other string").write.parquet(str(tmp_path / "t"))
    plan = find.files(spark.read.parquet(str(tmp_path / "t")), Search("b"))._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan.split("ReadSchema")[1]
    assert F is not None


def test_lines_take_time_in_proportion(spark):
    """A document of 200,000 lines is cut, counted and searched in seconds, and twice as many take about twice as long."""
    import time

    def seconds(n, run):
        docs = spark.createDataFrame([(1, "some words of a line\n" * n)], "doc bigint, text string").repartition(1).cache()
        docs.count()
        began = time.perf_counter()
        assert run(docs) == n
        took = time.perf_counter() - began
        docs.unpersist()
        return took

    for run in (
        lambda d: lines(d, offsets=True).agg(F.count("*"), F.max("byte_offset")).first()[0],
        lambda d: lines(d, UNICODE).agg(F.count("*"), F.max("terminator")).first()[0],
        lambda d: find.count_lines(d, Search("words")).first()["count"],
        lambda d: find.fields(d, Search("words")).count(),
    ):
        seconds(1000, run)
        small, large = seconds(50_000, run), seconds(200_000, run)
        assert large < 20 and large < 8 * max(small, 0.5)


def test_words_match_among_many_false_starts():
    text = "cat" * 30_000 + " cat"
    assert Search("cat", word=True).spans(text) == [(90_001, 90_004)]


def test_repeated_documents_count_twice(spark):
    docs = spark.createDataFrame([(1, "a KEY\nb\n"), (1, "a KEY\nb\n")], "doc bigint, text string")
    s = find.summary(docs, Search("KEY")).first()
    assert (s.files_searched, s.lines, s.matches, s.bytes) == (2, 2, 2, 16)
    assert find.fields(docs, Search("KEY")).count() == 2 and find.multiline(docs, Search("Y\nb", multiline=True)).count() == 4
