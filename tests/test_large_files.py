"""Lines of split files equal those of the whole."""

import random

import pytest

from weft.functions.lines import lines
from weft.operators import find
from weft.operators.find import Search
from weft.sources import large


@pytest.fixture(scope="module", params=[37, 300, 1 << 20])
def split_files(spark, tmp_path_factory, request):
    """Files, read in splits of so many bytes, and the same as documents."""
    folder, rng = tmp_path_factory.mktemp(f"large{request.param}"), random.Random(9)
    made = {"a": "one line\n", "b": "x", "c": "\n\n\n", "d": "".join(f"{rng.choice(['key', 'é', 'word ' * rng.randint(0, 9)])} {k}\r\n" for k in range(200)), "e": "no end\n" * 40 + "key at the end", "f": "key\n" + "\n" * 100 + "long " * 60 + "key\n"}
    for name, text in made.items():
        (folder / name).write_bytes(text.encode())
    (folder / "g").write_bytes(b"\xff\xfekey\n\xc3" * 30)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    docs = spark.createDataFrame([(f"file:{folder}/{n}", t.encode()) for n, t in made.items()] + [(f"file:{folder}/g", b"\xff\xfekey\n\xc3" * 30)], "doc string, text binary")
    yield f"file://{folder}", docs
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(df, *names):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*names).collect())


def test_numbers_offsets_and_tails(spark, split_files):
    path, docs = split_files
    found = large.numbered(spark, path, as_bytes=True)
    want = lines(docs, offsets=True)
    names = ("doc", "line_no", "byte_offset", "as_cut", "body", "terminator")
    assert rows(found, *names) == rows(want, *names)
    counts = {d: max(n for x, n in rows(want, "doc", "line_no") if x == d) for d in {x for x, _ in rows(want, "doc", "line_no")}}
    assert rows(large.tail(found, 3), "doc", "line_no") == [(d, n) for d, n in rows(want, "doc", "line_no") if n > counts[d] - 3]
    assert rows(large.every(found, 7), "doc", "line_no") == [(d, n) for d, n in rows(want, "doc", "line_no") if n % 7 == 0]


@pytest.mark.parametrize(("before", "after"), [(0, 0), (1, 0), (0, 2), (3, 5), (60, 60)])
def test_context_across_seams(spark, split_files, before, after):
    path, docs = split_files
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for search in (Search("key"), Search("word", invert=True)):
            found = large.context(large.numbered(spark, path, as_bytes=True), search, before, after)
            assert rows(found, "doc", "line_no", "is_match", "line") == rows(find.context(docs, search, before, after), "doc", "line_no", "is_match", "line")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_refusals(spark, split_files):
    found = large.numbered(spark, split_files[0])
    for bad in (lambda: large.tail(found, 0), lambda: large.every(found, 0), lambda: large.context(found, Search("a\nb", multiline=True)), lambda: large.context(found, Search("a"), -1)):
        with pytest.raises(ValueError):
            bad()
