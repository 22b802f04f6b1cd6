"""Order over all documents, table functions in SQL, and chunks written as files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weft.functions import tables
from weft.operators import chunk, distinct, segment
from weft.operators.find import Search
from weft.sources import chunk_files


def plain_disorder(texts, reverse, unique, fold):
    last = None
    for d, t in enumerate(texts):
        for n, line in enumerate(t.removesuffix("\n").split("\n") if t else [], 1):
            key = line.casefold() if fold else line
            if last is not None and ((key > last if reverse else key < last) or (unique and key == last)):
                return [(d, n)]
            last = key
    return []


def test_order_over_all_documents(spark, frame):
    rng = random.Random(2)
    for trial in range(6):
        words = sorted(rng.choice(["a", "B", "b", "é", "z", "C"]) * rng.randint(1, 3) for _ in range(30))
        if trial % 2:
            words[rng.randint(0, 29)] = "m"
        reverse = trial in (2, 3)
        words = words[::-1] if reverse else words
        cuts = sorted(rng.sample(range(1, 30), 6))
        texts = ["\n".join(words[a:b]) + rng.choice(["", "\n"]) for a, b in zip([0, *cuts], [*cuts, 30])]
        texts.insert(3, "")
        docs = frame(*texts).repartition(4)
        for unique in (False, True):
            for fold in (False, True):
                found = [tuple(r) for r in distinct.disorder(docs, reverse, unique, fold).collect()]
                assert found == plain_disorder(texts, reverse, unique, fold)
    assert distinct.disorder(frame("x").limit(0)).collect() == []
    assert [tuple(r) for r in distinct.disorder(spark.createDataFrame([("p", b"b\n"), ("q", b"\xffa\na")], "doc string, text binary")).collect()] == [("q", 2)]


def test_first_disorder_of_each_document(frame):
    docs = frame("a\nb\na\n", "a\na\n", "", "b\r\na", "B\na\n")
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(distinct.first_disorder(docs)) == [(0, 3), (3, 2)]
    assert order(distinct.first_disorder(docs, unique=True)) == [(0, 3), (1, 2), (3, 2)]
    assert order(distinct.first_disorder(docs, reverse=True)) == [(0, 2), (4, 2)]
    assert order(distinct.first_disorder(docs, ignore_case=True)) == [(0, 3), (3, 2), (4, 2)]
    assert "Exchange" not in distinct.first_disorder(docs)._jdf.queryExecution().executedPlan().toString()


def test_table_functions(spark, frame):
    tables.register(spark)
    docs = frame("One é. Two!", None, "")
    docs.createOrReplaceTempView("own_docs")
    for by in segment.TILERS:
        found = spark.sql(f"SELECT doc, s.* FROM own_docs, LATERAL weft_segments(text, '{by}') s")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, segment.segments(docs, by).collect()))
    found = spark.sql("SELECT doc, m.* FROM own_docs, LATERAL weft_matches(text, 'É', true) m").collect()
    assert [tuple(r) for r in found] == [(0, 4, 6, "é")]
    assert Search("É", ignore_case=True).byte_spans("One é. Two!") == [(4, 6, 4, 5)]


def test_chunks_are_files_of_their_names(spark, frame, tmp_path):
    text = "".join(f"line {k}\n" for k in range(25)) + "end"
    made = chunk.chunks(chunk.by_lines(frame(text), 10)).repartition(3)
    name = F.concat(F.lit("x"), chunk.suffix_column("chunk"))
    chunk_files.write_chunk_files(made, f"file://{tmp_path}/out", name)
    assert sorted(os.listdir(tmp_path / "out")) == ["xaa", "xab", "xac"]
    assert "".join((tmp_path / "out" / n).read_text() for n in ("xaa", "xab", "xac")) == text
    before = (tmp_path / "out/xaa").read_text()
    with pytest.raises(Exception, match="there already"):
        chunk_files.write_chunk_files(made, f"{tmp_path}/out", name)
    chunk_files.write_chunk_files(made, f"{tmp_path}/out", name, overwrite=True)
    assert (tmp_path / "out/xaa").read_text() == before and len(os.listdir(tmp_path / "out")) == 3


def test_a_failed_task_leaves_nothing(spark, frame, tmp_path):
    made = chunk.chunks(chunk.by_lines(frame("a\nb\nc\n"), 1)).repartition(3)
    broken = F.when(F.col("chunk") < 2, F.concat(F.lit("x"), chunk.suffix_column("chunk"))).otherwise(F.lit("../out"))
    with pytest.raises(Exception, match="no name of a chunk"):
        chunk_files.write_chunk_files(made, f"{tmp_path}/out", broken)
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="one name"):
        chunk_files.write_chunk_files(made, f"{tmp_path}/out", F.lit("xaa"))
    assert os.listdir(tmp_path / "out") == []
    raw = spark.createDataFrame([(0, b"\xff\n\xfe")], "doc bigint, text binary")
    chunk_files.write_chunk_files(chunk.chunks(chunk.by_lines(raw, 1)), f"{tmp_path}/raw", F.concat(F.lit("x"), chunk.suffix_column("chunk")))
    assert (tmp_path / "raw/xab").read_bytes() == b"\xfe"
