"""Registered queries against their SQL over documents that the driver's tables don't have."""

import random
import re

import duckdb
import pyarrow as pa
import pytest

from weft.functions import lines
from weft.operators import fuzzy, replace, segment
from weft.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture
def same(spark, tmp_path):
    """Rows of a query over documents of these texts, after they were found equal to those of its SQL."""

    def check(name, *texts):
        documents = spark.createDataFrame([(k, t, "de", "web") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
        documents.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        found = QUERIES[name](spark, str(tmp_path))
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        wanted = db.execute(SQL[name])
        assert found.columns == [c[0] for c in wanted.description]
        key = lambda row: tuple((x is not None, x) for x in row)
        rows = sorted(map(tuple, found.collect()), key=key)
        assert rows == sorted(wanted.fetchall(), key=key)
        return rows

    return check


def test_texts_of_fewer_bytes_than_shares(same):
    # none ends with a terminator: the SQL doesn't count a last one
    rows = same("chunk_count", "", "a", "a\nb", "\n\nc", "ä", "\nab", None, "one\ntwo\nthree\nfour\nfive")
    assert len(rows) == 32 and [r[2] for r in rows[:12]] == [0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 0]


def test_folded_matches_that_share_a_character(same, frame):
    assert [n for _, n in same("replace_folded", "dasßsch", "sßs sßß", "SSß", "ßsß", "sß", "kein", "", None)] == [2, 4, 2, 2, 1, 0, 0, None]
    for text, first, every in (("dasßsch", "da.sch", "da..ch"), ("xsßßy", "x.ßy", "x..y"), ("ßsß", ".sß", "..")):
        assert replace.replace(frame(text), "SS", ".", ignore_case=True).first().text == every
        assert replace.replace(frame(text), "SS", ".", "first", ignore_case=True).first().text == first
    # a match needs a character of its own
    assert replace.replace(frame("eﬃeß"), "f", ".", ignore_case=True).first().replacements == 1


def test_files_that_match_in_whole_characters_only(spark, same, frame):
    assert same("fuzzy_files", "ein ßchein", "ein SCHEIN", "x\nSchein\n", "Sche\nin", "schEİn", "ſchein", "ẞchein", "", None, "Scheinßchein") == [(1,), (2,), (4,), (9,)]
    # the others fold fully
    assert same("fuzzy_summary", "ein ßchein", "ein SCHEIN", "x\nSchein\n", "kein", "Sche\nin") == [(5, 3, 3)]
    found = fuzzy.score(spark, frame("ΛΟΓΟΣ ein", "λογος"), ["λογοσ"], fuzzy.Effort.EXACT, simple=True).collect()
    assert [r.doc for r in found] == [0]


def test_lines_on_their_way_to_python_carry_no_document(spark, frame, capsys):
    """A row of a line that holds all lines of its document is as large as the document, and is queued as it is."""
    for scored in (fuzzy.score(spark, frame("a\nschein\n"), ["schein"]), fuzzy.score(spark, frame("a\nschein\n"), ["schein"], fuzzy.Effort.EXACT)):
        scored.explain("formatted")
        queued = re.findall(r"\) (?:ArrowEvalPython|Generate).*\nInput .*\n(?:Arguments: posexplode\(.*?\), (.*))?", capsys.readouterr().out)
        told = [x for x in queued if x]
        assert told and not any(re.search(r"\bparts#", x.split(", false, ")[0]) for x in told)
    assert [tuple(r)[:2] for r in lines.numbered_lines(frame("a\nb\n"), lines.UNICODE).select("line_no", "n_lines").collect()] == [(1, 2), (2, 2)]


@pytest.mark.parametrize("by", segment.TILERS)
def test_segments_leave_a_task_in_batches_of_a_bounded_size(by):
    texts = ["", None, "é x. Y?\r\nß z", "w " * 120_000, "ü. " * 40_000, *["To be. Or not? " * 50] * 2000]
    columns = ["doc", "seq", "start", "end", "segment"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc", "text"])
    wanted = []
    for k, text in enumerate(texts):
        at = 0
        for n, s in enumerate(segment.TILE[by](text or "")):
            wanted.append((k, n, at, at + len(s.encode()), s))
            at = wanted[-1][3]
    batches = list(segment._tiled(by, columns)([batch]))
    assert len(batches) > 1 and max(b.num_rows for b in batches) < 2 * segment.ROWS
    assert [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns))] == wanted


def test_plain_stretches_are_cut_as_the_rules_cut_them():
    draw = random.Random(7)
    letters = [*"abZ09_" * 4, *"  \n\r\t.,'\"-()/$%:!?é́‍ ​⁠אカ漢😀🇩", "  ", "b c ", "d  "]
    for _ in range(20_000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 25)))
        assert segment.words(text) == segment._word_pattern().findall(text)
        assert segment.linebreaks(text) == segment._linebreaks(text)


def test_plain_segments(same):
    for name in ("segment_words_plain", "segment_linebreaks_plain"):
        same(name, "", None, " ", "a", "  a  bc d ", "a.b, ü c?", "x" * 70_000 + " y")
