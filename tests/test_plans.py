import bz2
import gzip
import io
import json
import lzma
import os
import sqlite3
import subprocess
import sys
import tarfile
import zipfile

import pytest

from weft.operators.find import Search
from weft.plans import catalogue, render, report
from weft.plans.report import Report
from weft.sources import containers, files
from weft.streaming import text as streams

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_files_and_walk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("print(1)\n")
    (tmp_path / "sub/b.md").write_text("# b\n")
    (tmp_path / "sub/c.bin").write_bytes(b"x\0y")
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "sub/.gitignore").write_text("*.bin\n")
    root = f"file://{tmp_path}"
    names = lambda df: sorted(r.doc.rsplit("/", 1)[1] for r in df.select("doc").collect())
    assert names(files.read_files(spark, root)) == ["a.py", "b.md", "c.bin"]
    assert names(files.read_files(spark, root, binary=False)) == ["a.py", "b.md"]
    assert names(files.read_files(spark, root, types=["md"])) == ["b.md"]
    assert names(files.read_files(spark, root, globs=["!*.py", "*.py", "*.md"])) == ["b.md"]
    assert [os.path.basename(p) for p in files.walk(str(tmp_path))] == ["a.py", "b.md"]
    assert [os.path.basename(p) for p in files.walk(str(tmp_path), max_depth=1, hidden=True)] == [".hidden", "a.py"]
    assert len(files.walk(str(tmp_path), ignore=False)) == 3


def test_ignore_files_and_named_files(spark, tmp_path):
    for name in ("keep.log", "a.log", "build/x.py", "src/build/y.py", "src/deep/er/z.tmp", "src/z.tmp", "doc/a1.md", "doc/a2.md", "doc/ab.md", "odd*.txt", "oddly.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    (tmp_path / ".gitignore").write_text("# rules\n*.log\n!keep.log\n/build/\nsrc/**/z.tmp\ndoc/a[0-9].md\nodd\\*.txt\n")
    (tmp_path / "src/.gitignore").write_text("!z.tmp\n")
    found = [os.path.relpath(p, tmp_path) for p in files.walk(str(tmp_path))]
    assert found == ["doc/ab.md", "keep.log", "oddly.txt", "src/build/y.py", "src/deep/er/z.tmp", "src/z.tmp"]
    names = lambda df: sorted(r.doc.rsplit("/", 1)[1] for r in df.select("doc").collect())
    root = f"file://{tmp_path}"
    assert names(files.read_files(spark, root, globs=["doc/*.md", "!a1.md"])) == ["a2.md", "ab.md"]
    assert names(files.read_files(spark, root, globs=["src/**/*.py"])) == ["y.py"] and names(files.read_files(spark, root, globs=["s*c/*.py"])) == []
    # a file that is named is read whatever the globs say
    assert names(files.read_files(spark, [f"{root}/a.log", f"{root}/doc"], globs=["*1.md"])) == ["a.log", "a1.md"]


def test_containers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.txt", "zip text")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.txt")
        info.size = 8
        t.addfile(info, io.BytesIO(b"tar text"))
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"plain"))
    (tmp_path / "e.xz").write_bytes(lzma.compress(b"x z"))
    (tmp_path / "f.bz2").write_bytes(bz2.compress(b"b z"))
    zst = pytest.importorskip("zstandard").ZstdCompressor()
    (tmp_path / "g.zst").write_bytes(zst.compress(b"two ") + zst.compress(b"frames"))
    (tmp_path / "h.tar.xz").write_bytes(lzma.compress((lambda o: (tarfile.open(fileobj=o, mode="w").addfile(tarfile.TarInfo("empty.txt")), o.getvalue())[1])(io.BytesIO()) + bytes(1024)))
    got = {(r.doc.rsplit("/", 1)[1], r.member): r.text for r in containers.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.zip", "in/x.txt"): "zip text", ("b.tar.gz", "y.txt"): "tar text", ("c.gz", ""): "plain", ("e.xz", ""): "x z", ("f.bz2", ""): "b z", ("g.zst", ""): "two frames", ("h.tar.xz", "empty.txt"): ""}
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": "c"}]})
    cells = containers.notebook_cells(spark.createDataFrame([("n", book)], "doc string, text string")).orderBy("cell").collect()
    assert [(r.cell_type, r.text) for r in cells] == [("code", "a\nb"), ("markdown", "c")]
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("CREATE TABLE t (x)")
        db.executemany("INSERT INTO t VALUES (?)", [("one",), (2,), ("three",)])
        db.execute("CREATE TABLE none (x)")
        db.execute("INSERT INTO t (rowid, x) VALUES (-7, 'seven'), (1000000, 'far')")
    containers.register(spark)
    found = spark.read.format("sqlite_text").option("path", str(tmp_path / "d.db")).option("table", "t").option("column", "x").load()
    assert sorted((r.rowid, r.text) for r in found.collect()) == [(-7, "seven"), (1, "one"), (3, "three"), (1000000, "far")]
    assert spark.read.format("sqlite_text").option("path", str(tmp_path / "d.db")).option("table", "none").option("column", "x").load().count() == 0


def test_rendering(frame, tmp_path):
    docs = frame("one MATCH\ntwo\nMATCH MATCH\n")
    records = [json.loads(r.record) for r in report.json_report(docs, Search("MATCH"), Report(form="json")).orderBy("doc", "phase", "line_no").collect()]
    assert [r["type"] for r in records] == ["begin", "match", "match", "end"]
    assert [len(r["data"]["submatches"]) for r in records[1:3]] == [1, 2]
    vim = [r.text for r in render.vimgrep(docs, Search("MATCH")).orderBy("line_no", "text").collect()]
    assert vim == ["0:1:5:one MATCH", "0:3:1:MATCH MATCH", "0:3:7:MATCH MATCH"]
    text = [r.text for r in render.text_lines(docs, Search("two"), 1, 0).orderBy("line_no").collect()]
    assert text == ["0-1-one MATCH", "0:2:two"]
    short = frame("áéíóú").select(render.trimmed("text", 3).alias("a"), render.trimmed("text", 3, unicode=False).alias("b")).first()
    assert (short.a, short.b) == ("áéí [...]", "á [...]")
    target = tmp_path / "f"
    target.write_bytes(b"old")
    target.chmod(0o640)
    render.replace_file(str(target), b"new")
    assert target.read_bytes() == b"new" and target.stat().st_mode & 0o777 == 0o640
    os.link(target, tmp_path / "second")
    os.symlink(target, tmp_path / "link")
    render.replace_file(str(tmp_path / "link"), b"newer")
    assert (tmp_path / "second").read_bytes() == b"newer" and (tmp_path / "link").is_symlink()
    render.replace_file("/dev/null", b"x")
    render.create_file(str(tmp_path / "fresh"), b"1")
    with pytest.raises(FileExistsError):
        render.create_file(str(tmp_path / "fresh"), b"2")
    assert (tmp_path / "fresh").read_bytes() == b"1" and not list(tmp_path.glob(".weft-*"))
    assert render.status_of(docs) == render.Status.FOUND and render.status_of(docs.limit(0)) == render.Status.NONE


@pytest.mark.parametrize("bad", [
    dict(show="all"), dict(form="xml"), dict(fields=("size",)), dict(show="count", fields=("line_numbers",)), dict(show="files", heading=True), dict(show="files_without", trim=3), dict(show="count", before=1),
    dict(form="json", heading=True), dict(form="json", trim=9), dict(form="json", colour=True), dict(form="json", fields=("byte_offset",)), dict(form="vimgrep", fields=("line_hashes",)), dict(form="vimgrep", heading=True),
    dict(fields=("file_hash",)), dict(hash_width=5), dict(quiet=True, most=3), dict(before=-1), dict(most=0), dict(trim=0),
])
def test_reports_refuse_what_excludes_itself(bad):
    with pytest.raises(ValueError):
        Report(**bad)


def test_reports(frame):
    docs = frame("one\nAß two ass\nthree\n")
    search = Search("SS", ignore_case=True)
    told = lambda **kw: [r.text for r in report.text_report(docs, search, Report(**kw)).orderBy("doc", "line_no", "part").collect()]
    assert told(colour=True, paths=False) == ["A\x1b[1;31mß\x1b[0m two a\x1b[1;31mss\x1b[0m"]
    assert told(show="matches", fields=("column_numbers", "line_numbers")) == ["0:2:2:ß", "0:2:9:ss"]
    assert told(fields=("line_numbers", "column_numbers", "byte_offset"), before=1) == ["0-1-0-one", "0:2:2:4:Aß two ass"]
    assert told(heading=True, fields=("file_hash",))[0].startswith("0  ") and told(show="count") == ["0:1"] and told(show="files") == ["0"]
    for s, r in ((Search("a", invert=True), Report(show="matches")), (Search("a", multiline=True), Report(fields=("column_numbers",)))):
        with pytest.raises(ValueError):
            report.text_report(docs, s, r)
    capped = report.text_report(frame("k\nk\nk\n"), Search("k"), Report(most=2, after=1)).collect()
    assert sorted(r.text for r in capped) == ["0-k", "0:k", "0:k"]


def test_count_tree(spark):
    c = spark.createDataFrame([("a/x", 1200), ("a/y", 3), ("b", 10)], "doc string, bytes bigint")
    assert [r.text for r in report.count_tree(c).orderBy("path").collect()] == ["1,203  a/", "1,200    x", "    3    y", "   10  b"]
    assert [r.text for r in report.count_tree(c.filter("doc = 'b'")).collect()] == ["10"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x MATCH\ny\nx MATCH\n")
    stream = streams.read_text(spark, f"file://{tmp_path}/in")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert len(run(streams.find_stream(stream, Search("MATCH")), "found")) == 2
    assert sorted(r.body for r in run(streams.dedup_stream(stream), "unique")) == ["x MATCH", "y"]
    assert run(streams.count_stream(stream), "counted", "complete")[0].words == 5
    with pytest.raises(ValueError):
        streams.refuse_stream(stream, "sorting")


def test_catalogue_is_whole():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 60


def test_entry_without_the_llm_folders(tmp_path):
    """The entry module and the text operators stand when weft/llm and corpus_pipeline.py are gone."""
    import shutil

    shutil.copytree(f"{ROOT}/weft", tmp_path / "weft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'find_lines' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
