"""Structural outlines of Markdown and C sources: one row for each element of a document."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKDOWN, C = "markdown", "c"
EXTENSIONS = {"md": MARKDOWN, "markdown": MARKDOWN, "c": C, "h": C}
#: What each level of detail shows.
DETAILS = {
    "headings": {"heading", "include", "function_declaration", "function_definition"},
    "positions": {"heading", "include", "function_declaration", "function_definition", "code_block", "image"},
    "blocks": {"heading", "include", "function_declaration", "function_definition", "code_block", "image", "table", "blockquote", "paragraph"},
}
ELEMENT = "array<struct<kind: string, text: string, level: int, line_number: long, line_count: long, byte_offset: long, byte_length: long, parent_line: long>>"
KEYWORDS = frozenset("if for while switch do else return sizeof case goto typedef struct union enum".split())
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*(\S*)")
IMAGE = re.compile(r"\s*!\[([^\]]*)\]\([^)]*\)")
INCLUDE = re.compile(r"\s*#\s*include\s*(<[^>]+>|\"[^\"]+\")")
FUNCTION = re.compile(r"([A-Za-z_][\w\s*&:<>,~]*?[\s*&])([A-Za-z_~][\w:~]*)\s*\(([^;{}]*)\)\s*(?:const|noexcept|override)?\s*$", re.S)


def language_of(path: Column | str) -> Column:
    """markdown or c by a path's extension, else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def _lines(text: str) -> list[tuple[int, str]]:
    """(byte offset, line without terminator)."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line.removesuffix("\r")))
        at += len(line.encode()) + 1
    if out and out[-1][1] == "":
        out.pop()
    return out


def _kind(line: str) -> tuple[str, str, int]:
    """What a line outside a fence is: kind, text, level."""
    if m := HEADING.match(line):
        return "heading", (m[2] or "").strip(), len(m[1])
    if m := IMAGE.match(line):
        return "image", m[1], 0
    bare = line.lstrip(" ") if len(line) - len(line.lstrip(" ")) <= 3 else line
    if bare.startswith(">"):
        return "blockquote", "", 0
    if "|" in bare:
        return "table", "", 0
    return ("blank", "", 0) if not bare.strip() else ("paragraph", "", 0)


def markdown(text: str) -> list[dict]:
    """Headings and, under the last of them, code blocks, images, quotes, tables and paragraphs."""
    rows, end_of_text = _lines(text), len(text.encode())
    out: list[dict] = []
    parent = None

    def add(kind: str, words: str, first: int, last: int, level: int = 0) -> None:
        start = rows[first][0]
        end = rows[last][0] + len(rows[last][1].encode())
        if kind in ("paragraph", "table", "blockquote"):
            end = rows[last + 1][0] if last + 1 < len(rows) else end_of_text
        out.append({"kind": kind, "text": words, "level": level, "line_number": first + 1, "line_count": last - first + 1, "byte_offset": start, "byte_length": end - start, "parent_line": None if kind == "heading" else parent})

    k = 0
    while k < len(rows):
        if m := FENCE.match(rows[k][1]):
            # the same character closes; without a close nothing is an element to the end
            close = next((j for j in range(k + 1, len(rows)) if (f := FENCE.match(rows[j][1])) and f[1][0] == m[1][0]), None)
            if close is None:
                break
            add("code_block", m[2], k, close)
            k = close + 1
            continue
        kind, words, level = _kind(rows[k][1])
        last = k
        if kind in ("paragraph", "table", "blockquote"):
            while last + 1 < len(rows) and _kind(rows[last + 1][1])[0] == kind and not FENCE.match(rows[last + 1][1]):
                last += 1
        if kind != "blank":
            add(kind, words, k, last, level)
        if kind == "heading":
            parent = k + 1
        k = last + 1
    return out


def _masked(text: str) -> str:
    """C source with comments and the insides of literals as spaces; line feeds stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", blank, text, flags=re.S)


def c_source(text: str) -> list[dict]:
    """Includes, function declarations and definitions at the outermost level."""
    rows = _lines(text)
    out: list[dict] = []
    code = _masked(text)
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    line_at = lambda pos: bisect.bisect_right(starts, pos) - 1
    no_directives = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code)

    def add(kind: str, words: str, first: int, last: int) -> None:
        start = rows[first][0]
        out.append({"kind": kind, "text": words, "level": 0, "line_number": first + 1, "line_count": last - first + 1, "byte_offset": start, "byte_length": rows[last][0] + len(rows[last][1].encode()) - start, "parent_line": None})

    for k, (_, line) in enumerate(rows):
        if m := INCLUDE.match(line):
            add("include", m[1], k, k)
    depth, begin, head = 0, 0, None
    for m in re.finditer(r"[{};]", no_directives):
        c = m[0]
        if c == "{":
            if depth == 0:
                head = (begin, no_directives[begin : m.start()])
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                if head and (name := _signature(head[1])):
                    at = head[0] + len(head[1]) - len(head[1].lstrip())
                    add("function_definition", name, line_at(at), line_at(m.start()))
                head, begin = None, m.end()
        elif depth == 0:
            piece = no_directives[begin : m.start()]
            if name := _signature(piece):
                at = begin + len(piece) - len(piece.lstrip())
                add("function_declaration", name, line_at(at), line_at(m.start()))
            begin = m.end()
    return sorted(out, key=lambda e: (e["line_number"], e["byte_offset"]))


def _signature(piece: str) -> str | None:
    """A function's signature in one line, or None for control words, macros and what is none."""
    m = FUNCTION.search(piece.strip())
    if not m or "=" in m[1] or m[2] in KEYWORDS or (m[2].isupper() and len(m[2]) > 1) or m[1].split()[0] in KEYWORDS - {"struct", "union", "enum"}:
        return None
    return " ".join(piece.split())


def _elements(text: Column | str, language: Column) -> Column:
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        made = {MARKDOWN: markdown, C: c_source}
        return pd.Series([made[n](t or "") if n in made else [] for t, n in zip(texts, languages)])

    return F.pandas_udf(run, ELEMENT)(text, language)


def outline(docs: DataFrame, language: str | None = None, detail: str = "blocks") -> DataFrame:
    """doc and its elements. The language is given, or follows from the extension of doc; others have none."""
    if language is not None and language not in (MARKDOWN, C):
        raise ValueError(f"language is {MARKDOWN} or {C}, not {language!r}")
    if detail not in DETAILS:
        raise ValueError(f"detail is one of {sorted(DETAILS)}")
    name = F.lit(language) if language else language_of(F.col("doc").cast("string"))
    rows = docs.select("doc", F.explode(_elements("text", name)).alias("e")).select("doc", "e.*")
    return rows.filter(F.col("kind").isin(*sorted(DETAILS[detail])))
