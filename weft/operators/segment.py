"""Segments of texts by Unicode rules.

Graphemes, words, sentences and line breaks tile a text; whitespace, delimiters and newlines are splitters
that drop what separates. Splitters are native; the tilers run over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weft.functions.lines import TERMINATOR, UNICODE

TILERS = ("graphemes", "words", "sentences", "linebreaks")
#: What separates, in Java's syntax.
SPLITTERS = {"whitespace": r"[\s\x0B\x{85}\p{Z}]", "delimiters": r"[\p{P}\p{S}\p{Z}\s\x0B\x{85}]", "newlines": f"(?:{TERMINATOR[UNICODE]})"}

#: Property values that the sentence and line break rules speak of.
SENTENCE = "CR LF Sep Extend Format Sp Lower Upper OLetter Numeric ATerm SContinue STerm Close".split()
LINE = "BK CR LF NL SP ZW ZWJ CM WJ GL BA HY B2 BB CL CP EX IN IS NS NU OP PO PR QU SY AL HL ID EB EM H2 H3 JL JV JT RI CB SA AI CJ SG XX".split()


def _classes(name: str, values: list[str]):
    found = {v: regex.compile(rf"\p{{{name}={v}}}") for v in values}

    @lru_cache(maxsize=65536)
    def of(c: str) -> str:
        return next((v for v, p in found.items() if p.match(c)), "Other")

    return of


_sb, _lb = _classes("Sentence_Break", SENTENCE), _classes("Line_Break", LINE)


def graphemes(text: str) -> list[str]:
    # below the first combining mark only CR LF joins characters
    if "\r" not in text and (text.isascii() or max(text) < "\u0300"):
        return list(text)
    return regex.findall(r"\X", text)


@lru_cache(maxsize=1)
def _word_pattern():
    """One segment between default word boundaries, as a pattern of word-break classes; no part of it is read twice."""
    one = lambda *names: "[" + "".join(rf"\p{{Word_Break={n}}}" for n in names) + "]"
    tail = one("Extend", "Format", "ZWJ") + "*+"  # belongs to what it follows (WB4)
    letter = one("ALetter", "Hebrew_Letter")
    hebrew, digit = one("Hebrew_Letter"), one("Numeric")
    # what stands between two letters, or two digits, holds them together (WB6, WB7, WB11, WB12)
    in_word = one("MidLetter", "MidNumLet", "Single_Quote") + tail + f"(?={letter})"
    in_number = one("MidNum", "MidNumLet", "Single_Quote") + tail + f"(?={digit})"
    # WB7b, WB7c; and WB7a, behind which nothing goes on
    quoted = f"{one('Double_Quote')}{tail}(?={hebrew})"
    last_quote = f"(?:(?<={hebrew}{tail[:-1]}){one('Single_Quote')}{tail})?+"
    group = f"(?:{one('ALetter')}{tail}(?:{in_word})?+|{hebrew}{tail}(?:{in_word}|{quoted})?+|{digit}{tail}(?:{in_number})?+)++"
    kana, joiner = f"(?:{one('Katakana')}{tail})++", f"(?:{one('ExtendNumLet')}{tail})"
    # WB13a, WB13b
    run = f"{joiner}*+(?:{group}|{kana})(?:{joiner}++(?:{group}|{kana}))*+{joiner}*+{last_quote}|{joiner}++"
    flag = one("Regional_Indicator")
    ends = rf"\r\n|[\r\n{one('Newline')[1:-1]}]"
    # WB3c: a pictograph behind a joiner goes on
    picture = rf"(?:(?<={one('ZWJ')})\p{{Extended_Pictographic}}{tail})*+"
    return regex.compile(f"(?s){ends}|(?:{run}|{one('WSegSpace')}++{tail}|{flag}{tail}(?:{flag}{tail})?+|.{tail}){picture}")


#: Texts of these alone are words and spaces in turn.
PLAIN_WORDS, PLAIN_RUNS = re.compile("[A-Za-z0-9_ ]*"), re.compile("[A-Za-z0-9_]+| +")
#: From a space behind a word to a word: what stands beside that decides nothing within it.
PLAIN_STRETCH = re.compile("(?<=[A-Za-z0-9_]) ++(?:[A-Za-z0-9_]++ ++)*(?=[A-Za-z0-9_])")


def _by_stretches(text: str, stretch: re.Pattern, pieces: re.Pattern, other) -> list[str]:
    """Segments of a text whose plain stretches are cut by a plain pattern, and what stands between them by ``other``."""
    out, at = [], 0
    for m in stretch.finditer(text):
        if m.start() > at:
            out += other(text[at : m.start()])
        at = m.end()
        out += pieces.findall(text, m.start(), at)
    return out + other(text[at:]) if at < len(text) else out


def words(text: str) -> list[str]:
    """Segments between default word boundaries; CR LF, and a run of spaces, are one each. In time proportional to a text."""
    if PLAIN_WORDS.fullmatch(text):
        return PLAIN_RUNS.findall(text)
    return _by_stretches(text, PLAIN_STRETCH, PLAIN_RUNS, _word_pattern().findall)


@lru_cache(maxsize=1)
def _sentence_stops():
    """What can end a sentence: a terminator, or a paragraph separator; nothing between these decides anything."""
    return regex.compile(r"[\p{Sentence_Break=ATerm}\p{Sentence_Break=STerm}\p{Sentence_Break=Sep}\r\n]")


@lru_cache(maxsize=1)
def _sentence_tail():
    """Closes, spaces and what is attached to them, behind a terminator."""
    attached = r"[\p{Sentence_Break=Extend}\p{Sentence_Break=Format}]*"
    return regex.compile(rf"{attached}((?:\p{{Sentence_Break=Close}}{attached})*)((?:\p{{Sentence_Break=Sp}}{attached})*)")


@lru_cache(maxsize=1)
def _sentence_goes_on():
    """The next character that tells whether a sentence goes on: a lower-case letter says so."""
    return regex.compile(r"[\p{Sentence_Break=OLetter}\p{Sentence_Break=Upper}\p{Sentence_Break=Lower}\p{Sentence_Break=Sep}\r\n\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}]")


def sentences(text: str) -> list[str]:
    """Sentences by rules SB1 to SB11; nothing knows abbreviations. Only what stands around a terminator is looked at."""
    n, k, begin, out = len(text), 0, 0, []
    stops, tails, goes_on = _sentence_stops(), _sentence_tail(), _sentence_goes_on()
    find, clear = stops.search, ("Extend", "Format")

    def cut(end: int) -> None:
        nonlocal begin
        if end > begin:
            out.append(text[begin:end])
            begin = end

    while m := find(text, k):
        k = m.start()
        kind = _sb(text[k])
        if kind in ("Sep", "CR", "LF"):
            k += 2 if kind == "CR" and text[k + 1 : k + 2] == "\n" else 1
            cut(k)
            continue
        tail = tails.match(text, k + 1)
        # a terminator, then closes, then spaces, then what comes
        first, spaces, j = tail.start(1), tail.start(2), tail.end()
        last = _sb(text[j]) if j < n else ""
        if kind == "ATerm" and first < n:
            after = _sb(text[first])
            before = k - 1
            while before >= 0 and _sb(text[before]) in clear:
                before -= 1
            if after == "Numeric" or (after == "Upper" and before >= 0 and _sb(text[before]) in ("Upper", "Lower")):
                k += 1
                continue
        if last in ("Sep", "CR", "LF"):
            k = j + (2 if last == "CR" and text[j + 1 : j + 2] == "\n" else 1)
            cut(k)
            continue
        if last in ("SContinue", "ATerm", "STerm"):
            k = max(k + 1, spaces if last == "SContinue" else j)
            continue
        if kind == "ATerm" and j < n:
            x = goes_on.search(text, j)
            if x and _sb(x[0]) == "Lower":
                k = j
                continue
        cut(j)
        k = max(j, k + 1)
    cut(n)
    return out


#: Pairs (before, after) that stay together without spaces between, by rules LB12 to LB30b.
TOGETHER = {
    **{(a, b): 1 for a in ("AL", "HL") for b in ("AL", "HL", "NU", "PR", "PO", "OP", "IN", "NS")},
    **{("NU", b): 1 for b in ("NU", "AL", "HL", "PO", "PR", "OP", "IN")},
    **{(a, "NU"): 1 for a in ("PO", "PR", "HY", "IS", "SY", "OP", "CL", "CP")},
    **{(a, b): 1 for a in ("PR", "PO") for b in ("AL", "HL", "OP")},
    **{("PR", b): 1 for b in ("ID", "EB", "EM", "JL", "JV", "JT", "H2", "H3")},
    **{(a, "PO"): 1 for a in ("ID", "EB", "EM", "JL", "JV", "JT", "H2", "H3", "CL", "CP")},
    **{(a, "PR"): 1 for a in ("CL", "CP")},
    **{("JL", b): 1 for b in ("JL", "JV", "H2", "H3")},
    **{(a, b): 1 for a in ("JV", "H2") for b in ("JV", "JT")},
    **{(a, "JT"): 1 for a in ("JT", "H3")},
    **{("IS", b): 1 for b in ("AL", "HL")},
    **{("CP", b): 1 for b in ("AL", "HL", "NU")},
    ("EB", "EM"): 1, ("B2", "B2"): 1, ("SY", "HL"): 1,
}
#: Never begin a line, after spaces or not (LB13); begin none without spaces before (LB21, LB22).
CLOSERS = frozenset("CL CP EX IS SY".split())
LATE = frozenset("BA HY NS IN".split())


#: Texts of these alone break behind each run of spaces.
PLAIN_LINES, PLAIN_PIECES = re.compile("[A-Za-z ]*"), re.compile("[A-Za-z]+ *| +")
#: From a word behind another and a space to a word behind such a space: a line may break at both ends, whatever stands beside them.
PLAIN_BROKEN = re.compile("(?<=[A-Za-z] )(?:[A-Za-z]++ ++)+(?=[A-Za-z])")


def linebreaks(text: str) -> list[str]:
    """Pieces that end where a line may or must break."""
    if PLAIN_LINES.fullmatch(text):
        return PLAIN_PIECES.findall(text)
    return _by_stretches(text, PLAIN_BROKEN, PLAIN_PIECES, _linebreaks)


def _linebreaks(text: str) -> list[str]:
    """As ``linebreaks``, by the rules alone."""
    n = len(text)
    if not n:
        return []
    alias = {"AI": "AL", "SG": "AL", "XX": "AL", "Other": "AL", "SA": "AL", "CJ": "NS"}
    kinds = [alias.get(k, k) for k in map(_lb, text)]
    breaks, base, spaces, flags, before_space = [], None, False, 0, None
    for k in range(n):
        now, last = kinds[k], kinds[k - 1] if k else None
        may = False
        if k:
            if last == "BK" or (last == "CR" and now != "LF") or last in ("LF", "NL"):
                may = True
                base, spaces, flags, before_space = None, False, 0, None
            elif now in ("BK", "CR", "LF", "NL", "SP", "ZW"):
                may = False
            elif before_space == "ZW" or last == "ZW":
                may = True
            elif now in ("CM", "ZWJ") and last != "SP":
                continue
            elif last == "ZWJ":
                may = False
            else:
                left = base
                right = "AL" if now in ("CM", "ZWJ") else now
                if right == "WJ" or left == "WJ" and not spaces:
                    may = False
                elif left == "GL" and not spaces:
                    may = False
                elif right == "GL" and not spaces and left not in ("BA", "HY"):
                    may = False
                elif right in CLOSERS:
                    may = False
                elif left == "OP":
                    may = False
                elif left == "QU" and right == "OP":
                    may = False
                elif left in ("CL", "CP") and right == "NS":
                    may = False
                elif left == "B2" and right == "B2":
                    may = False
                elif spaces:
                    may = True
                elif "QU" in (left, right):
                    may = False
                elif "CB" in (left, right):
                    may = True
                elif right in LATE or left == "BB":
                    may = False
                elif left == "RI" and right == "RI":
                    may = flags % 2 == 0
                else:
                    may = (left, right) not in TOGETHER
        if may:
            breaks.append(k)
        if now == "SP":
            spaces = True
            before_space = base if before_space is None else before_space
        elif now not in ("CM", "ZWJ") or base is None or spaces:
            flags = flags + 1 if now == "RI" and not spaces and base == "RI" else int(now == "RI")
            base = "AL" if now in ("CM", "ZWJ") else now
            spaces, before_space = False, None
    cuts = [0, *breaks, n]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


TILE = {"graphemes": graphemes, "words": words, "sentences": sentences, "linebreaks": linebreaks}


#: Segments, and characters of their texts, of one batch that a task makes.
ROWS, CHARS = 50_000, 4_000_000


def _tiled(by: str, names: list[str]):
    """Rows of segments in batches of a bounded size, however many texts a batch of texts has and however long they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # of each text, or part of one: its row, and the number and first byte of its first segment
            owners, many, pieces, chars = [], [], [], 0

            def made(owners, many, pieces, batch=batch) -> pa.RecordBatch:
                segment = pa.array(pieces, pa.string())
                sizes = pc.binary_length(segment).to_numpy().astype(np.int64)
                many = np.array(many)
                first = np.cumsum(many) - many
                start = np.cumsum(sizes) - sizes
                row, seq, at = (np.repeat(x, many) for x in np.array(owners).T)
                start += at - np.repeat(start[first], many)
                seq += np.arange(len(pieces)) - np.repeat(first, many)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(seq), pa.array(start), pa.array(start + sizes), segment], names)

            for k in range(batch.num_rows):
                segments, at = TILE[by](batch.column(1)[k].as_py() or ""), 0
                for seq in range(0, len(segments), ROWS):
                    part = segments[seq : seq + ROWS]
                    owners.append((k, seq, at))
                    many.append(len(part))
                    pieces += part
                    if seq + ROWS < len(segments):
                        at += len("".join(part).encode())
                    chars += sum(map(len, part))
                    if len(pieces) >= ROWS or chars >= CHARS:
                        yield made(owners, many, pieces)
                        owners, many, pieces, chars = [], [], [], 0
            if pieces:
                yield made(owners, many, pieces)

    return run


def segments(docs: DataFrame, by: str, keep_empty: bool = False) -> DataFrame:
    """doc, seq (from 0), start, end (bytes), segment. ``keep_empty`` is for splitters alone."""
    if by in TILE:
        if keep_empty:
            raise ValueError(f"{by} tile a text and have no empty segments")
        made = StructType([StructField("doc", docs.schema["doc"].dataType), *(StructField(x, LongType()) for x in ("seq", "start", "end")), StructField("segment", StringType())])
        return docs.select("doc", "text").mapInArrow(_tiled(by, made.names), made)
    if by not in SPLITTERS:
        raise ValueError(f"by is one of {(*TILERS, *SPLITTERS)}, not {by!r}")
    # one pass finds segments and separators in turn; sizes sum up to the offsets
    parts, seps = F.split("text", SPLITTERS[by], -1), F.regexp_extract_all("text", F.lit(SPLITTERS[by]), 0)
    sized = docs.select("doc", F.posexplode(F.arrays_zip(parts.alias("part"), F.concat(seps, F.array(F.lit(""))).alias("sep"))).alias("at", "z"))
    from pyspark.sql import Window

    order = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("z.part") + F.octet_length("z.sep")).over(order), F.lit(0)).cast("long")
    rows = sized.withColumn("start", start).withColumn("segment", F.col("z.part"))
    if by == "newlines":
        rows = rows.filter((F.col("segment") != "") | F.lit(keep_empty))
    elif not keep_empty:
        rows = rows.filter(F.col("segment") != "")
    seq = F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1
    return rows.select("doc", seq.cast("long").alias("seq"), "start", (F.col("start") + F.octet_length("segment")).alias("end"), "segment")


def count(docs: DataFrame, by: str, keep_empty: bool = False) -> DataFrame:
    """doc and its number of segments, without a row for each."""
    if by in TILE:

        @F.pandas_udf("long")
        def run(text: pd.Series) -> pd.Series:
            return pd.Series([len(TILE[by](t or "")) for t in text], dtype="int64")

        return docs.select("doc", run("text").alias("segments"))
    if by not in SPLITTERS:
        raise ValueError(f"by is one of {(*TILERS, *SPLITTERS)}, not {by!r}")
    parts = F.split("text", SPLITTERS[by], -1)
    n = F.size(parts) if keep_empty else F.size(F.filter(parts, lambda s: s != ""))
    return docs.select("doc", n.cast("long").alias("segments"))


def packed(docs: DataFrame, by: str, budget: int) -> DataFrame:
    """doc, chunk, bytes, text: tiling segments packed up to a budget, none split, a longer one alone."""
    if by not in TILE:
        raise ValueError(f"only {TILERS} can be packed")
    if budget < 1:
        raise ValueError("a chunk has a byte at least")

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            chunks, now, size = [], [], 0
            for s in TILE[by](t or ""):
                own = len(s.encode())
                if now and size + own > budget:
                    chunks.append("".join(now))
                    now, size = [], 0
                now.append(s)
                size += own
            out.append(chunks + (["".join(now)] if now else []))
        return pd.Series(out)

    rows = docs.select("doc", F.posexplode(run("text")).alias("chunk", "text"))
    return rows.select("doc", F.col("chunk").cast("long"), F.octet_length("text").cast("long").alias("bytes"), "text")
