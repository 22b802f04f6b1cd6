"""Typo-tolerant search for several queries at once, ranked by BM25.

The driver turns the queries into a vocabulary of weighted variants. A line matches if it holds any
variant as a substring. Scoring is a join for a small vocabulary and an automaton in Arrow batches for a
large one; spans are looked for in lines that matched alone.
"""

from __future__ import annotations

import re
import unicodedata
from enum import IntEnum
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.lines import LF, UNICODE, numbered_lines

K1, B = 1.2, 0.75
#: Weight of a variant by its last edit, before it is divided by one plus the number of edits.
WEIGHTS = {"exact": 1.0, "recorded": 0.95, "transposition": 0.9, "substitution": 0.8, "insertion": 0.7, "deletion": 0.6}
#: The keys of layouts, row by row; a key's neighbours are those beside it and above and below.
LAYOUTS = {
    "us": ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"),
    "de": ("1234567890ß", "qwertzuiopü+", "asdfghjklöä#", "yxcvbnm,.-"),
    "fr": ("&é\"'(-è_çà)=", "azertyuiop^$", "qsdfghjklmù*", "wxcvbn,;:!"),
    "ru": ("1234567890-=", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю."),
    "el": ("1234567890-=", ";ςερτυθιοπ[]", "ασδφγηξκλ΄'", "ζχψωβνμ,./"),
    "he": ("1234567890-=", "/'קראטוןםפ][", "שדגכעיחלךף,", "זסבהנמצתץ."),
    "ar": ("1234567890-=", "ضصثقفغعهخحجد", "شسيبلاتنمكط", "ئءؤرىةوزظ"),
    "ko": ("1234567890-=", "ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔ[]", "ㅁㄴㅇㄹㅎㅗㅓㅏㅣ;'", "ㅋㅌㅊㅍㅠㅜㅡ,./"),
}
#: Misspellings that people are known to make, and what they mean.
MISSPELLINGS = {
    "recieve": "receive", "seperate": "separate", "definately": "definitely", "occured": "occurred", "untill": "until",
    "wich": "which", "teh": "the", "adress": "address", "accomodate": "accommodate", "begining": "beginning",
    "beleive": "believe", "calender": "calendar", "collegue": "colleague", "commited": "committed", "enviroment": "environment",
    "existance": "existence", "foriegn": "foreign", "goverment": "government", "gaurd": "guard", "happend": "happened",
    "immediatly": "immediately", "independant": "independent", "knowlege": "knowledge", "liason": "liaison", "maintainance": "maintenance",
    "neccessary": "necessary", "noticable": "noticeable", "occassion": "occasion", "publically": "publicly", "reccomend": "recommend",
    "refered": "referred", "succesful": "successful", "suprise": "surprise", "tommorow": "tomorrow", "truely": "truly",
    "wierd": "weird", "writting": "writing", "color": "colour", "flavor": "flavour", "gray": "grey",
}
#: Named foldings: what they rewrite. Latin-ASCII further drops all combining marks.
FOLDS = {
    "Latin-ASCII": {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i"},
    "Cyrillic-Latin": dict(zip("абвгдезийклмнопрстуфхцэы", ["a", "b", "v", "g", "d", "e", "z", "i", "j", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "e", "y"])) | {"ё": "e", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""},
    "Greek-Latin": dict(zip("αβγδεζηικλμνξοπρσςτυφω", ["a", "v", "g", "d", "e", "z", "i", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "y", "f", "o"])) | {"θ": "th", "χ": "ch", "ψ": "ps"},
    "Latin-Phonetic": {"ph": "f", "ck": "k", "q": "k", "c": "k", "g": "k", "z": "s", "y": "i", "v": "f", "w": "f", "gh": "k", "kh": "k", "dh": "d", "th": "t"},
}
#: Sounds of the letters that a Hangul syllable is made of: first consonants, vowels, last consonants.
HANGUL = ("g kk n d tt r m b pp s ss - j jj ch k t p h".split(), "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(), "- k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split())


def _syllables() -> dict[str, str]:
    """Hangul syllables, which stand in the order of their letters."""
    first, vowel, last = HANGUL
    return {chr(0xAC00 + n): (first[n // 588] + vowel[n % 588 // 28] + last[n % 28]).replace("-", "") for n in range(11172)}


def _kana() -> dict[str, str]:
    """Hiragana and Katakana by the syllables in their Unicode names."""
    names = {c: unicodedata.name(c, "") for c in map(chr, range(0x3041, 0x30FB))}
    return {c: n.rsplit(" ", 1)[1].lower() for c, n in names.items() if " LETTER " in n} | {"ー": ""}


def _wide() -> dict[str, str]:
    """Full-width forms of ASCII."""
    return {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {"\u3000": " "}


FOLDS |= {
    "Hangul-Latin": _syllables(),
    "Kana-Latin": _kana(),
    "Fullwidth-ASCII": _wide(),
    "Hebrew-Latin": dict(zip("אבגדהוזחטיכלמנסעפצקרשתךםןףץ", ["", "b", "g", "d", "h", "v", "z", "h", "t", "i", "k", "l", "m", "n", "s", "", "p", "ts", "k", "r", "sh", "t", "k", "m", "n", "p", "ts"])),
    "Arabic-Latin": dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", ["a", "b", "t", "th", "j", "h", "kh", "d", "dh", "r", "z", "s", "sh", "s", "d", "t", "z", "", "gh", "f", "q", "k", "l", "m", "n", "h", "w", "y"])) | {"ة": "h", "ى": "a", "أ": "a", "إ": "i", "آ": "a", "ؤ": "w", "ئ": "y", "ء": ""},
}
SCRIPT_FOLDS = ("Fullwidth-ASCII", "Cyrillic-Latin", "Greek-Latin", "Hangul-Latin", "Kana-Latin", "Hebrew-Latin", "Arabic-Latin", "Latin-ASCII", "Latin-Phonetic")
SPAN = "array<struct<start: long, end: long, match: string>>"


class Effort(IntEnum):
    """How hard the search tries; each step finds what those before it find."""

    EXACT, TYPOS, SPELLING, ACCENTS, SOUNDS, SCRIPTS, DEEP = range(7)

    @property
    def edits(self) -> int:
        return {Effort.EXACT: 0, Effort.DEEP: 2}.get(self, 1)

    @property
    def folds(self) -> tuple[str, ...]:
        if self >= Effort.SCRIPTS:
            return SCRIPT_FOLDS
        return {Effort.ACCENTS: ("Latin-ASCII",), Effort.SOUNDS: ("Latin-ASCII", "Latin-Phonetic")}.get(self, ())


def script_layout(query: str) -> str:
    """The layout that most letters of a query are on."""
    names = [unicodedata.name(c, "") for c in query if c.isalpha()]
    for start, layout in (("CYRILLIC", "ru"), ("GREEK", "el"), ("HEBREW", "he"), ("ARABIC", "ar"), ("HANGUL", "ko")):
        if sum(n.startswith(start) for n in names) * 2 > len(names):
            return layout
    return "us"


def neighbours(layout: str) -> dict[str, str]:
    """For each key the keys beside it on a layout."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; there are {sorted(LAYOUTS)}")
    at = {c: (x, y) for y, row in enumerate(LAYOUTS[layout]) for x, c in enumerate(row)}
    return {c: "".join(sorted(d for d, (u, v) in at.items() if d != c and abs(v - y) <= 1 and abs(u - x) <= 1)) for c, (x, y) in at.items()}


def one_edit_away(word: str, alphabet: str, near: dict[str, str] | None = None):
    """(variant, edit) of all words one edit from a word: with any letter of the alphabet, or with ``near`` a neighbour of the key meant."""
    keys = (lambda meant: alphabet) if near is None else (lambda meant: near.get(meant, ""))
    for head, tail in ((word[:k], word[k:]) for k in range(len(word) + 1)):
        # the key meant is the next one, and behind the word its last
        yield from ((head + c + tail, "insertion") for c in keys(tail[:1] or head[-1:]))
        if tail:
            yield head + tail[1:], "deletion"
            yield from ((head + c + tail[1:], "substitution") for c in keys(tail[0]))
        if tail[1:]:
            yield head + tail[1] + tail[0] + tail[2:], "transposition"


def vocabulary(queries: list[str], effort: Effort = Effort.TYPOS, max_distance: int | None = None, layout: str | None = None, dictionary: dict[str, str] | None = None, most: int = 2_000_000) -> dict[str, float]:
    """Variants of all queries and their weights; the best weight of several. Empty variants don't enter."""
    found: dict[str, float] = {}
    distance = effort.edits if max_distance is None else max_distance
    known = MISSPELLINGS if dictionary is None else dictionary
    for query in queries:
        if not query:
            raise ValueError("an empty query matches everywhere")
        keys = layout or script_layout(query)
        near = neighbours(keys) if effort == Effort.TYPOS else None
        alphabet = "".join(sorted({c for row in LAYOUTS[keys] for c in row if c.isalpha()} | set("0123456789")))
        found[query] = max(found.get(query, 0), WEIGHTS["exact"])
        if effort >= Effort.SPELLING:
            for wrong, right in known.items():
                if right == query:
                    found[wrong] = max(found.get(wrong, 0), WEIGHTS["recorded"] / 2)
        ring = {query}
        for step in range(1, distance + 1):
            following: set[str] = set()
            for word in ring:
                for variant, edit in one_edit_away(word, alphabet, near):
                    if variant and variant != query:
                        following.add(variant)
                        found[variant] = max(found.get(variant, 0), WEIGHTS[edit] / (1 + step))
                if len(found) > most:
                    raise ValueError(f"more than {most} variants; ask for fewer edits or queries")
            ring = following
    return found


def fold_names(names) -> tuple[str, ...]:
    if unknown := set(names) - set(FOLDS):
        raise ValueError(f"unknown folds: {sorted(unknown)}; there are {sorted(FOLDS)}")
    return tuple(names)


def folded(text: str, folds=(), ignore_case: bool = True) -> tuple[str, list[int]]:
    """A text through case folding and the named folds, with the source place of each character and the end's."""
    places = list(range(len(text) + 1))

    def through(t: str, old: list[int], rewrite) -> tuple[str, list[int]]:
        out, at = [], []
        for k, size, new in rewrite(t):
            out.append(new)
            at += [old[k]] * len(new)
        return "".join(out), at + [old[-1]]

    if ignore_case:
        text, places = through(text, places, lambda t: ((k, 1, c.casefold()) for k, c in enumerate(t)))
    for name in folds:
        table = FOLDS[name]
        longest = max(map(len, table))

        def rewrite(t: str, table=table, longest=longest, marks=name == "Latin-ASCII"):
            k = 0
            while k < len(t):
                for size in range(min(longest, len(t) - k), 0, -1):
                    if t[k : k + size] in table:
                        yield k, size, table[t[k : k + size]]
                        k += size
                        break
                else:
                    plain = "".join(c for c in unicodedata.normalize("NFKD", t[k]) if not unicodedata.combining(c)) if marks else t[k]
                    yield k, 1, plain
                    k += 1

        text, places = through(text, places, rewrite)
    return text, places


@lru_cache(maxsize=64)
def _fused(folds: tuple[str, ...]) -> list:
    """Steps that do what the named folds do one after another: runs of tables of single characters are one table.

    A later table of a run folds what the earlier ones made of a character, and what they leave.
    """
    steps: list = []
    for name in folds:
        table = FOLDS[name]
        if name == "Latin-ASCII" or max(map(len, table)) > 1:
            longest = "|".join(map(re.escape, sorted(table, key=len, reverse=True)))
            steps.append((re.compile(longest), table, name == "Latin-ASCII"))
        elif steps and isinstance(steps[-1], dict):
            made = {c: new.translate(str.maketrans(table)) for c, new in steps[-1].items()}
            steps[-1] = table | made
        else:
            steps.append(dict(table))
    return [str.maketrans(x) if isinstance(x, dict) else x for x in steps]


def folded_text(text: str, folds=(), ignore_case: bool = True) -> str:
    """The text of ``folded``, without the places."""
    text = text.casefold() if ignore_case else text
    for step in _fused(tuple(folds)):
        if isinstance(step, dict):
            text = text if text.isascii() else text.translate(step)
            continue
        pattern, table, marks = step
        if marks and text.isascii():
            continue
        text = pattern.sub(lambda m, table=table: table[m[0]], text)
        if marks and not text.isascii():
            text = "".join(c if c.isascii() else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in text)
    return text


def _folder(folds, ignore_case: bool):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([folded_text(t or "", folds, ignore_case) for t in text])

    return run


SMALL = 64
#: What lower case would make two characters of, or another one at a word's end.
ONE_BY_ONE = ("İΣ", "iσ")


def score(spark: SparkSession, docs: DataFrame, queries: list[str], effort: Effort = Effort.TYPOS, ignore_case: bool = True, min_score: float = 0.0, unicode: bool = False, folds=None, simple: bool = False, **options) -> DataFrame:
    """Matched lines with their BM25: doc, line_no, line, score.

    A line's length is its bytes with the terminator, over the mean of its document. A term counts as often
    as it stands in the line, overlaps included. Only scores above 0 match. With ``simple`` case is ignored character by
    character (a sharp s is no ss), so that a match never begins or ends inside what one character folds to.
    """
    names = effort.folds if folds is None else fold_names(folds)
    lowered = lambda q: q.translate(str.maketrans(*ONE_BY_ONE)).lower() if simple else q
    words = vocabulary([folded_text(lowered(q), names, ignore_case and not simple) for q in queries], effort, **options)
    newlines = UNICODE if unicode or ignore_case else LF
    # the sizes of all lines of a document are those of its text
    rows = numbered_lines(docs.withColumn("total", F.octet_length("text")), newlines, carry=("total",))
    rows = rows.withColumn("size", (F.octet_length("as_cut") + F.octet_length("terminator")).cast("double")).withColumn("mean", F.col("total") / F.col("n_lines"))
    target = F.lower(F.translate("as_cut", *ONE_BY_ONE)) if simple else F.col("as_cut")
    if names or (ignore_case and not simple):
        target = _folder(names, ignore_case and not simple)(target)
    rows = rows.withColumn("target", target)
    if len(words) <= SMALL:
        needles = spark.createDataFrame([(w, float(x)) for w, x in words.items()], "needle string, weight double")
        # at most SMALL needles: every line meets each
        tf = F.regexp_count("target", F.concat(F.lit("(?=\\Q"), F.replace("needle", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)")))
        hit = rows.join(F.broadcast(needles), F.contains("target", F.col("needle"))).withColumn("tf", tf.cast("double"))
        hit = hit.groupBy("doc", "line_no", F.col("body").alias("line"), "size", "mean").agg(F.collect_list(F.struct("weight", "tf")).alias("terms"))
    else:
        ball = spark.sparkContext.broadcast(words)

        @F.pandas_udf("array<struct<weight: double, tf: double>>")
        def count(text: pd.Series) -> pd.Series:
            scan = _automaton(ball.value)
            out = []
            for t in text:
                seen: dict[str, int] = {}
                for _, needle in scan.iter(t or ""):
                    seen[needle] = seen.get(needle, 0) + 1
                out.append([{"weight": ball.value[w], "tf": float(n)} for w, n in sorted(seen.items())])
            return pd.Series(out)

        hit = rows.withColumn("terms", count("target")).filter(F.size("terms") > 0).select("doc", "line_no", F.col("body").alias("line"), "size", "mean", "terms")
    norm = F.when(F.col("mean") > 0, 1 - B + B * F.col("size") / F.col("mean")).otherwise(1.0)
    total = F.aggregate(F.array_sort("terms"), F.lit(0.0), lambda a, t: a + t["weight"] * t["tf"] * (K1 + 1) / (t["tf"] + K1 * norm))
    found = hit.withColumn("score", total).filter((F.col("score") > 0) & (F.col("score") >= min_score))
    return found.select("doc", "line_no", "line", "score")


def _automaton(words):
    import ahocorasick

    # kept by what is in it: another vocabulary may come to live at the same place
    if _KEPT.get("words") is not words and _KEPT.get("words") != words:
        scan = ahocorasick.Automaton()
        for w in words:
            scan.add_word(w, w)
        scan.make_automaton()
        _KEPT.update(words=words, scan=scan)
    return _KEPT["scan"]


_KEPT: dict = {}


def locate(scored: DataFrame, queries: list[str], effort: Effort = Effort.TYPOS, ignore_case: bool = True, folds=None, **options) -> DataFrame:
    """Spans of the variants in lines of ``score``: doc, line_no, start, end (bytes), match; leftmost, then longest."""
    names = effort.folds if folds is None else fold_names(folds)
    words = vocabulary([folded_text(q, names, ignore_case) for q in queries], effort, **options)
    ball = scored.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(SPAN)
    def run(text: pd.Series) -> pd.Series:
        scan, out = _automaton(ball.value), []
        for t in text:
            plain, places = folded(t or "", names, ignore_case)
            every = sorted((end - len(w) + 1, -(end + 1)) for end, w in scan.iter(plain))
            one, free = [], 0
            for a, b in every:
                if a >= free:
                    free = -b
                    x, y = places[a], places[-b - 1] + 1
                    start = len(t[:x].encode())
                    one.append({"start": start, "end": start + len(t[x:y].encode()), "match": t[x:y]})
            out.append(one)
        return pd.Series(out)

    return scored.select("doc", "line_no", F.explode(run("line")).alias("m")).select("doc", "line_no", "m.start", "m.end", "m.match")


def counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("doc").agg(F.count("*").alias("count"))


def files(scored: DataFrame) -> DataFrame:
    return scored.select("doc").distinct()


def files_without(docs: DataFrame, scored: DataFrame) -> DataFrame:
    return docs.select("doc").join(scored.select("doc").distinct(), "doc", "left_anti")


def summary(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: files_searched, files_matched, lines."""
    found = scored.agg(F.countDistinct("doc").alias("files_matched"), F.count("*").alias("lines"))
    # two tables of one row
    return docs.agg(F.count("*").alias("files_searched")).crossJoin(F.broadcast(found))
