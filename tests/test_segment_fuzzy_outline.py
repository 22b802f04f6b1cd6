import pytest

from weft.operators import checksum, fuzzy, outline, segment

SEAMS = ["", "q", "ñ東京 🙂day tail\n", "first row\r\nsecond row\r\n", "\t  \n\n \t", "e\u0301u\u200di 東西。", "Prof. Lee left for Oslo.", "p q\u2028r\x85", "🇯🇵🇧🇷 9,876.5%", "«said» [aside] half-done"]


@pytest.mark.parametrize("by", segment.TILERS)
def test_tilers_cover_the_text(frame, by):
    found = segment.segments(frame(*SEAMS), by).orderBy("doc", "seq").collect()
    for k, text in enumerate(SEAMS):
        own = [r for r in found if r.doc == k]
        assert "".join(r.segment for r in own) == text
        assert all(text.encode()[r.start : r.end].decode() == r.segment for r in own)


def test_segments(frame):
    n = lambda text, by, **kw: segment.count(frame(text), by, **kw).first().segments
    assert n("Größe 🙂🇯🇵\n", "graphemes") == 9
    assert n("w\u3000x\u00a0y z\n", "whitespace") == 4
    assert segment.sentences("Prof. Lee left for Oslo.") == ["Prof. ", "Lee left for Oslo."]
    assert segment.linebreaks("foo bar-baz\nx") == ["foo ", "bar-", "baz\n", "x"]
    assert segment.words("can't stop, 3.14") == ["can't", " ", "stop", ",", " ", "3.14"]
    assert n("a  b", "whitespace", keep_empty=True) == 3
    spans = segment.segments(frame("é b\n"), "whitespace").orderBy("seq").collect()
    assert [(r.start, r.end, r.segment) for r in spans] == [(0, 2, "é"), (3, 4, "b")]
    assert [r.segment for r in segment.segments(frame("a\n\nb"), "newlines", keep_empty=True).orderBy("seq").collect()] == ["a", "", "b"]
    with pytest.raises(ValueError):
        segment.segments(frame(""), "words", keep_empty=True)


def test_packed(frame):
    text = "One. Two is longer. Three.\nFour!"
    found = segment.packed(frame(text), "sentences", 12).orderBy("chunk").collect()
    assert "".join(r.text for r in found) == text
    assert all(r.bytes <= 12 or r.text in segment.sentences(text) for r in found)


def test_checksums(spark, frame):
    d = {r.path: r.digest for r in checksum.digests(frame("", "abc")).collect()}
    assert d["0"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    h, odd = d["1"], "a\\\nb"
    rows = spark.createDataFrame([(f"{h}  1",), (f"{h.upper()} *x ) = y\r",), (f"SHA256 (p) = q) = {h}",), (f"\\{h}  a\\\\\\nb",), ("",), ("# no",)], "line string")
    parsed = {r.path: r for r in checksum.parse_manifest(rows).collect()}
    assert {"1", "x ) = y", "p) = q", odd} <= set(parsed)
    assert parsed["x ) = y"].digest == h and sum(r.malformed for r in parsed.values()) == 1
    made = checksum.manifest(spark.createDataFrame([(odd, h)], "path string, digest string"))
    assert checksum.parse_manifest(made).first().path == odd
    claims = checksum.parse_manifest(spark.createDataFrame([(f"{h}  1",), (f"{h}  0",), (f"{h}  gone",)], "line string"))
    verdicts = {r.path: r.verdict for r in checksum.verify(claims, checksum.digests(frame("", "abc"))).collect()}
    assert verdicts == {"1": checksum.OK, "0": checksum.FAILED, "gone": checksum.UNREADABLE}
    assert checksum.outcome(claims, checksum.verify(claims, checksum.digests(frame("", "abc")))) == 1
    good = checksum.parse_manifest(spark.createDataFrame([(f"{h}  1",)], "line string"))
    assert checksum.outcome(good, checksum.verify(good, checksum.digests(frame("", "abc")))) == 0
    assert checksum.outcome(claims.filter("false"), verdicts_of := checksum.verify(claims, checksum.digests(frame("")))) == 2 and verdicts_of is not None


def lines_of(spark, docs, *queries, **kw):
    return {r.line for r in fuzzy.score(spark, docs, list(queries), **kw).collect()}


def test_fuzzy(spark, frame):
    E = fuzzy.Effort
    # a letter left out, a letter doubled, neighbours swapped; one other word
    assert lines_of(spark, frame("Copenhagen\nCopenhagn\nCopennhagen\nCopenahgen\nStockholm\n"), "Copenhagen", effort=E.SPELLING, ignore_case=False) == {"Copenhagen", "Copenhagn", "Copennhagen", "Copenahgen"}
    assert lines_of(spark, frame("room 417\nroom 471\n"), "417", effort=E.EXACT) == {"room 417"}
    assert lines_of(spark, frame("a green door\nits window sill\nroof\n"), "green", "window", effort=E.EXACT) == {"a green door", "its window sill"}
    assert len(lines_of(spark, frame("HARBOUR\nharbour\n"), "harbour", effort=E.EXACT)) == 2
    assert len(lines_of(spark, frame("HARBOUR\nharbour\n"), "harbour", effort=E.EXACT, ignore_case=False)) == 1


def test_fuzzy_ladder_never_narrows(spark, frame):
    docs = frame("gray stone\ngrey stone\nfotograf shop\nphotograf shop\ncafé corner\ncafe corner\nсад\nnothing\n")
    for query in ("gray", "cafe", "fotograf"):
        before = set()
        for effort in fuzzy.Effort:
            now = lines_of(spark, docs, query, effort=effort)
            assert before <= now
            before = now
    assert "café corner" in lines_of(spark, docs, "cafe", effort=fuzzy.Effort.ACCENTS)
    assert "photograf shop" in lines_of(spark, docs, "fotograf", effort=fuzzy.Effort.SOUNDS)
    assert "сад" in lines_of(spark, docs, "sad", effort=fuzzy.Effort.SCRIPTS)


def slow_distance(a, b):
    """Edits of one letter and swaps of neighbours between two words, by the table of all prefixes."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_variants_are_within_their_edits():
    words = fuzzy.vocabulary(["harbour"], fuzzy.Effort.SPELLING)
    assert len(words) > 100 and all(slow_distance("harbour", w) <= 1 for w in words)
    deletions = {"harbour"[:k] + "harbour"[k + 1 :] for k in range(7)}
    swaps = {"harbour"[:k] + "harbour"[k + 1] + "harbour"[k] + "harbour"[k + 2 :] for k in range(6)}
    assert deletions <= set(words) and swaps <= set(words)


def test_folds_in_one_pass_are_the_folds_one_after_another():
    texts = ["Straße ÆON Ǆ", "сад Щука ΨΥΧΗ ς", "한국 서울 값", "カタカナ ひらがな ラーメン", "ＡＢＣ　１２", "שלום עולם", "سلام عالم", "Philosophie quick ghost", "é̂ ﬁ İ", "", "plain ascii"]
    for names in (fuzzy.SCRIPT_FOLDS, ("Latin-ASCII", "Latin-Phonetic"), ("Hangul-Latin",), ("Cyrillic-Latin", "Greek-Latin"), ("Latin-Phonetic", "Fullwidth-ASCII"), ()):
        for case in (True, False):
            for text in texts:
                assert fuzzy.folded_text(text, names, case) == fuzzy.folded(text, names, case)[0]
    assert fuzzy.folded_text("한국 서울", ("Hangul-Latin",)) == "hanguk seoul" and fuzzy.folded_text("さくら サクラ", ("Kana-Latin",)) == "sakura sakura"
    assert fuzzy.folded_text("שלום", ("Hebrew-Latin",)) == "shlvm" and fuzzy.folded_text("سلام", ("Arabic-Latin",)) == "slam" and fuzzy.folded_text("ＡＢ１", ("Fullwidth-ASCII",), False) == "AB1"
    assert [fuzzy.script_layout(x) for x in ("שלום", "سلام", "서울", "word")] == ["he", "ar", "ko", "us"]


def test_automaton_is_that_of_the_words(spark):
    # two vocabularies in one process, one after the other gone
    for words in ({"alpha": 1.0}, {"omega": 1.0}, {"alpha": 1.0, "omega": 0.5}):
        assert {w for _, w in fuzzy._automaton(dict(words)).iter("alpha and omega")} == set(words)


def test_fuzzy_spans_and_words(spark, frame):
    docs = frame("the Café here\n")
    found = fuzzy.locate(fuzzy.score(spark, docs, ["cafe"], fuzzy.Effort.EXACT, folds=["Latin-ASCII"]), ["cafe"], fuzzy.Effort.EXACT, folds=["Latin-ASCII"]).collect()
    assert [(r.start, r.end, r.match) for r in found] == [(4, 9, "Café")]
    words = fuzzy.vocabulary(["abc"], fuzzy.Effort.SPELLING)
    assert words["abc"] == 1.0 and words["ab"] == 0.3 and words["bac"] == 0.45 and "" not in fuzzy.vocabulary(["a"], fuzzy.Effort.SPELLING)
    with pytest.raises(ValueError):
        fuzzy.fold_names(["Han-Latin"])
    assert fuzzy.script_layout("привет") == "ru"


def test_outlines(frame):
    kinds = lambda text, name, **kw: [(r.kind, r.text) for r in outline.outline(frame(text), name, **kw).orderBy("byte_offset").collect()]
    md = "# Harbour\n\nBoats lie here.\n\n## Tides\n\n```sh\nls\n```\n"
    assert kinds(md, "markdown", detail="headings") == [("heading", "Harbour"), ("heading", "Tides")]
    assert kinds(md, "markdown") == [("heading", "Harbour"), ("paragraph", ""), ("heading", "Tides"), ("code_block", "sh")]
    found = outline.markdown("# Top\n\n| h | w |\n| - | - |\n> said\n\nlast\n")
    assert [e["kind"] for e in found] == ["heading", "table", "blockquote", "paragraph"]
    assert all(a["byte_offset"] + a["byte_length"] <= b["byte_offset"] for a, b in zip(found, found[1:]))
    assert {e["parent_line"] for e in found[1:]} == {1}
    last = outline.markdown("# Top\n\nno end")[-1]
    assert last["byte_offset"] + last["byte_length"] == len("# Top\n\nno end")
    assert outline.markdown("~~~\nopen for ever\n# no\n") == []
    c = '#include "boat.h"\n\nint sail(int knots,\n        int wind);\n/* int never(void); */\nint row(void) {\n    if (oars) { say("}"); }\n    return 2;\n}\n'
    assert kinds(c, "c") == [("include", '"boat.h"'), ("function_declaration", "int sail(int knots, int wind)"), ("function_definition", "int row(void)")]
    assert outline.c_source("int half(void) {\n  return 1;\n") == []


def test_many_full_stops_take_time_in_proportion():
    import time

    def seconds(n):
        text = "Mr. " * n
        began = time.perf_counter()
        assert "".join(segment.sentences(text)) == text
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 16 * max(seconds(10_000), 0.02)
