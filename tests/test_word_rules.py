"""Words against the boundary rules, applied one by one to every place of a text."""

import random
import time

import regex

from weft.operators import segment

KINDS = "CR LF Newline Extend ZWJ Format Katakana Hebrew_Letter ALetter Single_Quote Double_Quote MidNumLet MidLetter MidNum Numeric ExtendNumLet Regional_Indicator WSegSpace".split()
CLASSES = {k: regex.compile(rf"\p{{Word_Break={k}}}") for k in KINDS}
PICTURE = regex.compile(r"\p{Extended_Pictographic}")


def kind(c):
    return next((k for k, p in CLASSES.items() if p.match(c)), "Other")


def breaks(text, at):
    kinds = [kind(c) for c in text]
    a, b = kinds[at - 1], kinds[at]
    if a == "CR" and b == "LF":
        return False
    if {a, b} & {"Newline", "CR", "LF"}:
        return True
    if a == "ZWJ" and PICTURE.match(text[at]):
        return False
    if a == b == "WSegSpace":
        return False
    if b in ("Extend", "Format", "ZWJ"):
        return False
    # from here on what is attached to a character isn't seen
    left = [k for n, k in enumerate(kinds[:at]) if k not in ("Extend", "Format", "ZWJ") or n == 0 or kinds[n - 1] in ("Newline", "CR", "LF")]
    right = [k for k in kinds[at:] if k not in ("Extend", "Format", "ZWJ")]
    a, b, before, after = left[-1], right[0], left[-2] if len(left) > 1 else "", right[1] if len(right) > 1 else ""
    letters, middle = ("ALetter", "Hebrew_Letter"), ("MidLetter", "MidNumLet", "Single_Quote")
    numbers = ("MidNum", "MidNumLet", "Single_Quote")
    together = [
        a in letters and b in letters, a in letters and b in middle and after in letters, before in letters and a in middle and b in letters, a == "Hebrew_Letter" and b == "Single_Quote",
        a == "Hebrew_Letter" and b == "Double_Quote" and after == "Hebrew_Letter", before == "Hebrew_Letter" and a == "Double_Quote" and b == "Hebrew_Letter",
        a in (*letters, "Numeric") and b == "Numeric", a == "Numeric" and b in letters, before == "Numeric" and a in numbers and b == "Numeric", a == "Numeric" and b in numbers and after == "Numeric",
        a == b == "Katakana", a in (*letters, "Numeric", "Katakana", "ExtendNumLet") and b == "ExtendNumLet", a == "ExtendNumLet" and b in (*letters, "Numeric", "Katakana"),
    ]
    if any(together):
        return False
    if a == b == "Regional_Indicator":
        flags = 0
        while flags < len(left) and left[-1 - flags] == "Regional_Indicator":
            flags += 1
        return flags % 2 == 0
    return True


def plain_words(text):
    cuts = [0, *(k for k in range(1, len(text)) if breaks(text, k)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def test_words_follow_the_rules():
    rng = random.Random(5)
    pieces = ["a", "B", "é", "1", "2", ".", ",", "'", ":", '"', "_", " ", " ", "\n", "\r", "\r\n", "́", "‍", "\xad", "😀", "❤", "️", "ア", "ー", "日", "א", "ב", "🇩", "🇪", "’", ";", "-", "·", "\x85", "　"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        assert segment.words(text) == plain_words(text), repr(text)


def test_words_of_a_text_without_line_ends_take_time_in_proportion():
    def seconds(n):
        began = time.process_time()
        assert len(segment.words("ab cd " * n)) == 4 * n
        return time.process_time() - began

    seconds(100)
    assert seconds(100_000) < 30 * max(seconds(10_000), 0.02)
