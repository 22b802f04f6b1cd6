"""Content names: the first 64 bits of SHA-256 in thirteen characters of Crockford's base 32.

A name's first n characters pin its leading 5 n bits, so any prefix of a name addresses what has it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL, DEFAULT, LEAST = 13, 8, 4
#: Crockford's digits; the last character carries four bits and a zero.
DIGITS = "0123456789abcdefghjkmnpqrstvwxyz"
LAST = "02468acegjmprtwy"


def content_name(content: Column | str, width: int = FULL) -> Column:
    if not LEAST <= width <= FULL:
        raise ValueError(f"a name has {LEAST} to {FULL} characters, not {width}")
    h = F.sha2(content, 256)
    high = F.translate(F.lpad(F.conv(F.substring(h, 1, 15), 16, 32), 12, "0"), "ABCDEFGHIJKLMNOPQRSTUV", DIGITS[10:])
    low = F.substring(F.lit(LAST), F.conv(F.substring(h, 16, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.substring(F.concat(high, low), 1, width)


def parse_name(name: str, whole: bool = False) -> str:
    """A name or a prefix of one in lower case; ValueError if nothing can have it."""
    name = name.lower()
    if not re.fullmatch(f"[{DIGITS}]+", name):
        raise ValueError(f"not a content name: {name!r}")
    if len(name) > FULL or len(name) < LEAST or (whole and len(name) != FULL):
        raise ValueError(f"a name has {FULL if whole else f'{LEAST} to {FULL}'} characters: {name!r}")
    if len(name) == FULL and name[-1] not in LAST:
        raise ValueError(f"no name ends with {name[-1]!r}: {name!r}")
    return name


def has_name(content: Column | str, name: str) -> Column:
    return F.startswith(content_name(content), F.lit(parse_name(name)))
