"""Byte sizes as people write them."""

from __future__ import annotations

import re

#: Factors of the suffixes, decimal and binary.
UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}


def parse_size(text: str) -> int:
    """``10``, ``4K``, ``2MiB`` and the like in bytes; ValueError for anything else and for nothing."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgt]i?)?b?\s*", text, re.I)
    if not m or int(m[1]) == 0:
        raise ValueError(f"not a size above 0: {text!r}")
    return int(m[1]) * UNITS[(m[2] or "").lower()]
