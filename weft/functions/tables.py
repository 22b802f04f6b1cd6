"""Table functions for SQL: segments, lines and matches of a text, for use behind LATERAL.

``register(spark)`` names them; SELECT doc, s.* FROM docs, LATERAL weft_segments(text, 'sentences') s.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Segments:
    """seq, start, end (bytes) and segment of a text, by graphemes, words, sentences or linebreaks."""

    def eval(self, text: str, by: str) -> Iterator[tuple]:
        from weft.operators.segment import TILE

        if by not in TILE:
            raise ValueError(f"by is one of {tuple(TILE)}, not {by!r}")
        at = 0
        for seq, s in enumerate(TILE[by](text or "")):
            size = len(s.encode())
            yield seq, at, at + size, s
            at += size


class Matches:
    """start, end (bytes) and match of a literal in a text; folded matches end with whole characters."""

    def eval(self, text: str, pattern: str, ignore_case: bool) -> Iterator[tuple]:
        from weft.operators.find import Search

        for a, b, x, y in Search(pattern, ignore_case=ignore_case, multiline=True).byte_spans(text or ""):
            yield a, b, text[x:y]


def register(spark: SparkSession) -> None:
    spark.udtf.register("weft_segments", F.udtf(Segments, returnType="seq bigint, start bigint, end bigint, segment string"))
    spark.udtf.register("weft_matches", F.udtf(Matches, returnType="start bigint, end bigint, match string"))
