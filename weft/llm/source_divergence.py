"""Which sources of a language write differently: chi-square-like divergence of word frequencies, in whole numbers.

A term is a run of ASCII letters and characters beyond ASCII, with A-Z in lower case. A language keeps the terms
that at least MIN_DOCS of its rows have. A group is a (lang, source) that occurs; each gives every kept term
p = 1 + floor(SCALE * (count + 1) / (N + V)), N its occurrences of kept terms and V the number of them.

For pairs of sources nothing is evaluated term by term. A pair's joint histogram tells how many terms have
the counts (a, b) in the two; cells with a zero are implied: a source's own histogram gives the terms with
a there, those met in both are taken off. The function is evaluated once a cell and multiplied.

Tasks send what they counted, so a source with a third of all rows is a row for each of its terms and tasks.
Terms with the same counts in all sources are one before pairs are made. Nulls count as ''; rows that repeat
count each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.storage import Scratch, table
from weft.llm.word_hash import release

MIN_DOCS, SCALE, SHOWN = 3, 1_000_000_000, 200
#: Terms of bytes whose A-Z are lower-case already; bytes from 0x80 on are parts of characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: A-Z in lower case, and a blank for every byte that no term has.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Counted terms that a task holds before it sends them, and bytes of a text that are cut at once.
HELD, PIECE = 600_000, 4_000_000
#: A table of groups of at most so many rows is sent to all tasks; a larger one is joined by shuffle.
FEW_GROUPS = 50_000


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, as they come, piece by piece."""
    at = 0
    while at < len(text):
        # a piece ends where a term does
        end = at + PIECE
        while end < len(text) and TERM.match(text[end : end + 1].lower()):
            end += 1
        yield text[at:end].translate(FOLDED).split()
        at = end


def terms_of(text: bytes) -> Counter:
    """How often each term is in a text."""
    found = Counter()
    for terms in pieces_of(text):
        found.update(terms)
    return found


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8), n (occurrences), docs (rows with it) of all rows of docs (text, lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple, Counter] = {}
        rows: dict[tuple, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                names, again = list(found), rows.get((lang, source), {})
                columns = [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.binary()), pa.array(found.values(), pa.int64()), pa.array([again.get(x, 0) + 1 for x in names], pa.int64())]
                if names:
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            times.clear()
            rows.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                key, own = (lang, source), set()
                found = times.setdefault(key, Counter())
                before = len(found)
                # lists and sets are counted in one call, mappings in a loop; only rows after a term's first are counted
                for terms in pieces_of(text):
                    new = set(terms) - own
                    rows.setdefault(key, Counter()).update(found.keys() & new)
                    found.update(terms)
                    own |= new
                size += len(found) - before
                if size > HELD:
                    yield from told()
                    size = 0
        yield from told()
        release()

    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = docs.select(*empty, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = texts.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    # tasks have added up what they hold; all rows of a term meet here, for what follows too
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a term, exact for any counts of 64 bits."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", big(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), big(n + v))


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _sent(groups: DataFrame, n: int) -> DataFrame:
    return F.broadcast(groups) if n <= FEW_GROUPS else groups


def audit(spark: SparkSession, docs: DataFrame, shown: int = SHOWN) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: how a source differs from each other one, and its most telling terms."""
    scratch = Scratch(spark, "divergence")
    # rare terms, which are most, go before lists are made
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))
    common = count_terms(docs).withColumn("everywhere", everywhere).filter(F.col("everywhere") >= MIN_DOCS)
    own = F.collect_list(F.struct("source", "n"))
    kept = scratch.keep(common.groupBy("lang", "term").agg(F.array_sort(own).alias("counts"), F.sum("n").alias("total")), "kept")
    by_lang = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    by_source = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(by_lang, "lang", "left").join(by_source, ["lang", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = scratch.keep(groups.select("lang", "source", zero("n_lang"), zero("v"), zero("n_source")), "groups")
    n = groups.count()
    result = scratch.keep(_pairs(kept, groups, n).unionByName(_terms(kept, groups, n, shown)), "result")
    scratch.only(result)
    return result


def joint_cells(kept: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """lang, x, y (x < y: sources), a, b, times: how many kept terms have these counts in the two, zero cells too."""
    alike = kept.groupBy("lang", "counts").agg(F.count("*").alias("terms"))
    # each source of a term with those behind it, a row at a time
    first = alike.filter(F.size("counts") > 1).select("lang", "terms", "counts", F.posexplode("counts").alias("k", "at"))
    later = first.filter(F.col("k") + 1 < F.size("counts")).select("lang", "terms", F.col("at.source").alias("x"), F.col("at.n").alias("a"), F.inline(F.slice("counts", F.col("k") + 2, F.size("counts"))).alias("y", "b"))
    both = later.groupBy("lang", "x", "y", "a", "b").agg(F.sum("terms").alias("times"))
    # each source's own histogram, with the terms of the language that it lacks
    own = alike.select("lang", "terms", F.inline("counts")).groupBy("lang", "source", F.col("n").alias("a")).agg(F.sum("terms").alias("times"))
    names = groups.select("lang", "source", "v")
    pairs = names.join(_sent(names.select("lang", F.col("source").alias("other")), n), "lang").filter("source <> other")
    ahead = pairs.filter("source < other").select("lang", F.col("source").alias("x"), F.col("other").alias("y"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("v").alias("times"))
    one = pairs.drop("v").join(own, ["lang", "source"])
    first = F.col("source") < F.col("other")
    one = one.select("lang", F.least("source", "other").alias("x"), F.greatest("source", "other").alias("y"), F.when(first, F.col("a")).otherwise(0).alias("a"), F.when(first, 0).otherwise(F.col("a")).alias("b"), "times")
    # a term with a in x stands in (a, 0) until it is known to have b in y; one that both have was counted in three zero cells
    moves = F.array(*[F.struct(a.alias("a"), b.alias("b"), (F.col("times") * sign).alias("times")) for a, b, sign in ((F.col("a"), F.col("b"), 1), (F.col("a"), F.lit(0).cast("long"), -1), (F.lit(0).cast("long"), F.col("b"), -1), (F.lit(0).cast("long"), F.lit(0).cast("long"), 1))])
    met = both.select("lang", "x", "y", F.inline(moves))
    taken = one.select("lang", "x", "y", F.inline(F.array(F.struct("a", "b", "times"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), (-F.col("times")).alias("times")))))
    return ahead.unionByName(met).unionByName(taken).groupBy("lang", "x", "y", "a", "b").agg(F.sum("times").alias("times")).filter("times <> 0")


def _pairs(kept: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    cells = joint_cells(kept, groups, n)
    side = lambda c, name: _sent(groups.select("lang", F.col("source").alias(c), F.col("n_source").alias(name), *(["v"] if c == "x" else [])), n)
    cells = cells.join(side("x", "n_x"), ["lang", "x"]).join(side("y", "n_y"), ["lang", "y"])
    cells = cells.select("lang", "x", "y", "times", share(F.col("a"), F.col("n_x"), F.col("v")).alias("p"), share(F.col("b"), F.col("n_y"), F.col("v")).alias("q"))
    both = cells.groupBy("lang", "x", "y").agg(F.sum(excess(F.col("p"), F.col("q")) * F.col("times")).alias("forth"), F.sum(excess(F.col("q"), F.col("p")) * F.col("times")).alias("back"))
    # a language that keeps no term has pairs without cells
    names = groups.select("lang", "source")
    pairs = names.join(_sent(names.select("lang", F.col("source").alias("item")), n), "lang").filter("source <> item")
    values = both.select("lang", F.inline(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item"), F.col("forth").alias("value")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"), F.col("back").alias("value")))))
    found = pairs.join(values, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(kept: DataFrame, groups: DataFrame, n: int, shown: int) -> DataFrame:
    rows = kept.select("lang", "term", "total", F.inline("counts"))
    rows = rows.join(_sent(groups, n), ["lang", "source"])
    rows = rows.select("lang", "source", "term", share(F.col("n"), F.col("n_source"), F.col("v")).alias("p"), share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q")).filter("p > q")
    found = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    # each task leaves its own first rows before these are brought together
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= shown)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
lv AS (SELECT lang, sum(total)::HUGEINT AS n_lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS n_source FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(gn.n_source, 0) + lv.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (lv.n_lang + lv.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN lv USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
