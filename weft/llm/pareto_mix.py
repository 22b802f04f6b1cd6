"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source whose target is r times its size takes floor(r) whole copies of each document, and f = r - floor(r)
of its words by a sample. Inclusion probabilities differ by document: p = f + TILT * min(f, 1 - f) * (g - the
mean of g over words), where g falls from 1 for an empty document to 0 for an endless one, so that short
documents are repeated rather than long ones, and the expected words are f times the source's size.

The sample is a Pareto order sample: a document's rank is its random odds u / (1 - u) divided by its inclusion
odds p / (1 - p), and documents are taken in ascending rank up to a fixed size, here the words that are due.
The first document that doesn't fit ends it; what is then left goes to the one document outside the sample whose
size is nearest to it, if that comes nearer to the target than none. u comes from md5 of the id and a seed, so
that reruns agree and SQL can repeat it.

Nothing sorts a whole source: ranks are first counted in bins, whose cumulative sums tell the one bin in which
the sample ends, and only that bin is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.storage import Scratch

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
TILT = 0.5
BITS, BINS, SCALE = 52, 1 << 13, 1024
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs, target of sizes (source, size): weights repeat over sources by code point, null last.

    Targets share the total by weight. One above ``most`` times its source's size stops there, and the
    excess goes to the others by weight: with sources in ascending order of size by weight, those that
    stop are a prefix, and the first source whose share isn't above its bound ends it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # one row a source from here on
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights) + 1).cast("long"))
    bound = F.col("source_size") * most
    before = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("fill", bound / F.col("weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(bound).over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("rate", left / share)
    fits = F.col("rate") * F.col("weight") <= bound
    rate = F.first(F.when(fits, F.col("rate")), ignorenulls=True).over(every)
    return per.withColumn("final", rate).select("source", "source_size", "n_docs", F.least(bound.cast("double"), F.col("final") * F.col("weight")).alias("target"))


def inclusion(scratch: Scratch, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of sizes with their source's figures: whole copies, due words, and each row's own p."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.expr("greatest(1, source_size div n_docs)")
    per = targets.select(F.col("source").alias("s"), "source_size", "target", mean.alias("mean"), F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("f"))
    rows = sizes.join(per, F.col("source").eqNullSafe(F.col("s"))).withColumn("g", F.expr(f"({SCALE} * mean) div (mean + size)"))
    # whole numbers, so that the sum is one whatever the order
    mean_g = scratch.keep(rows.groupBy(F.col("source").alias("s3")).agg(F.sum(F.col("g") * F.col("size")).alias("gs")), "tilt")
    rows = rows.join(mean_g, F.col("source").eqNullSafe(F.col("s3")))
    tilt = F.lit(TILT) * F.least(F.col("f"), 1 - F.col("f"))
    mean = F.when(F.col("source_size") > 0, F.col("gs").cast("double") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return rows.withColumn("p", F.col("f") + tilt * ((F.col("g") - mean) / F.lit(float(SCALE)))).withColumn("due", F.col("f") * F.col("source_size")).drop("s", "s3", "g", "gs", "mean")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """How often the mix takes each row of docs (doc_id, text, source; other columns are ignored).

    Returns doc_id, size, source_size, target, taken (size times copies) and copies. Null and empty texts
    have size 0; they go with their source's copies and take no words. A null source is a source, the last.
    Rows with equal ids have equal random numbers; ties of rank go by that number, id and size. A source of no words
    takes nothing, one at its bound takes ``most`` copies of each row. No rows give no rows.
    """
    scratch = Scratch(spark, "mix")
    random = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), random.alias("v"))
    sizes = scratch.keep(sizes, "sizes")
    targets = scratch.keep(source_targets(sizes, weights, most), "targets")

    u = (F.col("v") + 0.5) / float(1 << BITS)
    rows = inclusion(scratch, sizes, targets)
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    # ranks from 0 to infinity in equal parts of rank / (1 + rank); rows without a chance have none
    rows = scratch.keep(rows.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int")).drop("p", "f"), "ranked")

    bins = rows.filter("bin is not null").groupBy("source", "bin", "due").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("end", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    over = F.col("end") > F.col("due")
    cuts = bins.groupBy(F.col("source").alias("s")).agg(F.min(F.when(over, F.col("bin"))).alias("cut"), F.coalesce(F.max(F.when(~over, F.col("end"))), F.lit(0)).alias("start"))
    cuts = scratch.keep(cuts, "cuts")
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    own = ["doc_id", "source", "size", "v", "rank", "source_size", "target", "whole", "due"]
    inside = F.col("bin").eqNullSafe(F.col("cut")) & F.col("cut").isNotNull()
    order = Window.partitionBy("source").orderBy("rank", "v", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = rows.filter(inside).withColumn("upto", F.col("start") + F.sum("size").over(order)).withColumn("more", (F.col("upto") <= F.col("due")).cast("int"))
    at_cut = scratch.keep(at_cut.select(*own, "start", "more"), "cut")
    outer = rows.filter(~inside).select(*own, F.when(F.col("bin").isNull(), 0).when(F.col("cut").isNull(), 1).otherwise((F.col("bin") < F.col("cut")).cast("int")).alias("more"))
    sampled = outer.unionByName(at_cut.drop("start"))

    # a row for each source with a cut
    gaps = at_cut.groupBy(F.col("source").alias("s")).agg((F.max("due") - F.max("start") - F.sum(F.col("size") * F.col("more"))).alias("gap"))
    miss = F.abs(F.col("gap") - F.col("size"))
    free = sampled.filter("more = 0 and size > 0 and rank is not null").join(gaps, F.col("source").eqNullSafe(F.col("s"))).filter(miss < F.col("gap"))
    last = free.groupBy(F.col("s")).agg(F.min(F.struct(miss.alias("miss"), "rank", "v", "doc_id", "size")).alias("last"))
    last = scratch.keep(last.select("s", "last.*").select("s", F.col("rank").alias("r"), F.col("v").alias("w"), F.col("doc_id").alias("d"), F.col("size").alias("z")), "last")
    chosen = F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")) & (F.col("v") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    marked = sampled.join(last, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("chosen", F.coalesce(chosen & (F.col("more") == 0), F.lit(False)))
    out = ["doc_id", "size", "source_size", "target"]
    # a row that repeats is chosen once; few rows are
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) == 1
    closing = marked.filter("chosen").withColumn("more", first.cast("int"))
    every = marked.filter(~F.col("chosen")).unionByName(closing).select(*out, (F.col("whole") + F.col("more")).cast("long").alias("copies"))
    return every.select(*out, (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


def sql(documents: str = "documents") -> str:
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, {BITS // 4}))::BIGINT AS v
  FROM {documents}),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, greatest(1, sum(size)::BIGINT // count(*)) AS mean,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 3 * source_size AS bound FROM per),
rates AS (
  SELECT *,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(bound) OVER before, 0)::DOUBLE)
         / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER before, 0)::DOUBLE) AS rate
  FROM weighed
  WINDOW before AS (ORDER BY bound::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (
  SELECT arg_min(rate, (bound::DOUBLE / weight, place)) AS rate FROM rates WHERE rate * weight <= bound),
targets AS (
  SELECT source, source_size, mean, least(bound::DOUBLE, final.rate * weight) AS target FROM rates, final),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
joined AS (
  SELECT s.doc_id, s.size, s.v, s.source, p.source_size, p.target, floor(p.ratio) AS whole, p.ratio - floor(p.ratio) AS f,
         ({SCALE} * p.mean) // (p.mean + s.size) AS g
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
tilted AS (
  SELECT *, f * source_size AS due,
         CASE WHEN source_size > 0 THEN sum(g * size) OVER (PARTITION BY source)::DOUBLE / source_size::DOUBLE ELSE 0 END AS mean_g
  FROM joined),
odds AS (
  SELECT *, f + {TILT}::DOUBLE * least(f, 1 - f) * ((g - mean_g) / {SCALE}::DOUBLE) AS p, (v + 0.5::DOUBLE) / {1 << BITS}::DOUBLE AS u FROM tilted),
ranked AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM odds),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, v, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked),
sampled AS (
  SELECT *, (rank IS NOT NULL AND upto <= due)::INT AS more FROM summed),
gaps AS (
  SELECT *, due - sum(size * more) OVER (PARTITION BY source) AS gap FROM sampled),
closing AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY more = 0 AND size > 0 AND rank IS NOT NULL AND abs(gap - size) < gap DESC, abs(gap - size), rank, v, doc_id NULLS FIRST, size) = 1
            AND more = 0 AND size > 0 AND rank IS NOT NULL AND abs(gap - size) < gap AS last
  FROM gaps)
SELECT doc_id, size, source_size, target, (size * (whole + more + last::INT))::BIGINT AS taken
FROM closing
"""


SQL = sql()
