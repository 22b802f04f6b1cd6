"""SHA-256 of files and documents, manifests of them, and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, FAILED, UNREADABLE, SKIPPED = "OK", "FAILED", "FAILED open or read", "SKIPPED"
#: Lines of a manifest: digest, space, space or asterisk, path; and the BSD form. A backslash leads an escaped path.
PLAIN = r"^(\\?)([0-9a-fA-F]{64}) [ *](.+)$"
BSD = r"^(\\?)SHA256 \((.*)\) = ([0-9a-fA-F]{64})$"


def digests(docs: DataFrame, content: str = "text") -> DataFrame:
    """path, digest, bytes of documents (doc and a text or binary column)."""
    return docs.select(F.col("doc").cast("string").alias("path"), F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("bytes"))


def digest_files(spark, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))


def escaped(path: str = "path"):
    """A path as a manifest line has it, and whether it needs the leading backslash."""
    p = F.replace(F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return p, p != F.col(path)


def manifest(found: DataFrame, form: str = "coreutils") -> DataFrame:
    """path and line of digests (path, digest): coreutils or bsd."""
    if form not in ("coreutils", "bsd"):
        raise ValueError("a manifest is in coreutils or bsd form")
    p, odd = escaped()
    lead = F.when(odd, F.lit("\\")).otherwise(F.lit(""))
    line = F.concat(lead, "digest", F.lit("  "), p) if form == "coreutils" else F.concat(lead, F.lit("SHA256 ("), p, F.lit(") = "), "digest")
    return found.select("path", line.alias("line"))


def table(found: DataFrame) -> DataFrame:
    """path and text of digests (path, digest, bytes): the digest, the size in grouped digits as wide as the widest, the path."""
    size = F.format_number("bytes", 0)
    # one row
    widest = found.agg(F.max(F.char_length(size)).alias("wide"))
    p, odd = escaped()
    text = F.concat("digest", F.lit("  "), F.lpad(size, F.col("wide"), F.lit(" ")), F.lit("  "), F.when(odd, F.lit("\\")).otherwise(F.lit("")), p)
    return found.crossJoin(F.broadcast(widest)).select("path", text.alias("text"))


def parse_manifest(rows: DataFrame, column: str = "line") -> DataFrame:
    """line, digest, path, malformed of a manifest's lines; blank lines go."""
    line = F.regexp_replace(column, r"\r\z", "")
    rows = rows.select(line.alias("line")).filter(F.trim("line") != "")
    bsd = F.rlike("line", F.lit("(?s)" + BSD))
    plain = F.rlike("line", F.lit("(?s)" + PLAIN))
    pick = lambda b, p: F.when(bsd, F.regexp_extract("line", "(?s)" + BSD, b)).when(plain, F.regexp_extract("line", "(?s)" + PLAIN, p))
    raw = pick(2, 3)
    # a backslash pair first becomes a character that no path has
    plain_path = F.replace(F.replace(F.replace(F.replace(raw, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\0"), F.lit("\\"))
    path = F.when(pick(1, 1) == "\\", plain_path).otherwise(raw)
    return rows.select("line", F.lower(pick(3, 2)).alias("digest"), path.alias("path"), (~bsd & ~plain).alias("malformed"))


def verify(claims: DataFrame, found: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """path, verdict of well-formed claims (parse_manifest) against digests (path, digest)."""
    own = found.select(F.col("path").alias("p"), F.col("digest").alias("d"))
    rows = claims.filter(~F.col("malformed")).join(own, F.col("path") == F.col("p"), "left")
    missing = F.lit(SKIPPED if ignore_missing else UNREADABLE)
    return rows.select("path", F.when(F.col("d").isNull(), missing).when(F.col("d") == F.col("digest"), OK).otherwise(FAILED).alias("verdict"))


def outcome(claims: DataFrame, verdicts: DataFrame, strict: bool = False) -> int:
    """0 if all is well, 1 if something failed or nothing was verified, 2 if no line is well-formed."""
    lines = claims.agg(F.count_if(~F.col("malformed")), F.count_if("malformed")).first()
    if not lines[0]:
        return 2
    seen = {r["verdict"]: r["count"] for r in verdicts.groupBy("verdict").count().collect()}
    if seen.get(FAILED) or seen.get(UNREADABLE) or not seen.get(OK) or (strict and lines[1]):
        return 1
    return 0


def totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
