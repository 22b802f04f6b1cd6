"""More registered queries: bytes, regions, caps, observed totals, split files, order over all documents, segments against patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import tables
from weft.functions.lines import lines
from weft.operators import distinct, find, replace, rows, segment
from weft.operators.find import Search
from weft.plans import report, summaries
from weft.plans.catalogue import NEEDLE, OFFSETS, WORD, L, _lines, _name_sql, docs
from weft.plans.report import Report
from weft.sources import large, scratch


def _bytes(spark, d) -> DataFrame:
    """Documents as bytes in which each e is 0xFF, which no UTF-8 has."""
    source = docs(spark, d)
    return source.select("doc", F.encode(F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), "e", "ÿ"), "ISO-8859-1").alias("text"))


#: The word as these bytes have it; a byte that is no UTF-8 is written as a lone surrogate.
BYTE_WORD = WORD.replace("e", "\udcff")


def _hex(text: str) -> str:
    """Upper-case hex of a text's bytes with 0xFF for e, in SQL."""
    return f"replace(replace(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), '65 ', 'FF '), ' ', '')"


def _files(spark, d) -> DataFrame:
    """The documents of each source as one file of lines, in the order of their ids, read back in splits."""
    path = scratch.new_folder(spark, "large")
    texts = spark.read.parquet(f"{d}/documents.parquet").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    texts.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    found = large.numbered(spark, path)
    return found.withColumn("doc", F.regexp_extract("doc", "source=([^/]*)/", 1))


FILES = "(SELECT coalesce(source, 'none') AS source, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1)"
FL = _lines(FILES, "source", "text")
#: Texts of letters, spaces and exclamation marks, on which the rules of segments are patterns.
PLAIN = "regexp_replace(regexp_replace(text, '[.?]', '!', 'g'), '[^A-Za-z! ]', ' ', 'g')"


def _plain(spark, d, marks: bool = True) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("text", "[.?]", "!"), "[^A-Za-z! ]", " ")
    return docs(spark, d).select("doc", (text if marks else F.replace(text, F.lit("!"), F.lit(" "))).alias("text"))


def _segments_sql(text: str, pattern: str) -> str:
    return f"SELECT doc, unnest(range(len(m))) AS seq, unnest(m) AS segment FROM (SELECT doc_id AS doc, regexp_extract_all({text}, '{pattern}') AS m FROM documents)"


WORDS_ONLY = f"replace({PLAIN}, '!', ' ')"


def _lateral(spark, d) -> DataFrame:
    tables.register(spark)
    _plain(spark, d, marks=False).createOrReplaceTempView("weft_plain_documents")
    return spark.sql("SELECT doc, s.seq, s.segment FROM weft_plain_documents, LATERAL weft_segments(text, 'words') s")


def _regions(spark, d) -> DataFrame:
    found = report.json_report(docs(spark, d), Search(".\nD", multiline=True), Report(form="json"))
    at = lambda name, kind: F.get_json_object("record", f"$.data.{name}").cast(kind)
    return found.select("doc", "line_no", F.get_json_object("record", "$.type").alias("kind"), at("absolute_offset", "long").alias("byte_offset"), at("lines.text", "string").alias("line"), at("stats.matches", "long").alias("matches"))


REGIONS = f"""
WITH {L}, {OFFSETS}, P AS (SELECT *, lead(line) OVER w AS following, lag(line) OVER w AS previous FROM O WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
R AS (SELECT * FROM P WHERE (line LIKE '%.' AND following LIKE 'D%') OR (line LIKE 'D%' AND previous LIKE '%.')), N AS (SELECT doc, count(*) AS matches FROM P WHERE line LIKE '%.' AND following LIKE 'D%' GROUP BY doc)
SELECT doc, line_no, 'match' AS kind, byte_offset, line, NULL::BIGINT AS matches FROM R UNION ALL SELECT doc, 0, 'begin', NULL, NULL, NULL FROM N UNION ALL SELECT doc, 0, 'end', NULL, NULL, matches FROM N"""

CAPPED = f"""
WITH {L}, H AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS k FROM L WHERE contains(line, '{WORD}')), N AS (SELECT doc, count(*) AS n_lines FROM L GROUP BY doc),
M AS (SELECT doc, least(max(k), 2) AS matches, max(CASE WHEN k = 2 THEN line_no END) AS second FROM H GROUP BY doc)
SELECT doc, '{{"type":"end","data":{{"path":{{"text":"' || doc || '"}},"stats":{{"matches":' || matches || ',"lines_searched":' || coalesce(least(second + 1, n_lines), n_lines) || '}}}}}}' AS record FROM M JOIN N USING (doc)"""

RUN = f"""
WITH {L}, N AS (SELECT doc, count(*) AS n, count(*) FILTER (contains(line, '{WORD}')) AS hits FROM L GROUP BY doc)
SELECT '{{"type":"summary","data":{{"files_searched":' || (SELECT count(*) FROM documents) || ',"bytes":' || (SELECT sum(strlen(text))::BIGINT FROM documents) || ',"files_matched":' || count(*) || ',"matches":' || sum(hits)::BIGINT || ',"lines_searched":' || sum(n)::BIGINT || '}}}}' AS record FROM N WHERE hits > 0"""

OVERALL = f"""
WITH {L}, S AS (SELECT *, lag(line) OVER (ORDER BY doc, line_no) AS before FROM L) SELECT doc, line_no FROM S WHERE line < before ORDER BY doc, line_no LIMIT 1"""

#: name: (query, SQL or None)
MORE = {
    "bytes_lines": (lambda s, d: lines(_bytes(s, d), offsets=True).select("doc", "line_no", "byte_offset", F.hex("as_cut").alias("line")), f"WITH {L}, {OFFSETS} SELECT doc, line_no, byte_offset, {_hex('line')} AS line FROM O"),
    "bytes_find": (lambda s, d: find.matches(_bytes(s, d), Search(BYTE_WORD)).select("doc", "line_no", "start", F.hex("match").alias("match")), f"""
WITH {L}, K AS (SELECT doc, line_no, string_split(line, '{WORD}') AS p, unnest(range(1, len(p))) AS k FROM L)
SELECT doc, line_no, (list_sum(list_transform(p[1:k], lambda x: strlen(x))) + (k - 1) * {len(WORD)})::BIGINT AS start, {_hex(f"'{WORD}'")} AS match FROM K"""),
    "bytes_replace": (lambda s, d: replace.replace(_bytes(s, d), BYTE_WORD, "<>").select("doc", F.hex("text").alias("text"), "replacements"), f"SELECT doc_id AS doc, {_hex(f"replace(text, '{WORD}', '<>')")} AS text, (len(string_split(text, '{WORD}')) - 1)::BIGINT AS replacements FROM documents"),
    "bytes_records": (lambda s, d: report.json_report(_bytes(s, d), Search("tion"), Report(form="json")).filter("phase = 1").select("doc", "line_no", F.get_json_object("record", "$.data.lines.text").alias("text"), F.get_json_object("record", "$.data.lines.bytes").alias("bytes")), f"WITH {L} SELECT doc, line_no, CASE WHEN NOT contains(line, 'e') THEN line END AS text, CASE WHEN contains(line, 'e') THEN to_base64(unhex({_hex('line')})) END AS bytes FROM L WHERE contains(line, 'tion')"),
    "bytes_dedup": (lambda s, d: distinct.dedup(_bytes(s, d)).select("doc", "line_no", F.hex("line").alias("line"), "times"), f"WITH {L} SELECT doc, line_no, {_hex('line')} AS line, times FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY line) AS times FROM L WINDOW w AS (PARTITION BY line ORDER BY doc, line_no)) WHERE k = 1"),
    "find_regions": (_regions, REGIONS),
    "find_capped_ends": (lambda s, d: report.json_report(docs(s, d), Search(WORD), Report(form="json", most=2)).filter("phase = 2").select("doc", "record"), CAPPED),
    "find_capped_counts": (lambda s, d: find.count_lines(docs(s, d), Search(WORD), most=2), f"WITH {L} SELECT doc, least(2, count(*)) AS count FROM L WHERE contains(line, '{WORD}') GROUP BY doc"),
    "find_run_totals": (lambda s, d: summaries.record_of(s, summaries.searched(docs(s, d), Search(WORD), Report(form="json"))), RUN),
    "large_lines": (lambda s, d: _files(s, d).select("doc", "line_no", "byte_offset", F.col("as_cut").alias("line")), f"WITH {FL}, {OFFSETS} SELECT doc, line_no, byte_offset, line FROM O"),
    "large_tail": (lambda s, d: large.tail(_files(s, d), 3).select("doc", "line_no", F.col("as_cut").alias("line")), f"WITH {FL} SELECT doc, line_no, line FROM (SELECT *, max(line_no) OVER (PARTITION BY doc) AS last FROM L) WHERE line_no > last - 3"),
    "large_context": (lambda s, d: large.context(_files(s, d), Search(NEEDLE), 1, 1), f"""
WITH {FL}, M AS (SELECT *, contains(line, '{NEEDLE}') AS is_match, bool_or(contains(line, '{NEEDLE}')) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM L)
SELECT doc, line_no, is_match, line FROM M WHERE near"""),
    "sort_disorder_overall": (lambda s, d: distinct.disorder(docs(s, d)), OVERALL),
    "dedup_written": (lambda s, d: distinct.written(docs(s, d), "\0"), f"WITH {L} SELECT doc, line_no, line || chr(0) AS text FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc, line_no) AS k FROM L) WHERE k = 1"),
    "rows_told": (lambda s, d: rows.told(rows.select_rows(docs(s, d), every=3, hash_width=5), True, True), f"WITH {L}, M AS (SELECT *, max(line_no) OVER (PARTITION BY doc) AS last FROM L) SELECT doc, line_no, line_no || ':' || {_name_sql("line || CASE WHEN line_no = last THEN '' ELSE chr(10) END", 5)} || ':' || line AS text FROM M WHERE line_no % 3 = 0"),
    "segment_sentences_plain": (lambda s, d: segment.segments(_plain(s, d), "sentences").select("doc", "seq", "segment"), _segments_sql(PLAIN, "[^!]*(?:! *)+|[^!]+")),
    "segment_words_plain": (lambda s, d: segment.segments(_plain(s, d, False), "words").select("doc", "seq", "segment"), _segments_sql(WORDS_ONLY, "[A-Za-z]+| +")),
    "segment_words_lateral": (_lateral, _segments_sql(WORDS_ONLY, "[A-Za-z]+| +")),
    "segment_linebreaks_plain": (lambda s, d: segment.segments(_plain(s, d, False), "linebreaks").select("doc", "seq", "segment"), _segments_sql(WORDS_ONLY, "[A-Za-z]* +|[A-Za-z]+")),
}
