"""Inputs derived from the given tables.

The SQL here reads the same in Spark and in the checking engine. It only shapes tables into files,
rule lines, headings and streams; it holds nothing of what is being checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import java_charsets

DOC_PATH = """concat(source, '/',
  CASE WHEN doc_id % 10 = 0 THEN 'node_modules/' WHEN doc_id % 10 = 1 THEN '.cache/'
       WHEN doc_id % 10 = 2 THEN 'target/' WHEN doc_id % 10 = 3 THEN 'logs/' ELSE 'src/' END,
  lang, '/', CAST(doc_id AS STRING),
  CASE WHEN doc_id % 7 = 0 THEN '.png' WHEN doc_id % 7 = 1 THEN '.log'
       WHEN doc_id % 7 = 2 THEN '.md' ELSE '.txt' END)"""

DOC_FILES = f"""SELECT source AS bundle_id, doc_id, lang, text, {DOC_PATH} AS path FROM documents"""

# Line ends, TABs, control characters and empty files, which the texts lack.
DIRTY_TEXT = """CASE doc_id % 6
  WHEN 0 THEN concat(text, chr(10), chr(10)) WHEN 1 THEN replace(text, chr(10), concat(chr(13), chr(10)))
  WHEN 2 THEN concat(chr(9), text, ' ') WHEN 3 THEN replace(text, '. ', chr(1))
  WHEN 4 THEN concat(text, chr(10)) ELSE replace(text, chr(10), concat(chr(10), chr(10))) END"""

DIRTY_FILES = f"""SELECT source AS bundle_id, doc_id, lang, {DIRTY_TEXT} AS text, {DOC_PATH} AS path
FROM documents UNION ALL SELECT source, -1 - doc_id, lang, '', concat('empty/', {DOC_PATH}) FROM documents WHERE doc_id % 6 = 4"""

PAGE_FILES = """SELECT regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS bundle_id, page_id,
  regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path, html AS text FROM pages"""

# Rule lines named after sources, languages and numbers of the documents; repeated lines of a source
# count once, at their first place.
RULE_LINES = """SELECT source AS ruleset_id, CAST(min(doc_id) AS INT) AS line_no, line FROM (
  SELECT source, doc_id, CASE doc_id % 13
    WHEN 0 THEN '*.log' WHEN 1 THEN concat('  ', lang, '/  ') WHEN 2 THEN concat('# ', lang)
    WHEN 3 THEN concat('!', CAST(doc_id % 100 AS STRING), '.md')
    WHEN 4 THEN concat('/', source, '/logs/')
    WHEN 5 THEN concat('!**/', lang, '/*.txt') WHEN 6 THEN concat(source, '/src/**/*',
      CAST(doc_id % 10 AS STRING), '.*')
    WHEN 7 THEN '???.png' WHEN 8 THEN concat(chr(92), '#', lang)
    WHEN 9 THEN concat('*', CAST(doc_id % 100 AS STRING), '.t?t') WHEN 10 THEN ''
    WHEN 11 THEN concat('!', source, '/*/', lang, '/', CAST(doc_id % 10 AS STRING), '*')
    ELSE concat('tar', chr(92), '*', CASE WHEN lang = 'en' THEN '' ELSE '/' END) END AS line
  FROM documents) lines GROUP BY source, line"""

TURN_STREAM = """SELECT CAST(conv_id AS STRING) AS bundle_id, turn AS seq,
  CASE WHEN role = 'user' THEN 'Heading1' END AS style, text FROM conversations"""

# Turns whose headings are paths: some empty, some repeated, some bad.
PATH_STREAM = """SELECT CAST(conv_id AS STRING) AS bundle_id, conv_id AS bundle_ord, turn AS seq,
  CASE WHEN role = 'user' THEN 'Heading1' END AS style,
  CASE WHEN role <> 'user' THEN text
    WHEN conv_id % 9 = 4 AND turn >= 2 THEN concat('../', CAST(turn AS STRING))
    WHEN (conv_id + turn) % 11 = 5 THEN ''
    WHEN conv_id % 3 = 0 THEN concat('t/./', CAST(turn % 4 AS STRING), '.txt')
    ELSE concat('t', chr(92), CAST(turn % 4 AS STRING), '.txt') END AS text FROM conversations"""

HEADINGS = """SELECT page_id AS id, CASE page_id % 17
    WHEN 0 THEN path WHEN 1 THEN replace(path, '/', chr(92)) WHEN 2 THEN concat('  ', path, ' ')
    WHEN 3 THEN concat(chr(9), ' ') WHEN 4 THEN concat('/', path) WHEN 5 THEN concat('//srv/', path)
    WHEN 6 THEN 'C:' WHEN 7 THEN concat('C:', chr(92), path) WHEN 8 THEN concat('c:/', path)
    WHEN 9 THEN concat('C:', path) WHEN 10 THEN concat(path, '/../', path)
    WHEN 11 THEN concat(path, '/CON') WHEN 12 THEN concat('lpt1.', path)
    WHEN 13 THEN concat('con.tar.gz/', path) WHEN 14 THEN concat('Nul/../', path)
    WHEN 15 THEN concat(replace(path, '/', '<|'), '?*', chr(34), '>:')
    ELSE concat('./', path, '//..x') END AS heading FROM page_files"""

# Pages that arrive four at a time, a minute apart, under few paths, so that paths come again.
ARRIVALS = """SELECT bundle_id, concat(bundle_id, '/', CAST(page_id % 12 AS STRING)) AS path,
  CAST(page_id AS STRING) AS source, 1700000000 + 15 * (page_id - page_id % 4) AS arrived FROM page_files"""

BYTE_FORMS = 9
# Documents, and some empty files with numbers of their own.
BYTE_DOCS = """SELECT bundle_id, doc_id, lang, text, path FROM doc_files UNION ALL
SELECT bundle_id, -1 - doc_id, lang, '', concat('empty/', path) FROM doc_files WHERE doc_id % 50 = 0"""


def sql(spark: SparkSession, sf_dir: str, query: str, *tables: str, **views: DataFrame) -> DataFrame:
    """Run one of the texts above over the tables it names."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables} | views
    for name, frame in frames.items():
        query = _bind(query, name)
    return spark.sql(query, **frames)


def _bind(query: str, name: str) -> str:
    return query.replace(f"FROM {name}", f"FROM {{{name}}}")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, DOC_FILES, "documents")


def dirty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, DIRTY_FILES, "documents")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PAGE_FILES, "pages")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, ARRIVALS, page_files=page_files(spark, sf_dir))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, HEADINGS, page_files=page_files(spark, sf_dir))


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, RULE_LINES, "documents")


def turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, TURN_STREAM, "conversations")


def path_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PATH_STREAM, "conversations")


def _files(df: DataFrame, content) -> DataFrame:
    out = df.select(
        "bundle_id",
        F.lit(0).alias("source_ord"),
        F.lit(False).alias("direct"),
        "path",
        content.alias("content"),
        "doc_id",
    )
    return out.withColumn("length", F.octet_length("content").cast("bigint"))


def byte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes in nine forms: UTF-8 plain and marked, wide ones, a Chinese one, with noise."""
    text = F.col("text")
    marked = lambda mark, body: F.unhex(F.concat(F.lit(mark), F.hex(body)))
    forms = [
        F.encode(text, "UTF-8"),
        marked("EFBBBF", F.encode(text, "UTF-8")),
        F.encode(text, "UTF-16LE"),
        F.encode(text, "UTF-16BE"),
        marked("FFFE", F.encode(text, "UTF-16LE")),
        F.encode(text, "UTF-32"),
        F.encode(text, "GB18030"),
        F.encode(F.replace(text, F.lit(" "), F.lit("\0")), "UTF-8"),
        F.encode(F.translate(text, "ea", "\1\1"), "UTF-8"),
    ]
    content = F.when(F.col("doc_id") < 0, F.unhex(F.lit("")))
    for i, form in enumerate(forms):
        content = content.when(F.col("doc_id") % BYTE_FORMS == i, form)
    with java_charsets(spark):
        return _files(sql(spark, sf_dir, BYTE_DOCS, doc_files=doc_files(spark, sf_dir)), content)


# Texts that each legacy form can hold. The last two take any bytes for bad or for control characters.
LEGACY_TEXT = """CASE doc_id % 6 WHEN 0 THEN translate(plain, 'aeiou', 'あいうえお') WHEN 1 THEN translate(plain, 'aeiou', '아에이오우')
  WHEN 2 THEN text ELSE plain END"""
LEGACY_DOCS = f"""SELECT *, {LEGACY_TEXT} AS body FROM (
  SELECT bundle_id, doc_id, path, text, regexp_replace(text, concat('[^ -~', chr(10), ']+'), '') AS plain FROM doc_files) d"""


def legacy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes in legacy charsets, each with bytes at its end that charset libraries read differently."""
    body = F.col("body")
    ended = lambda charset, tail: F.unhex(F.concat(F.hex(F.encode(body, charset)), F.lit(tail)))
    forms = [
        ended("windows-31j", "80"), ended("x-windows-949", "B0A1"), ended("ISO-8859-1", "6381E9"),
        ended("UTF-8", "80"), ended("UTF-8", "FF"), ended("UTF-8", "A1BF"),
    ]
    content = F.lit(None).cast("binary")
    for i, form in enumerate(forms):
        content = F.when(F.col("doc_id") % len(forms) == i, form).otherwise(content)
    with java_charsets(spark):
        return _files(sql(spark, sf_dir, LEGACY_DOCS, doc_files=doc_files(spark, sf_dir)), content)


def gb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a Chinese encoding."""
    docs = doc_files(spark, sf_dir)
    with java_charsets(spark):
        return _files(docs, F.encode("text", "GB18030"))


def utf8_files(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    docs = dirty_files(spark, sf_dir) if dirty else doc_files(spark, sf_dir)
    return _files(docs, F.encode("text", "UTF-8"))
