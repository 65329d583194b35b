"""Queries over recognised pages, with the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ocr
from .catalog import _add, _parts, _pick, _sql_list

HEADERS = [["", "合并", "综合", " 合 并 ", "Consolidated ", "母公司"], ["利润表", "损益表", "资产负债表", "财务状况表", "现金流量表", "Income Statement", "BALANCE SHEET", "Statement of Cash Flows", "综合收益表", "附注"], ["", "（续）", "(续)", "续", " 见下", "\n现金流量表"]]
_header, _header_sql = _parts(HEADERS, "c_custkey")
_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(x, '{p}') THEN '{k}'" for k, p in ocr.KINDS) + " END"


def _first_kind(text: str) -> str:
    return f"[k FOR k IN [{_KIND_SQL} FOR x IN string_split(regexp_replace({text}, '[ \\t]+', '', 'g'), chr(10))] IF k IS NOT NULL][1]"


_add(
    "heading_kind",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ocr.heading_kind(_header()).alias("kind")),
    f"SELECT c_custkey, {_first_kind(_header_sql)} AS kind FROM customer",
)

WORDS = ["1,234", "[1,200)", "（45）", "(7.5]", "Revenue", "12%", "−3", "OCR", "[x)", "20 25", "—"]


def _words(spark, sf_dir: str):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 7).alias("page_number"), (F.col("l_orderkey") % 100).cast("double").alias("x0"), (F.col("l_partkey") % 50).cast("double").alias("y0"), (F.col("l_orderkey") % 100 + 9).cast("double").alias("x1"),
        (F.col("l_partkey") % 50 + F.col("l_linenumber")).cast("double").alias("y1"), _pick(WORDS, f"(l_orderkey + l_linenumber) % {len(WORDS)}").alias("text"), (F.col("l_orderkey") % 10 / 40 + 0.75).alias("score"),
    )


_WORDS_SQL = f"""words AS (SELECT l_suppkey AS doc_id, l_orderkey % 7 AS page_number, (l_orderkey % 100)::DOUBLE AS x0, (l_partkey % 50)::DOUBLE AS y0, (l_partkey % 50 + l_linenumber)::DOUBLE AS y1, ({_sql_list(WORDS)})[((l_orderkey + l_linenumber) % {len(WORDS)} + 1)::INTEGER] AS t, l_orderkey % 10 / 40 + 0.75 AS score FROM lineitem),
plain AS (SELECT *, CASE WHEN regexp_full_match(t, '[\\[（(][\\d, .]+[\\]）)]') THEN '(' || substr(t, 2, length(t) - 2) || ')' ELSE t END AS p, round_even((y0 + y1) / 2 / 3, 0) AS band FROM words),
judged AS (SELECT *, regexp_full_match(p, '[\\d,.()（）\\[\\]−–—+%\\-\\s]+') AND score < 0.90 AS doubtful FROM plain)"""
_add(
    "checked_words",
    lambda spark, sf_dir: ocr.checked_words(_words(spark, sf_dir)).groupBy("doc_id", "page_number", "band", "x0", "text", "doubtful").agg(F.count("*").alias("n"), F.sum("place").alias("places")),
    f"WITH {_WORDS_SQL}, placed AS (SELECT doc_id, page_number, band, x0, CASE WHEN doubtful THEN 'OCR待核对' ELSE p END AS text, doubtful FROM judged)\nSELECT doc_id, page_number, band, x0, text, doubtful, count(*) AS n, sum(place)::BIGINT AS places FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY band, x0, text) AS place FROM placed) GROUP BY ALL",
)


def _scanned(spark, sf_dir: str):
    """Conversations read as scanned reports: some pages have hardly any text, some are full of figures."""
    figures = F.repeat(F.lit("1,234 "), 14)
    text = F.when(F.col("turn") % 3 == 0, "scan").when(F.col("turn") % 3 == 1, F.concat(figures, F.lit("2024 2025 "), "text")).otherwise(F.concat(figures, F.lit("2024 "), "text"))
    header = F.replace(_pick([x.replace("\n", "") for x in HEADERS[1]], f"(conv_id + turn * 3) % {len(HEADERS[1])}"), F.lit("附注"), F.lit("x"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), text.alias("text"), header.alias("header"))


_SCANNED_SQL = f"""p AS (SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page_number, CASE turn % 3 WHEN 0 THEN 'scan' WHEN 1 THEN repeat('1,234 ', 14) || '2024 2025 ' || text ELSE repeat('1,234 ', 14) || '2024 ' || text END AS text,
    replace(({_sql_list(HEADERS[1])})[((conv_id + turn * 3) % {len(HEADERS[1])} + 1)::INTEGER], '附注', 'x') AS header FROM conversations)"""
_CANDIDATES_SQL = r"""c AS (SELECT * FROM (SELECT *, len(list_distinct([y FOR y IN regexp_extract_all(text, '[0-9]+') IF length(y) = 4 AND y LIKE '20%'])) AS years FROM {pages}) WHERE length(trim(text, ' \t\n\r')) < 80 OR (len(regexp_extract_all(text, '\d{{1,3}}(?:,\d{{3}})+')) >= 12 AND years >= 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_number) <= 160)"""
_add(
    "locate_pages",
    lambda spark, sf_dir: ocr.locate_pages(_scanned(spark, sf_dir)).withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")),
    f"""WITH {_SCANNED_SQL},
{_CANDIDATES_SQL.format(pages='p')},
k AS (SELECT doc_id, page_number, {_first_kind('header')} AS kind FROM c),
f AS (SELECT a.doc_id, a.page_number FROM k a WHERE kind IS NOT NULL AND (SELECT count(DISTINCT b.kind) FROM k b WHERE b.doc_id = a.doc_id AND b.page_number < a.page_number) < 3),
n AS (SELECT doc_id, max(page_number) AS n FROM p GROUP BY ALL),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(page_number, least(page_number + 3, n) + 1))))) AS pages FROM f JOIN n USING (doc_id) GROUP BY ALL)
SELECT n.doc_id, CASE WHEN g.pages IS NULL THEN 'NOT_FOUND' WHEN len(g.pages) > 20 THEN 'TOO_MANY' ELSE '' END AS reason, CASE WHEN len(g.pages) <= 20 THEN array_to_string(g.pages, ',') END AS pages FROM n LEFT JOIN g USING (doc_id)""",
)


def _long_scans(spark, sf_dir: str):
    """Sixty-four conversations as one scanned report, so that more pages are worth a look than the cap lets through."""
    pages = _scanned(spark, sf_dir).withColumn("part", F.expr("doc_id div 64"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "page_number", "text"))
    return pages.select(F.col("part").alias("doc_id"), place.alias("page_number"), "text", "header")


_add(
    "candidate_pages",
    lambda spark, sf_dir: ocr.candidate_pages(_long_scans(spark, sf_dir)),
    f"""WITH {_SCANNED_SQL},
long AS (SELECT doc_id // 64 AS doc_id, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id, page_number, text)::INTEGER AS page_number, text, header FROM p),
{_CANDIDATES_SQL.format(pages='long')}
SELECT doc_id, page_number, {_first_kind('header')} AS kind FROM c""",
)
