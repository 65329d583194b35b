"""Facts built from order lines, so that every gate of the operators is met by real rows.

Entities are suppliers, so reports grow with the tables; periods are ship years, scope "consolidated" takes all lines and
"parent" the closed ones. Fixed rules on the supplier's number add what real reports have: absent statements, duplicates,
conflicts, missing cells, unknown units, mixed currencies, restated columns, rounded thousands, scales of a billion, amounts with one decimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row per reported value.
FACTS_DDL = (
    "doc_id int, company_name string, statement_type string, scope string, metric_ordinal int, canonical_name string, "
    "original_label string, raw_value string, value decimal(28,6), value_type string, year int, period_type string, "
    "start_date string, end_date string, is_restated boolean, currency string, multiplier decimal(12,0), source_page int, "
    "extraction_method string"
)

_VALUES = (
    # name, statement, ordinal, cents
    ("revenue", "income_statement", 3, "rev"),
    ("cost_of_revenue", "income_statement", 4, "ext * 7 div 10"),
    ("gross_profit", "income_statement", 5, "rev - ext * 7 div 10 + case when doc_id % 6 = 0 and year = 2001 then 90000000 else 0 end"),
    ("operating_profit", "income_statement", 6, "rev div 5 - tax"),
    ("net_income", "income_statement", 7, "rev div 5 - tax - rev div 20"),
    ("total_assets", "balance_sheet", 1, "rev * 3"),
    ("total_liabilities", "balance_sheet", 2, "rev + tax + case when doc_id % 4 = 1 and year = 1998 then 70000000 else 0 end"),
    ("total_equity", "balance_sheet", 3, "rev * 2 - tax"),
    ("operating_cash_flow", "cash_flow", 1, "rev div 5 - rev div 20"),
    ("capital_expenditure", "cash_flow", 2, "case when doc_id % 9 = 5 then -1 else 1 end * (rev div 10)"),
    ("segment_a", "income_statement", 1, "rev div 3"),
    ("segment_b", "income_statement", 2, "rev - rev div 3 + case when doc_id % 5 = 3 then 1 else 0 end"),
)


def facts(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The facts table of FACTS_DDL; with ``whole`` no statement is absent."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    per_supplier = line.groupBy("l_suppkey", F.year("l_shipdate").alias("year"), "l_linestatus").agg(
        F.sum(price * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("rev"),
        F.sum(price).alias("ext"),
        F.sum(price * F.col("l_tax").cast("decimal(4,2)")).alias("tax"),
    )
    scoped = per_supplier.select("*", F.explode(F.when(F.col("l_linestatus") == "F", F.array(F.lit("consolidated"), F.lit("parent"))).otherwise(F.array(F.lit("consolidated")))).alias("scope"))
    cents = scoped.groupBy(F.col("l_suppkey").cast("int").alias("doc_id"), "year", "scope").agg(*[F.floor(F.sum(c).cast("double") * 100).cast("long").alias(c) for c in ("rev", "ext", "tax")])
    named = cents.join(supplier, F.col("doc_id") == F.col("s_suppkey"))
    structs = ", ".join(f"struct('{n}' as name, '{s}' as statement_type, {o} as metric_ordinal, cast({e} as bigint) as cents)" for n, s, o, e in _VALUES)
    long = named.selectExpr("doc_id", "year", "scope", "s_name as company_name", f"explode(array({structs})) as m").selectExpr("doc_id", "year", "scope", "company_name", "m.*")
    # reports without a cash flow, and parents without a balance sheet
    absent = ((F.col("statement_type") == "cash_flow") & (F.col("doc_id") % 7 == 1)) | ((F.col("statement_type") == "balance_sheet") & (F.col("doc_id") % 7 == 2) & (F.col("scope") == "parent"))
    copies = F.when(F.lit(False) if whole else absent, F.lit(0)).when((F.col("name") == "net_income") & (F.col("doc_id") % 10 == 9) & (F.col("year") == 1997), F.lit(0)).when((F.col("name") == "gross_profit") & (F.col("doc_id") % 3 != 0), F.lit(0)).when(
        (F.col("name") == "revenue") & (((F.col("doc_id") % 5 == 0) & (F.col("year") == 1997)) | ((F.col("doc_id") % 5 == 1) & (F.col("year") == 1998))), F.lit(2)
    ).when((F.col("doc_id") % 8 == 6) & (F.col("year") == 1999) & (F.col("statement_type") == "income_statement"), F.lit(2)).otherwise(F.lit(1))
    rows = long.select("*", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))).alias("copy"))
    conflict = (F.col("name") == "revenue") & (F.col("doc_id") % 5 == 0) & (F.col("year") == 1997) & (F.col("copy") == 2)
    thousands = F.col("doc_id") % 2 == 1
    tenths = F.col("doc_id") % 12 == 2
    cents_ = F.col("cents") + F.when(conflict, F.lit(100000)).otherwise(F.lit(0))
    exact = (cents_.cast("decimal(22,2)") * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(28,6)")
    billions = F.col("doc_id") % 29 == 3
    value = F.when(billions, F.floor(cents_.cast("double") / 100_000_000).cast("decimal(28,6)")).when(thousands, F.expr("0.0") + F.floor(cents_.cast("double") / 100000).cast("decimal(28,6)")).otherwise(exact).cast("decimal(28,6)")
    value = F.when((F.col("name") == "operating_profit") & (F.col("doc_id") % 7 == 3) & (F.col("year") == 2000), F.lit(None)).otherwise(value)
    value = F.when(tenths & ~billions, F.floor(value * 10).cast("decimal(28,6)") / 10).otherwise(value).cast("decimal(28,6)")
    raw = F.when(thousands, value.cast("decimal(28,0)").cast("string")).when(tenths, value.cast("decimal(28,1)").cast("string")).otherwise(value.cast("decimal(28,2)").cast("string"))
    point = F.col("statement_type") == "balance_sheet"
    return rows.select(
        "doc_id", "company_name", "statement_type", "scope", "metric_ordinal",
        F.when(F.col("name").startswith("segment"), F.lit(None)).otherwise(F.col("name")).alias("canonical_name"), F.col("name").alias("original_label"),
        raw.alias("raw_value"), value.alias("value"), F.lit("monetary").alias("value_type"), "year",
        F.when(point, "point_in_time").otherwise("annual").alias("period_type"), F.lit("").alias("start_date"),
        F.concat(F.col("year").cast("string"), F.lit("-12-31")).alias("end_date"),
        ((F.col("doc_id") % 8 == 6) & (F.col("year") == 1999) & ~point & (F.col("copy") == 2)).alias("is_restated"),
        F.when((F.col("name") == "net_income") & (F.col("doc_id") % 7 == 2) & (F.col("year") == 1999), "").when((F.col("name") == "cost_of_revenue") & (F.col("doc_id") % 6 == 4) & (F.col("year") == 1996), "USD").otherwise("CNY").alias("currency"),
        F.when(billions, 1_000_000_000).when(thousands, 1000).otherwise(1).cast("decimal(12,0)").alias("multiplier"), (F.lit(5) + F.when(point, 1).otherwise(0) + F.when((F.col("doc_id") % 13 == 4) & (F.col("name") == "revenue") & (F.col("year") == 2001), 3).otherwise(0)).alias("source_page"),
        F.when(F.col("doc_id") % 11 == 4, "local_ocr").otherwise("native").alias("extraction_method"),
    )


def _duck(expression: str) -> str:
    return expression.replace(" div ", " // ")


#: The same rows in DuckDB, as common table expressions that end in ``facts``.
FACTS_SQL = """
cents AS (
    SELECT l_suppkey::INTEGER AS doc_id, year(l_shipdate)::INTEGER AS year, scope,
           floor(sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE * 100)::BIGINT AS rev,
           floor(sum(l_extendedprice::DECIMAL(12,2))::DOUBLE * 100)::BIGINT AS ext,
           floor(sum(l_extendedprice::DECIMAL(12,2) * l_tax::DECIMAL(4,2))::DOUBLE * 100)::BIGINT AS tax
    FROM lineitem JOIN (VALUES ('consolidated'), ('parent')) v(scope) ON scope = 'consolidated' OR l_linestatus = 'F'
    GROUP BY ALL
), long AS (
""" + " UNION ALL\n".join(
    f"    SELECT doc_id, year, scope, '{n}' AS name, '{s}' AS statement_type, {o} AS metric_ordinal, ({_duck(e)})::BIGINT AS cents FROM cents" for n, s, o, e in _VALUES
) + """
), copied AS (
    SELECT *, unnest(range(1, 1 + CASE
        WHEN statement_type = 'cash_flow' AND doc_id % 7 = 1 THEN 0
        WHEN statement_type = 'balance_sheet' AND doc_id % 7 = 2 AND scope = 'parent' THEN 0
        WHEN name = 'net_income' AND doc_id % 10 = 9 AND year = 1997 THEN 0
        WHEN name = 'gross_profit' AND doc_id % 3 <> 0 THEN 0
        WHEN name = 'revenue' AND ((doc_id % 5 = 0 AND year = 1997) OR (doc_id % 5 = 1 AND year = 1998)) THEN 2
        WHEN doc_id % 8 = 6 AND year = 1999 AND statement_type = 'income_statement' THEN 2 ELSE 1 END)) AS copy FROM long
), valued AS (
    SELECT *, CASE WHEN name = 'operating_profit' AND doc_id % 7 = 3 AND year = 2000 THEN NULL
        WHEN doc_id % 29 = 3 THEN floor(c::DOUBLE / 100000000)::DECIMAL(28,6) WHEN doc_id % 2 = 1 THEN floor(c::DOUBLE / 100000)::DECIMAL(28,6) WHEN doc_id % 12 = 2 THEN (floor(c::DOUBLE / 10)::DECIMAL(22,2) * 0.1::DECIMAL(4,2))::DECIMAL(28,6) ELSE (c::DECIMAL(22,2) * 0.01::DECIMAL(4,2))::DECIMAL(28,6) END AS value
    FROM (SELECT *, cents + CASE WHEN name = 'revenue' AND doc_id % 5 = 0 AND year = 1997 AND copy = 2 THEN 100000 ELSE 0 END AS c FROM copied)
), facts AS (
    SELECT doc_id, s_name AS company_name, statement_type, scope, metric_ordinal, CASE WHEN name LIKE 'segment%' THEN NULL ELSE name END AS canonical_name, name AS original_label,
        CASE WHEN doc_id % 2 = 1 THEN value::DECIMAL(28,0)::VARCHAR WHEN doc_id % 12 = 2 THEN value::DECIMAL(28,1)::VARCHAR ELSE value::DECIMAL(28,2)::VARCHAR END AS raw_value, value, 'monetary' AS value_type, year,
        CASE WHEN statement_type = 'balance_sheet' THEN 'point_in_time' ELSE 'annual' END AS period_type, '' AS start_date, year || '-12-31' AS end_date,
        doc_id % 8 = 6 AND year = 1999 AND statement_type <> 'balance_sheet' AND copy = 2 AS is_restated,
        CASE WHEN name = 'net_income' AND doc_id % 7 = 2 AND year = 1999 THEN '' WHEN name = 'cost_of_revenue' AND doc_id % 6 = 4 AND year = 1996 THEN 'USD' ELSE 'CNY' END AS currency,
        CASE WHEN doc_id % 29 = 3 THEN 1000000000 WHEN doc_id % 2 = 1 THEN 1000 ELSE 1 END AS multiplier, 5 + CASE WHEN statement_type = 'balance_sheet' THEN 1 ELSE 0 END + CASE WHEN doc_id % 13 = 4 AND name = 'revenue' AND year = 2001 THEN 3 ELSE 0 END AS source_page,
        CASE WHEN doc_id % 11 = 4 THEN 'local_ocr' ELSE 'native' END AS extraction_method
    FROM valued JOIN supplier ON doc_id = s_suppkey
)"""
_ABSENT = """        WHEN statement_type = 'cash_flow' AND doc_id % 7 = 1 THEN 0
        WHEN statement_type = 'balance_sheet' AND doc_id % 7 = 2 AND scope = 'parent' THEN 0
"""
#: The same with every statement, as facts(..., whole=True) gives them.
WHOLE_FACTS_SQL = FACTS_SQL.replace(_ABSENT, "")
