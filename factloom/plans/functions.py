"""Queries that call the functions made for SQL, with the same results as the column expressions."""

from __future__ import annotations


from ..functions.sql import register
from .catalog import _BASE, ORACLES, _add, _cells, _period_text, _unit_text, facts


def _called(view, query: str):
    """query over ``factloom_input``, which view(spark, sf_dir) makes, with the functions at hand."""

    def run(spark, sf_dir: str):
        register(spark)
        view(spark, sf_dir).createOrReplaceTempView("factloom_input")
        return spark.sql(query)

    return run


def _customers(text):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text().alias("t"))


_add("sql_read_amount", _called(_cells, "SELECT l_orderkey, l_linenumber, round(a.value, 6) AS value, a.kind AS value_type FROM (SELECT *, read_amount(raw) AS a FROM factloom_input)"), ORACLES["parse_number"])
_add(
    "sql_read_period",
    _called(_customers(_period_text), "SELECT c_custkey, p.* FROM (SELECT c_custkey, read_period(t, CASE WHEN c_custkey % 5 = 0 THEN 'balance_sheet' ELSE 'income_statement' END) AS p FROM factloom_input)"),
    ORACLES["detect_period"],
)
_add("sql_read_unit", _called(_customers(_unit_text), "SELECT c_custkey, u.* FROM (SELECT c_custkey, read_unit(t) AS u FROM factloom_input)"), ORACLES["detect_unit"])


def _with_facts(query: str):
    def run(spark, sf_dir: str):
        register(spark, facts(spark, sf_dir))
        return spark.sql(query)

    return run


_add(
    "sql_ratio_of",
    _with_facts("SELECT doc_id, scope, year, period_type, end_date, is_restated, round(value, 6) AS value, reason FROM ratio_of('gross_profit', 'cost_of_revenue')"),
    f"""{_BASE}
SELECT doc_id, scope, year, period_type, end_date, is_restated, CASE WHEN reason = '' THEN round(a / b * 100, 6) END AS value, reason FROM (
    SELECT n.doc_id, n.scope, n.year, n.period_type, n.end_date, n.is_restated, n.amount::DOUBLE AS a, d.amount::DOUBLE AS b,
           CASE WHEN n.reason <> '' THEN n.reason WHEN d.doc_id IS NULL THEN 'MISSING' WHEN d.reason <> '' THEN d.reason WHEN n.currency <> d.currency THEN 'CURRENCY_MIX' WHEN d.amount <= 0 THEN 'NONPOSITIVE_DENOMINATOR' ELSE '' END AS reason
    FROM (SELECT * FROM selected WHERE canonical_name = 'gross_profit') n LEFT JOIN (SELECT * FROM selected WHERE canonical_name = 'cost_of_revenue') d
    ON d.doc_id = n.doc_id AND d.scope = n.scope AND d.year = n.year AND d.period_type = n.period_type AND d.start_date IS NOT DISTINCT FROM n.start_date AND d.end_date IS NOT DISTINCT FROM n.end_date AND d.is_restated = n.is_restated)""",
)
_add(
    "sql_labels_like",
    _with_facts("SELECT * FROM labels_like('(?i)^(total|net)')"),
    f"{_BASE}\nSELECT doc_id, original_label AS label, canonical_name AS metric, count(*) AS n FROM facts WHERE regexp_matches(original_label, '(?i)^(total|net)') GROUP BY ALL",
)
