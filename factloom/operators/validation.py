"""Accounting checks over all periods and scopes: coverage, balance equation, input quality. No value is altered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inputs import PERIOD, REPORT, first_reason, select_values, wide

STATEMENTS = ("income_statement", "balance_sheet", "cash_flow")


def balance_checks(facts: DataFrame, selected: DataFrame | None = None, with_pages: bool = False) -> DataFrame:
    """assets = liabilities + equity within half of the summed rounding steps of the reported figures.

    selected: select_values(facts), if it is at hand; with_pages: also the pages of all sources of the three.
    """
    names = ["total_assets", "total_liabilities", "total_equity"]
    selected = select_values(facts.where("statement_type = 'balance_sheet'")) if selected is None else selected.where("statement_type = 'balance_sheet'")
    got = wide(selected, names, [*REPORT, *PERIOD])
    a, li, e = (F.col(n) for n in names)
    reason = F.when(F.col("period_type") != "point_in_time", "NOT_POINT_IN_TIME").otherwise(first_reason(a, li, e))
    diff = F.abs(a["amount"] - li["amount"] - e["amount"])
    tolerance = (a["quantum"] + li["quantum"] + e["quantum"]) / 2
    larger = F.greatest(F.abs(a["amount"]), F.abs(li["amount"] + e["amount"])).cast("double")
    status = F.when(reason != "", "skipped").when(diff.cast("double") <= tolerance + 1e-9, "passed").otherwise("failed")
    ok = status != "skipped"
    return got.select(
        *REPORT, *PERIOD, F.lit("balance_sheet_equation").alias("rule"), status.alias("status"), reason.alias("reason"), F.when(ok, F.round(diff.cast("double"), 6)).alias("difference"),
        F.when(ok, F.round(F.coalesce(F.try_divide(diff.cast("double"), larger), F.lit(0.0)), 9)).alias("relative"), F.when(ok, F.round(tolerance, 6)).alias("tolerance"),
        *([F.array_sort(F.array_distinct(F.flatten(F.array(*[x["pages"].cast("array<int>") for x in (a, li, e)])))).alias("pages")] if with_pages else []),
    )


def latest_balance(facts: DataFrame) -> DataFrame:
    """The check of each report's latest period only."""
    return balance_checks(facts).groupBy(*REPORT).agg(F.max_by(F.struct("year", "status", "difference", "tolerance"), F.struct(*PERIOD)).alias("c")).select(*REPORT, "c.*")


def statement_coverage(facts: DataFrame) -> DataFrame:
    """A skipped row for each statement that a report in a scope lacks."""
    have = facts.select(*REPORT, "statement_type").distinct()
    every = have.select(*REPORT).distinct().withColumn("statement_type", F.explode(F.array(*[F.lit(s) for s in STATEMENTS])))
    gone = every.join(have, [*REPORT, "statement_type"], "left_anti")
    return gone.select(*REPORT, "statement_type", F.lit("statement_coverage").alias("rule"), F.lit("skipped").alias("status"), F.lit("MISSING_STATEMENT").alias("reason"))


def input_quality(facts: DataFrame, selected: DataFrame | None = None, with_pages: bool = False) -> DataFrame:
    """Keys that are refused: failed for conflicts and non-finite amounts, skipped else. EPS and reported margins are not checked."""
    checked = ~F.col("canonical_name").startswith("eps_") & (F.col("canonical_name") != "gross_margin")
    got = (select_values(facts.where(checked)) if selected is None else selected.where(checked)).where("reason <> ''")
    status = F.when(F.col("reason").isin("CONFLICT", "NON_FINITE"), "failed").otherwise("skipped")
    return got.select(*REPORT, "statement_type", "canonical_name", *PERIOD, F.lit("input_quality").alias("rule"), status.alias("status"), "reason", "n_sources", *([F.col("pages").cast("array<int>").alias("pages")] if with_pages else []))


#: How a label names restated and original columns: fixed values.
RESTATED, ORIGINAL = "重述", "原列"


def period_label(year: Column, kind: Column, end: Column, restated: Column) -> Column:
    """Year, kind, end date if there is one, and whether the column is restated; empty without a year."""
    label = F.concat_ws(" / ", year.cast("string"), kind, F.nullif(F.coalesce(end, F.lit("")), F.lit("")), F.when(restated, RESTATED).otherwise(ORIGINAL))
    return F.when(year.isNull(), "").otherwise(label)


def fixed_tolerance(multiplier: Column) -> Column:
    """Tolerance for three amounts rounded on their own, half a unit each, where no printed figures are at hand."""
    return 1.5 * multiplier.cast("double")


def run_all(facts: DataFrame, selected: DataFrame | None = None, with_pages: bool = False) -> DataFrame:
    """All checks: (doc_id, scope, rule, item, period, period_label, status, reason); item is a statement or a metric.

    selected: select_values(facts), if it is at hand; with_pages: also the pages that a check looked at.
    """
    none = {"year": "int", "period_type": "string", "start_date": "string", "end_date": "string", "is_restated": "boolean"}
    rows = balance_checks(facts, selected, with_pages).withColumn("item", F.lit("balance_sheet"))
    gaps = statement_coverage(facts).withColumnRenamed("statement_type", "item").withColumns({n: F.lit(None).cast(t) for n, t in none.items()}).withColumn("pages", F.array().cast("array<int>"))
    keys = input_quality(facts, selected, with_pages).withColumnRenamed("canonical_name", "item")
    columns = [*REPORT, "rule", "item", *PERIOD, "status", "reason", *(["pages"] if with_pages else [])]
    every = rows.select(*columns).unionByName(gaps.select(*columns)).unionByName(keys.select(*columns))
    return every.withColumn("period_label", period_label(*(F.col(c) for c in ("year", "period_type", "end_date", "is_restated"))))


BALANCE_SQL = """
balance AS (
    SELECT *, CASE WHEN reason <> '' THEN 'skipped' WHEN diff::DOUBLE <= tol + 1e-9 THEN 'passed' ELSE 'failed' END AS status
    FROM (SELECT doc_id, scope, year, period_type, start_date, end_date, is_restated, abs(a - l - e) AS diff, greatest(abs(a), abs(l + e)) AS larger, tol,
                 CASE WHEN period_type <> 'point_in_time' THEN 'NOT_POINT_IN_TIME' WHEN whys <> '' THEN whys WHEN n < 3 THEN 'MISSING' WHEN c_lo <> c_hi THEN 'CURRENCY_MIX' ELSE '' END AS reason
          FROM (SELECT doc_id, scope, year, period_type, start_date, end_date, is_restated, count(*) AS n, sum(quantum) / 2 AS tol,
                       max(amount) FILTER (canonical_name = 'total_assets') AS a, max(amount) FILTER (canonical_name = 'total_liabilities') AS l, max(amount) FILTER (canonical_name = 'total_equity') AS e,
                       coalesce(string_agg(DISTINCT nullif(reason, ''), ';'), '') AS whys, min(currency) AS c_lo, max(currency) AS c_hi
                FROM selected WHERE canonical_name IN ('total_assets', 'total_liabilities', 'total_equity') GROUP BY ALL))
)"""
