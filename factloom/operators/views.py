"""Views of facts, metrics and comparisons as a reader sees them, and facts about whole reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed_number
from .inputs import PERIOD, REPORT, amount

#: What stands for missing values, unknown currencies and labels without a metric: fixed values.
NONE, UNKNOWN, UNMAPPED = "—", "未知", "未映射"
#: Names of metrics in messages: fixed values.
FIELD_NAMES = (
    ("revenue", "营业收入"), ("net_income", "净利润"), ("operating_cash_flow", "经营现金流"), ("operating_profit", "营业利润"), ("gross_profit", "毛利"),
    ("cost_of_revenue", "营业成本"), ("total_assets", "总资产"), ("total_liabilities", "总负债"), ("capital_expenditure", "资本支出"),
)
#: Kinds of failures to open a file, by what the message mentions, first match first.
FAILURES = (("PASSWORD", "password|encrypted|authenticate"), ("UNREADABLE", "empty|broken|invalid|not a pdf|format"))


def value_rows(facts: DataFrame) -> DataFrame:
    """One row per source value with its provenance, duplicates and missing values included."""
    total = amount(F.col("value"), F.col("multiplier"))
    return facts.select(
        *REPORT, "statement_type", F.col("original_label").alias("label"), F.col("year").cast("string").alias("year"), "period_type", "is_restated", F.coalesce(F.nullif("raw_value", F.lit("")), F.lit(NONE)).alias("raw_value"),
        F.coalesce(F.nullif("currency", F.lit("")), F.lit(UNKNOWN)).alias("currency"), "value_type", F.coalesce(F.col("multiplier").cast("string"), F.lit(UNKNOWN)).alias("multiplier"),
        F.coalesce(trimmed_number(total, 8), F.lit(NONE)).alias("amount"), "source_page", F.coalesce("canonical_name", F.lit(UNMAPPED)).alias("metric"), "extraction_method",
    )


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Metrics with results of two decimals, and whether they could be computed."""
    return metrics.select(*REPORT, "metric", "year", "period_type", "is_restated", F.coalesce(F.format_number("value", 2), F.lit(NONE)).alias("result"), "unit", F.when(F.col("value").isNotNull(), "computed").otherwise("refused").alias("status"), "reason")


#: Metric -> its inputs as (name, of the year before).
INPUTS = {
    "net_margin": (("net_income", 0), ("revenue", 0)), "operating_margin": (("operating_profit", 0), ("revenue", 0)), "debt_to_assets": (("total_liabilities", 0), ("total_assets", 0)),
    "revenue_growth": (("revenue", 0), ("revenue", 1)), "net_income_growth": (("net_income", 0), ("net_income", 1)), "ocf_margin": (("operating_cash_flow", 0), ("revenue", 0)),
    "free_cash_flow": (("operating_cash_flow", 0), ("capital_expenditure", 0)),
}


def metric_inputs(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """Every source value behind a computed metric, one row each."""
    spec = F.create_map(*[x for n, parts in INPUTS.items() for x in (F.lit(n), F.array(*[F.struct(F.lit(p).alias("input"), F.lit(back).alias("back")) for p, back in parts]))])
    wanted = metrics.where("value is not null").withColumn("i", F.explode(F.element_at(spec, F.col("metric"))))
    wanted = wanted.select(*REPORT, "metric", F.col("year").alias("result_year"), "is_restated", F.col("i.input").alias("canonical_name"), (F.col("year") - F.col("i.back")).alias("year"), F.col("i.back").alias("back"))
    told = facts.where("canonical_name is not null").withColumnRenamed("is_restated", "told_restated")
    met = wanted.join(told, [*REPORT, "canonical_name", "year"]).where("back = 1 or told_restated = is_restated")
    return met.select(*REPORT, "metric", "result_year", "is_restated", F.col("canonical_name").alias("input"), F.col("year").alias("input_year"), F.col("original_label").alias("label"), "raw_value", F.coalesce(F.nullif("currency", F.lit("")), F.lit(UNKNOWN)).alias("currency"), F.col("multiplier").cast("string").alias("multiplier"), "source_page")


def comparison_rows(points: DataFrame) -> DataFrame:
    """Points of two reports as printed: numbers of at most six decimals, and why one is not usable."""
    shown = lambda c: F.coalesce(trimmed_number(F.col(c), 6), F.lit(NONE))
    return points.select(
        "pair_id", "scope", F.col("canonical_name").alias("metric"), "year", shown("value").alias("value"), F.coalesce(F.nullif("currency", F.lit("")), F.lit(UNKNOWN)).alias("currency"), "status", shown("change").alias("change"),
        shown("growth_percent").alias("growth_percent"), F.concat_ws("；", F.nullif("reason", F.lit("")), F.nullif("change_reason", F.lit(""))).alias("note"),
    )


def comparison_originals(values: DataFrame) -> DataFrame:
    """The values of both documents behind the points, one row each."""
    own = values.where("canonical_name is not null and period_type in ('annual', 'point_in_time')")
    return own.select("pair_id", "scope", F.col("canonical_name").alias("metric"), "year", "document_id", "source_page", F.col("original_label").alias("label"), "raw_value", F.coalesce(F.nullif("currency", F.lit("")), F.lit(UNKNOWN)).alias("currency"), F.col("multiplier").cast("string").alias("multiplier"), "is_restated")


def report_facts(facts: DataFrame) -> DataFrame:
    """Per report: its currency if all values share one, whether it has values, its scopes, and whether OCR needs review."""
    scopes = F.transform(F.array_sort(F.collect_set(F.struct(F.when(F.col("scope") == "consolidated", 0).when(F.col("scope") == "parent", 1).otherwise(2).alias("o"), "scope"))), lambda s: s["scope"])
    currency = F.nullif("currency", F.lit(""))
    return facts.groupBy("doc_id").agg(
        F.when(F.count_distinct(currency) == 1, F.max(currency)).otherwise("").alias("currency"), (F.count("value") > 0).alias("has_values"), F.array_join(scopes, ",").alias("scopes"),
        F.bool_or(F.col("extraction_method") == "local_ocr").alias("needs_review"),
    )


def reviewed(reports: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Reports that may be analysed: those without OCR, and those that a user confirmed. confirmed: doc_id."""
    met = reports.join(confirmed.select("doc_id").distinct().withColumn("_ok", F.lit(True)), "doc_id", "left")
    return met.where(~F.col("needs_review") | F.col("_ok")).drop("_ok")


def garbled_pages(pages: DataFrame) -> DataFrame:
    """Documents with a replacement character in any page, and how many such pages."""
    return pages.where(F.col("text").contains("\ufffd")).groupBy("doc_id").agg(F.count("*").alias("n_pages"))


def first_warnings(warnings: DataFrame) -> DataFrame:
    """Each message of a document once, numbered by where it first stood. warnings: doc_id, ord, message."""
    first = warnings.groupBy("doc_id", "message").agg(F.min("ord").alias("first"), F.count("*").alias("times"))
    return first.select("doc_id", "message", "times", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "message")).alias("no"))


def bridge_pages(facts: DataFrame) -> DataFrame:
    """The pages that a report's gross profit of a year rests on: of revenue, cost and reported gross profit."""
    own = facts.where("statement_type = 'income_statement' and period_type = 'annual' and canonical_name in ('revenue', 'cost_of_revenue', 'gross_profit') and source_page > 0")
    return own.groupBy(*REPORT, "year").agg(F.array_join(F.transform(F.array_sort(F.collect_set("source_page")), lambda p: p.cast("string")), ",").alias("pages"))


def named_reason(reason: Column) -> Column:
    """A reason with metric names in place of field names."""
    for field, name in FIELD_NAMES:
        reason = F.regexp_replace(reason, rf"\b{field}\b", name)
    return reason


def failure_kind(message: Column) -> Column:
    """What kept a file from being read: PASSWORD, UNREADABLE or UNKNOWN."""
    out = F.lit("UNKNOWN")
    for code, pattern in reversed(FAILURES):
        out = F.when(F.lower(message).rlike(pattern), code).otherwise(out)
    return out
