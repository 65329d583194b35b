"""Gated scalars: each input is an amount or the reason why there is none.

Candidates of one key are never resolved silently: a missing cell, an unknown unit or two different amounts refuse the
whole key, and the first gate that fails names the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = ["year", "period_type", "start_date", "end_date", "is_restated"]
REPORT = ["doc_id", "scope"]


def amount(value: Column, multiplier: Column) -> Column:
    """value * multiplier as an exact decimal; null if either is missing or the product is out of range."""
    return F.try_multiply(value.try_cast("decimal(24,6)"), multiplier.try_cast("decimal(13,0)")).try_cast("decimal(38,6)")


def money_unit(currency: Column, scale: str | Column = "亿") -> Column:
    """Display unit: scale and the currency's name (its code if it has none; an unknown currency reads 元)."""
    names = F.create_map(*[F.lit(x) for kv in {"CNY": "元", "USD": "美元", "HKD": "港元", "SGD": "新加坡元", "EUR": "欧元"}.items() for x in kv])
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return F.concat(scale, F.coalesce(F.element_at(names, currency), F.nullif(currency, F.lit("")), F.lit("元")))


def first_reason(*inputs: Column) -> Column:
    """Distinct reasons in order, else CURRENCY_MIX if currencies differ, else empty. inputs are gated structs."""
    reasons = F.array_distinct(F.filter(F.array(*[i["reason"] for i in inputs]), lambda r: r != ""))
    mixed = F.size(F.array_distinct(F.array(*[i["currency"] for i in inputs]))) > 1
    return F.when(F.size(reasons) > 0, F.array_join(reasons, ";")).when(mixed, "CURRENCY_MIX").otherwise("")


#: What identifies an input.
KEY = [*REPORT, "statement_type", "canonical_name", *PERIOD]


def told(facts: DataFrame) -> DataFrame:
    """One row per input with what its sources say together: counts, flags and extremes, which can be merged further."""
    own = facts.where(F.col("canonical_name").isNotNull()).withColumn("amount", amount(F.col("value"), F.col("multiplier")))
    # the step of the last printed digit, as an exact decimal
    decimals = F.length(F.regexp_extract(F.translate("raw_value", "０１２３４５６７８９．", "0123456789."), r"\.(\d+)", 1))
    quantum = (F.col("multiplier").cast("decimal(13,0)") * F.concat(F.lit("1e-"), decimals).try_cast("decimal(20,12)")).cast("double")
    return own.withColumn("quantum", quantum).groupBy(*KEY).agg(
        F.count("*").alias("n_sources"),
        F.bool_or((F.coalesce("currency", F.lit("")) == "") | F.col("multiplier").isNull() | (F.col("multiplier") <= 0)).alias("no_unit"),
        F.bool_or(F.col("value").isNull()).alias("no_value"),
        F.bool_or(F.coalesce(F.col("value_type") != "monetary", F.lit(True))).alias("not_money"),
        F.bool_or(F.col("value").isNotNull() & F.col("amount").isNull()).alias("not_finite"),
        F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.min("currency").alias("c_lo"), F.max("currency").alias("c_hi"),
        F.max("quantum").alias("quantum"), F.array_sort(F.collect_set("source_page")).alias("pages"),
        F.bool_or(F.col("extraction_method") == "local_ocr").alias("ocr"), F.max("multiplier").alias("scale"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Rows of told() over parts of the facts as told() over all of them would give them."""
    flags = [F.bool_or(c).alias(c) for c in ("no_unit", "no_value", "not_money", "not_finite", "ocr")]
    ends = [f(c).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"), (F.min, "c_lo"), (F.max, "c_hi"), (F.max, "quantum"), (F.max, "scale"))]
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages")
    # a part has a key once, so there is nothing to aggregate before the shuffle
    return parts.repartition(*KEY).groupBy(*KEY).agg(F.sum("n_sources").alias("n_sources"), *flags, *ends, pages).select(parts.columns)


def gated(got: DataFrame) -> DataFrame:
    """The amount of each row of told(), or the first reason for refusing one."""
    reason = (
        F.when(F.col("scope") == "unknown", "UNKNOWN_SCOPE").when(F.col("no_unit"), "UNKNOWN_UNIT").when(F.col("no_value"), "NULL_VALUE").when(F.col("not_money"), "NOT_MONETARY")
        .when(F.col("not_finite"), "NON_FINITE").when((F.col("lo") != F.col("hi")) | (F.col("c_lo") != F.col("c_hi")), "CONFLICT").otherwise("")
    )
    ok = reason == ""
    return got.select(
        *KEY, "n_sources", F.when(ok, F.col("lo")).alias("amount"), F.when(ok, F.col("c_lo")).otherwise("").alias("currency"),
        reason.alias("reason"), "quantum", "pages", "ocr", "scale",
    )


def select_values(facts: DataFrame) -> DataFrame:
    """One row per (report, statement, metric, period): amount, currency, reason, and how many sources it has."""
    return gated(told(facts))


def wide(selected: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """One row per ``by`` with a gated struct per name; an absent key is MISSING."""
    fields = ["amount", "currency", "reason", "n_sources", "quantum", "pages", "ocr", "scale"]
    aggs = [F.max(F.when(F.col("canonical_name") == n, F.struct(*fields))).alias(n) for n in names]
    absent = lambda n: F.struct(
        F.lit(None).cast("decimal(38,6)").alias("amount"), F.lit("").alias("currency"), F.lit("MISSING").alias("reason"), F.lit(0).cast("long").alias("n_sources"),
        F.lit(None).cast("double").alias("quantum"), F.array().cast("array<int>").alias("pages"), F.lit(False).alias("ocr"), F.lit(None).cast("decimal(12,0)").alias("scale"),
    )
    return selected.groupBy(*by).agg(*aggs).select(*by, *[F.coalesce(n, absent(n)).alias(n) for n in names])


#: select_values in DuckDB, over ``facts``.
SELECTED_SQL = """
selected AS (
    SELECT doc_id, scope, statement_type, canonical_name, year, period_type, start_date, end_date, is_restated, n_sources, quantum, scale, ocr, reason, p_lo, p_hi,
           CASE WHEN reason = '' THEN lo END AS amount, CASE WHEN reason = '' THEN c_lo ELSE '' END AS currency
    FROM (SELECT *, CASE WHEN scope = 'unknown' THEN 'UNKNOWN_SCOPE' WHEN no_unit THEN 'UNKNOWN_UNIT' WHEN no_value THEN 'NULL_VALUE' WHEN not_money THEN 'NOT_MONETARY'
                 WHEN lo <> hi OR c_lo <> c_hi THEN 'CONFLICT' ELSE '' END AS reason
          FROM (SELECT doc_id, scope, statement_type, canonical_name, year, period_type, start_date, end_date, is_restated, count(*) AS n_sources,
                       bool_or(currency = '' OR multiplier <= 0) AS no_unit, bool_or(value IS NULL) AS no_value, bool_or(value_type <> 'monetary') AS not_money,
                       min(value * multiplier) AS lo, max(value * multiplier) AS hi, min(currency) AS c_lo, max(currency) AS c_hi,
                       max(multiplier::DOUBLE / pow(10, CASE WHEN contains(raw_value, '.') THEN length(raw_value) - instr(raw_value, '.') ELSE 0 END)) AS quantum, max(multiplier) AS scale, bool_or(extraction_method = 'local_ocr') AS ocr, min(source_page) AS p_lo, max(source_page) AS p_hi
                FROM facts WHERE canonical_name IS NOT NULL GROUP BY ALL))
)"""
