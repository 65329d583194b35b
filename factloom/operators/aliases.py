"""Labels to canonical metrics: exact match first, then the longest alias inside the label; ties resolve to nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_key

#: Names, owning statement and aliases; duplicates within one metric matter (they tie in the second tier).
METRICS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("revenue", "income_statement", ("营业收入", "营业总收入", "营收", "经营收入", "收入", "Revenue", "Operating Revenue", "Total Revenue", "Sales", "Net Sales", "Total Net Sales", "Turnover", "Revenues", "Operating Revenues", "营业(总)?收入",)),
    ("cost_of_revenue", "income_statement", ("营业成本", "Cost of Revenue", "销售成本", "Cost of revenues", "Cost of Sales", "Total Cost of Sales", "Cost of Goods Sold",)),
    ("gross_profit", "income_statement", ("毛利", "毛利润", "销售毛利", "Gross Profit", "毛利",)),
    ("gross_margin", "income_statement", ("毛利率", "Gross Margin", "Gross Profit Margin",)),
    ("operating_profit", "income_statement", ("营业利润", "Operating Profit", "经营利润", "Operating Income", "Income from Operations",)),
    ("profit_before_tax", "income_statement", ("利润总额", "税前利润", "Profit Before Tax", "除所得税前利润", "Profit before income tax", "Income Before Tax", "Profit before taxation",)),
    ("net_income", "income_statement", ("净利润", "Net Income", "Net Profit", "年度利润", "Profit for the year", "Net Earnings",)),
    ("net_income_attributable_to_parent", "income_statement", ("归属于母公司股东的净利润", "归属于母公司所有者的净利润", "归属于上市公司股东的净利润", "归属母公司股东净利润", "Net income attributable to shareholders of the parent", "Net income attributable to owners of the parent", "Net income attributable to equity holders", "Profit attributable to shareholders", "归属于母公司净利润",)),
    ("eps_basic", "income_statement", ("基本每股收益", "每股收益", "Basic Earnings Per Share", "Basic EPS", "Earnings Per Share",)),
    ("eps_diluted", "income_statement", ("稀释每股收益", "Diluted Earnings Per Share", "Diluted EPS",)),
    ("total_assets", "balance_sheet", ("资产总计", "资产总额", "总资产", "Total Assets", "Total assets",)),
    ("total_liabilities", "balance_sheet", ("负债合计", "负债总额", "总负债", "Total Liabilities", "Total liabilities",)),
    ("total_equity", "balance_sheet", ("股东权益合计", "所有者权益合计", "权益合计", "权益总额", "归属母公司股东权益合计", "Total Equity", "Total equity", "Shareholders' Equity", "Stockholders' Equity", "Total shareholders' equity",)),
    ("cash_and_cash_equivalents", "balance_sheet", ("货币资金", "现金及现金等价物", "Cash and Cash Equivalents", "Cash and cash equivalents", "Cash & Cash Equivalents",)),
    ("accounts_receivable", "balance_sheet", ("应收账款", "应收款项", "Accounts Receivable", "Trade Receivables", "Trade and Other Receivables",)),
    ("inventory", "balance_sheet", ("存货", "库存", "Inventory", "Inventories",)),
    ("short_term_debt", "balance_sheet", ("短期借款", "短期债务", "Short-term Debt", "Short-term Borrowings", "Current Debt",)),
    ("long_term_debt", "balance_sheet", ("长期借款", "长期债务", "Long-term Debt", "Long-term Borrowings", "Non-current Debt",)),
    ("operating_cash_flow", "cash_flow", ("经营活动产生的现金流量净额", "经营活动现金流量净额", "经营活动现金流净额", "经营活动所得现金净额", "Net cash flows from operating activities", "Net cash provided by operating activities", "Net cash generated from operating activities", "Net cash flows generated from operating activities", "Operating cash flow", "Cash flows from operating activities", "Cash generated by operating activities",)),
    ("investing_cash_flow", "cash_flow", ("投资活动产生的现金流量净额", "投资活动现金流量净额", "投资活动所用现金净额", "Net cash flows from investing activities", "Net cash used in investing activities", "Net cash flows used in investing activities", "Cash flows from investing activities",)),
    ("financing_cash_flow", "cash_flow", ("筹资活动产生的现金流量净额", "融资活动产生的现金流量净额", "融资活动所得现金净额", "融资活动所用现金净额", "Net cash flows from financing activities", "Net cash used in financing activities", "Net cash flows used in financing activities", "Cash flows from financing activities",)),
    ("capital_expenditure", "cash_flow", ("资本支出", "资本性支出", "购买物业、厂房及设备、土地使用权及无形资产", "购建固定资产、无形资产和其他长期资产支付的现金", "Capital Expenditure", "Capital Expenditures", "CapEx", "Purchase of property, plant and equipment", "Purchases of PP&E",)),
    ("free_cash_flow", "cash_flow", ("自由现金流", "Free Cash Flow", "FCF",)),
)


#: Aliases are looked up by so many of their first signs (those of two by both).
ANCHOR = 3


def alias_table(spark: SparkSession) -> DataFrame:
    """(metric, statement_type, alias_ord, key, length): a fixed dimension of under 200 rows."""
    quote = lambda x: "'" + x.replace("'", "\\'") + "'"
    rows = [(m, s, i, "".join(a.split()).lower()) for m, s, names in METRICS for i, a in enumerate(names)]
    values = ", ".join(f"({quote(m)}, {quote(s)}, {i}, {quote(k)}, {len(k)})" for m, s, i, k in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(metric, statement_type, alias_ord, key, length)")


def with_grams(keyed: DataFrame, key: str) -> DataFrame:
    """keyed once for each distinct run of two to ANCHOR signs in its key, in column gram."""
    places = F.when(F.length(key) > 0, F.sequence(F.lit(1), F.length(key))).otherwise(F.array().cast("array<int>"))
    run_of = lambda n: F.transform(places, lambda i: F.substring(F.col(key), i, F.lit(n)))
    return keyed.withColumn("gram", F.explode(F.array_distinct(F.concat(*map(run_of, range(2, ANCHOR + 1))))))


def resolve(labels: DataFrame, label_col: str = "label", statement: str | None = None, patterns: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """labels with ``metric`` and ``confidence``.

    high: the whole label is an alias of one metric; medium: one alias is the longest inside it; low: only one of
    ``patterns`` (metric, regular expression) fits, or a tie left no metric; unknown: nothing fits.
    """
    table = alias_table(labels.sparkSession)
    if statement:
        table = table.where(F.col("statement_type") == statement)
    keyed = labels.select(F.col(label_col).alias("_label")).distinct().withColumn("_key", label_key(F.col("_label")))
    # labels meet aliases by an equi join on the alias's first signs, which a label that holds it has somewhere
    inside = with_grams(keyed, "_key").join(table.withColumn("anchor", F.substring("key", 1, ANCHOR)), F.col("gram") == F.col("anchor")).where(F.col("_key").contains(F.col("key")))
    by_length = inside.groupBy("_label", "length", (F.length("_key") == F.col("length")).alias("whole")).agg(F.count("*").alias("n"), F.count_distinct("metric").alias("metrics"), F.min("metric").alias("metric"))
    best = by_length.groupBy("_label").agg(F.max_by(F.struct(F.when(F.col("whole"), F.col("metrics")).otherwise(F.col("n")).alias("n"), "metric", "whole"), "length").alias("b"))
    one = F.col("b.n") == 1
    done = best.select("_label", F.when(one, F.col("b.metric")).alias("metric"), F.when(~one, "low").when(F.col("b.whole"), "high").otherwise("medium").alias("confidence"))
    out = labels.join(done, F.col(label_col) == F.col("_label"), "left").drop("_label")
    fits = F.filter(F.array(*[F.when(F.col(label_col).rlike(x), F.lit(m)) for m, x in patterns]).cast("array<string>"), lambda m: m.isNotNull())
    last = F.col("confidence").isNull() & (F.size(fits) > 0)
    return out.withColumns({"metric": F.when(last & (F.size(fits) == 1), F.get(fits, F.lit(0))).otherwise(F.col("metric")), "confidence": F.when(last, "low").otherwise(F.coalesce("confidence", F.lit("unknown")))})


def _keys(statement: str | None) -> list[tuple[str, str]]:
    """(metric, alias without white space in lower case)."""
    return [(m, "".join(a.split()).lower()) for m, s, names in METRICS if statement in (None, s) for a in names]


def metric_hits(text: Column, statement: str | None = None) -> Column:
    """How many metrics have an alias in single-spaced lower-case text (each counts once)."""
    by_metric: dict[str, list[str]] = {}
    for m, k in _keys(statement):
        by_metric.setdefault(m, []).append(k)
    hits = []
    for keys in by_metric.values():
        # an alias that holds a shorter one is met with it
        short = [k for k in dict.fromkeys(keys) if not any(o != k and o in k for o in keys)]
        met = text.contains(short[0])
        for k in short[1:]:
            met = met | text.contains(k)
        hits.append(met.cast("int"))
    return sum(hits[1:], hits[0])
