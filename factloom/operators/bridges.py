"""Why a figure changed: gross profit by revenue and cost, revenue by segments; and trend cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .inputs import PERIOD, REPORT, amount, first_reason, money_unit, select_values, wide
from .metrics import _filled, compute_metrics

_DECIMAL = "decimal(38,6)"


def _scale(magnitude: Column, currency: Column) -> tuple[Column, Column]:
    """Divisor and display unit for a bridge."""
    big, mid = magnitude >= 1_000_000, magnitude >= 10_000
    divisor = F.when(big, F.lit(1e8)).when(mid, F.lit(1e4)).otherwise(F.lit(1.0))
    return divisor, F.when(big, money_unit(currency, "亿")).when(mid, money_unit(currency, "万")).otherwise(money_unit(currency, ""))


def _latest_pair(facts: DataFrame, selected: DataFrame, names: list[str]) -> DataFrame:
    """Per report: the latest annual year, how many periods it and the year before have, and both years' inputs."""
    by = [*REPORT, *PERIOD]
    periods = facts.where("statement_type = 'income_statement' and period_type = 'annual'").select(*by).distinct()
    got = _filled(periods.join(wide(selected.where("statement_type = 'income_statement'"), names, by), by, "left"), names)
    # struct of strings and inputs per year; a report has a few years only
    latest = F.max("year").over(Window.partitionBy(*REPORT))
    rows = got.withColumn("latest", latest).where("year >= latest - 1")
    row = F.struct(*PERIOD, *names)
    return rows.groupBy(*REPORT, "latest").agg(
        F.count_if(F.col("year") == F.col("latest")).alias("n_now"), F.count_if(F.col("year") == F.col("latest") - 1).alias("n_before"),
        F.max_by(F.when(F.col("year") == F.col("latest"), row), F.col("year") == F.col("latest")).alias("now"), F.max_by(F.when(F.col("year") < F.col("latest"), row), F.col("year") < F.col("latest")).alias("before"),
    )


def gross_profit_bridge(facts: DataFrame) -> DataFrame:
    """Start, effect of revenue, effect of cost and end of gross profit between the two latest years, or a reason."""
    pair = _latest_pair(facts, select_values(facts), ["revenue", "cost_of_revenue", "gross_profit"])
    now, before = F.col("now"), F.col("before")
    cut = lambda c: F.substring(c, 5, 100)
    r0, r1, c0, c1 = before["revenue"], now["revenue"], before["cost_of_revenue"], now["cost_of_revenue"]
    a0, a1 = F.abs(c0["amount"]), F.abs(c1["amount"])
    start, end = r0["amount"] - a0, r1["amount"] - a1
    revenue_effect, cost_effect = r1["amount"] - r0["amount"], a0 - a1
    tolerance = F.greatest(F.lit(1), 2 * F.greatest(r0["scale"], r1["scale"], c0["scale"], c1["scale"])).cast("double")
    inputs = first_reason(r0, c0, r1, c1)

    def reported(gross: Column, derived: Column) -> Column:
        return (
            F.when(gross["n_sources"] == 0, "").when(gross["reason"] != "", "GP_REPORTED").when(gross["currency"] != r0["currency"], "GP_CURRENCY")
            .when(F.abs(gross["amount"] - derived).cast("double") > tolerance, "GP_MISMATCH").otherwise("")
        )

    g0, g1 = reported(before["gross_profit"], start), reported(now["gross_profit"], end)
    reason = (
        F.when((F.col("n_now") != 1) | (F.col("n_before") != 1), "GP_NOT_UNIQUE").when((cut(now["start_date"]) != cut(before["start_date"])) | (cut(now["end_date"]) != cut(before["end_date"])), "GP_PERIOD")
        .when(inputs != "", F.concat(F.lit("GP_INPUT:"), inputs)).when(~(((c0["amount"] >= 0) & (c1["amount"] >= 0)) | ((c0["amount"] <= 0) & (c1["amount"] <= 0))), "GP_SIGN")
        .when(start + revenue_effect + cost_effect != end, "GP_ALIGN").when(g0 != "", g0).otherwise(g1)
    )
    divisor, unit = _scale(F.greatest(F.abs(start), F.abs(end), F.abs(revenue_effect), F.abs(cost_effect)), r0["currency"])
    shown = lambda c: F.when(reason == "", F.round(c.cast("double") / divisor, 6))
    return pair.select(
        *REPORT, F.col("latest").alias("year"), reason.alias("reason"), F.when(reason == "", unit).alias("unit"), shown(start).alias("start"), shown(revenue_effect).alias("revenue_effect"),
        shown(cost_effect).alias("cost_effect"), shown(end).alias("end"), (F.coalesce((reason == "") & (before["gross_profit"]["n_sources"] > 0) & (now["gross_profit"]["n_sources"] > 0), F.lit(False))).alias("verified"),
        F.coalesce(r0["ocr"] | r1["ocr"] | c0["ocr"] | c1["ocr"], F.lit(False)).alias("provisional"),
    )


def revenue_segment_bridge(facts: DataFrame) -> DataFrame:
    """Change of revenue by the unmapped rows just above it, if both years' rows add up to it exactly.

    One row per segment; a report that is refused has one row with a reason.
    """
    pair = _latest_pair(facts, select_values(facts), ["revenue"])
    now, before = F.col("now"), F.col("before")
    cut = lambda c: F.substring(c, 5, 100)
    pages = F.array_union(now["revenue"]["pages"], before["revenue"]["pages"])
    gate = (
        F.when((F.col("n_now") != 1) | (F.col("n_before") != 1), "SEG_NOT_UNIQUE").when((cut(now["start_date"]) != cut(before["start_date"])) | (cut(now["end_date"]) != cut(before["end_date"])), "SEG_PERIOD")
        .when(first_reason(before["revenue"], now["revenue"]) != "", "SEG_TOTAL").when(F.size(pages) != 1, "SEG_PAGE").otherwise("")
    )
    totals = pair.select(
        *REPORT, F.col("latest").alias("year"), gate.alias("gate"), before["revenue"]["amount"].alias("t0"), now["revenue"]["amount"].alias("t1"), before["revenue"]["currency"].alias("currency"),
        F.when(gate == "", pages[0]).alias("page"), *[before[c].alias(f"b_{c}") for c in PERIOD], *[now[c].alias(f"n_{c}") for c in PERIOD],
    )
    # the run of unmapped rows that ends right before a revenue row: rows between the mapped one before and it
    lines = facts.where("statement_type = 'income_statement'").select(*REPORT, "metric_ordinal", "canonical_name", "original_label").distinct()
    up = Window.partitionBy(*REPORT).orderBy("metric_ordinal")
    run = lines.withColumn("next_mapped", F.min(F.when(F.col("canonical_name").isNotNull(), F.col("metric_ordinal"))).over(up.rowsBetween(1, Window.unboundedFollowing)))
    revenue = lines.where("canonical_name = 'revenue'").select(*REPORT, F.col("metric_ordinal").alias("at"))
    blocks = run.where("canonical_name is null").join(revenue, REPORT).where("next_mapped = at and metric_ordinal >= at - 8")
    fit = blocks.groupBy(*REPORT, "at").agg(F.count("*").alias("n"), F.count_distinct(F.trim("original_label")).alias("labels")).where("n between 2 and 6 and n = labels")
    values = facts.where("statement_type = 'income_statement' and canonical_name is null").withColumn("amount", amount(F.col("value"), F.col("multiplier")))
    cells = blocks.join(fit, [*REPORT, "at"]).join(totals.where("gate = ''"), REPORT).select(*REPORT, "at", "metric_ordinal", F.trim("original_label").alias("label"), "n", "t0", "t1", "currency", "page", "year", *[f"b_{c}" for c in PERIOD], *[f"n_{c}" for c in PERIOD])
    same = lambda p: F.struct(*[F.col(c) for c in PERIOD]) == F.struct(*[F.col(f"{p}_{c}") for c in PERIOD])
    joined = cells.join(values.select(*REPORT, "metric_ordinal", *PERIOD[1:], F.col("year").alias("v_year"), "amount", "value_type", "source_page", F.col("currency").alias("v_currency")), [*REPORT, "metric_ordinal"])
    joined = joined.withColumnRenamed("year", "latest").withColumnRenamed("v_year", "year").where(same("b") | same("n"))
    usable = F.col("amount").isNotNull() & (F.col("amount") >= 0) & (F.col("value_type") == "monetary") & (F.col("source_page") == F.col("page")) & (F.col("v_currency") == F.col("currency"))
    per_line = joined.groupBy(*REPORT, "at", "metric_ordinal", "label", "n", "t0", "t1", "currency", "latest").agg(
        F.count_if(same("b")).alias("k0"), F.count_if(same("n")).alias("k1"), F.bool_and(usable).alias("usable"), F.max(F.when(same("b"), F.col("amount"))).alias("v0"), F.max(F.when(same("n"), F.col("amount"))).alias("v1")
    )
    block = per_line.groupBy(*REPORT, "at", "n", "t0", "t1", "currency").agg(
        F.count_if((F.col("k0") == 1) & (F.col("k1") == 1) & F.col("usable")).alias("good"), F.sum("v0").alias("s0"), F.sum("v1").alias("s1"), F.max(F.abs(F.col("v1") - F.col("v0"))).alias("most")
    ).where("good = n and s0 = t0 and s1 = t1")
    first = block.groupBy(*REPORT).agg(F.min("at").alias("at"))
    divisor, unit = _scale(F.greatest(F.abs("t0"), F.abs("t1"), "most"), F.col("currency"))
    good = per_line.join(block.join(first, [*REPORT, "at"]).select(*REPORT, "at", "most"), [*REPORT, "at"]).select(
        *REPORT, F.col("latest").alias("year"), F.lit("").alias("reason"), "label", F.round((F.col("v1") - F.col("v0")).cast("double") / divisor, 6).alias("effect"), unit.alias("unit")
    )
    bad = totals.join(first, REPORT, "left_anti").select(*REPORT, "year", F.when(F.col("gate") == "", "SEG_NOT_FOUND").otherwise(F.col("gate")).alias("reason"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("effect"), F.lit(None).cast("string").alias("unit"))
    return good.unionByName(bad)


#: Cards: fixed order (name, statement or none, format).
CARDS = (
    ("revenue", "income_statement", "money"), ("net_income", "income_statement", "money"), ("operating_cash_flow", "cash_flow", "money"), ("revenue_growth", None, "percent"),
    ("operating_profit", "income_statement", "money"), ("gross_profit", "income_statement", "money"), ("net_income_growth", None, "percent"), ("gross_margin", None, "percent"),
    ("net_margin", None, "percent"), ("operating_margin", None, "percent"), ("total_assets", "balance_sheet", "money"), ("total_liabilities", "balance_sheet", "money"),
    ("debt_to_assets", None, "percent"), ("ocf_margin", None, "percent"), ("free_cash_flow", None, "money"),
)


def cards(facts: DataFrame) -> DataFrame:
    """One row per report and card: current and previous value, change, and whether its years make a trend."""
    by = [*REPORT, *PERIOD]
    spec = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("card"), F.lit(f).alias("format"), F.lit(n == "debt_to_assets" or s == "balance_sheet").alias("point")) for i, (n, s, f) in enumerate(CARDS, 1)])
    dated = "statement_type = 'income_statement' and period_type = 'annual' or statement_type = 'balance_sheet' and period_type = 'point_in_time'"
    per_year = facts.where(dated).select(*by, (F.col("statement_type") == "balance_sheet").alias("point")).distinct()
    latest = per_year.where("not point").groupBy(*REPORT).agg(F.max("year").alias("latest"))
    unique = per_year.groupBy(*REPORT, "point", "year").agg(F.count("*").alias("periods"), F.first(F.struct(*PERIOD[1:])).alias("p")).where("periods = 1").select(*REPORT, "point", "year", "p.*")
    selected = kept(select_values(facts), "selected")
    money = selected.where(F.concat_ws("/", "statement_type", "canonical_name").isin([f"{s}/{n}" for n, s, _ in CARDS if s])).select(*by, F.col("canonical_name").alias("card"), F.col("amount").cast("double").alias("value"), "currency", "reason")
    derived = compute_metrics(facts, tuple(n for n, s, _ in CARDS if not s), selected).select(*by, F.col("metric").alias("card"), "value", F.col("unit").alias("currency"), "reason")
    points = latest.withColumn("c", F.explode(spec)).select(*REPORT, "latest", "c.*").join(unique, [*REPORT, "point"]).join(money.unionByName(derived), [*by, "card"]).where("reason = '' and value is not null")
    # other currencies than the latest year's are left out, not converted
    own = Window.partitionBy(*REPORT, "card")
    now_currency = F.max(F.when(F.col("year") == F.col("latest"), F.col("currency"))).over(own)
    mixed = F.min("currency").over(own) != F.max("currency").over(own)
    alike = points.withColumn("now_currency", now_currency).withColumn("mixed", mixed).where((F.col("format") == "percent") | ~F.col("mixed") | F.col("currency").eqNullSafe(F.col("now_currency")))
    scaled = alike.withColumn("shown", F.when(F.col("format") == "money", F.col("value") / 1e8).otherwise(F.col("value")))
    largest = F.max(F.abs("shown")).over(own)
    factor = F.when(F.col("format") == "percent", 1.0).when(largest < 0.0001, 1e8).when(largest < 0.01, 1e4).otherwise(1.0)
    scaled = scaled.withColumn("factor", factor).withColumn("shown", F.col("shown") * F.col("factor"))
    fiscal = F.concat_ws("|", F.substring("start_date", 5, 100), F.substring("end_date", 5, 100))
    got = scaled.groupBy(*REPORT, "latest", "ord", "card", "format", "factor").agg(
        F.count("*").alias("n_points"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max(F.when(F.col("year") == F.col("latest"), F.col("shown"))).alias("current"),
        F.max(F.when(F.col("year") == F.col("latest") - 1, F.col("shown"))).alias("previous"), F.max(F.when(F.col("year") == F.col("latest"), fiscal)).alias("f1"), F.max(F.when(F.col("year") == F.col("latest") - 1, fiscal)).alias("f0"),
        (F.min(fiscal) == F.max(fiscal)).alias("one_fiscal"), F.coalesce(F.min("is_restated") == F.max("is_restated"), F.lit(False)).alias("one_kind"), F.max(F.when(F.col("year") == F.col("latest"), F.col("currency"))).alias("currency"),
    )
    both = F.col("current").isNotNull() & F.col("previous").isNotNull() & (F.col("f0") == F.col("f1"))
    delta = F.when(both, F.col("current") - F.col("previous"))
    trend = F.col("current").isNotNull() & (F.col("n_points") >= 3) & (F.col("last_year") == F.col("latest")) & (F.col("last_year") - F.col("first_year") + 1 == F.col("n_points")) & F.col("one_fiscal") & F.col("one_kind")
    scale = F.when(F.col("factor") == 1e8, "").when(F.col("factor") == 1e4, "万").otherwise("亿")
    return got.select(
        *REPORT, F.col("latest").alias("year"), "ord", "card", F.when(F.col("format") == "percent", "%").otherwise(money_unit(F.coalesce("currency", F.lit("CNY")), scale)).alias("unit"), "n_points",
        F.round("current", 6).alias("current"), F.round("previous", 6).alias("previous"), F.round(delta, 6).alias("delta"),
        F.round(F.when((F.col("format") == "money") & (F.col("previous") > 0), F.try_divide(delta, F.col("previous")) * 100), 6).alias("rate"), trend.alias("can_trend"),
    )


#: The two latest years per report in DuckDB, over ``facts`` and ``selected``.
PAIR_SQL = """
inc AS (SELECT DISTINCT doc_id, scope, year, is_restated FROM facts WHERE statement_type = 'income_statement'),
last AS (SELECT doc_id, scope, max(year) AS latest FROM inc GROUP BY ALL),
pair AS (
    SELECT l.doc_id, l.scope, l.latest, (SELECT count(*) FROM inc i WHERE i.doc_id = l.doc_id AND i.scope = l.scope AND i.year = l.latest) AS n_now, (SELECT count(*) FROM inc i WHERE i.doc_id = l.doc_id AND i.scope = l.scope AND i.year = l.latest - 1) AS n_before
    FROM last l
)"""
