"""Ratios, growth and free cash flow: one conditional aggregate per report and period, unpivoted to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inputs import PERIOD, REPORT, first_reason, select_values

_INCOME = ["revenue", "cost_of_revenue", "gross_profit", "operating_profit", "net_income"]
_BALANCE = ["total_assets", "total_liabilities", "total_equity"]
_CASH = ["operating_cash_flow", "capital_expenditure"]


def _d(c: Column) -> Column:
    return c["amount"].cast("double")


def _pages(*inputs: Column) -> Column:
    """Pages of all inputs, each once and in order."""
    none = F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(i["pages"].cast("array<int>"), none) for i in inputs]))))


def _metric(name: str, inputs: list[Column], refuse: Column, code: str, value: Column, unit: Column | None = None) -> Column:
    """A result row: a value, or the reason for refusing one."""
    inputs_ok = first_reason(*inputs)
    reason = F.when(inputs_ok != "", inputs_ok).when(refuse, F.lit(code)).otherwise("")
    made = F.when(reason == "", value)
    finite = made.isNull() | ~(F.isnan(made) | (F.abs(made) == float("inf")))
    return F.struct(
        F.lit(name).alias("metric"), F.when(finite, made).alias("value"), F.when(finite, reason).otherwise("RESULT_NON_FINITE").alias("reason"),
        (unit if unit is not None else F.lit("%")).alias("unit"), sum((i["n_sources"] for i in inputs[1:]), inputs[0]["n_sources"]).alias("n_sources"),
        _pages(*inputs).alias("pages"),
    )


def _ratio(name: str, a: Column, b: Column) -> Column:
    return _metric(name, [a, b], b["amount"] <= 0, "NONPOSITIVE_DENOMINATOR", F.try_divide(_d(a), _d(b)) * 100)


def _growth(name: str, now: Column, before: Column) -> Column:
    return _metric(name, [now, before], before["amount"] <= 0, "NONPOSITIVE_BASE", F.try_divide(_d(now) - _d(before), _d(before)) * 100)


def compute_metrics(facts: DataFrame, names: tuple[str, ...] | None = None, selected: DataFrame | None = None, with_pages: bool = False) -> DataFrame:
    """(doc_id, scope, period, metric, value, unit, reason, n_sources) for every annual or point-in-time period.

    names: only these metrics are computed; selected: select_values(facts), if it is at hand; with_pages: also the pages of
    all sources of the inputs, those of the base year included.
    """
    by = [*REPORT, *PERIOD]
    wanted = lambda name: names is None or name in names
    years = _by_period(facts, select_values(facts) if selected is None else selected, with_pages)
    # the base year: same fiscal dates one year before, and only one such period (original or restated, not both)
    cut = lambda c: F.coalesce(F.substring(c, 5, 100), F.lit(""))
    before = Window.partitionBy(*REPORT, cut("start_date"), cut("end_date"), "period_type", "of_income").orderBy("year").rangeBetween(-1, -1)
    years = years.withColumns({"bases": F.count("*").over(before), "base": F.max(F.struct("revenue", "net_income")).over(before)})
    none = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in (("amount", None, "decimal(38,6)"), ("currency", "", "string"), ("reason", "NO_UNIQUE_BASE", "string"), ("n_sources", 0, "long"), ("pages", None, "array<int>"))])
    prior = lambda n: F.when(F.col("bases") == 1, F.col(f"base.{n}")).otherwise(none)
    revenue, cost, gross, profit, ocf, spent = (F.col(c) for c in ("revenue", "cost_of_revenue", "gross_profit", "net_income", "operating_cash_flow", "capital_expenditure"))
    derived = _metric("gross_margin", [revenue, cost], (revenue["amount"] <= 0) | (cost["amount"] < 0), "BAD_GROSS_INPUT", F.try_divide(_d(revenue) - _d(cost), _d(revenue)) * 100)
    unit = F.coalesce(F.nullif(ocf["currency"], F.lit("")), F.nullif(spent["currency"], F.lit("")), F.lit("unknown"))
    # what makes a period one of the metric's, and the result there
    annual, income = F.col("period_type") == "annual", F.col("of_income")
    made = {
        "net_margin": (annual & income, _ratio("net_margin", profit, revenue)), "operating_margin": (annual & income, _ratio("operating_margin", F.col("operating_profit"), revenue)),
        "revenue_growth": (annual & income, _growth("revenue_growth", revenue, prior("revenue"))), "net_income_growth": (annual & income, _growth("net_income_growth", profit, prior("net_income"))),
        "gross_margin": (annual & income, F.when(gross["n_sources"] > 0, _ratio("gross_margin", gross, revenue)).otherwise(derived)), "ocf_margin": (annual & income, _ratio("ocf_margin", ocf, revenue)),
        "debt_to_assets": ((F.col("period_type") == "point_in_time") & F.col("of_balance"), _ratio("debt_to_assets", F.col("total_liabilities"), F.col("total_assets"))),
        "free_cash_flow": (annual & F.col("of_cash"), _metric("free_cash_flow", [ocf, spent], F.lit(False), "", (ocf["amount"] - F.abs(spent["amount"])).cast("double"), unit)),
    }
    rows = F.filter(F.array(*[F.when(here, m) for name, (here, m) in made.items() if wanted(name)]), lambda m: m.isNotNull())
    out = years.select(*by, F.explode(rows).alias("m"))
    return out.select(*by, "m.metric", F.round("m.value", 6).alias("value"), "m.unit", "m.reason", "m.n_sources", *(["m.pages"] if with_pages else []))


def _by_period(facts: DataFrame, selected: DataFrame, with_pages: bool) -> DataFrame:
    """One row per report and period: a gated struct per input (MISSING if absent), and which statements it has.

    An income statement's period counts if any of its rows is of that period, also one whose metric is unknown.
    """
    by, fields = [*REPORT, *PERIOD], ["amount", "currency", "reason", "n_sources", "pages"]
    pages = (F.col("pages") if with_pages else F.array()).cast("array<int>").alias("pages")
    own = selected.select(*by, "statement_type", "canonical_name", F.struct(*fields[:-1], pages).alias("v"))
    bare = facts.where("statement_type = 'income_statement'").select(*by).distinct().select(*by, F.lit("income_statement").alias("statement_type"), F.lit(None).cast("string").alias("canonical_name"), F.lit(None).cast(own.schema["v"].dataType).alias("v"))
    absent = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in (("amount", None, "decimal(38,6)"), ("currency", "", "string"), ("reason", "MISSING", "string"), ("n_sources", 0, "long"), ("pages", None, "array<int>"))])
    inputs = [(s, n) for s, ns in (("income_statement", _INCOME), ("balance_sheet", _BALANCE), ("cash_flow", _CASH)) for n in ns]
    values = [F.max(F.when((F.col("statement_type") == s) & (F.col("canonical_name") == n), F.col("v"))).alias(n) for s, n in inputs]
    flags = [F.bool_or(F.col("statement_type") == s).alias(f) for f, s in (("of_income", "income_statement"), ("of_balance", "balance_sheet"), ("of_cash", "cash_flow"))]
    got = own.unionByName(bare).groupBy(*by).agg(*values, *flags)
    return got.withColumns({n: F.coalesce(n, absent) for _, n in inputs})


def _filled(df: DataFrame, names: list[str]) -> DataFrame:
    """Gated structs that a left join left empty become MISSING."""
    missing = {"amount": None, "currency": "", "reason": "MISSING", "n_sources": 0, "quantum": None, "pages": None, "ocr": False, "scale": None}
    fields = {n: df.schema[n].dataType for n in names}
    made = {n: F.coalesce(n, F.struct(*[F.lit(missing[f.name]).cast(f.dataType).alias(f.name) for f in t.fields])) for n, t in fields.items()}
    return df.withColumns(made)


#: compute_metrics in DuckDB, over ``facts`` and ``selected``.
METRICS_SQL = """
have AS (SELECT DISTINCT doc_id, scope, statement_type, year, period_type, start_date, end_date, is_restated FROM facts),
pick AS (
    SELECT h.doc_id, h.scope, h.statement_type, h.year, h.period_type, h.end_date, h.is_restated, n.name,
           s.amount, coalesce(s.currency, '') AS currency, coalesce(s.reason, 'MISSING') AS reason, coalesce(s.n_sources, 0) AS n_sources
    FROM have h
    JOIN (VALUES ('income_statement', 'revenue'), ('income_statement', 'cost_of_revenue'), ('income_statement', 'gross_profit'), ('income_statement', 'operating_profit'), ('income_statement', 'net_income'),
          ('balance_sheet', 'total_assets'), ('balance_sheet', 'total_liabilities'), ('cash_flow', 'operating_cash_flow'), ('cash_flow', 'capital_expenditure')) n(st, name) ON n.st = h.statement_type
    LEFT JOIN selected s ON s.doc_id = h.doc_id AND s.scope = h.scope AND s.statement_type = h.statement_type AND s.canonical_name = n.name
        AND s.year = h.year AND s.period_type = h.period_type AND s.is_restated = h.is_restated
),
pairs AS (
    SELECT a.*, m.metric, m.kind, m.unit_of,
           CASE WHEN m.kind = 'growth' THEN CASE WHEN q.n = 1 THEN q.amount END ELSE b.amount END AS b_amount,
           CASE WHEN m.kind = 'growth' THEN CASE WHEN q.n = 1 THEN q.currency ELSE '' END ELSE coalesce(b.currency, '') END AS b_currency,
           CASE WHEN m.kind = 'growth' THEN CASE WHEN q.n = 1 THEN q.reason ELSE 'NO_UNIQUE_BASE' END ELSE coalesce(b.reason, 'MISSING') END AS b_reason,
           CASE WHEN m.kind = 'growth' THEN CASE WHEN q.n = 1 THEN q.n_sources ELSE 0 END ELSE coalesce(b.n_sources, 0) END AS b_sources
    FROM pick a
    JOIN (VALUES ('net_margin', 'ratio', 'net_income', 'revenue', '%'), ('operating_margin', 'ratio', 'operating_profit', 'revenue', '%'), ('revenue_growth', 'growth', 'revenue', '', '%'),
          ('net_income_growth', 'growth', 'net_income', '', '%'), ('gross_margin', 'reported', 'gross_profit', 'revenue', '%'), ('gross_margin', 'derived', 'revenue', 'cost_of_revenue', '%'),
          ('debt_to_assets', 'ratio', 'total_liabilities', 'total_assets', '%'), ('free_cash_flow', 'fcf', 'operating_cash_flow', 'capital_expenditure', 'c')) m(metric, kind, a, b, unit_of) ON m.a = a.name
    LEFT JOIN pick b ON b.name = m.b AND b.doc_id = a.doc_id AND b.scope = a.scope AND b.statement_type = a.statement_type AND b.year = a.year AND b.is_restated = a.is_restated
    LEFT JOIN (SELECT doc_id, scope, name, year, count(*) AS n, max(amount) AS amount, max(currency) AS currency, max(reason) AS reason, max(n_sources) AS n_sources
               FROM pick WHERE statement_type = 'income_statement' GROUP BY ALL) q ON q.doc_id = a.doc_id AND q.scope = a.scope AND q.name = a.name AND q.year = a.year - 1
    UNION ALL
    SELECT r.doc_id, r.scope, r.statement_type, r.year, r.period_type, r.end_date, r.is_restated, 'operating_cash_flow', o.amount, coalesce(o.currency, ''), coalesce(o.reason, 'MISSING'), coalesce(o.n_sources, 0),
           'ocf_margin', 'ratio', '%', r.amount, r.currency, r.reason, r.n_sources
    FROM pick r LEFT JOIN pick o ON o.name = 'operating_cash_flow' AND o.doc_id = r.doc_id AND o.scope = r.scope AND o.year = r.year AND o.is_restated = r.is_restated
    WHERE r.name = 'revenue'
),
judged AS (
    SELECT *, CASE WHEN reason <> '' AND b_reason <> '' AND reason <> b_reason THEN reason || ';' || b_reason WHEN reason <> '' THEN reason WHEN b_reason <> '' THEN b_reason
                   WHEN currency <> b_currency THEN 'CURRENCY_MIX'
                   WHEN kind IN ('ratio', 'reported') AND b_amount <= 0 THEN 'NONPOSITIVE_DENOMINATOR' WHEN kind = 'growth' AND b_amount <= 0 THEN 'NONPOSITIVE_BASE'
                   WHEN kind = 'derived' AND (amount <= 0 OR b_amount < 0) THEN 'BAD_GROSS_INPUT' ELSE '' END AS why
    FROM pairs p
    WHERE kind NOT IN ('reported', 'derived') OR (kind = 'reported') = EXISTS (SELECT 1 FROM pick g WHERE g.name = 'gross_profit' AND g.n_sources > 0 AND g.doc_id = p.doc_id AND g.scope = p.scope AND g.year = p.year AND g.is_restated = p.is_restated)
),
metrics AS (
    SELECT doc_id, scope, year, period_type, '' AS start_date, end_date, is_restated, metric,
           round(CASE WHEN why = '' THEN CASE kind WHEN 'growth' THEN (amount::DOUBLE - b_amount::DOUBLE) / b_amount::DOUBLE * 100 WHEN 'derived' THEN (amount::DOUBLE - b_amount::DOUBLE) / amount::DOUBLE * 100
                      WHEN 'fcf' THEN (amount - abs(b_amount))::DOUBLE ELSE amount::DOUBLE / b_amount::DOUBLE * 100 END END, 6) AS value,
           CASE WHEN unit_of = '%' THEN '%' ELSE coalesce(nullif(currency, ''), nullif(b_currency, ''), 'unknown') END AS unit, why AS reason, n_sources + b_sources AS n_sources
    FROM judged
)"""
