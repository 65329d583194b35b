"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL of each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import comparison, inputs, metrics, validation
from ..sources.facts_adapter import FACTS_SQL, WHOLE_FACTS_SQL
from ..sources.facts_adapter import facts as _facts
from ..sources.scratch import kept

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


_KEPT: dict = {}


def facts(spark, sf_dir: str, whole: bool = False):
    """The facts table; every operator reads it several times, so it is written once per folder and session.

    It lies in the shared folder for intermediate tables, so a lost executor loses nothing of it.
    """
    key = spark.sparkContext.applicationId, sf_dir, whole
    if key not in _KEPT:
        _KEPT[key] = kept(_facts(spark, sf_dir, whole), "facts")
    return _KEPT[key]


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


_BASE = f"WITH {FACTS_SQL.strip()},\n{inputs.SELECTED_SQL.strip()}"
_KEY = "doc_id, scope, year, period_type, start_date, end_date, is_restated"


def _metric_query(name: str):
    return lambda spark, sf_dir: metrics.compute_metrics(facts(spark, sf_dir), (name,))


for _name in ("revenue_growth", "net_income_growth", "net_margin", "operating_margin", "gross_margin", "debt_to_assets", "ocf_margin", "free_cash_flow"):
    _add(_name, _metric_query(_name), f"{_BASE},\n{metrics.METRICS_SQL.strip()}\nSELECT * FROM metrics WHERE metric = '{_name}'")

_add("compute_metrics", lambda spark, sf_dir: metrics.compute_metrics(facts(spark, sf_dir)), f"{_BASE},\n{metrics.METRICS_SQL.strip()}\nSELECT * FROM metrics")
_add(
    "select_value_consensus",
    lambda spark, sf_dir: inputs.select_values(facts(spark, sf_dir)).select(*inputs.REPORT, "statement_type", "canonical_name", *inputs.PERIOD, "n_sources", F.round(F.col("amount").cast("double"), 6).alias("amount"), "currency", "reason"),
    f"{_BASE}\nSELECT doc_id, scope, statement_type, canonical_name, year, period_type, start_date, end_date, is_restated, n_sources, round(amount::DOUBLE, 6) AS amount, currency, reason FROM selected",
)
_add(
    "balance_equation_checks",
    lambda spark, sf_dir: validation.balance_checks(facts(spark, sf_dir)),
    f"{_BASE},\n{validation.BALANCE_SQL.strip()}\nSELECT {_KEY}, 'balance_sheet_equation' AS rule, status, reason, CASE WHEN reason = '' THEN round(diff::DOUBLE, 6) END AS difference, "
    "CASE WHEN reason = '' THEN round(CASE WHEN larger = 0 THEN 0 ELSE diff::DOUBLE / larger::DOUBLE END, 9) END AS relative, CASE WHEN reason = '' THEN round(tol, 6) END AS tolerance FROM balance",
)
_add(
    "latest_balance_check",
    lambda spark, sf_dir: validation.latest_balance(facts(spark, sf_dir)),
    f"{_BASE},\n{validation.BALANCE_SQL.strip()}\nSELECT doc_id, scope, year, status, CASE WHEN reason = '' THEN round(diff::DOUBLE, 6) END AS difference, CASE WHEN reason = '' THEN round(tol, 6) END AS tolerance "
    "FROM balance QUALIFY row_number() OVER (PARTITION BY doc_id, scope ORDER BY year DESC) = 1",
)
_add(
    "statement_coverage",
    lambda spark, sf_dir: validation.statement_coverage(facts(spark, sf_dir)),
    f"WITH {FACTS_SQL.strip()}\nSELECT doc_id, scope, s.statement_type, 'statement_coverage' AS rule, 'skipped' AS status, 'MISSING_STATEMENT' AS reason FROM (SELECT DISTINCT doc_id, scope FROM facts) r "
    "CROSS JOIN (VALUES ('income_statement'), ('balance_sheet'), ('cash_flow')) s(statement_type) WHERE NOT EXISTS (SELECT 1 FROM facts h WHERE h.doc_id = r.doc_id AND h.scope = r.scope AND h.statement_type = s.statement_type)",
)
_add(
    "input_quality_checks",
    lambda spark, sf_dir: validation.input_quality(facts(spark, sf_dir)),
    f"{_BASE}\nSELECT doc_id, scope, statement_type, canonical_name, year, period_type, start_date, end_date, is_restated, 'input_quality' AS rule, CASE WHEN reason IN ('CONFLICT', 'NON_FINITE') THEN 'failed' ELSE 'skipped' END AS status, reason, n_sources FROM selected WHERE reason <> ''",
)
_POINTS = f"WITH {FACTS_SQL.strip()},\n{comparison.POINTS_SQL.strip()}"
_points = lambda spark, sf_dir: comparison.compare_reports(comparison.two_documents(facts(spark, sf_dir)))
_add("compare_two_reports", _points, f"{_POINTS}\nSELECT * FROM points")
# counts of every statement: none is absent here
_add(
    "comparison_status_counts",
    lambda spark, sf_dir: comparison.compare_reports(comparison.two_documents(facts(spark, sf_dir, whole=True))).groupBy("scope", "status", "reason").agg(F.count("*").alias("n")),
    f"WITH {WHOLE_FACTS_SQL.strip()},\n{comparison.POINTS_SQL.strip()}\nSELECT scope, status, reason, count(*) AS n FROM points GROUP BY ALL",
)
_add(
    "comparison_warnings",
    lambda spark, sf_dir: comparison.comparison_warnings(_points(spark, sf_dir)),
    f"{_POINTS}\nSELECT pair_id, scope, count(DISTINCT year) < 3 AS few_years, NOT bool_or(status = 'matched') AS no_overlap FROM points GROUP BY ALL",
)
_add(
    "trend_eligibility",
    lambda spark, sf_dir: comparison.trend_eligibility(_points(spark, sf_dir)),
    f"{_POINTS}\nSELECT *, consecutive AND complete AND one_currency AND one_signature AND n_years >= 3 AS can_trend FROM (SELECT pair_id, scope, statement_type, canonical_name, count(*) AS n_years, max(year) - min(year) + 1 = count(*) AS consecutive, "
    "bool_and(value IS NOT NULL) AS complete, count(DISTINCT currency) = 1 AS one_currency, count(DISTINCT sig) = 1 AS one_signature FROM points GROUP BY ALL)",
)

from ..operators import bridges  # noqa: E402

_add(
    "gross_profit_bridge",
    lambda spark, sf_dir: bridges.gross_profit_bridge(facts(spark, sf_dir)),
    f"""{_BASE},
{bridges.PAIR_SQL.strip()},
v AS (
    SELECT p.*, r0.amount AS r0, r1.amount AS r1, c0.amount AS c0, c1.amount AS c1, g0.amount AS g0, g1.amount AS g1, g0.reason AS gw0, g1.reason AS gw1, r0.ocr OR r1.ocr OR c0.ocr OR c1.ocr AS ocr,
           greatest(1, 2 * greatest(r0.scale, r1.scale, c0.scale, c1.scale)) AS tol, r0.currency AS cur, g0.currency AS gc0, g1.currency AS gc1,
           list_distinct([x FOR x IN [coalesce(r0.reason, 'MISSING'), coalesce(c0.reason, 'MISSING'), coalesce(r1.reason, 'MISSING'), coalesce(c1.reason, 'MISSING')] IF x <> '']) AS whys,
           len(list_distinct([r0.currency, c0.currency, r1.currency, c1.currency])) > 1 AS mixed
    FROM pair p
    LEFT JOIN selected r0 ON r0.doc_id = p.doc_id AND r0.scope = p.scope AND r0.canonical_name = 'revenue' AND r0.year = p.latest - 1
    LEFT JOIN selected r1 ON r1.doc_id = p.doc_id AND r1.scope = p.scope AND r1.canonical_name = 'revenue' AND r1.year = p.latest
    LEFT JOIN selected c0 ON c0.doc_id = p.doc_id AND c0.scope = p.scope AND c0.canonical_name = 'cost_of_revenue' AND c0.year = p.latest - 1
    LEFT JOIN selected c1 ON c1.doc_id = p.doc_id AND c1.scope = p.scope AND c1.canonical_name = 'cost_of_revenue' AND c1.year = p.latest
    LEFT JOIN selected g0 ON g0.doc_id = p.doc_id AND g0.scope = p.scope AND g0.canonical_name = 'gross_profit' AND g0.year = p.latest - 1
    LEFT JOIN selected g1 ON g1.doc_id = p.doc_id AND g1.scope = p.scope AND g1.canonical_name = 'gross_profit' AND g1.year = p.latest
), w AS (
    SELECT *, r0 - abs(c0) AS s, r1 - abs(c1) AS e, r1 - r0 AS re, abs(c0) - abs(c1) AS ce,
           CASE WHEN n_now <> 1 OR n_before <> 1 THEN 'GP_NOT_UNIQUE' WHEN len(whys) > 0 THEN 'GP_INPUT:' || array_to_string(whys, ';') WHEN mixed THEN 'GP_INPUT:CURRENCY_MIX'
                WHEN sign(c0) * sign(c1) < 0 THEN 'GP_SIGN' WHEN gw0 <> '' THEN 'GP_REPORTED' WHEN gc0 <> cur THEN 'GP_CURRENCY' WHEN abs(g0 - (r0 - abs(c0))) > tol THEN 'GP_MISMATCH'
                WHEN gw1 <> '' THEN 'GP_REPORTED' WHEN gc1 <> cur THEN 'GP_CURRENCY' WHEN abs(g1 - (r1 - abs(c1))) > tol THEN 'GP_MISMATCH' ELSE '' END AS reason
    FROM v
), m AS (SELECT *, CASE WHEN greatest(abs(s), abs(e), abs(re), abs(ce)) >= 1000000 THEN 1e8 WHEN greatest(abs(s), abs(e), abs(re), abs(ce)) >= 10000 THEN 1e4 ELSE 1.0 END AS d FROM w)
SELECT doc_id, scope, latest AS year, reason, CASE WHEN reason = '' THEN CASE d WHEN 1e8 THEN '亿' WHEN 1e4 THEN '万' ELSE '' END || CASE cur WHEN 'CNY' THEN '元' WHEN 'USD' THEN '美元' END END AS unit,
       CASE WHEN reason = '' THEN round(s::DOUBLE / d, 6) END AS start, CASE WHEN reason = '' THEN round(re::DOUBLE / d, 6) END AS revenue_effect, CASE WHEN reason = '' THEN round(ce::DOUBLE / d, 6) END AS cost_effect,
       CASE WHEN reason = '' THEN round(e::DOUBLE / d, 6) END AS "end", coalesce(reason = '' AND gw0 IS NOT NULL AND gw1 IS NOT NULL, FALSE) AS verified, coalesce(ocr, FALSE) AS provisional
FROM m""",
)
_add(
    "revenue_segment_bridge",
    lambda spark, sf_dir: bridges.revenue_segment_bridge(facts(spark, sf_dir)),
    f"""{_BASE},
{bridges.PAIR_SQL.strip()},
t AS (
    SELECT p.*, r0.amount AS t0, r1.amount AS t1, r0.currency AS cur, CASE WHEN n_now <> 1 OR n_before <> 1 THEN 'SEG_NOT_UNIQUE' WHEN coalesce(r0.reason, 'x') <> '' OR coalesce(r1.reason, 'x') <> '' OR r0.currency <> r1.currency THEN 'SEG_TOTAL' WHEN least(r0.p_lo, r1.p_lo) <> greatest(r0.p_hi, r1.p_hi) THEN 'SEG_PAGE' ELSE '' END AS gate
    FROM pair p
    LEFT JOIN selected r0 ON r0.doc_id = p.doc_id AND r0.scope = p.scope AND r0.canonical_name = 'revenue' AND r0.year = p.latest - 1
    LEFT JOIN selected r1 ON r1.doc_id = p.doc_id AND r1.scope = p.scope AND r1.canonical_name = 'revenue' AND r1.year = p.latest
), s AS (
    SELECT f.doc_id, f.scope, t.latest, t.t0, t.t1, t.cur, f.original_label AS label, max(f.value * f.multiplier) FILTER (f.year = t.latest - 1) AS v0, max(f.value * f.multiplier) FILTER (f.year = t.latest) AS v1
    FROM t JOIN facts f ON f.doc_id = t.doc_id AND f.scope = t.scope WHERE gate = '' AND f.canonical_name IS NULL AND f.year IN (t.latest, t.latest - 1) GROUP BY ALL
), ok AS (SELECT doc_id, scope, max(abs(v1 - v0)) AS most FROM s GROUP BY doc_id, scope, t0, t1 HAVING sum(v0) = t0 AND sum(v1) = t1),
d AS (SELECT s.*, CASE WHEN greatest(t0, t1, most) >= 1000000 THEN 1e8 WHEN greatest(t0, t1, most) >= 10000 THEN 1e4 ELSE 1.0 END AS d FROM s JOIN ok USING (doc_id, scope))
SELECT doc_id, scope, latest AS year, '' AS reason, label, round((v1 - v0)::DOUBLE / d, 6) AS effect, CASE d WHEN 1e8 THEN '亿' WHEN 1e4 THEN '万' ELSE '' END || '元' AS unit FROM d
UNION ALL SELECT doc_id, scope, latest, CASE WHEN gate = '' THEN 'SEG_NOT_FOUND' ELSE gate END, NULL, NULL, NULL FROM t WHERE (doc_id, scope) NOT IN (SELECT (doc_id, scope) FROM ok)""",
)
_add(
    "kpi_cards",
    lambda spark, sf_dir: bridges.cards(facts(spark, sf_dir)),
    f"""{_BASE},
{metrics.METRICS_SQL.strip()},
spec(ord, card, st, fmt) AS (VALUES {", ".join(f"({i}, '{n}', {f"'{s}'" if s else 'NULL'}, '{f}')" for i, (n, s, f) in enumerate(bridges.CARDS, 1))}),
per AS (SELECT DISTINCT doc_id, scope, statement_type = 'balance_sheet' AS point, year, end_date, is_restated FROM facts WHERE statement_type IN ('income_statement', 'balance_sheet')),
uni AS (SELECT doc_id, scope, point, year, any_value(end_date) AS end_date, any_value(is_restated) AS is_restated FROM per GROUP BY doc_id, scope, point, year HAVING count(*) = 1),
last AS (SELECT doc_id, scope, max(year) AS latest FROM per WHERE NOT point GROUP BY ALL),
vals AS (
    SELECT s.doc_id, s.scope, c.ord, c.card, c.fmt, u.year, u.end_date, u.is_restated, s.amount::DOUBLE AS value, s.currency FROM spec c JOIN selected s ON s.statement_type = c.st AND s.canonical_name = c.card
    JOIN uni u ON u.doc_id = s.doc_id AND u.scope = s.scope AND u.year = s.year AND u.is_restated = s.is_restated AND u.point = (c.st = 'balance_sheet') WHERE s.reason = ''
    UNION ALL
    SELECT m.doc_id, m.scope, c.ord, c.card, c.fmt, u.year, u.end_date, u.is_restated, m.value, m.unit FROM spec c JOIN metrics m ON c.st IS NULL AND m.metric = c.card
    JOIN uni u ON u.doc_id = m.doc_id AND u.scope = m.scope AND u.year = m.year AND u.is_restated = m.is_restated AND u.point = (c.card = 'debt_to_assets') WHERE m.reason = '' AND m.value IS NOT NULL
), k AS (
    SELECT v.*, l.latest, max(CASE WHEN year = latest THEN currency END) OVER w AS nc, min(currency) OVER w <> max(currency) OVER w AS mixed FROM vals v JOIN last l USING (doc_id, scope) WINDOW w AS (PARTITION BY doc_id, scope, card)
), z AS (SELECT *, CASE WHEN fmt = 'money' THEN value / 1e8 ELSE value END AS raw FROM k WHERE fmt = 'percent' OR NOT mixed OR currency IS NOT DISTINCT FROM nc),
q AS (SELECT *, CASE WHEN fmt = 'percent' THEN 1.0 WHEN big < 0.0001 THEN 1e8 WHEN big < 0.01 THEN 1e4 ELSE 1.0 END AS fac FROM (SELECT *, max(abs(raw)) OVER (PARTITION BY doc_id, scope, card) AS big FROM z)),
g AS (
    SELECT doc_id, scope, latest, ord, card, fmt, fac, count(*) AS n_points, min(year) AS y0, max(year) AS y1, max(CASE WHEN year = latest THEN raw * fac END) AS cur, max(CASE WHEN year = latest - 1 THEN raw * fac END) AS prev,
           count(DISTINCT is_restated) = 1 AS one, max(CASE WHEN year = latest THEN currency END) AS currency FROM q GROUP BY ALL
)
SELECT doc_id, scope, latest AS year, ord, card, CASE WHEN fmt = 'percent' THEN '%' ELSE CASE fac WHEN 1e8 THEN '' WHEN 1e4 THEN '万' ELSE '亿' END || CASE coalesce(currency, 'CNY') WHEN 'CNY' THEN '元' WHEN 'USD' THEN '美元' ELSE currency END END AS unit, n_points,
       round(cur, 6) AS current, round(prev, 6) AS previous, round(cur - prev, 6) AS delta, CASE WHEN fmt = 'money' AND prev > 0 THEN round((cur - prev) / prev * 100, 6) END AS rate,
       coalesce(cur IS NOT NULL AND n_points >= 3 AND y1 = latest AND y1 - y0 + 1 = n_points AND one, FALSE) AS can_trend
FROM g""",
)

from ..functions import text as T  # noqa: E402
from ..operators import aliases, pages as page_ops  # noqa: E402


def _pick(items: list[str], by: str):
    """Column of the item that a number selects; items stand for printed cells, labels or headers."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.expr(by) + 1).cast("int"))


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


CELLS = ["{n}", "({n})", "-{n}", "{n}%", "¥{n}/股", "$ {n}", "$({n})", "($1)", "—", "N/A", "..", "--5", "１２３,４５６．５", "100 90", "1.234,5", "hello", "{n} 元/股", "(5)%", "1_000", "5d", ""]


def _cells(spark, sf_dir: str):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2).alias("n"))
    raw = F.replace(_pick(CELLS, f"(l_orderkey + l_linenumber) % {len(CELLS)}"), F.lit("{n}"), F.col("n"))
    return line.select("l_orderkey", "l_linenumber", raw.alias("raw"))


def _parse_number(spark, sf_dir: str):
    return T.with_number(_cells(spark, sf_dir), "raw", "value", "value_type").select("l_orderkey", "l_linenumber", F.round("value", 6).alias("value"), "value_type")


_add(
    "parse_number",
    _parse_number,
    f"""WITH c AS (SELECT l_orderkey, l_linenumber, replace(({_sql_list(CELLS)})[((l_orderkey + l_linenumber) % {len(CELLS)} + 1)::INTEGER], '{{n}}', format('{{:,.2f}}', l_extendedprice::DECIMAL(12,2)::DOUBLE)) AS raw FROM lineitem),
b AS (SELECT *, regexp_replace(trim(raw), '^[$¥￥€£]\\s*', '') AS x FROM c),
p AS (SELECT *, regexp_matches(x, '[%％]\\s*$') AS pct, trim(regexp_replace(x, '[%％]\\s*$', '')) AS y FROM b),
s AS (SELECT *, regexp_matches(y, '/\\s*(股|shares?)') AS shr, CASE WHEN regexp_matches(y, '/\\s*(股|shares?)') THEN trim(regexp_replace(regexp_replace(y, '[¥￥$€£元]', '', 'g'), '/\\s*(股|shares?)', '', 'g')) ELSE y END AS z FROM p),
t AS (SELECT *, regexp_replace(regexp_replace(translate(z, '０１２３４５６７８９，．', '0123456789,.'), '(\\d)[,\\s](\\d)', '\\1\\2', 'g'), '(\\d)[,\\s](\\d)', '\\1\\2', 'g') AS w FROM s),
u AS (SELECT *, w LIKE '(%' AND w LIKE '%)' AS par, CASE WHEN w LIKE '(%' AND w LIKE '%)' THEN trim(substr(w, 2, length(w) - 2)) ELSE w END AS v FROM t),
m AS (SELECT *, v LIKE '-%' AS neg, CASE WHEN v LIKE '-%' THEN trim(substr(v, 2)) ELSE v END AS q FROM u),
r AS (SELECT *, CASE WHEN NOT regexp_matches(trim(raw), '^(—|–|-{{1,3}}|\\.{{2,}}|N/?A|n/?a|)$') AND regexp_matches(q, '^[+-]?(\\d+(_\\d+)*\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN CASE WHEN par OR neg THEN -1 ELSE 1 END * try_cast(replace(q, '_', '') AS DOUBLE) END AS value FROM m)
SELECT l_orderkey, l_linenumber, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'unknown' WHEN shr THEN 'per_share' WHEN pct THEN 'percentage' ELSE 'unknown' END AS value_type FROM r""",
)

def _parts(lists: list[list[str]], key: str):
    """A text made of one item of each list, picked by a key's digits in their bases; and the same in SQL."""
    bases = [math.prod(len(x) for x in lists[:i]) for i in range(len(lists))]
    sql = " || ".join(f"({_sql_list(items)})[({key} // {base} % {len(items)} + 1)::INTEGER]" for items, base in zip(lists, bases, strict=True))
    return lambda: F.concat(*[_pick(items, f"{key} div {base} % {len(items)}") for items, base in zip(lists, bases, strict=True)]), sql


UNIT_TEXTS = [
    ["", "人民币", "RMB", "USD", "US$", "$", "HK$", "S$", "EUR", "港币", "人民币 USD", "in CNY and"], [" "],
    ["", "元", "千元", "万元", "千万元", "百万元", "亿元", "thousand", "Millions", "billion", "万元 千元", "million 百万元", "thousandth"],
    ["", "，每股收益（元）", " (except per share data in USD thousand)", "；每股 港元", " EXCEPT shares\nmillion"],
]
_unit_text, _unit_sql = _parts(UNIT_TEXTS, "c_custkey")


def _detect_unit(spark, sf_dir: str):
    currency, scale = T.detect_unit(F.col("t"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", _unit_text().alias("t")).select("c_custkey", currency.alias("currency"), scale.alias("multiplier"))


_add(
    "detect_unit",
    _detect_unit,
    rf"""WITH t AS (SELECT c_custkey, regexp_replace(regexp_replace({_unit_sql}, '(?i)每股[^，,;；\n]*|except[^;\n]*per.share[^;\n]*', '', 'g'), '(?i)\bexcept\b[^\n]*', '', 'g') AS t FROM customer),
f AS (SELECT c_custkey, [c FOR c IN [CASE WHEN regexp_matches(t, '(?i)人民币|人民幣|\bRMB\b|\bCNY\b') THEN 'CNY' END, CASE WHEN regexp_matches(t, '(?i)美元|US\$|\bUSD\b|(^|[^A-Za-z])\$($|[^A-Za-z])') THEN 'USD' END,
    CASE WHEN regexp_matches(t, '(?i)港元|港币|HK\$|\bHKD\b') THEN 'HKD' END, CASE WHEN regexp_matches(t, '(?i)新加坡元|(^|[^A-Za-z])S\$|\bSGD\b') THEN 'SGD' END, CASE WHEN regexp_matches(t, '(?i)欧元|\bEUR\b') THEN 'EUR' END] IF c IS NOT NULL] AS cs,
    list_distinct([CASE WHEN w = '百万元' THEN 1e6 WHEN w = '千万元' THEN 1e7 WHEN w = '亿元' THEN 1e8 WHEN w = '万元' THEN 1e4 WHEN w = '千元' THEN 1e3 WHEN w = '元' THEN 1.0 WHEN w LIKE 'b%' THEN 1e9 WHEN w LIKE 'm%' THEN 1e6 ELSE 1e3 END
        FOR w IN regexp_extract_all(lower(t), '百万元|千万元|亿元|万元|千元|元|\bbillions?\b|\bmillions?\b|\bthousands?\b')]) AS ms FROM t)
SELECT c_custkey, CASE WHEN len(cs) = 1 THEN cs[1] ELSE '' END AS currency, CASE WHEN len(ms) = 1 THEN ms[1]::DOUBLE END AS multiplier FROM f""",
)

PERIOD_TEXTS = [
    ["2025", "2024年", "FY2023", "12024", "2024 and 2025", "2024/2024", "", "１９９９ 1999"], ["", "年度", " December 31,", "/6/30", "年12月31日", "年13月40日", "-2-30", "-2-28", " 31 december"],
    ["", " restated", " unrestated", " 重述", " Three months", "半年度", " 季度", " half-year"],
]
_period_text, _period_sql = _parts(PERIOD_TEXTS, "c_custkey")


def _detect_period(spark, sf_dir: str):
    statement = F.when(F.col("c_custkey") % 5 == 0, "balance_sheet").otherwise("income_statement")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", T.detect_period(_period_text(), statement).alias("p")).select("c_custkey", "p.year", "p.period_type", "p.end_date", "p.is_restated")


_DATE = r"(?:19|20)\d\d\s*[年/-]\s*(\d{1,2})\s*[月/-]\s*(\d{1,2})"
_add(
    "detect_period",
    _detect_period,
    rf"""WITH h AS (SELECT c_custkey, {_period_sql} AS h FROM customer),
y AS (SELECT *, list_distinct([x FOR x IN regexp_extract_all(h, '[0-9]+') IF length(x) = 4 AND (x LIKE '19%' OR x LIKE '20%')]) AS ys, regexp_matches(h, '{_DATE}') AS printed FROM h),
e AS (SELECT *, CASE WHEN printed THEN try_cast(ys[1] || '-' || lpad(regexp_extract(h, '{_DATE}', 1), 2, '0') || '-' || lpad(regexp_extract(h, '{_DATE}', 2), 2, '0') AS DATE)::VARCHAR
      WHEN regexp_matches(h, '(?i)December\s+31|31\s+December') THEN ys[1] || '-12-31' END AS e FROM y),
o AS (SELECT *, len(ys) = 1 AND NOT (printed AND e IS NULL) AS ok FROM e)
SELECT c_custkey, CASE WHEN ok THEN ys[1]::INTEGER END AS year, CASE WHEN ok THEN CASE WHEN c_custkey % 5 = 0 THEN 'point_in_time' WHEN regexp_matches(lower(h), 'quarter|three months|季度|三个月') THEN 'quarter' WHEN regexp_matches(lower(h), 'half.year|six months|半年度|六个月') THEN 'half_year' ELSE 'annual' END END AS period_type,
       CASE WHEN ok THEN e END AS end_date, CASE WHEN ok THEN regexp_matches(lower(h), '(^|[^n]|(^|[^u])n)restated|重述|调整后|重列') END AS is_restated FROM o""",
)

_documents = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

#: Letters of every ninth document as Chinese ones, those of every eleventh as the signs that broken fonts leave.
_LATIN, _HAN, _BROKEN = "etaoinsr", "的一是不了人我在", "\u2460\u2461\u2500\u2501\u3105\u3400\ufffd\u1d00"


def _printed_documents(spark, sf_dir: str):
    text = F.when(F.col("doc_id") % 9 == 0, F.translate("text", _LATIN, _HAN)).when(F.col("doc_id") % 11 == 0, F.translate("text", _LATIN, _BROKEN)).otherwise(F.col("text"))
    return _documents(spark, sf_dir).withColumn("text", text)


_PRINTED_SQL = f"(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN translate(text, '{_LATIN}', '{_HAN}') WHEN doc_id % 11 = 0 THEN translate(text, '{_LATIN}', '{_BROKEN}') ELSE text END AS text FROM documents)"


def _detect_language(spark, sf_dir: str):
    language, confidence = T.detect_language(F.col("text"))
    return _printed_documents(spark, sf_dir).select("doc_id", language.alias("language"), confidence.alias("confidence"))


_add(
    "detect_language",
    _detect_language,
    f"SELECT doc_id, CASE WHEN n < 10 OR c + a = 0 THEN 'unknown' WHEN c / (c + a) > 0.3 THEN 'zh' ELSE 'en' END AS language, CASE WHEN n < 10 OR c + a = 0 THEN 0.0 WHEN c / (c + a) > 0.3 THEN round(c / (c + a), 3) ELSE round(1 - c / (c + a), 3) END AS confidence FROM "
    f"(SELECT doc_id, length(trim(text, ' \t\n\r')) AS n, length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{F900}}-\\x{{FAFF}}]', '', 'g'))::DOUBLE AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE AS a FROM {_PRINTED_SQL})",
)


def _text_quality(spark, sf_dir: str):
    per_page, scanned, warning = T.text_quality(F.col("text"), 1 + F.col("doc_id") % 7)
    return _printed_documents(spark, sf_dir).select("doc_id", per_page.alias("chars_per_page"), scanned.alias("scanned"), warning.alias("warning"))


_add(
    "text_quality",
    _text_quality,
    f"""SELECT doc_id, round(n / p, 1) AS chars_per_page, n / p < 80 AS scanned, CASE WHEN n > 100 AND odd / n > 0.12 THEN 'GARBLED' WHEN n / p < 80 THEN 'SCANNED' ELSE '' END AS warning
FROM (SELECT doc_id, length(trim(text, ' \t\n\r'))::DOUBLE AS n, 1 + doc_id % 7 AS p, len([x FOR x IN string_split(text, '') IF ord(x) BETWEEN 7424 AND 12287 OR ord(x) BETWEEN 12544 AND 19903 OR ord(x) = 65533])::DOUBLE AS odd FROM {_PRINTED_SQL})""",
)
_add(
    "year_mentions",
    lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", T.years_in(F.col("text")).alias("years")).where(F.size("years") > 0).select("doc_id", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years")),
    "SELECT doc_id, array_to_string([y FOR y, i IN ys IF list_position(ys, y) = i], ',') AS years FROM (SELECT doc_id, regexp_extract_all(text, '(20[12]\\d|19\\d\\d)') AS ys FROM documents) WHERE len(ys) > 0",
)
_add(
    "numeric_density",
    lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(T.NUMBER_RUN)).cast("long").alias("n_numbers")),
    "SELECT doc_id, len(regexp_extract_all(text, '\\b\\d[\\d,.\\s]*\\d\\b|\\b\\d\\b'))::BIGINT AS n_numbers FROM documents",
)

#: Labels as aliases with something around them, or two together.
_NAMES = [a for _, _, names in aliases.METRICS for a in names]
_AROUND = ["{x}", "  {x} ", "{x} growth", "其中：{x}小计", "net of {x}, total", "{x} {y}", "Item {z}", "{y}"]
REGEXES = (("revenue", r"(?i)^item \d*[05]$"), ("inventory", r"(?i)^item \d*0$"))


def _labels(spark, sf_dir: str):
    n = len(_NAMES)
    around = _pick(_AROUND, f"p_partkey % {len(_AROUND)}")
    for mark, by in (("{x}", f"p_partkey * 11 % {n}"), ("{y}", f"p_partkey * 7 div 3 % {n}")):
        around = F.replace(around, F.lit(mark), _pick(_NAMES, by))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.replace(around, F.lit("{z}"), F.col("p_partkey").cast("string")).alias("label"))


_LABELS_SQL = f"replace(replace(replace(({_sql_list(_AROUND)})[(p_partkey % {len(_AROUND)} + 1)::INTEGER], '{{x}}', ({_sql_list(_NAMES)})[(p_partkey * 11 % {len(_NAMES)} + 1)::INTEGER]), '{{y}}', ({_sql_list(_NAMES)})[(p_partkey * 7 // 3 % {len(_NAMES)} + 1)::INTEGER]), '{{z}}', p_partkey::VARCHAR)"
_ALIAS_ROWS = ", ".join("('%s', '%s', '%s')" % (m, st, a.replace("'", "''")) for m, st, names in aliases.METRICS for a in names)


def _resolved_sql(label: str, regexes=()) -> str:
    fits = "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(label, '{x}') THEN '{m}' END" for m, x in regexes) + "] IF x IS NOT NULL]" if regexes else "[]::VARCHAR[]"
    return rf"""WITH al AS (SELECT metric, st, lower(replace(a, ' ', '')) AS k FROM (VALUES {_ALIAS_ROWS}) v(metric, st, a)), l AS (SELECT p_partkey, {label} AS label FROM part),
m AS (SELECT p_partkey, metric, lower(regexp_replace(label, '\s+', '', 'g')) = k AS whole, length(k) AS n FROM l JOIN al ON contains(lower(regexp_replace(label, '\s+', '', 'g')), k)),
g AS (SELECT p_partkey, bool_or(whole) AS whole, CASE WHEN bool_or(whole) THEN count(DISTINCT metric) ELSE count(*) END AS c, min(metric) AS metric FROM (SELECT * FROM m QUALIFY n = max(n) OVER (PARTITION BY p_partkey)) GROUP BY p_partkey),
r AS (SELECT l.*, g.whole, g.c, g.metric, {fits} AS fits FROM l LEFT JOIN g USING (p_partkey))
SELECT p_partkey, label, CASE WHEN c = 1 THEN metric WHEN c IS NULL AND len(fits) = 1 THEN fits[1] END AS metric, CASE WHEN c = 1 AND whole THEN 'high' WHEN c = 1 THEN 'medium' WHEN c > 1 OR len(fits) > 0 THEN 'low' ELSE 'unknown' END AS confidence FROM r"""


_add("resolve_metric", lambda spark, sf_dir: aliases.resolve(_labels(spark, sf_dir), patterns=REGEXES), _resolved_sql(_LABELS_SQL, REGEXES))
_add(
    "resolve_part_names",
    lambda spark, sf_dir: aliases.resolve(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("label"))).select("p_partkey", "metric", "confidence"),
    f"SELECT p_partkey, metric, confidence FROM ({_resolved_sql('p_name')})",
)

TITLES = [
    "合并利润表", "Consolidated Balance Sheet 2025", "合并现金流量表（续）", "plain page", "这些财务报表包括资产负债表", "目录\n合并利润表 ........ 12\n合并资产负债表 ........ 14\n合并现金流量表 ...... 16", "母公司资产负债表", "  利润表", "续表", "2024年度合并及母公司利润表",
    "CONSOLIDATED BALANCE SHEETS, 2025", "利润表 2025年12月31日", "合并利润表2024年度", "资产负债表（2024 续）", "3. Income statement continued", "一、 母公司的现金流量表 2024 2023", "利润表 现金流量表", "see Note 7\nCompany Statement of Financial Position",
    "合并利润表\n合并资产负债表", "Statement of Cash Flows / 2024",
]
BODY = "\n单位：人民币百万元\n项目 2025年 2024年\n营业收入 1,234 1,111\n营业成本 900 800\n毛利 334 311\n营业利润 120 110\n净利润 100 90\n基本每股收益 0.36 0.30\n资产总计 5,000 4,800\n负债合计 2,000 1,900\n权益合计 3,000 2,900\n"

#: Bodies of pages, from full statements to running text.
BODIES = [
    BODY, "\nRMB million\nItem 2025 2024\nRevenue 1,234 1,111\nCost of revenue 900 800\nGross profit 334 311\nNet income 100 90\n", "\nCash flows from operating activities 12 10\nOperating cash flow 2025 1 2\ncontinued\n",
    "\n货币资金 12,000 11,000\n应收账款 8 9\n存货 7 6\n资产总计 5,000 4,800\n负债合计 2,000 1,900\n股东权益合计 3,000 2,900\n2025年12月31日\n", "\nGeneral remarks without any figures.\n", "\nRevenue .... 1\nInventory .... 2\nCapEx ..... 3\nFCF ------ 4\n2024\n",
    "\n(Continued)\n2025 2024 Total assets 10 11 Total liabilities 4 5 Inventory 1 2 Shareholders' Equity 6 6 Current Debt 1 1\n",
]

def _report_pages(spark, sf_dir: str):
    """Conversations read as reports: a turn is a page, its title and body follow from the numbers."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    title = _pick(TITLES, f"(conv_id * 3 + turn * (1 + conv_id % 2)) % {len(TITLES)}")
    body = F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, F.concat(F.lit("\n"), "text")).otherwise(_pick(BODIES, f"(conv_id * 5 + turn) % {len(BODIES)}"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.concat(title, body).alias("text"))


_PAGES_SQL = f"""WITH pages_of AS (SELECT conv_id AS doc_id, turn::INTEGER AS page_number, ({_sql_list(TITLES)})[((conv_id * 3 + turn * (1 + conv_id % 2)) % {len(TITLES)} + 1)::INTEGER] || CASE WHEN (conv_id + turn) % 5 = 4 THEN chr(10) || text ELSE ({_sql_list(BODIES)})[((conv_id * 5 + turn) % {len(BODIES)} + 1)::INTEGER] END AS text FROM conversations)"""


def _content_sql(pages: str) -> str:
    """Tables al (aliases), f, h and s (content scores) over a table of pages, after other tables of a WITH."""
    return f""", al AS (SELECT metric, st, lower(replace(a, ' ', '')) AS k FROM (VALUES {_ALIAS_ROWS}) v(metric, st, a)),
f AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS flat, replace(replace(regexp_replace(text, '[^\\p{{N}}\\P{{L}}年度]|[\\p{{M}}]', 'x', 'g'), '年', 'y'), '度', 'z') AS bare FROM {pages}),
h AS (SELECT *, (SELECT count(DISTINCT metric) FROM al WHERE contains(flat, k)) AS hits, len(regexp_extract_all(bare, '\\b\\d[\\d,.\\s]*\\d\\b|\\b\\d\\b')) AS n, regexp_matches(bare, '\\b(20[12]\\d|19\\d\\d)\\s*(?:yz|y)?\\b') AS dated,
      regexp_matches(lower(text), '人民币|美元|港元|新加坡元|rmb|cny|usd|hkd|sgd|千元|百万元|万元|亿元|thousands?|millions?|billions?') AS unit, len(regexp_extract_all(text, '\\.{{4,}}|-{{4,}}')) > 3 OR len(regexp_extract_all(text, '\\.+\\s*\\d{{1,4}}\\s*$')) > 5 AS listed FROM f),
s AS (SELECT *, CASE WHEN hits >= 5 THEN 0.35 WHEN hits >= 3 THEN 0.2 WHEN hits >= 1 THEN 0.1 ELSE 0 END + CASE WHEN n >= 20 THEN 0.3 WHEN n >= 10 THEN 0.2 WHEN n >= 5 THEN 0.1 ELSE 0 END + CASE WHEN dated THEN 0.15 ELSE 0 END + CASE WHEN unit THEN 0.1 ELSE 0 END AS score FROM h)"""


_add("content_score", lambda spark, sf_dir: page_ops.content_scores(_report_pages(spark, sf_dir)), f"{_PAGES_SQL}{_content_sql('pages_of')}\nSELECT doc_id, page_number, round(least(CASE WHEN listed THEN score * 0.3 ELSE score END, 1)::DOUBLE, 4) AS score FROM s")

SELECTIONS = ["{a}", "{a}-{b}", "{a},{b}", "{a}–{b}，{c}", " {c} {a}  {b} ", "x{a}", "{a}-", "", "0-{a}", "{a}-{z}", "{b}-{a}", "{a}-{b},{c}-{z}"]


def _page_selection(spark, sf_dir: str):
    spec = _pick(SELECTIONS, f"c_custkey % {len(SELECTIONS)}")
    for mark, by in (("{a}", "c_custkey * 7 % 40"), ("{b}", "c_custkey * 7 % 40 + c_custkey % 25"), ("{c}", "c_custkey % 9 + 1"), ("{z}", "c_custkey % 9 + c_custkey % 31 * 5")):
        spec = F.replace(spec, F.lit(mark), F.expr(f"cast({by} as string)"))
    pages, reason = T.page_selection(F.col("spec"), F.lit(100))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", spec.alias("spec")).select("c_custkey", F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"), reason.alias("reason"))


_add("page_selection", _page_selection, rf"""WITH s AS (SELECT c_custkey, trim(replace(replace(replace(replace(({_sql_list(SELECTIONS)})[(c_custkey % {len(SELECTIONS)} + 1)::INTEGER], '{{a}}', (c_custkey * 7 % 40)::VARCHAR), '{{b}}', (c_custkey * 7 % 40 + c_custkey % 25)::VARCHAR), '{{c}}', (c_custkey % 9 + 1)::VARCHAR), '{{z}}', (c_custkey % 9 + c_custkey % 31 * 5)::VARCHAR)) AS s FROM customer),
p AS (SELECT c_custkey, unnest(regexp_split_to_array(s, '[,，\s]+')) AS part FROM s WHERE s <> ''),
b AS (SELECT *, regexp_full_match(part, '\d+([-–]\d+)?') AS form, try_cast(regexp_extract(part, '^(\d+)', 1) AS INTEGER) AS lo, coalesce(try_cast(nullif(regexp_extract(part, '[-–](\d+)$', 1), '') AS INTEGER), try_cast(regexp_extract(part, '^(\d+)', 1) AS INTEGER)) AS hi FROM p),
g AS (SELECT c_custkey, bool_and(form) AS form, bool_or(lo < 1 OR hi < lo OR hi > 100) AS outside, bool_or(hi - lo + 1 > 20) AS wide FROM b GROUP BY ALL),
n AS (SELECT c_custkey, list_sort(list_distinct(flatten(list(range(lo, hi + 1))))) AS pages FROM b WHERE form AND lo >= 1 AND hi BETWEEN lo AND 100 GROUP BY ALL),
j AS (SELECT s.c_custkey, CASE WHEN g.c_custkey IS NULL THEN '' WHEN NOT form THEN 'FORMAT' WHEN outside THEN 'BOUNDS' WHEN wide OR len(pages) > 20 THEN 'TOO_MANY' ELSE '' END AS reason, pages FROM s LEFT JOIN g USING (c_custkey) LEFT JOIN n USING (c_custkey))
SELECT c_custkey, reason, CASE WHEN reason = '' THEN coalesce(array_to_string(pages, ','), '') END AS pages FROM j""")
_add(
    "metric_issue",
    lambda spark, sf_dir: metrics.compute_metrics(facts(spark, sf_dir)).groupBy("metric", "reason", T.metric_issue(F.col("reason")).alias("action")).agg(F.count("*").alias("n")),
    f"{_BASE},\n{metrics.METRICS_SQL.strip()}\nSELECT metric, reason, CASE WHEN reason = '' THEN '' WHEN regexp_matches(reason, 'MISSING|NULL_VALUE') THEN 'CHECK_STATEMENT' WHEN regexp_matches(reason, 'UNIT|CURRENCY') THEN 'CHECK_UNIT' WHEN regexp_matches(reason, 'CONFLICT|UNIQUE') THEN 'CHECK_DUPLICATES' WHEN regexp_matches(reason, 'NONPOSITIVE') THEN 'NOT_APPLICABLE' ELSE 'CHECK_SOURCES' END AS action, count(*) AS n FROM metrics GROUP BY ALL",
)

from . import headings  # noqa: E402, F401
from . import reports  # noqa: E402, F401
from . import functions  # noqa: E402, F401
from . import streams  # noqa: E402, F401
from . import grids  # noqa: E402, F401
from . import extraction  # noqa: E402, F401
from . import scans  # noqa: E402, F401
