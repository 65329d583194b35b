"""Functions for SQL: printed amounts, periods and units as scalar functions, user-defined ratios and labels as table functions.

``register(spark)`` makes them for a session; with facts it also makes the views they read.  A user's own metric is then a
query like ``SELECT * FROM ratio_of('net_income', 'total_assets')``, and a user's own pattern ``labels_like('(?i)lease')``.
All are SQL, so Catalyst expands them in the query that calls them; no Python runs for a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import CURRENCIES, MISSING, PER_SHARE, SCALES

_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def _let(name: str, value: str, body: str) -> str:
    """body with name standing for value, which is computed once; a fold over nothing, see text.let()."""
    return f"aggregate(array(), {value}, (kept, _none) -> kept, {name} -> {body})"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, r'(?U)^\s+|\s+$', '')"


def _amount() -> str:
    """Struct of value and kind, step by step: currency sign, percent sign, share mark, separators, brackets, minus."""
    result = f"named_struct('value', CASE WHEN abs(v) <> double('infinity') THEN v END, 'kind', CASE WHEN v IS NULL OR abs(v) = double('infinity') THEN 'unknown' WHEN share THEN 'per_share' WHEN pct THEN 'percentage' ELSE 'unknown' END)"
    signed = _let("v", f"CASE WHEN bare RLIKE r'{_NUMBER}' THEN try_cast(translate(bare, '_', '') AS DOUBLE) * CASE WHEN held OR minus THEN -1 ELSE 1 END END", result)
    unminused = _let("minus", "startswith(inner_, '-')", _let("bare", f"CASE WHEN minus THEN {_strip('substring(inner_, 2)')} ELSE inner_ END", signed))
    unwrapped = _let("held", "startswith(plain, '(') AND endswith(plain, ')')", _let("inner_", f"CASE WHEN held THEN {_strip('substring(plain, 2, length(plain) - 2)')} ELSE plain END", unminused))
    plain = _let("plain", r"regexp_replace(translate(each, '０１２３４５６７８９，．', '0123456789,.'), r'(?U)(?<=\d)[,\s](?=\d)', '')", unwrapped)
    shared = f"CASE WHEN share THEN {_strip(f"regexp_replace(translate(whole, '¥￥$€£元', ''), r'{PER_SHARE}', '')")} ELSE whole END"
    each = _let("share", f"whole RLIKE r'{PER_SHARE}'", _let("each", shared, plain))
    whole = _let("pct", r"signless RLIKE r'(?U)[%％]\s*$'", _let("whole", _strip(r"regexp_replace(signless, r'(?U)[%％]\s*$', '')"), each))
    return _let("t", _strip("raw"), _let("signless", rf"CASE WHEN NOT t RLIKE r'{MISSING}' THEN regexp_replace(t, r'(?U)^[$¥￥€£]\s*', '') END", whole))


def _period() -> str:
    """Struct of year, kind, end date and restatement; null unless the header names one year and no impossible date."""
    date = r"(?:19|20)\d{2}\s*[年/-]\s*(\d{1,2})\s*[月/-]\s*(\d{1,2})"
    kind = "CASE WHEN statement = 'balance_sheet' THEN 'point_in_time' WHEN header RLIKE '(?i)quarter|three months|季度|三个月' THEN 'quarter' WHEN header RLIKE '(?i)half.year|six months|半年度|六个月' THEN 'half_year' ELSE 'annual' END"
    day = f"date_format(try_to_date(concat_ws('-', y, lpad(regexp_extract(header, r'{date}', 1), 2, '0'), lpad(regexp_extract(header, r'{date}', 2), 2, '0')), 'yyyy-MM-dd'), 'yyyy-MM-dd')"
    end = rf"CASE WHEN header RLIKE r'{date}' THEN coalesce({day}, 'none') WHEN header RLIKE r'(?i)December\s+31|31\s+December' THEN concat(y, '-12-31') END"
    made = f"CASE WHEN y IS NOT NULL AND NOT coalesce(e = 'none', false) THEN named_struct('year', int(y), 'period_type', {kind}, 'end_date', e, 'is_restated', header RLIKE '(?i)(?<!un)restated|重述|调整后|重列') END"
    years = r"array_distinct(regexp_extract_all(header, r'(?<!\d)((?:19|20)\d{2})(?!\d)', 1))"
    return _let("ys", years, _let("y", "CASE WHEN size(ys) = 1 THEN ys[0] END", _let("e", end, made)))


def _unit() -> str:
    """Struct of currency and multiplier, each only if the text names exactly one."""
    tests = ", ".join(f"CASE WHEN t RLIKE r'{p}' THEN '{c}' END" for c, p in CURRENCIES)
    scale = "CASE " + " ".join(f"WHEN startswith(lower(w), '{k}') THEN double({v})" for k, v in SCALES) + " END"
    words = rf"regexp_extract_all(t, r'(?i)(百万元|千万元|亿元|万元|千元|(?<![万千百亿])元|\bbillions?\b|\bmillions?\b|\bthousands?\b)', 1)"
    made = "named_struct('currency', CASE WHEN size(found) = 1 THEN found[0] ELSE '' END, 'multiplier', CASE WHEN size(scales) = 1 THEN scales[0] END)"
    bare = r"regexp_replace(regexp_replace(context, r'(?i)每股[^，,;；\n]*|except[^;\n]*per.share[^;\n]*', ''), r'(?i)\bexcept\b[^\n]*', '')"
    return _let("t", bare, _let("found", f"filter(array({tests}), c -> c IS NOT NULL)", _let("scales", f"array_distinct(transform({words}, w -> {scale}))", made)))


def register(spark: SparkSession, facts: DataFrame | None = None) -> None:
    """Make read_amount, read_period and read_unit, and with facts also the views ``facts`` and ``selected_values`` of
    this library (named factloom_facts and factloom_values) with the table functions ratio_of and labels_like."""
    make = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    make("read_amount(raw STRING) RETURNS STRUCT<value: DOUBLE, kind: STRING>", _amount())
    make("read_period(header STRING, statement STRING) RETURNS STRUCT<year: INT, period_type: STRING, end_date: STRING, is_restated: BOOLEAN>", _period())
    make("read_unit(context STRING) RETURNS STRUCT<currency: STRING, multiplier: DOUBLE>", _unit())
    if facts is None:
        return
    from ..operators.inputs import PERIOD, REPORT, select_values

    facts.createOrReplaceTempView("factloom_facts")
    values = select_values(facts).select(*REPORT, "statement_type", "canonical_name", *PERIOD, F.col("amount").cast("double").alias("amount"), "currency", "reason")
    values.createOrReplaceTempView("factloom_values")
    same = " AND ".join(f"a.{c} <=> b.{c}" for c in (*REPORT, *PERIOD))
    out = "doc_id INT, scope STRING, year INT, period_type STRING, end_date STRING, is_restated BOOLEAN, value DOUBLE, reason STRING"
    refused = "CASE WHEN a.reason <> '' THEN a.reason WHEN b.reason IS NULL THEN 'MISSING' WHEN b.reason <> '' THEN b.reason WHEN a.currency <> b.currency THEN 'CURRENCY_MIX' WHEN b.amount <= 0 THEN '{code}' ELSE '' END"
    head = "int(a.doc_id), a.scope, a.year, a.period_type, a.end_date, a.is_restated"
    ratio = f"SELECT {head}, CASE WHEN {refused.format(code='NONPOSITIVE_DENOMINATOR')} = '' THEN a.amount / b.amount * 100 END, {refused.format(code='NONPOSITIVE_DENOMINATOR')} FROM factloom_values a LEFT JOIN factloom_values b ON b.canonical_name = bottom AND {same} WHERE a.canonical_name = top"
    make(f"ratio_of(top STRING, bottom STRING) RETURNS TABLE({out})", ratio)
    make(
        "labels_like(pattern STRING) RETURNS TABLE(doc_id INT, label STRING, metric STRING, n LONG)",
        "SELECT int(doc_id), original_label, canonical_name, count(*) FROM factloom_facts WHERE original_label RLIKE pattern GROUP BY ALL",
    )
