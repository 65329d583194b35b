"""Queries from pages and words to facts: reports of four kinds are dealt to suppliers and read as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as ex
from ..operators import positional
from ..sources.scratch import kept
from .catalog import _add
from .grids import _ALIASES, SUMS_SQL, _quoted, filled, sums

_FIGURES = " / ".join(f"1,{i:03d}" for i in range(1, 23))
#: Pages of each kind of report (text), and their drawn tables; {a} to {f} are numbers of a supplier.
_PAGES = [
    (0, 1, "Annual Report", []),
    (0, 2, f"合并利润表\n单位：人民币百万元\n2025年 2024年\n{_FIGURES}", [[["项目", "2025年", "2024年"], ["营业收入", "{a}", "{b}"], ["营业成本", "{c}", "{d}"]]]),
    (0, 3, f"（续）\n单位：人民币百万元\n2025年 2024年\n{_FIGURES}", [[["净利润", "{a}", "{c}"], ["营业收入", "{a}", "{d}"]]]),
    (0, 4, f"合并资产负债表\n单位：人民币千元\n2025年\n{_FIGURES}", [[["项目", "合并 2025年12月31日", "母公司 2025年12月31日"], ["资产总计", "{a}", "{b}"], ["负债合计", "{c}", "{d}"]]]),
    (0, 5, f"合并现金流量表\n单位：人民币百万元\n2025年 2024年\n{_FIGURES}", [[["项目", "2025年", "2024年"], ["经营活动产生的现金流量净额", "{a}", "({b})"], ["资本支出", "{c}", "—"]]]),
    (0, 6, "General remarks without any figures.", []),
    (1, 1, f"Consolidated Income Statement\nUSD million\n2025 2024\n{_FIGURES}", []),
    (1, 2, f"Consolidated Balance Sheet\nUSD million\n2025 �\n{_FIGURES}", [[["Item", "2025", "2025"], ["Total assets", "{a}", "{b}"]]]),
    (2, 1, "General remarks without any figures.", [[["Item", "2025"], ["Revenue", "{a}"]]]),
    (3, 1, f"母公司利润表\n单位：人民币百万元\n2025年 2024年\n{_FIGURES}", [[["项目", "2025年", "2024年"], ["营业收入", "{a}", "{b}"]]]),
    (3, 2, f"利润表\n单位：人民币百万元\n项目  2025  2024\n营业收入  {{a}}  {{b}}\n{_FIGURES}", []),
]
_TABLES = [(v, p, t, r, c, cell) for v, p, _, grids in _PAGES for t, rows in enumerate(grids) for r, row in enumerate(rows) for c, cell in enumerate(row)]
#: Words of a page (x0, x1, y, text): lines drift downwards, a label goes on over three lines, a footer looks like a row.
_WORDS = [
    (0, 30, 4.0, "Revenue"), (100, 120, 4.0, "2025"), (160, 180, 4.0, "2024"), (0, 20, 10.0, "Item"), (100, 120, 10.5, "2025"), (160, 180, 11.5, "2024"),
    (0, 30, 20.0, "Revenue"), (32, 36, 20.5, "7(a)"), (105, 115, 21.75, "{a}"), (165, 175, 23.0, "{b}"), (0, 20, 24.5, "Cost"), (25, 30, 24.5, "of"), (40, 60, 24.5, "revenue"), (105, 115, 25.0, "{c}"), (165, 175, 26.5, "{d}"),
    (0, 20, 40.0, "Basic"), (0, 30, 50.0, "earnings"), (0, 10, 60.0, "per"), (20, 40, 60.0, "share"), (105, 115, 60.0, "1.5"), (165, 175, 61.0, "1.4"),
    (0, 30, 70.0, "Revenues:"), (0, 20, 80.0, "sales"), (30, 50, 80.0, "abroad"), (105, 115, 80.0, "7"), (165, 175, 80.0, "8"), (300, 310, 85.0, "17"), (0, 20, 90.0, "Annual"), (25, 40, 90.0, "Report"), (45, 60, 90.0, "2025"),
    (0, 20, 100.0, "Wages,"), (105, 115, 110.0, "5"), (0, 20, 110.0, "Salaries"), (165, 175, 110.0, "6"),
]
_FIRST = [w for w in _WORDS if 4.0 < w[2] < 95.0]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_quoted(x).replace("\n", "\\n") if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _sql_values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else _quoted(x).replace("\n", "' || chr(10) || '") if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _of_kind(spark, sf_dir: str, rows, columns: str):
    """Fixed rows (v, ...) for each supplier of kind v."""
    return sums(spark, sf_dir).join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS t(v, {columns})")), F.col("doc_id") % 4 == F.col("v"))


def report_pages(spark, sf_dir: str):
    rows = _of_kind(spark, sf_dir, [(v, p, text) for v, p, text, _ in _PAGES], "page_number, text")
    return kept(rows.select("doc_id", "page_number", filled(F.col("text")).alias("text")), "report-pages")


def _native(spark, sf_dir: str):
    rows = _of_kind(spark, sf_dir, _TABLES, "page_number, table_no, row_no, col_no, cell")
    return rows.select("doc_id", "page_number", "table_no", "row_no", "col_no", filled(F.col("cell")).alias("cell"))


def _words(spark, sf_dir: str, words, stretched: bool):
    """Boxes of words; with ``stretched`` lines lie wider apart for some suppliers, so that words change their line."""
    word = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("x0", "x1", "y", "text"), w, strict=True)]) for w in words])).alias("w")
    line = sums(spark, sf_dir) if stretched else sums(spark, sf_dir).where("doc_id % 4 = 1")
    y = F.col("y") * (1 + F.col("doc_id") % 5 / 4) if stretched else F.col("y")
    double = lambda c: F.col(c).cast("double").alias(c)
    return line.select("*", word).select("*", "w.*").select("doc_id", F.lit(1).alias("page_number"), double("x0"), (y - 1).alias("y0"), double("x1"), (y + 1).alias("y1"), filled(F.col("text")).alias("text"))


def extracted(spark, sf_dir: str):
    pages = report_pages(spark, sf_dir)
    return ex.extract(pages, kept(ex.page_tables(_native(spark, sf_dir), _words(spark, sf_dir, _FIRST, False), pages), "report-cells"))


#: What each kind of report says, read by hand: kind, range, kind of statement, scope, slot, table, row, metric, label, cell, sign of the
#: value (0: none), value type, year, end date, currency, multiplier, page, method, confidence.
_two = lambda head, last, new, old: [(*head, new, 1, *last[:1], 2025, *last[1:]), (*head, old, 1, *last[:1], 2024, *last[1:])]
_CN, _US = ("monetary", None, "CNY", 1e6), ("monetary", None, "USD", 1e6)
_SAID = [
    *_two((0, 1, "income_statement", "consolidated", "main", 0, 1, "revenue", "营业收入"), (*_CN, 2, "native", "medium"), "{a}", "{b}"),
    *_two((0, 1, "income_statement", "consolidated", "main", 0, 2, "cost_of_revenue", "营业成本"), (*_CN, 2, "native", "medium"), "{c}", "{d}"),
    *_two((0, 1, "income_statement", "consolidated", "main", 1, 0, "net_income", "净利润"), (*_CN, 3, "native", "medium"), "{a}", "{c}"),
    *_two((0, 1, "income_statement", "consolidated", "main", 1, 1, "revenue", "营业收入"), (*_CN, 3, "native", "medium"), "{a}", "{d}"),
    (0, 2, "balance_sheet", "consolidated", "main", 0, 1, "total_assets", "资产总计", "{a}", 1, "monetary", 2025, "2025-12-31", "CNY", 1e3, 4, "native", "medium"),
    (0, 2, "balance_sheet", "consolidated", "main", 0, 2, "total_liabilities", "负债合计", "{c}", 1, "monetary", 2025, "2025-12-31", "CNY", 1e3, 4, "native", "medium"),
    (0, 2, "balance_sheet", "parent", "alternative", 0, 1, "total_assets", "资产总计", "{b}", 1, "monetary", 2025, "2025-12-31", "CNY", 1e3, 4, "native", "medium"),
    (0, 2, "balance_sheet", "parent", "alternative", 0, 2, "total_liabilities", "负债合计", "{d}", 1, "monetary", 2025, "2025-12-31", "CNY", 1e3, 4, "native", "medium"),
    (0, 3, "cash_flow", "consolidated", "main", 0, 1, "operating_cash_flow", "经营活动产生的现金流量净额", "{a}", 1, "monetary", 2025, None, "CNY", 1e6, 5, "native", "medium"),
    (0, 3, "cash_flow", "consolidated", "main", 0, 1, "operating_cash_flow", "经营活动产生的现金流量净额", "({b})", -1, "monetary", 2024, None, "CNY", 1e6, 5, "native", "medium"),
    (0, 3, "cash_flow", "consolidated", "main", 0, 2, "capital_expenditure", "资本支出", "{c}", 1, "monetary", 2025, None, "CNY", 1e6, 5, "native", "medium"),
    (0, 3, "cash_flow", "consolidated", "main", 0, 2, "capital_expenditure", "资本支出", "—", 0, "monetary", 2024, None, "CNY", 1e6, 5, "native", "medium"),
    *_two((1, 1, "income_statement", "consolidated", "main", 0, 1, "revenue", "Revenue"), (*_US, 1, "positional", "medium"), "{a}", "{b}"),
    *_two((1, 1, "income_statement", "consolidated", "main", 0, 2, "cost_of_revenue", "Cost of revenue"), (*_US, 1, "positional", "medium"), "{c}", "{d}"),
    *_two((1, 1, "income_statement", "consolidated", "main", 0, 3, "eps_basic", "Basic earnings per share"), ("per_share", None, "USD", 1.0, 1, "positional", "medium"), "1.5", "1.4"),
    *_two((1, 1, "income_statement", "consolidated", "main", 0, 5, None, "sales abroad"), (*_US, 1, "positional", "low"), "7", "8"),
    *_two((3, 1, "income_statement", "parent", "alternative", 0, 1, "revenue", "营业收入"), (*_CN, 1, "native", "medium"), "{a}", "{b}"),
    *_two((3, 2, "income_statement", "unknown", "main", 0, 3, "revenue", "营业收入"), (*_CN, 2, "text", "medium"), "{a}", "{b}"),
]
_FILLED = "cell"
for _name in "abcdef":
    _FILLED = f"replace({_FILLED}, '{{{_name}}}', format('{{:,}}', {_name}))"
_SAID_SQL = f"""WITH {SUMS_SQL}, said(v, span, statement_type, scope, slot, table_no, metric_ordinal, canonical_name, original_label, cell, sign, value_type, year, end_date, currency, multiplier, source_page, extraction_method, confidence) AS (VALUES {_sql_values(_SAID)})"""
_add(
    "extract_facts",
    lambda spark, sf_dir: extracted(spark, sf_dir)["facts"].select(
        "doc_id", "span", "statement_type", "scope", "slot", "table_no", "metric_ordinal", "canonical_name", "original_label", "raw_value", "value", "value_type", "year", "end_date", "currency", "multiplier", "source_page", "extraction_method", "confidence"
    ),
    f"""{_SAID_SQL}
SELECT doc_id, span, statement_type, scope, slot, table_no, metric_ordinal, canonical_name, original_label, {_FILLED} AS raw_value, CASE WHEN sign <> 0 THEN sign * regexp_replace({_FILLED}, '[(),]', '', 'g')::DOUBLE END AS value, value_type, year, end_date, currency,
multiplier::DOUBLE AS multiplier, source_page, extraction_method, confidence FROM sums JOIN said ON doc_id % 4 = v""",
)
#: Warnings of each kind of report: kind, range, scope, warning, detail.
_WARNED = [
    (0, 1, "consolidated", "INHERITED_COLUMNS", "3"), (1, 2, "consolidated", "DUPLICATE_PERIODS", "2"), (1, 2, "consolidated", "NO_ROWS", "balance_sheet"), (1, None, None, "GARBLED", None), (1, None, None, "MISSING", "cash_flow"),
    (2, None, None, "NO_RANGES", None), (3, 2, "unknown", "IRREGULAR_ROW", "2"), (3, None, None, "MISSING", "balance_sheet"), (3, None, None, "MISSING", "cash_flow"),
]
_add(
    "extract_warnings",
    lambda spark, sf_dir: extracted(spark, sf_dir)["warnings"],
    f"""WITH {SUMS_SQL}, warned(v, span, scope, warning, detail) AS (VALUES {_sql_values(_WARNED)})
SELECT doc_id, span, scope, warning, detail, 1 AS n FROM sums JOIN warned ON doc_id % 4 = v UNION ALL SELECT doc_id, 1, 'consolidated', 'CONFLICT', 'revenue 2024', 1 FROM sums WHERE doc_id % 4 = 0 AND b <> d""",
)
_STATED = [
    (0, 1, "income_statement", "consolidated", "main", 2, 3), (0, 2, "balance_sheet", "consolidated", "main", 4, 4), (0, 2, "balance_sheet", "parent", "alternative", 4, 4), (0, 3, "cash_flow", "consolidated", "main", 5, 5),
    (1, 1, "income_statement", "consolidated", "main", 1, 1), (1, 2, "balance_sheet", "consolidated", "main", 2, 2), (3, 1, "income_statement", "parent", "alternative", 1, 1), (3, 2, "income_statement", "unknown", "main", 2, 2),
]


def _statements(spark, sf_dir: str):
    made = extracted(spark, sf_dir)
    report = made["reports"].select("doc_id", "currency", F.col("n_facts").alias("in_report"), "n_statements")
    return report.join(made["statements"], "doc_id", "left")


_add(
    "extract_statements",
    _statements,
    f"""{_SAID_SQL}, stated(v, span, statement_type, scope, slot, anchor_page, end_page) AS (VALUES {_sql_values(_STATED)})
SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'USD' WHEN 2 THEN '' ELSE 'CNY' END AS currency, (SELECT count(*) FROM said f WHERE f.v = doc_id % 4) AS in_report, (SELECT count(*) FROM stated z WHERE z.v = doc_id % 4) AS n_statements, s.* EXCLUDE (v),
CASE WHEN s.v IS NOT NULL THEN (SELECT count(*) FROM said f WHERE f.v = s.v AND f.span = s.span AND f.scope = s.scope) END AS n_facts FROM sums LEFT JOIN stated s ON doc_id % 4 = s.v""",
)
_add(
    "positional_tables",
    lambda spark, sf_dir: positional.positional_cells(_words(spark, sf_dir, _WORDS, True)),
    f"""WITH RECURSIVE {SUMS_SQL}, al(metric, st, k) AS (VALUES {_ALIASES}), word(x0, x1, y, cell) AS (VALUES {_sql_values(_WORDS)}),
w AS (SELECT doc_id, x0, (x0 + x1) / 2.0 AS x, (y * (1 + doc_id % 5 / 4.0))::DOUBLE AS y, {_FILLED} AS text, regexp_full_match(cell, '(19|20)\\d\\d(年度|年)?') AS dated FROM sums, word),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x0) AS rn FROM w),
walk AS (SELECT doc_id, rn, [y] AS starts, 0 AS line FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.rn, CASE WHEN near IS NULL THEN list_append(starts, o.y) ELSE starts END, coalesce(near - 1, len(starts)) FROM
    (SELECT k.*, q.y, list_max([i FOR i IN range(greatest(len(k.starts) - 3, 1), len(k.starts) + 1) IF abs(k.starts[i] - q.y) <= 3]) AS near FROM walk k JOIN o q ON q.doc_id = k.doc_id AND q.rn = k.rn + 1) p JOIN o ON o.doc_id = p.doc_id AND o.rn = p.rn + 1),
l AS (SELECT o.*, k.line FROM o JOIN walk k USING (doc_id, rn)),
heads AS (SELECT doc_id, min_by(xs, line) AS xs, min_by(titles, line) AS titles, min(line) AS head FROM (SELECT doc_id, line, list(x ORDER BY x0) FILTER (dated) AS xs, list(text ORDER BY x0) FILTER (dated) AS titles, coalesce(string_agg(text, ' ' ORDER BY rn) FILTER (NOT dated), '') AS other FROM l GROUP BY ALL)
  WHERE len(xs) >= 2 AND NOT EXISTS (SELECT 1 FROM al WHERE contains(lower(replace(other, ' ', '')), k)) GROUP BY ALL),
gaps AS (SELECT *, list_min([xs[i + 1] - xs[i] FOR i IN range(1, len(xs))]) AS gap FROM heads),
b AS (SELECT doc_id, head, titles, list_concat([xs[1] - gap / 2], [(xs[i] + xs[i + 1]) / 2 FOR i IN range(1, len(xs))], [xs[len(xs)] + gap / 2]) AS edges FROM gaps),
placed AS (SELECT l.doc_id, line, text, x0, rn, CASE WHEN x < edges[1] THEN 0 WHEN x < edges[len(edges)] THEN len([e FOR e IN edges IF e <= x]) END AS col FROM l JOIN b USING (doc_id) WHERE line > head),
r AS (SELECT doc_id, line, regexp_replace(coalesce(string_agg(text, ' ' ORDER BY x0, rn) FILTER (col = 0), ''), '\\s+(\\d{{1,3}}(\\s*[,，]\\s*\\d{{1,3}})*(\\([a-z]\\))?|[（(][一二三四五六七八九十\\d]+[）)])$', '') AS label,
  coalesce(string_agg(text, ' ' ORDER BY x0, rn) FILTER (col = 1), '') AS one, coalesce(string_agg(text, ' ' ORDER BY x0, rn) FILTER (col = 2), '') AS two FROM placed GROUP BY ALL),
rows_of AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn FROM r WHERE NOT regexp_matches(label, '(?i)^Annual Report\\b')),
m AS (SELECT doc_id, rn, label, one, two, 1 AS grp FROM rows_of WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.rn, CASE WHEN j THEN p.before || ' ' || r.label ELSE r.label END, r.one, r.two, grp + CASE WHEN j THEN 0 ELSE 1 END FROM
    (SELECT k.doc_id, k.rn, k.grp, k.label AS before, k.label <> '' AND k.one = '' AND k.two = '' AND q.label <> '' AND (k.label LIKE '%,' OR regexp_matches(q.label, '^[a-z]')) AND NOT regexp_matches(k.label, '(?i)^(Note|Revenues|Attributable to|Cash flows from)\\b') AS j FROM m k JOIN rows_of q ON q.doc_id = k.doc_id AND q.rn = k.rn + 1) p
    JOIN rows_of r ON r.doc_id = p.doc_id AND r.rn = p.rn + 1),
t AS (SELECT doc_id, grp AS row_no, arg_max([label, one, two], rn) AS cells FROM m GROUP BY ALL UNION ALL SELECT doc_id, 0, list_concat([''], titles) FROM b)
SELECT doc_id, 1 AS page_number, row_no, unnest(range(len(cells))) AS col_no, unnest(cells) AS cell FROM t""",
)
