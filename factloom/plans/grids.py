"""Queries over table grids: grids of every kind are dealt to suppliers, assembled to facts, and checked by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aliases, tables
from ..sources.scratch import kept
from .catalog import _add

#: Kinds of reports as lists of (context, rows); {a} to {f} are numbers of a supplier, {e} = {a} + {c}, {f} = {b} + {d}.
GRIDS = (
    [("单位：人民币百万元", [["项目", "附注", "2024年", "2025年", "增减变动%"], ["一、营业收入", "1", "{a}", "{b}", "5%"], ["减：营业成本", "2", "{c}", "{d}", "3%"], ["基本每股收益", "", "0.30", "0.36", ""], ["毛利率", "", "7.2%", "8.1%", ""], ["Revenue growth", "", "10", "12", ""], ["", "", "1", "2", ""]])],
    [("RMB thousand", [["Item", "合并 2025年度", "合并 2024年度", "母公司 2025年度", "母公司 2024年度"], ["Total revenue", "{a}", "{b}", "{c}", "{d}"], ["Net income", "({a})", "-{b}", "—", "N/A"]])],
    [("RMB million", [["Item", "2025", "2024"], ["Revenue", "{a}", "{b}"]]), ("continued", [["Net income", "(123)", "—"], ["Cost of sales", "{c}", "n.m."]]), ("continued", [["Gross profit", "1", "2", "3"]])],
    [("USD million", [["Revenue", "{a}", "{b}"], ["Net income", "{c}", "{d}"]])],
    [("million", [["Item", "2025", "2024", "2024"], ["", "", "重述", "原列"], ["Revenue", "{a}", "{b}", "{c}"], ["Operating income", "{d}", "", "{a}"]])],
    [("RMB thousand", [["Item", "2025", "2024"], ["Revenue", "", ""], ["Segment A", "{a}", "{b}"], ["Segment B", "{c}", "{d}"], ["3", "{e}", "{f}"], ["Gross margin", "50", "40"], ["Gross profit margin", "50%", "40%"]]), ("RMB thousand", [["Item", "2025", "2024"], ["Sales", "", ""], ["Segment A", "{a}", "{b}"], ["Segment B", "{c}", "{d}"], ["", "{e}", "{a}"]])],
    [("RMB thousand", [["Item", "2025", "2025"], ["Revenue", "{a}", "{b}"]]), ("RMB thousand", [["Item", "2025年12月31日", "2024"], ["Operating profit", "{a}"], ["Net income", "{a}", "{b}"], ["Net profit", "{c}", "{b}"]])],
    [("RMB thousand", [["Item", "2025", "2024"], ["Revenue", "{a}", "{b}"]]), ("币种", [["Item", "2024", "2023"], ["Revenue", "{c}", "{d}"], ["Diluted EPS", "1.5", "1.4"]]), ("", [["Item", "2023", "2022"], ["Revenue", "{a}", "{d}"]])],
)
_CELLS = [(v, t, r, c, cell) for v, grids in enumerate(GRIDS) for t, (_, rows) in enumerate(grids) for r, row in enumerate(rows) for c, cell in enumerate(row)]
_CONTEXTS = [(v, t, context) for v, grids in enumerate(GRIDS) for t, (context, _) in enumerate(grids)]
_quoted = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
_values = lambda rows: ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


_KEPT: dict = {}


def sums(spark, sf_dir: str):
    """(doc_id, a to f): numbers of each supplier; order lines are read once per folder and session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _KEPT:
        line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").cast("int").alias("doc_id")).agg(
            F.sum(F.col("l_quantity").cast("long")).alias("a"), (F.count("*") * 7).alias("b"), F.sum("l_linenumber").cast("long").alias("c"), F.max("l_partkey").alias("d")
        )
        _KEPT[key] = kept(line.selectExpr("*", "a + c as e", "b + d as f"), "sums")
    return _KEPT[key]


def filled(text):
    """A template with the numbers of its supplier."""
    for name in "abcdef":
        text = F.replace(text, F.lit(f"{{{name}}}"), F.format_number(name, 0))
    return text


def cells(spark, sf_dir: str):
    """A grid table: each supplier prints its sums in the tables of one kind."""
    line = sums(spark, sf_dir)
    grid = spark.sql(f"SELECT * FROM VALUES {_values(_CELLS)} AS t(v, table_no, row_no, col_no, cell)").join(spark.sql(f"SELECT * FROM VALUES {_values(_CONTEXTS)} AS t(v, table_no, context)"), ["v", "table_no"])
    met = line.join(F.broadcast(grid), F.col("doc_id") % len(GRIDS) == F.col("v"))  # the grids are a fixed table
    return kept(met.select("doc_id", "table_no", (F.col("table_no") + 3).alias("source_page"), F.when(F.col("doc_id") % 9 == 4, "local_ocr").otherwise("native").alias("method"), "context", "row_no", "col_no", filled(F.col("cell")).alias("cell")), "grid-cells")


_ALIASES = ", ".join(f"('{m}', '{st}', '{k}')" for m, st, names in aliases.METRICS for k in dict.fromkeys("".join(a.split()).lower().replace("'", "''") for a in names))
_CELL = "cell"
for _name in "abcdef":
    _CELL = f"replace({_CELL}, '{{{_name}}}', format('{{:,}}', {_name}))"
SUMS_SQL = "sums AS (SELECT *, a + c AS e, b + d AS f FROM (SELECT l_suppkey::INTEGER AS doc_id, sum(l_quantity::BIGINT)::BIGINT AS a, count(*) * 7 AS b, sum(l_linenumber)::BIGINT AS c, max(l_partkey) AS d FROM lineitem GROUP BY ALL))"
_GRID_SQL = f"""WITH al(metric, st, k) AS (VALUES {_ALIASES}),
{SUMS_SQL},
cells AS (SELECT doc_id, t.table_no, row_no, col_no, {_CELL} AS cell, context FROM sums JOIN (VALUES {_values(_CELLS)}) t(v, table_no, row_no, col_no, cell) ON doc_id % {len(GRIDS)} = v JOIN (VALUES {_values(_CONTEXTS)}) x(v, table_no, context) ON x.v = t.v AND x.table_no = t.table_no),
dated AS (SELECT *, CASE WHEN len(list_distinct(ys)) = 1 THEN ys[1]::INTEGER END AS year FROM (SELECT *, regexp_extract_all(cell, '(?:^|\\D)((?:19|20)\\d\\d)', 1) AS ys FROM cells)),
lines AS (SELECT doc_id, table_no, row_no, bool_or(year IS NOT NULL) AS dated, bool_or(trim(cell) IN ('重述', '原列')) AS marker, max(cell) FILTER (col_no = 0) AS label FROM dated GROUP BY ALL),
named AS (SELECT *, EXISTS (SELECT 1 FROM al WHERE contains(lower(replace(label, ' ', '')), k)) AS named FROM lines),
tops AS (SELECT n.doc_id, n.table_no, min(n.row_no) FILTER (NOT ((dated AND NOT named) OR (NOT dated AND marker))) - 1 AS header_end FROM named n JOIN (SELECT doc_id, table_no, min(row_no) AS f FROM named WHERE dated AND NOT named GROUP BY ALL) q ON q.doc_id = n.doc_id AND q.table_no = n.table_no AND n.row_no >= f GROUP BY ALL),
heads AS (SELECT c.doc_id, c.table_no, col_no, header_end, string_agg(cell, ' ' ORDER BY row_no) AS h FROM cells c JOIN tops t ON t.doc_id = c.doc_id AND t.table_no = c.table_no AND row_no <= header_end GROUP BY ALL),
found AS (SELECT *, list_distinct(regexp_extract_all(h, '(?:19|20)\\d\\d'))[1]::INTEGER AS year, contains(h, '重述') AS is_restated, CASE WHEN contains(h, '12月31日') THEN '2025-12-31' END AS end_date, CASE WHEN contains(h, '合并') THEN 'consolidated' WHEN contains(h, '母公司') THEN 'parent' ELSE 'unknown' END AS col_scope
          FROM heads WHERE col_no > 0 AND NOT regexp_matches(h, '附注|变动') AND regexp_matches(h, '(?:19|20)\\d\\d')),
kept AS (SELECT * FROM (SELECT *, bool_or(col_scope <> 'unknown') OVER (PARTITION BY doc_id, table_no) AS scoped FROM found) WHERE NOT scoped OR col_scope = @scope),
twice AS (SELECT DISTINCT doc_id, table_no FROM kept GROUP BY doc_id, table_no, year, is_restated, end_date HAVING count(*) > 1),
refused AS (SELECT doc_id, table_no, 'DUPLICATE_PERIODS' AS warning FROM twice UNION ALL SELECT DISTINCT doc_id, table_no, 'SCOPE_NEEDED' FROM found WHERE col_scope <> 'unknown' AND @scope = ''),
own AS (SELECT k.* FROM kept k WHERE (doc_id, table_no) NOT IN (SELECT (doc_id, table_no) FROM twice)),
tabs AS (SELECT doc_id, table_no, max(col_no) + 1 AS width, any_value(context) AS context FROM cells GROUP BY ALL),
how AS (SELECT t.*, EXISTS (SELECT 1 FROM own o WHERE o.doc_id = t.doc_id AND o.table_no = t.table_no) AS has, (SELECT max(o.table_no) FROM own o WHERE o.doc_id = t.doc_id AND o.table_no < t.table_no) AS before FROM tabs t WHERE (doc_id, table_no) NOT IN (SELECT (doc_id, table_no) FROM refused)),
src AS (SELECT h.doc_id, h.table_no, h.width, h.has, CASE WHEN h.has THEN h.table_no WHEN p.width = h.width THEN h.before END AS source FROM how h LEFT JOIN tabs p ON p.doc_id = h.doc_id AND p.table_no = h.before),
cols AS (SELECT s.doc_id, s.table_no, s.width, CASE WHEN s.has THEN o.header_end ELSE -1 END AS header_end, o.col_no, o.year, o.is_restated, o.end_date FROM src s JOIN own o ON o.doc_id = s.doc_id AND o.table_no = s.source),
told AS (SELECT doc_id, table_no, CASE WHEN regexp_matches(context, '人民币|RMB') THEN 'CNY' WHEN contains(context, 'USD') THEN 'USD' ELSE '' END AS currency, CASE WHEN regexp_matches(context, '百万元|million') THEN 1e6 WHEN contains(context, 'thousand') THEN 1e3 END AS multiplier,
                regexp_matches(context, '单位|币种|RMB|USD|million|thousand') AS says FROM tabs),
units AS (SELECT t.doc_id, t.table_no, coalesce(u.currency, '') AS currency, u.multiplier FROM told t LEFT JOIN told u ON u.doc_id = t.doc_id AND u.table_no = (SELECT max(w.table_no) FROM told w WHERE w.doc_id = t.doc_id AND w.table_no <= t.table_no AND w.says)),
grid AS (SELECT c.doc_id, c.table_no, c.row_no, max(c.cell) FILTER (c.col_no = 0) AS label, count(*) AS n_cells, any_value(q.width) AS width FROM cells c JOIN (SELECT DISTINCT doc_id, table_no, width, header_end FROM cols) q ON q.doc_id = c.doc_id AND q.table_no = c.table_no AND c.row_no > q.header_end GROUP BY ALL),
raw AS (SELECT g.doc_id, g.table_no, g.row_no, g.label, k.col_no, k.year, k.is_restated, k.end_date, c.cell, CASE WHEN regexp_matches(c.cell, '^[(-]') THEN -1 ELSE 1 END * try_cast(regexp_replace(c.cell, '[(),%-]', '', 'g') AS DOUBLE) AS num
        FROM grid g JOIN cols k ON k.doc_id = g.doc_id AND k.table_no = g.table_no JOIN cells c ON c.doc_id = g.doc_id AND c.table_no = g.table_no AND c.row_no = g.row_no AND c.col_no = k.col_no),
opens AS (SELECT doc_id, table_no, row_no, label FROM raw GROUP BY ALL HAVING bool_and(trim(cell) = '') AND lower(label) IN ('revenue', 'sales')),
closes AS (SELECT o.doc_id, o.table_no, o.row_no AS at, o.label AS head, min(g.row_no) AS row_no FROM opens o JOIN grid g ON g.doc_id = o.doc_id AND g.table_no = o.table_no AND g.row_no > o.row_no AND regexp_full_match(g.label, '\\s*\\d*\\s*') GROUP BY ALL),
back AS (SELECT c.* FROM closes c WHERE NOT EXISTS (SELECT 1 FROM raw t WHERE t.doc_id = c.doc_id AND t.table_no = c.table_no AND t.row_no = c.row_no AND t.num IS DISTINCT FROM (SELECT sum(s.num) FROM raw s WHERE s.doc_id = t.doc_id AND s.table_no = t.table_no AND s.col_no = t.col_no AND s.row_no > c.at AND s.row_no < c.row_no))),
labelled AS (SELECT g.* REPLACE (coalesce(b.head, g.label) AS label) FROM grid g LEFT JOIN back b ON b.doc_id = g.doc_id AND b.table_no = g.table_no AND b.row_no = g.row_no),
mapped AS (SELECT l.*, (SELECT min(metric) FROM al WHERE st = 'income_statement' AND k = lower(replace(regexp_replace(regexp_replace(label, '^[一二三]、', ''), '^减：', ''), ' ', ''))) AS metric,
           NOT EXISTS (SELECT 1 FROM raw r WHERE r.doc_id = l.doc_id AND r.table_no = l.table_no AND r.row_no = l.row_no AND trim(r.cell) <> '') AS blank,
           EXISTS (SELECT 1 FROM raw r WHERE r.doc_id = l.doc_id AND r.table_no = l.table_no AND r.row_no = l.row_no AND contains(r.cell, '%')) AS pct FROM labelled l WHERE trim(label) <> ''),
facts_of AS (SELECT m.doc_id, m.table_no, m.row_no AS metric_ordinal, CASE WHEN metric = 'gross_margin' AND lower(m.label) = 'gross margin' AND NOT pct THEN 'gross_profit' ELSE metric END AS canonical_name, m.label AS original_label, r.cell AS raw_value, r.num AS value, r.year, r.end_date, r.is_restated, u.currency,
             CASE WHEN regexp_matches(m.label, '每股|EPS') THEN 'per_share' WHEN contains(r.cell, '%') OR regexp_matches(m.label, '率') OR (regexp_matches(lower(m.label), 'margin') AND NOT (lower(m.label) = 'gross margin' AND NOT pct)) THEN 'percentage' ELSE 'monetary' END AS value_type, u.multiplier AS scale
             FROM mapped m JOIN raw r ON r.doc_id = m.doc_id AND r.table_no = m.table_no AND r.row_no = m.row_no JOIN units u ON u.doc_id = m.doc_id AND u.table_no = m.table_no WHERE n_cells = width AND NOT blank AND (r.num IS NOT NULL OR trim(r.cell) IN ('', '—', 'N/A'))),
typed AS (SELECT * EXCLUDE (scale), CASE WHEN value_type <> 'monetary' THEN 1.0 WHEN currency <> '' THEN scale END AS multiplier FROM facts_of)"""
_FACTS = """SELECT *, CASE WHEN canonical_name IS NOT NULL AND currency <> '' AND multiplier IS NOT NULL AND doc_id % 9 <> 4 THEN 'medium' ELSE 'low' END AS confidence FROM typed t
WHERE canonical_name IS NOT NULL OR EXISTS (SELECT 1 FROM typed o WHERE o.doc_id = t.doc_id AND o.table_no = t.table_no AND o.metric_ordinal = t.metric_ordinal AND o.value IS NOT NULL)"""
_WARNINGS = """SELECT doc_id, table_no, warning, count(*) AS n FROM (SELECT * FROM refused
UNION ALL SELECT doc_id, table_no, CASE WHEN source IS NULL THEN 'NO_YEAR_COLUMNS' ELSE 'INHERITED_COLUMNS' END FROM src WHERE NOT has
UNION ALL SELECT DISTINCT u.doc_id, u.table_no, 'UNKNOWN_UNIT' FROM units u JOIN cols c ON c.doc_id = u.doc_id AND c.table_no = u.table_no WHERE currency = '' OR multiplier IS NULL
UNION ALL SELECT doc_id, table_no, 'IRREGULAR_ROW' FROM mapped WHERE n_cells <> width) GROUP BY ALL"""
_COLUMNS = ["doc_id", "table_no", "metric_ordinal", "canonical_name", "original_label", "raw_value", "value", "value_type", "year", "end_date", "is_restated", "currency", "multiplier", "confidence"]


def _assembled(scope: str | None):
    return lambda spark, sf_dir: tables.assemble(cells(spark, sf_dir), "income_statement", scope)[0].select(*_COLUMNS)


for _tag, _scope in (("", None), ("_consolidated", "consolidated"), ("_parent", "parent")):
    _add(f"assemble_statement{_tag}", _assembled(_scope), _GRID_SQL.replace("@scope", f"'{_scope or ''}'") + "\n" + _FACTS)
_add(
    "assembly_warnings",
    lambda spark, sf_dir: tables.assemble(cells(spark, sf_dir), "income_statement")[1].groupBy("doc_id", "table_no", "warning").agg(F.count("*").alias("n")),
    _GRID_SQL.replace("@scope", "''") + "\n" + _WARNINGS,
)
_add(
    "duplicate_conflicts",
    lambda spark, sf_dir: tables.duplicate_conflicts(tables.assemble(cells(spark, sf_dir), "income_statement")[0]).select("doc_id", "canonical_name", "year", "end_date", "is_restated", "versions", "n"),
    _GRID_SQL.replace("@scope", "''") + ", out AS (" + _FACTS + ")\nSELECT doc_id, canonical_name, year, end_date, is_restated, count(DISTINCT (coalesce(value, 'nan'::DOUBLE), currency, coalesce(multiplier, -1))) AS versions, count(*) AS n FROM out WHERE canonical_name IS NOT NULL GROUP BY ALL HAVING versions > 1",
)

_add(
    "conflicting_pairs",
    lambda spark, sf_dir: tables.conflicting_pairs(tables.assemble(cells(spark, sf_dir), "income_statement")[0]).select("doc_id", "canonical_name", "year", "end_date", "is_restated", "table_no", "metric_ordinal", "value", "earlier_table_no", "earlier_ordinal", "earlier_value"),
    _GRID_SQL.replace("@scope", "''") + ", out AS (" + _FACTS + """)
SELECT n.doc_id, n.canonical_name, n.year, n.end_date, n.is_restated, n.table_no, n.metric_ordinal, n.value, o.table_no AS earlier_table_no, o.metric_ordinal AS earlier_ordinal, o.value AS earlier_value
FROM out n JOIN out o ON o.doc_id = n.doc_id AND o.canonical_name = n.canonical_name AND o.year = n.year AND o.end_date IS NOT DISTINCT FROM n.end_date AND o.is_restated = n.is_restated
AND (o.table_no < n.table_no OR (o.table_no = n.table_no AND o.metric_ordinal < n.metric_ordinal)) AND (o.value, o.currency, o.multiplier) IS DISTINCT FROM (n.value, n.currency, n.multiplier)""",
)

#: Native tables of a page, one kind per customer: rows of cells; and whether words show year columns (2), columns (1) or none (0).
_SCANS = (
    [["Item", "2025", "2024"], ["Revenue", "1", "2"]], [["Item", "2025"], ["Revenue\nCost", "1"]], [["Item", "2025"], ["", "1"], ["", "2"], ["", "3"], ["x", "4"]], [["Revenue", "1"]], [], [["Item", "Change 2025"], ["Revenue", "1"]],
    [["Item", "2025"], ["", "1"], ["", "2"], ["x", "3"]],
)
_NATIVE = [(k, r, c, cell) for k, rows in enumerate(_SCANS) for r, row in enumerate(rows) for c, cell in enumerate(row)]
_PLACED = [(1, 0, 0, "Revenue"), (1, 0, 1, "5"), (2, 0, 0, ""), (2, 0, 1, "2025"), (2, 1, 0, "Revenue"), (2, 1, 1, "5")]


def _choose_scan(spark, sf_dir: str):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 5 + 1).cast("int").alias("page_number"))
    table = lambda rows: F.broadcast(spark.sql("SELECT * FROM VALUES " + _values(rows).replace("\n", "\\n") + " AS t(k, row_no, col_no, cell)"))
    cells = lambda rows, kind: keys.join(table(rows), F.expr(kind) == F.col("k")).select("doc_id", "page_number", F.lit(0).alias("table_no"), "row_no", "col_no", "cell")
    lines = keys.select("doc_id", "page_number", F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.lit(0).alias("col_no"), F.lit("text").alias("cell"))
    return tables.choose_scan(cells(_NATIVE, f"doc_id % {len(_SCANS)}"), cells(_PLACED, f"doc_id div {len(_SCANS)} % 3"), lines)


_add(
    "choose_scan",
    _choose_scan,
    f"""WITH k AS (SELECT c_custkey AS doc_id, (c_custkey % 5 + 1)::INTEGER AS page_number, c_custkey % {len(_SCANS)} AS kind, c_custkey // {len(_SCANS)} % 3 AS placed FROM customer), n(kind, row_no, col_no, cell) AS (VALUES {_values(_NATIVE)}),
r AS (SELECT kind, row_no, max(cell) FILTER (col_no = 0) AS label, bool_or(col_no > 0 AND trim(cell) <> '') AS figures, bool_or(col_no > 0 AND row_no < 15 AND regexp_matches(cell, '^20\\d\\d$')) AS dated FROM n GROUP BY ALL),
m AS (SELECT kind, bool_or(dated) AS dated, bool_or(figures AND contains(label, chr(10))) AS merged, count(*) FILTER (row_no > 0 AND figures) AS n, count(*) FILTER (row_no > 0 AND figures AND trim(label) = '') AS bare FROM r GROUP BY ALL)
SELECT doc_id, page_number, CASE WHEN dated AND NOT (merged OR (n >= 4 AND bare * 2 > n)) THEN 'native' WHEN dated AND placed = 2 THEN 'positional' WHEN dated THEN 'native' WHEN placed > 0 THEN 'positional' WHEN m.kind IS NOT NULL THEN 'native' ELSE 'text' END AS method FROM k LEFT JOIN m USING (kind)""",
)

_add(
    "page_lines",
    lambda spark, sf_dir: tables.page_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id", (F.col("doc_id") % 9).cast("int").alias("page_number"), F.replace("text", F.lit(" de "), F.lit("  \t ")).alias("text")))
    .groupBy("doc_id", "table_no", "row_no").agg(F.count("*").alias("n_cells"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda c: c["cell"]), "|").cast("binary")).alias("cells")),
    """WITH t AS (SELECT doc_id, (doc_id % 9)::INTEGER AS table_no, unnest(regexp_split_to_array(replace(text, ' de ', '  ' || chr(9) || ' '), '\\r\\n|[\\n\\r\\x0B\\x0C\\x{85}\\x{2028}\\x{2029}]')) AS line, generate_subscripts(regexp_split_to_array(replace(text, ' de ', '  ' || chr(9) || ' '), '\\r\\n|[\\n\\r\\x0B\\x0C\\x{85}\\x{2028}\\x{2029}]'), 1) AS i FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS row_no, regexp_split_to_array(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\t+| {2,}') AS parts FROM t WHERE trim(line, ' ') <> '')
SELECT doc_id, table_no, row_no::INTEGER AS row_no, len(parts) AS n_cells, md5(array_to_string(parts, '|')) AS cells FROM r""",
)
