"""Queries over whole reports: checks, evidence and citations, views; with the DuckDB SQL of each."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import comparison, evidence, inputs, metrics, tables, validation, views
from ..sources.scratch import kept
from .catalog import _BASE, _POINTS, ORACLES, _add, _points, _sql_list, facts

_METRICS = f"{_BASE},\n{metrics.METRICS_SQL.strip()}"
_AND_BALANCE = f"{_METRICS},\n{validation.BALANCE_SQL.strip()}"
_CHECKS = f"""checks AS (
    SELECT doc_id, scope, 'balance_sheet_equation' AS rule, 'balance_sheet' AS item, year, period_type, start_date, end_date, is_restated, status, reason FROM balance
    UNION ALL
    SELECT r.doc_id, r.scope, 'statement_coverage', s.st, NULL, NULL, NULL, NULL, NULL, 'skipped', 'MISSING_STATEMENT' FROM (SELECT DISTINCT doc_id, scope FROM facts) r
    CROSS JOIN (VALUES ('income_statement'), ('balance_sheet'), ('cash_flow')) s(st) WHERE NOT EXISTS (SELECT 1 FROM facts h WHERE h.doc_id = r.doc_id AND h.scope = r.scope AND h.statement_type = s.st)
    UNION ALL
    SELECT doc_id, scope, 'input_quality', canonical_name, year, period_type, start_date, end_date, is_restated, CASE WHEN reason IN ('CONFLICT', 'NON_FINITE') THEN 'failed' ELSE 'skipped' END, reason FROM selected WHERE reason <> ''
)"""
_LABEL = "CASE WHEN year IS NULL THEN '' ELSE year || ' / ' || period_type || CASE WHEN coalesce(end_date, '') = '' THEN '' ELSE ' / ' || end_date END || CASE WHEN is_restated THEN ' / 重述' ELSE ' / 原列' END END"

_add("run_validations", lambda spark, sf_dir: validation.run_all(facts(spark, sf_dir)), f"{_AND_BALANCE},\n{_CHECKS}\nSELECT *, {_LABEL} AS period_label FROM checks")
_add(
    "check_counts",
    lambda spark, sf_dir: validation.run_all(facts(spark, sf_dir)).groupBy("doc_id", "scope").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")]),
    f"{_AND_BALANCE},\n{_CHECKS}\nSELECT doc_id, scope, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM checks GROUP BY ALL",
)
_add(
    "fixed_tolerances",
    lambda spark, sf_dir: facts(spark, sf_dir).groupBy("doc_id").agg(F.max("multiplier").alias("multiplier")).select("doc_id", validation.fixed_tolerance(F.col("multiplier")).alias("tolerance")),
    f"{_BASE}\nSELECT doc_id, 1.5 * max(multiplier)::DOUBLE AS tolerance FROM facts GROUP BY ALL",
)


def _pages(spark, sf_dir: str):
    """Documents read as pages 3, 4 ... of 40 reports."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(1 + doc_id % 40 as int) as doc_id", "cast(doc_id div 40 + 3 as int) as page_number", "text")


_PAGES_SQL = "pages_of AS (SELECT (1 + doc_id % 40)::INTEGER AS doc_id, (doc_id // 40 + 3)::INTEGER AS page_number, text FROM documents)"
#: Inputs of each metric: metric, input, statement, years back.
_INPUTS = (
    ("net_margin", "net_income", "income_statement", 0), ("net_margin", "revenue", "income_statement", 0), ("operating_margin", "operating_profit", "income_statement", 0), ("operating_margin", "revenue", "income_statement", 0),
    ("revenue_growth", "revenue", "income_statement", 0), ("revenue_growth", "revenue", "income_statement", 1), ("net_income_growth", "net_income", "income_statement", 0), ("net_income_growth", "net_income", "income_statement", 1),
    ("gross_margin", "revenue", "income_statement", 0), ("gross_margin", "gross_profit", "income_statement", 0), ("gross_margin", "cost_of_revenue", "income_statement", 0),
    ("ocf_margin", "operating_cash_flow", "cash_flow", 0), ("ocf_margin", "revenue", "income_statement", 0), ("debt_to_assets", "total_liabilities", "balance_sheet", 0), ("debt_to_assets", "total_assets", "balance_sheet", 0),
    ("free_cash_flow", "operating_cash_flow", "cash_flow", 0), ("free_cash_flow", "capital_expenditure", "cash_flow", 0),
)
_SAME = "k.period_type IS NOT DISTINCT FROM {0}.period_type AND k.start_date IS NOT DISTINCT FROM {0}.start_date AND k.end_date IS NOT DISTINCT FROM {0}.end_date AND k.is_restated IS NOT DISTINCT FROM {0}.is_restated"
_FISCAL = "{0}.period_type = {1}.period_type AND substr(coalesce({0}.start_date, ''), 5) = substr(coalesce({1}.start_date, ''), 5) AND substr(coalesce({0}.end_date, ''), 5) = substr(coalesce({1}.end_date, ''), 5)"
#: Pages of the figures behind each check and metric; a base year counts only if it is unique, costs only without a gross profit.
_KEY_PAGES = "key_pages AS (SELECT doc_id, scope, statement_type, canonical_name, year, period_type, start_date, end_date, is_restated, list(DISTINCT source_page) AS ps FROM facts WHERE canonical_name IS NOT NULL GROUP BY ALL)"
_CHECK_PAGES = f"""check_pages AS (SELECT c.*, coalesce((SELECT list_sort(list_distinct(flatten(list(k.ps)))) FROM key_pages k WHERE k.doc_id = c.doc_id AND k.scope = c.scope AND k.year = c.year AND {_SAME.format('c')}
    AND ((c.rule = 'balance_sheet_equation' AND k.canonical_name IN ('total_assets', 'total_liabilities', 'total_equity')) OR (c.rule = 'input_quality' AND k.canonical_name = c.item))), []) AS pages FROM checks c)"""
_CITED = f"""{_KEY_PAGES},
uses(metric, input, statement, back) AS (VALUES {", ".join(map(str, _INPUTS))}),
bases AS (SELECT doc_id, scope, year, period_type, substr(coalesce(start_date, ''), 5) AS s, substr(coalesce(end_date, ''), 5) AS e FROM (SELECT DISTINCT doc_id, scope, year, period_type, start_date, end_date, is_restated FROM facts WHERE statement_type = 'income_statement') GROUP BY ALL HAVING count(*) = 1),
used AS (SELECT m.doc_id, m.scope, m.metric, m.year, m.period_type, m.start_date, m.end_date, m.is_restated, u.input, k.ps FROM metrics m JOIN uses u USING (metric) JOIN key_pages k ON k.doc_id = m.doc_id AND k.scope = m.scope AND k.canonical_name = u.input AND k.statement_type = u.statement AND k.year = m.year - u.back
    AND CASE WHEN u.back = 0 THEN {_SAME.format('m')} ELSE {_FISCAL.format('k', 'm')} AND EXISTS (SELECT 1 FROM bases b WHERE b.doc_id = m.doc_id AND b.scope = m.scope AND b.year = k.year AND b.period_type = k.period_type AND b.s = substr(coalesce(k.start_date, ''), 5) AND b.e = substr(coalesce(k.end_date, ''), 5)) END),
metric_pages AS (SELECT m.*, coalesce((SELECT list_sort(list_distinct(flatten(list(k.ps)))) FROM used k WHERE k.doc_id = m.doc_id AND k.scope = m.scope AND k.metric = m.metric AND k.year = m.year AND {_SAME.format('m')}
    AND NOT (m.metric = 'gross_margin' AND k.input = 'cost_of_revenue' AND EXISTS (SELECT 1 FROM used g WHERE g.doc_id = m.doc_id AND g.scope = m.scope AND g.metric = 'gross_margin' AND g.input = 'gross_profit' AND g.year = m.year AND g.period_type IS NOT DISTINCT FROM m.period_type AND g.end_date IS NOT DISTINCT FROM m.end_date AND g.is_restated = m.is_restated))), []) AS pages FROM metrics m),
{_CHECK_PAGES}"""
_VALUES_SQL = """vals AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, scope ORDER BY CASE statement_type WHEN 'balance_sheet' THEN 0 WHEN 'income_statement' THEN 1 ELSE 2 END, metric_ordinal, year, is_restated, raw_value, multiplier) AS n,
           count(*) OVER (PARTITION BY doc_id, scope) AS total FROM facts WHERE canonical_name IS NOT NULL
), ents AS (
    SELECT doc_id, scope, 'R' || n AS id, 'reported_value' AS kind, canonical_name AS name, original_label AS label, year, raw_value AS value, currency AS unit, '' AS status, '' AS reason, [source_page] AS pages, NULL AS text FROM vals WHERE n <= 160
    UNION ALL
    SELECT doc_id, scope, 'M' || row_number() OVER (PARTITION BY doc_id, scope ORDER BY year DESC, metric, period_type, is_restated), 'computed_metric', metric, '', year, coalesce(format('{:.6f}', value), ''), unit, '', reason, pages, NULL FROM metric_pages
    UNION ALL
    SELECT doc_id, scope, 'C' || row_number() OVER (PARTITION BY doc_id, scope ORDER BY rule, coalesce(year, 0), item, period_type NULLS FIRST, is_restated NULLS FIRST), 'validation', rule, item, year, '', '', status, reason, pages, NULL FROM check_pages
), cited AS (SELECT doc_id, scope, page FROM (SELECT DISTINCT doc_id, scope, unnest(pages) AS page FROM ents) WHERE page > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, scope ORDER BY page) <= 8),
entries AS (
    SELECT * FROM ents UNION ALL
    SELECT c.doc_id, c.scope, 'P' || page, 'source_excerpt', '', '', NULL, '', '', CASE WHEN length(p.text) > 2000 THEN 'truncated' ELSE '' END, '', [page], substr(p.text, 1, 2000)
    FROM cited c JOIN pages_of p ON p.doc_id = c.doc_id AND p.page_number = c.page
)"""
_EVIDENCE = f"{_AND_BALANCE},\n{_CHECKS},\n{_PAGES_SQL},\n{_CITED},\n{_VALUES_SQL}"


def _entries(spark, sf_dir: str):
    return evidence.build_evidence(facts(spark, sf_dir), _pages(spark, sf_dir))


_joined = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",")
_add(
    "reported_evidence",
    lambda spark, sf_dir: evidence.reported_values(facts(spark, sf_dir)).withColumn("pages", _joined("pages")).drop("kind", "status", "reason"),
    f"{_BASE},\n{_VALUES_SQL.split(', ents AS')[0]}\nSELECT doc_id, scope, 'R' || n AS id, canonical_name AS name, original_label AS label, year, raw_value AS value, currency AS unit, source_page::VARCHAR AS pages, greatest(0, total - 160) AS omitted FROM vals WHERE n <= 160",
)
_add(
    "build_evidence",
    lambda spark, sf_dir: _entries(spark, sf_dir).withColumn("pages", _joined("pages")).withColumn("text", F.md5(F.col("text").cast("binary"))),
    f"{_EVIDENCE}\nSELECT doc_id, scope, id, kind, name, label, year, value, unit, status, reason, array_to_string(pages, ',') AS pages, md5(text) AS text FROM entries",
)
_JSON = "'{{\"doc_id\":' || doc_id || ',\"scope\":\"' || scope || '\",\"evidence\":' || to_json(list(struct_pack({fields}) ORDER BY regexp_replace(id, '\\d+$', ''), regexp_extract(id, '(\\d+)$', 1)::INTEGER)) || '}}'"
_FIELDS = ", ".join(("id", "kind", "name", "label", "year", "value", "unit", "status", "reason", "pages", "text"))
_add(
    "evidence_packages",
    lambda spark, sf_dir: evidence.packages(_entries(spark, sf_dir), inputs.REPORT).drop("json"),
    f"{_EVIDENCE}\nSELECT doc_id, scope, n_entries, length(json) AS chars, length(json) <= 120000 AS fits, sha256(json) AS key FROM (SELECT doc_id, scope, count(*)::INTEGER AS n_entries, {_JSON.format(fields=_FIELDS)} AS json FROM entries GROUP BY doc_id, scope)",
)
def _long_facts(spark, sf_dir: str):
    """Ten reports read as one long report, their years ten apart, so that the caps on values and characters bind."""
    return facts(spark, sf_dir).withColumns({"year": (F.col("year") + F.col("doc_id") % 10 * 10).cast("int"), "doc_id": F.expr("doc_id div 10")})


def _long_sql(sql: str) -> str:
    """SQL over facts as SQL over the facts of long reports."""
    longer = "facts AS (SELECT * REPLACE (doc_id // 10 AS doc_id, (year + doc_id % 10 * 10)::INTEGER AS year) FROM short_facts)"
    selected = inputs.SELECTED_SQL.strip()
    return sql.replace("), facts AS (", "), short_facts AS (", 1).replace(selected, f"{longer},\n{selected}", 1)


_add(
    "long_reported_evidence",
    lambda spark, sf_dir: evidence.reported_values(_long_facts(spark, sf_dir)).withColumn("pages", _joined("pages")).drop("kind", "status", "reason"),
    _long_sql(ORACLES["reported_evidence"]),
)
_add(
    "long_evidence_packages",
    lambda spark, sf_dir: evidence.packages(evidence.build_evidence(_long_facts(spark, sf_dir), _pages(spark, sf_dir)), inputs.REPORT).drop("json"),
    _long_sql(ORACLES["evidence_packages"]),
)
_add(
    "long_comparison_evidence",
    lambda spark, sf_dir: evidence.comparison_evidence(_points(spark, sf_dir).withColumns({"year": (F.col("year") + F.col("pair_id") % 10 * 10).cast("int"), "pair_id": F.expr("pair_id div 10")})),
    f"""{_POINTS}, longer AS (SELECT * REPLACE (pair_id // 10 AS pair_id, (year + pair_id % 10 * 10)::INTEGER AS year) FROM points)
SELECT * EXCLUDE (n, total), 'T' || n AS id, greatest(0, total - 180) AS omitted FROM (
    SELECT pair_id, scope, canonical_name AS name, statement_type, year, status, reason, value, change, growth_percent, change_reason, currency, n_sources,
           row_number() OVER (PARTITION BY pair_id, scope ORDER BY status NOT IN ('conflict', 'incompatible'), canonical_name, year, statement_type) AS n, count(*) OVER (PARTITION BY pair_id, scope) AS total FROM longer
) WHERE n <= 180""",
)
_add("comparison_evidence", lambda spark, sf_dir: evidence.comparison_evidence(_points(spark, sf_dir)), f"""{_POINTS}
SELECT * EXCLUDE (n, total), 'T' || n AS id, greatest(0, total - 180) AS omitted FROM (
    SELECT pair_id, scope, canonical_name AS name, statement_type, year, status, reason, value, change, growth_percent, change_reason, currency, n_sources,
           row_number() OVER (PARTITION BY pair_id, scope ORDER BY status NOT IN ('conflict', 'incompatible'), canonical_name, year, statement_type) AS n, count(*) OVER (PARTITION BY pair_id, scope) AS total FROM points
) WHERE n <= 180""")
_add(
    "comparison_excerpts",
    lambda spark, sf_dir: evidence.comparison_excerpts(comparison.two_documents(facts(spark, sf_dir)), _pages(spark, sf_dir)).withColumn("text", F.md5(F.col("text").cast("binary"))),
    f"""{_POINTS},\n{_PAGES_SQL}, cited AS (SELECT doc_id AS pair_id, document_id, source_page FROM (SELECT DISTINCT doc_id, document_id, source_page FROM two) QUALIFY row_number() OVER (PARTITION BY doc_id, document_id ORDER BY source_page) <= 4)
SELECT pair_id, document_id || '_P' || page_number AS id, page_number, length(text) > 1200 AS truncated, md5(substr(text, 1, 1200)) AS text FROM cited JOIN pages_of p ON p.doc_id = pair_id AND p.page_number = source_page""",
)

#: The checks of both documents of a pair: the same SQL over their facts, each document being a report of its own.
_OF_TWO = re.sub(r"\b(facts|selected|balance|checks|key_pages|check_pages)\b", r"\1_of_two", f"facts AS (SELECT * REPLACE (doc_id || ':' || document_id AS doc_id) FROM two),\n{inputs.SELECTED_SQL.strip()},\n{validation.BALANCE_SQL.strip()},\n{_CHECKS},\n{_KEY_PAGES},\n{_CHECK_PAGES}")
_written = lambda sources: F.array_join(F.transform(sources, lambda s: F.concat_ws(":", s["document_id"], s["page"], s["raw_value"])), ";")


def _package(spark, sf_dir: str):
    values = kept(comparison.two_documents(facts(spark, sf_dir)), "two-documents")
    return evidence.comparison_package(comparison.compare_reports(values), values, _pages(spark, sf_dir))


_PACKAGE_SQL = f"""{_POINTS},\n{_PAGES_SQL},\n{_OF_TWO},
own AS (SELECT * FROM two WHERE canonical_name IS NOT NULL AND period_type IN ('annual', 'point_in_time')),
behind AS (SELECT doc_id AS pair_id, scope, statement_type, canonical_name, year, list_sort(list_distinct(list(source_page))) AS pages, string_agg(document_id || ':' || source_page || ':' || coalesce(raw_value, ''), ';' ORDER BY document_id, source_page, metric_ordinal, raw_value) AS sources FROM own GROUP BY ALL),
first_pages AS (SELECT doc_id AS pair_id, scope, document_id, source_page FROM (SELECT DISTINCT doc_id, scope, document_id, source_page FROM own) QUALIFY row_number() OVER (PARTITION BY doc_id, scope, document_id ORDER BY source_page) <= 4),
package AS (
    SELECT p.pair_id, p.scope, 'T' || n AS id, 'multi_report_comparison' AS kind, canonical_name AS name, statement_type AS label, year, format('{{:.6f}}', value) AS value, status, reason, b.pages, b.sources, NULL AS text FROM
        (SELECT *, row_number() OVER (PARTITION BY pair_id, scope ORDER BY status NOT IN ('conflict', 'incompatible'), canonical_name, year, statement_type) AS n FROM points) p JOIN behind b USING (pair_id, scope, statement_type, canonical_name, year) WHERE n <= 180
    UNION ALL SELECT split_part(doc_id, ':', 1)::INTEGER, scope, split_part(doc_id, ':', 2) || '_C' || n, 'validation', rule, item, year, NULL, status, reason, pages, array_to_string([split_part(doc_id, ':', 2) || ':' || p FOR p IN pages], ';'), NULL FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id, scope ORDER BY rule, coalesce(year, 0), item, period_type NULLS FIRST, is_restated NULLS FIRST) AS n FROM check_pages_of_two)
    UNION ALL SELECT f.pair_id, f.scope, document_id || '_P' || source_page, 'source_excerpt', '', '', NULL, NULL, CASE WHEN length(p.text) > 1200 THEN 'truncated' ELSE '' END, '', [source_page], document_id || ':' || source_page, substr(p.text, 1, 1200)
        FROM first_pages f JOIN pages_of p ON p.doc_id = f.pair_id AND p.page_number = f.source_page
)"""
_add(
    "comparison_package",
    lambda spark, sf_dir: _package(spark, sf_dir).withColumns({"pages": _joined("pages"), "sources": _written("sources"), "text": F.md5(F.col("text").cast("binary"))}),
    f"{_PACKAGE_SQL}\nSELECT * REPLACE (coalesce(array_to_string(pages, ','), '') AS pages, coalesce(sources, '') AS sources, md5(text) AS text) FROM package",
)
_add(
    "comparison_package_sizes",
    lambda spark, sf_dir: evidence.packages(_package(spark, sf_dir).drop("sources"), ["pair_id", "scope"]).select("pair_id", "scope", "n_entries", "fits"),
    f"{_PACKAGE_SQL}\nSELECT pair_id, scope, count(*)::INTEGER AS n_entries, sum(length(to_json(struct_pack(id, kind, name, label, year, value, status, reason, pages, text)))) + 100 <= 120000 AS fits FROM package GROUP BY ALL",
)

#: Answers as a model might give them: good ones and one of each fault, by the report's number.
_CLAIM = '{"topic":"t%d","kind":"fact","text":"%s","evidence_ids":[%s]}'
ANSWERS = (
    ("completed", '{"claims":[%s,%s],"limitations":["l"]}' % (_CLAIM % (1, "grew", '"R1","M1"'), _CLAIM % (2, "fell", '"C1"'))),
    ("completed", '{"claims":[%s],"limitations":[]}' % (_CLAIM % (1, "grew", '"X9"'))),
    ("completed", '{"claims":[%s],"limitations":[]}' % (_CLAIM % (1, "grew", ""))),
    ("completed", '{"claims":[%s],"limitations":[]}' % (_CLAIM % (1, "  ", '"R1"'))),
    ("incomplete", '{"claims":[%s],"limitations":[]}' % (_CLAIM % (1, "grew", '"R1"'))),
    ("completed", '{"claims":[%s],"limitations":[]}' % ",".join(_CLAIM % (i, "grew", '"R1"') for i in range(13))),
    ("completed", '{"claims":[],"limitations":[]}'),
    ("completed", '{"claims":[%s],"limitations":[]}' % (_CLAIM % (1, "grew", '"R2","R1","R2","R160"'))),
)


def _answers(spark, sf_dir: str):
    row = F.element_at(F.array(*[F.struct(F.lit(s).alias("status"), F.lit(a).alias("answer")) for s, a in ANSWERS]), (F.col("doc_id") % len(ANSWERS) + 1).cast("int"))
    return facts(spark, sf_dir).select(*inputs.REPORT).distinct().withColumn("r", row).select(*inputs.REPORT, "r.status", "r.answer")


_ANSWERS_SQL = f"""answers AS (SELECT doc_id, scope, ({_sql_list([s for s, _ in ANSWERS])})[doc_id % {len(ANSWERS)} + 1] AS status, ({_sql_list([a for _, a in ANSWERS])})[doc_id % {len(ANSWERS)} + 1] AS answer FROM (SELECT DISTINCT doc_id, scope FROM facts)),
claims AS (SELECT doc_id, scope, status, i - 1 AS claim_no, json_extract(answer, '$.claims[' || (i - 1) || ']') AS c FROM answers, range(1, 20) t(i) WHERE i <= json_array_length(answer, '$.claims')),
cites AS (SELECT doc_id, scope, claim_no, c ->> '$.topic' AS topic, j - 1 AS pos, json_extract_string(c, '$.evidence_ids[' || (j - 1) || ']') AS id FROM claims, range(1, 20) t(j) WHERE j <= json_array_length(c, '$.evidence_ids'))"""
_add("judge_analyses", lambda spark, sf_dir: evidence.judge_analyses(_answers(spark, sf_dir), _entries(spark, sf_dir), inputs.REPORT), f"""{_EVIDENCE},\n{_ANSWERS_SQL}
SELECT doc_id, scope, json_array_length(answer, '$.claims')::INTEGER AS n_claims, CASE WHEN status <> 'completed' THEN 'INCOMPLETE' WHEN json_array_length(answer, '$.claims') NOT BETWEEN 1 AND 12 THEN 'FORMAT'
    WHEN EXISTS (SELECT 1 FROM claims c WHERE c.doc_id = a.doc_id AND c.scope = a.scope AND (trim(c.c ->> '$.text') = '' OR json_array_length(c.c, '$.evidence_ids') = 0)) THEN 'EMPTY_CLAIM'
    WHEN EXISTS (SELECT 1 FROM cites c WHERE c.doc_id = a.doc_id AND c.scope = a.scope AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.doc_id = c.doc_id AND e.scope = c.scope AND e.id = c.id)) THEN 'UNKNOWN_ID' ELSE '' END AS reason
FROM answers a""")
_add(
    "claim_sources",
    lambda spark, sf_dir: evidence.claim_sources(_answers(spark, sf_dir), _entries(spark, sf_dir), inputs.REPORT).withColumn("ids", F.array_join("ids", ",")).withColumn("pages", _joined("pages")),
    f"""{_EVIDENCE},\n{_ANSWERS_SQL}, met AS (SELECT c.*, e.pages FROM cites c JOIN entries e ON e.doc_id = c.doc_id AND e.scope = c.scope AND e.id = c.id)
SELECT doc_id, scope, claim_no::INTEGER AS claim_no, topic, (SELECT string_agg(id, ',' ORDER BY pos) FROM (SELECT id, min(pos) AS pos FROM met k WHERE k.doc_id = m.doc_id AND k.scope = m.scope AND k.claim_no = m.claim_no GROUP BY id)) AS ids,
       coalesce(array_to_string(list_sort(list_distinct(flatten(list(pages)))), ','), '') AS pages FROM met m GROUP BY ALL""",
)

_TRIMMED = "regexp_replace(regexp_replace({0}, '0+$', ''), '\\.$', '')"
_EXACT = "CASE WHEN a < 0 THEN '-' ELSE '' END || format('{:,}', trunc(abs(a))::BIGINT) || regexp_replace(regexp_replace(regexp_extract(a::VARCHAR, '(\\.\\d*)$', 1), '0+$', ''), '\\.$', '')"
_add(
    "value_rows",
    lambda spark, sf_dir: views.value_rows(facts(spark, sf_dir)),
    f"""{_BASE}\nSELECT doc_id, scope, statement_type, original_label AS label, year::VARCHAR AS year, period_type, is_restated, coalesce(nullif(raw_value, ''), '—') AS raw_value, CASE WHEN currency = '' THEN '未知' ELSE currency END AS currency, value_type,
       multiplier::VARCHAR AS multiplier, CASE WHEN a IS NULL THEN '—' ELSE {_EXACT} END AS amount, source_page, coalesce(canonical_name, '未映射') AS metric, extraction_method FROM (SELECT *, value * multiplier AS a FROM facts)""",
)
_all_metrics = lambda spark, sf_dir: metrics.compute_metrics(facts(spark, sf_dir))
_add(
    "metric_rows",
    lambda spark, sf_dir: views.metric_rows(_all_metrics(spark, sf_dir)).withColumn("result", F.when(F.col("result") == "—", "—").otherwise("number")),
    f"{_METRICS}\nSELECT doc_id, scope, metric, year, period_type, is_restated, CASE WHEN value IS NULL THEN '—' ELSE 'number' END AS result, unit, CASE WHEN value IS NULL THEN 'refused' ELSE 'computed' END AS status, reason FROM metrics",
)
_INPUTS = ", ".join(f"('{m}', '{n}', {back})" for m, parts in views.INPUTS.items() for n, back in parts)
_add(
    "metric_inputs",
    lambda spark, sf_dir: views.metric_inputs(_all_metrics(spark, sf_dir), facts(spark, sf_dir)),
    f"""{_METRICS}, spec(metric, name, back) AS (VALUES {_INPUTS})
SELECT m.doc_id, m.scope, m.metric, m.year AS result_year, m.is_restated, s.name AS input, f.year AS input_year, f.original_label AS label, f.raw_value, CASE WHEN f.currency = '' THEN '未知' ELSE f.currency END AS currency, f.multiplier::VARCHAR AS multiplier, f.source_page
FROM metrics m JOIN spec s USING (metric) JOIN facts f ON f.doc_id = m.doc_id AND f.scope = m.scope AND f.canonical_name = s.name AND f.year = m.year - s.back AND (s.back = 1 OR f.is_restated = m.is_restated) WHERE m.value IS NOT NULL""",
)
_add(
    "comparison_rows",
    lambda spark, sf_dir: views.comparison_rows(_points(spark, sf_dir)).select("pair_id", "scope", "metric", "year", "currency", "status", "note", *[(F.col(c) == "—").alias(f"no_{c}") for c in ("value", "change", "growth_percent")]),
    f"""{_POINTS}\nSELECT pair_id, scope, canonical_name AS metric, year, CASE WHEN currency = '' THEN '未知' ELSE currency END AS currency, status, concat_ws('；', nullif(reason, ''), nullif(change_reason, '')) AS note,
       value IS NULL AS no_value, change IS NULL AS no_change, growth_percent IS NULL AS no_growth_percent FROM points""",
)
_add(
    "comparison_originals",
    lambda spark, sf_dir: views.comparison_originals(comparison.two_documents(facts(spark, sf_dir))),
    f"{_POINTS}\nSELECT doc_id AS pair_id, scope, canonical_name AS metric, year, document_id, source_page, original_label AS label, raw_value, CASE WHEN currency = '' THEN '未知' ELSE currency END AS currency, multiplier::VARCHAR AS multiplier, is_restated FROM two WHERE canonical_name IS NOT NULL",
)
_REPORTS = "SELECT doc_id, CASE WHEN count(DISTINCT nullif(currency, '')) = 1 THEN max(nullif(currency, '')) ELSE '' END AS currency, count(value) > 0 AS has_values, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes, bool_or(extraction_method = 'local_ocr') AS needs_review FROM facts GROUP BY ALL"
_add("report_facts", lambda spark, sf_dir: views.report_facts(facts(spark, sf_dir)), f"{_BASE}\n{_REPORTS}")
_add(
    "reviewed_reports",
    lambda spark, sf_dir: views.reviewed(views.report_facts(facts(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("doc_id"))),
    f"{_BASE}\nSELECT * FROM ({_REPORTS}) WHERE NOT needs_review OR doc_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)",
)
_add(
    "bridge_pages",
    lambda spark, sf_dir: views.bridge_pages(facts(spark, sf_dir)),
    f"{_BASE}\nSELECT doc_id, scope, year, array_to_string(list_sort(list(DISTINCT source_page)), ',') AS pages FROM facts WHERE canonical_name IN ('revenue', 'cost_of_revenue', 'gross_profit') AND source_page > 0 GROUP BY ALL",
)
_add(
    "garbled_pages",
    lambda spark, sf_dir: views.garbled_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 9 == 4, F.concat("html", F.lit("�"))).otherwise(F.col("html")).alias("text"))),
    "SELECT page_id AS doc_id, count(*) AS n_pages FROM (SELECT page_id, CASE WHEN page_id % 9 = 4 THEN html || chr(65533) ELSE html END AS text FROM pages) WHERE contains(text, chr(65533)) GROUP BY ALL",
)

#: Messages of a parser, one for every kind of guidance and some of none.
MESSAGES = (
    "No financial statement ranges detected; no data extracted.", "Missing balance_sheet.", "Missing cash_flow_statement.", "Page 3: unknown currency or unit; monetary normalization unavailable.",
    "Page 4: ambiguous/missing year columns; table skipped.", "Conflicting duplicate revenue for 2024; retained both source rows.", "OCR result", "Page 7: irregular row width", "Missing income_statement.", "Page 2: duplicate period columns",
)


def _messages(spark, sf_dir: str):
    pick = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.expr(f"event_id * 7 div 3 % {len(MESSAGES)}") + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id")).alias("doc_id"), F.col("event_id").alias("ord"), pick.alias("message"))


_MESSAGES_SQL = f"told AS (SELECT user_id AS doc_id, event_id AS ord, ({_sql_list(list(MESSAGES))})[(event_id * 7 // 3 % {len(MESSAGES)} + 1)::INTEGER] AS message FROM events)"
_add("first_warnings", lambda spark, sf_dir: views.first_warnings(_messages(spark, sf_dir)), f"WITH {_MESSAGES_SQL} SELECT doc_id, message, count(*) AS times, row_number() OVER (PARTITION BY doc_id ORDER BY min(ord), message)::INTEGER AS no FROM told GROUP BY doc_id, message")
_add(
    "warning_guidance",
    lambda spark, sf_dir: _messages(spark, sf_dir).where("ord % 5 = 0 or doc_id % 2 = 0").groupBy("doc_id").agg(F.collect_set("message").alias("w")).select("doc_id", F.array_join(T.warning_guidance(F.col("w")), ",").alias("guidance")),
    f"""WITH {_MESSAGES_SQL}, j AS (SELECT doc_id, lower(string_agg(message, chr(10))) AS m FROM told WHERE ord % 5 = 0 OR doc_id % 2 = 0 GROUP BY doc_id),
g AS (SELECT doc_id, [x FOR x IN [CASE WHEN contains(m, 'no financial statement') OR contains(m, 'no financial rows') OR contains(m, 'missing income_statement') THEN 'NO_STATEMENTS' END, CASE WHEN contains(m, 'missing balance_sheet') THEN 'NO_BALANCE_SHEET' END,
    CASE WHEN contains(m, 'missing cash_flow_statement') THEN 'NO_CASH_FLOW' END, CASE WHEN contains(m, 'unknown currency') OR contains(m, 'unknown unit') OR contains(m, 'unit; monetary') THEN 'UNKNOWN_UNIT' END,
    CASE WHEN contains(m, 'ambiguous/missing year') OR contains(m, 'duplicate period columns') THEN 'YEAR_COLUMNS' END, CASE WHEN contains(m, 'conflicting duplicate') OR contains(m, 'restatement') THEN 'DUPLICATES' END, CASE WHEN contains(m, 'ocr') THEN 'VERIFY_OCR' END] IF x IS NOT NULL] AS k FROM j)
SELECT doc_id, CASE WHEN len(k) = 0 THEN 'GENERIC' ELSE array_to_string(k, ',') END AS guidance FROM g""",
)
_FAILED = ("Password required", "file is ENCRYPTED", "cannot authenticate", "broken xref", "not a PDF", "empty document", "bad format", "out of memory", "timeout")
_add(
    "failure_kinds",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", views.failure_kind(F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in _FAILED]), (F.col("c_custkey") % len(_FAILED) + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in _FAILED[4:]]), (F.col("c_custkey") % 5 + 1).cast("int")))).alias("kind")),
    f"SELECT c_custkey, CASE WHEN contains(m, 'password') OR contains(m, 'encrypted') OR contains(m, 'authenticate') THEN 'PASSWORD' WHEN contains(m, 'empty') OR contains(m, 'broken') OR contains(m, 'invalid') OR contains(m, 'not a pdf') OR contains(m, 'format') THEN 'UNREADABLE' ELSE 'UNKNOWN' END AS kind "
    f"FROM (SELECT c_custkey, lower(({_sql_list(list(_FAILED))})[(c_custkey % {len(_FAILED)} + 1)::INTEGER] || ' ' || ({_sql_list(list(_FAILED[4:]))})[(c_custkey % 5 + 1)::INTEGER]) AS m FROM customer)",
)
_NAMED = "reason"
for _field, _label in views.FIELD_NAMES:
    _NAMED = f"regexp_replace({_NAMED}, '\\b{_field}\\b', '{_label}', 'g')"
_add(
    "named_reasons",
    lambda spark, sf_dir: validation.input_quality(facts(spark, sf_dir)).select("doc_id", "scope", "year", "is_restated", "canonical_name", views.named_reason(F.concat_ws(" ", "reason", "canonical_name", F.lit("total_assets_x revenue"))).alias("message")),
    f"{_BASE}, r AS (SELECT doc_id, scope, year, is_restated, canonical_name, reason || ' ' || canonical_name || ' total_assets_x revenue' AS reason FROM selected WHERE reason <> '') SELECT doc_id, scope, year, is_restated, canonical_name, {_NAMED} AS message FROM r",
)
_add(
    "comparison_preconditions",
    lambda spark, sf_dir: comparison.check_sources(_pairs(spark, sf_dir)),
    """WITH s AS (SELECT s_suppkey // 2 AS pair_id, CASE WHEN s_suppkey % 11 = 3 THEN s_suppkey - s_suppkey % 2 ELSE s_suppkey END AS document_id, CASE WHEN s_suppkey // 2 % 5 = 2 THEN 'same' WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS h,
        CASE s_suppkey // 2 % 4 WHEN 1 THEN ' Acme ' WHEN 2 THEN '' WHEN 3 THEN 'Acme' ELSE 'C' || s_nationkey % 3 END AS company, s_suppkey // 2 % 9 <> 4 AS ok FROM supplier)
SELECT pair_id, CASE WHEN count(*) <> 2 THEN 'NOT_TWO' WHEN count(DISTINCT document_id) <> 2 THEN 'SAME_DOCUMENT' WHEN count(nullif(h, '')) = 2 AND count(DISTINCT nullif(h, '')) = 1 THEN 'SAME_CONTENT' WHEN NOT bool_and(ok) THEN 'NOT_CONFIRMED'
       WHEN count(DISTINCT nullif(trim(company), '')) > 1 THEN 'COMPANIES_DIFFER' ELSE '' END AS reason FROM s GROUP BY ALL""",
)


def _pairs(spark, sf_dir: str):
    pair = F.expr("s_suppkey div 2")
    company = F.when(pair % 4 == 1, " Acme ").when(pair % 4 == 2, "").when(pair % 4 == 3, "Acme").otherwise(F.concat(F.lit("C"), (F.col("s_nationkey") % 3).cast("string")))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        pair.alias("pair_id"), F.when(F.col("s_suppkey") % 11 == 3, F.col("s_suppkey") - F.col("s_suppkey") % 2).otherwise(F.col("s_suppkey")).alias("document_id"),
        F.when(pair % 5 == 2, "same").when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.col("s_name")).alias("content_hash"), company.alias("company_name"), (pair % 9 != 4).alias("confirmed"),
    )


_add(
    "statement_slots",
    lambda spark, sf_dir: tables.statement_slots(
        spark.read.parquet(f"{sf_dir}/orders.parquet").select(
            F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("statement_id"), F.element_at(F.array(*[F.lit(s) for s in validation.STATEMENTS]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("statement_type"),
            F.element_at(F.array(F.lit("consolidated"), F.lit("parent"), F.lit("unknown")), (F.length("o_orderpriority") % 3 + 1).cast("int")).alias("scope"), F.col("o_orderkey").alias("seq"),
        )
    ),
    f"""WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS statement_id, ({_sql_list(list(validation.STATEMENTS))})[(o_orderkey % 3 + 1)::INTEGER] AS statement_type, (['consolidated', 'parent', 'unknown'])[length(o_orderpriority) % 3 + 1] AS scope, o_orderkey AS seq FROM orders)
SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id, statement_type ORDER BY CASE scope WHEN 'consolidated' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, seq) = 1 THEN 'main' ELSE 'alternative' END AS slot FROM s""",
)

_add(
    "script_json",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.escaped_json(F.to_json(F.struct("page_id", "url", "html"), {"ignoreNullFields": "false"})).alias("json")),
    r"SELECT page_id, replace(replace(replace(to_json(struct_pack(page_id, url, html))::VARCHAR, '<', '\u003c'), '>', '\u003e'), '&', '\u0026') AS json FROM pages",
)
