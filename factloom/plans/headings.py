"""Headings and page ranges of statements as queries, with the DuckDB SQL of each.

The SQL takes another way than the operators: a heading's line is cut out of the page around its first place, and ranges
are walked page by page.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pages as page_ops
from .catalog import _PAGES_SQL, BODIES, TITLES, _add, _content_sql, _pick, _report_pages, _sql_list

_HEADINGS = ", ".join(
    f"({i * 100 + j}, '{st}', '{h}')" for i, (st, names) in enumerate(page_ops.HEADINGS.items()) for j, h in enumerate(names)
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12288)"
_MARKS = "' ' || chr(9) || chr(10) || chr(13) || '、，,.。;；:：-—'"


def _replaced(text: str, *patterns: str) -> str:
    """SQL that removes each pattern in turn."""
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return text


_PREFIX = _replaced("substr(bare, 1, lead_n)", r"^(合并|母公司(的)?)\s*", r"^(?i:Consolidated|Company)\s+", r"^[一二三四五六七八九十\d]+[、．.\s]*")
_SUFFIX = _replaced("substr(bare, lead_n + found_n + 1)", r"(20[12]\d|19\d\d)\s*(年|财年)?", r"[（(]\s*续\s*[）)]", r"(?i)\bcontinued\b")


def _headings_sql(pages: str) -> str:
    """Tables hd ... best: the heading of each page that has one, after other tables of a WITH."""
    return rf""", hd(ord, kind, name) AS (VALUES {_HEADINGS}),
top_of AS (SELECT doc_id, page_number, greatest(floor(length(text) * 0.4)::INTEGER, 300) AS top_len,
           substr(text, 1, greatest(floor(length(text) * 0.4)::INTEGER, 300)) AS top FROM {pages}),
fair AS (SELECT * FROM top_of WHERE NOT regexp_matches(substr(trim(regexp_replace(top, '\s+', ' ', 'g')), 1, 200), '(?i)目\s*录|Table\s+of\s+Contents|CONTENTS|Index')
         AND len(regexp_extract_all(top, '\.{{4,}}|-{{4,}}')) <= 2),
whole AS (SELECT * FROM (SELECT *, instr(lower(top), lower(name)) AS o FROM fair, hd) WHERE o > 0),
line_of AS (SELECT * FROM (SELECT *, instr(lower(line), lower(name)) AS o FROM (SELECT *, unnest(string_split(top, chr(10))) AS line FROM fair) x, hd) WHERE o > 0),
spots AS (
    SELECT doc_id, page_number, top_len, ord, kind, TRUE AS first, o - 1 AS off, string_split(substr(top, 1, o - 1), chr(10))[-1] AS lead,
           substr(top, o, length(name)) AS found, string_split(substr(top, o + length(name)), chr(10))[1] AS rest FROM whole
    UNION ALL
    SELECT doc_id, page_number, top_len, ord, kind, FALSE, NULL, substr(line, 1, o - 1), substr(line, o, length(name)), substr(line, o + length(name)) FROM line_of
),
bared AS (SELECT *, lead || found || rest AS line, trim(lead || found || rest, {_BLANKS}) AS bare, length(lead) AS lead_n, length(found) AS found_n FROM spots),
mixed AS (SELECT line FROM (SELECT DISTINCT line, bare FROM bared) b JOIN hd ON contains(lower(b.bare), lower(hd.name)) GROUP BY line HAVING count(DISTINCT kind) > 1),
judged AS (
    SELECT *, line NOT IN (SELECT line FROM mixed)
           AND NOT regexp_matches(bare, '(?i)包括|详见|参见|参照|includes?\s+the\s+|shown?\s+in|discussed?\s+(in|below|above)|see\s+(Note|below|above)|refer\s+to')
           AND trim({_PREFIX}, {_BLANKS}) = '' AND trim({_SUFFIX}, {_MARKS}) = '' AS ok FROM bared
),
listed AS (SELECT doc_id, page_number FROM judged WHERE NOT first AND ok GROUP BY ALL HAVING count(DISTINCT kind) > 1),
best AS (
    SELECT doc_id, page_number, kind AS statement_type, found AS heading, round(greatest(0.7, least(1.0, 1 - off::DOUBLE / top_len * 0.3)), 3)::DOUBLE AS score,
           CASE WHEN regexp_matches(line, '(?i)合并|Consolidated\s+(Balance\s+Sheets?|Income\s+Statements?|Statements?\s+of\s+(Operations|Financial\s+Position|Cash\s+Flows|Profit\s+or\s+Loss|Comprehensive\s+Income))') THEN 'consolidated'
                WHEN regexp_matches(line, '(?i)母公司|Company\s+(Balance\s+Sheet|Income\s+Statement|Statement\s+of\s+(Financial\s+Position|Cash\s+Flows|Profit\s+or\s+Loss|Comprehensive\s+Income))') THEN 'parent' ELSE 'unknown' END AS scope
    FROM judged WHERE first AND ok AND (doc_id, page_number) NOT IN (SELECT (doc_id, page_number) FROM listed)
    QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY off, ord) = 1
)"""


_add(
    "heading_score",
    lambda spark, sf_dir: page_ops.headings(_report_pages(spark, sf_dir)).drop("text"),
    f"{_PAGES_SQL}{_headings_sql('pages_of')}\nSELECT doc_id, page_number, statement_type, heading, score, scope FROM pages_of LEFT JOIN best USING (doc_id, page_number)",
)

_COMBINED = r"\s*((19|20)\d{2}\s*年\s*(度|\d{1,2}\s*月\s*\d{1,2}\s*日)?\s*)?合并及(母)?公司(资产负债表|利润表|现金流量表|财务状况表)([（(]续[）)])?\s*"
_OF_KIND = "CASE a.kind " + " ".join(
    f"WHEN '{st}' THEN (SELECT count(DISTINCT metric) FROM al WHERE st = '{st}' AND contains(p.flat, k))" for st in page_ops.HEADINGS
) + " END"


def _ranges_sql(pages: str) -> str:
    """Ranges walked page by page from each anchor, then neighbours of one statement and scope put together."""
    return rf""", plain AS (SELECT doc_id, page_number, array_to_string([CASE WHEN regexp_full_match(x, '{_COMBINED}') THEN regexp_extract(x, '{_COMBINED}', 5) ELSE x END FOR x IN string_split(text, chr(10))], chr(10)) AS text FROM {pages})
{_content_sql('plain')}{_headings_sql('plain')},
told AS (SELECT h.*, b.statement_type AS kind, b.scope, b.statement_type IS NOT NULL AND CASE WHEN s.listed THEN s.score * 0.3 ELSE s.score END >= 0.3 AS anchor,
         list_distinct(regexp_extract_all(h.text, '(20[12]\d|19\d\d)')) AS years
         FROM h JOIN s USING (doc_id, page_number) LEFT JOIN best b USING (doc_id, page_number)),
walk(doc_id, start, kind, scope, years, page) AS (
    SELECT doc_id, page_number, kind, scope, years, page_number FROM told WHERE anchor
    UNION ALL
    SELECT a.doc_id, a.start, a.kind, a.scope, a.years, p.page_number FROM walk a JOIN told p ON p.doc_id = a.doc_id AND p.page_number = a.page + 1
    WHERE p.page_number <= a.start + 8 AND NOT p.anchor AND (p.kind IS NULL OR p.kind = a.kind)
      AND (p.hits >= 3)::INTEGER + CASE WHEN regexp_matches(p.text, '(?i)续|Continued|Cont''d') THEN 2 ELSE 0 END
          + (len([y FOR y IN a.years IF contains(p.text, y)]) >= 2)::INTEGER + ({_OF_KIND} >= 5)::INTEGER + (p.n >= 10)::INTEGER >= 3
),
own AS (SELECT doc_id, start, any_value(kind) AS kind, any_value(scope) AS scope, max(page) AS last FROM walk GROUP BY doc_id, start),
parts AS (SELECT *, sum((coalesce(before + 1 <> start OR k <> kind OR sc <> scope, TRUE))::INTEGER) OVER (PARTITION BY doc_id ORDER BY start) AS part FROM
    (SELECT *, lag(last) OVER w AS before, lag(kind) OVER w AS k, lag(scope) OVER w AS sc FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY start))),
spans AS (SELECT doc_id, kind, scope, min(start) AS start, min_by(last, start) AS own_last, max(last) AS last, count(*) AS n FROM parts GROUP BY doc_id, part, kind, scope)
SELECT doc_id, kind AS statement_type, scope, start AS anchor_page, array_to_string(range(start + 1, last + 1), ',') AS continuation_pages, last AS end_page, CASE WHEN own_last > start THEN 'medium' ELSE 'high' END AS confidence,
       CASE WHEN own_last > start THEN 'anchor ' || start || ', pages ' || (start + 1) || ' to ' || own_last || ' follow with 3 signals or more' ELSE 'single page ' || start END
       || CASE WHEN n > 1 THEN '; heading repeated ' || (n - 1) || ' times' ELSE '' END AS evidence FROM spans"""


def _ranges(pages):
    return page_ops.statement_ranges(pages).withColumn("continuation_pages", F.array_join(F.transform("continuation_pages", lambda p: p.cast("string")), ","))


_add("statement_ranges", lambda spark, sf_dir: _ranges(_report_pages(spark, sf_dir)), _PAGES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _ranges_sql("pages_of"))


def _long_reports(spark, sf_dir: str):
    """Eight conversations read as one long report: headings stand up to fifteen pages apart, each 17th page is missing."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") / 8).cast("long").alias("doc_id"), "conv_id", "turn", "text")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("conv_id", "turn", "text"))
    placed = turns.select("doc_id", n.alias("n"), "text")
    title = F.when(F.col("n") % (3 + F.col("doc_id") % 4 * 4) == 1, _pick(TITLES, f"(doc_id * 7 + n) % {len(TITLES)}")).otherwise(F.lit("续表"))
    body = F.when(F.col("n") % 29 == 0, F.concat(F.lit("\n"), "text")).otherwise(_pick(BODIES, f"if(doc_id % 3 = 0, 0, (doc_id + n div (2 + doc_id % 11)) % {len(BODIES)})"))
    return placed.select("doc_id", (F.col("n") + F.floor(F.col("n") / 17)).cast("int").alias("page_number"), F.concat(title, body).alias("text"))


_LONG_SQL = f"""WITH RECURSIVE placed AS (SELECT conv_id // 8 AS doc_id, row_number() OVER (PARTITION BY conv_id // 8 ORDER BY conv_id, turn, text) AS n, text FROM conversations),
pages_of AS (SELECT doc_id, (n + n // 17)::INTEGER AS page_number, CASE WHEN n % (3 + doc_id % 4 * 4) = 1 THEN ({_sql_list(TITLES)})[((doc_id * 7 + n) % {len(TITLES)} + 1)::INTEGER] ELSE '续表' END
    || CASE WHEN n % 29 = 0 THEN chr(10) || text ELSE ({_sql_list(BODIES)})[(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id + n // (2 + doc_id % 11)) % {len(BODIES)} END + 1)::INTEGER] END AS text FROM placed)"""
_add("long_report_ranges", lambda spark, sf_dir: _ranges(_long_reports(spark, sf_dir)), _LONG_SQL + _ranges_sql("pages_of"))
