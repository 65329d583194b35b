"""From the pages of reports and their tables to facts, warnings and one statement of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .pages import statement_ranges
from .positional import PAGE, positional_cells
from .tables import assemble, choose_scan, conflicting_pairs, page_lines, statement_slots, table_scopes

#: So many characters of a page say what unit its tables are in.
CONTEXT = 1500
SLOTS = ("balance_sheet", "income_statement", "cash_flow")


def page_tables(native: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, method, table_no, row_no, col_no, cell): the tables of every page, by the scan that fits it.

    native: (doc_id, page_number, table_no, row_no, col_no, cell) of drawn tables; words: boxes as for positional_cells();
    pages: (doc_id, page_number, text).  A page without either is cut at tabs and wide spaces.
    """
    one = ["table_no", "row_no", "col_no", "cell"]
    placed = positional_cells(words).withColumn("table_no", F.lit(0)).select(*PAGE, *one)
    lines = page_lines(pages).select("doc_id", F.col("table_no").alias("page_number"), F.lit(0).alias("table_no"), "row_no", "col_no", "cell")
    scans = {name: kept(df.select(*PAGE, *one), f"scan-{name}") for name, df in (("native", native), ("positional", placed), ("text", lines))}
    chosen = kept(choose_scan(*scans.values()), "scan-chosen")
    parts = [df.join(chosen.where(F.col("method") == name), PAGE).select(*PAGE, "method", *one) for name, df in scans.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _statement_cells(spans: DataFrame, pages: DataFrame, cells: DataFrame) -> DataFrame:
    """The tables of every range of pages, numbered in the order of pages, with what their page says at its beginning.

    A range becomes its pages, so ranges and tables meet in an equi join by page; ``doc_id`` names document and range.
    """
    on_page = spans.select("doc_id", "span", "statement_type", F.explode(F.concat(F.array("anchor_page"), "continuation_pages")).alias("page_number"))
    context = pages.select(*PAGE, F.substring(F.coalesce("text", F.lit("")), 1, CONTEXT).alias("context"))
    met = cells.join(on_page, PAGE).join(context, PAGE)
    order = Window.partitionBy("doc_id", "span").orderBy("page_number", "table_no")
    return met.select(
        F.concat_ws(":", "doc_id", "span").alias("doc_id"), (F.dense_rank().over(order) - 1).alias("table_no"), F.col("page_number").alias("source_page"), "method", "context", "row_no", "col_no", "cell", "statement_type"
    )


def extract(pages: DataFrame, cells: DataFrame, recognised: DataFrame | None = None) -> dict[str, DataFrame]:
    """facts, warnings, statements and reports of documents.

    pages: (doc_id, page_number, text); cells: (doc_id, page_number, method, table_no, row_no, col_no, cell), a page's
    tables in their order, as page_tables() gives them; recognised: (doc_id, page_number) of pages whose text was
    recognised from a picture, whose facts are of low confidence.

    Ranges of pages that hold a statement are found first.  Its tables are read once for each scope that their headers name
    (once without scope if none does).  The best scope of a kind fills its slot (consolidated, unknown, parent; the
    earlier of equals), all others stay as alternatives.

    * facts: doc_id, span (number of the range), scope, slot and the columns of tables.assemble()
    * warnings: doc_id, span, scope, warning, detail (page, metric or kind), n
    * statements: doc_id, span, statement_type, scope, slot, anchor_page, end_page, n_facts
    * reports: doc_id, currency (of the main statements, if they agree), n_statements, n_facts
    """
    if recognised is not None:
        cells = cells.join(recognised.select(*PAGE).distinct().withColumn("_seen", F.lit(True)), PAGE, "left").withColumn("method", F.when(F.col("_seen"), "local_ocr").otherwise(F.col("method"))).drop("_seen")
    by_place = Window.partitionBy("doc_id").orderBy("anchor_page")
    spans = kept(statement_ranges(pages).withColumn("span", F.row_number().over(by_place)).withColumn("key", F.concat_ws(":", "doc_id", "span")), "spans")
    read = kept(_statement_cells(spans, pages, cells), "span-cells")
    scopes = table_scopes(read.withColumn("wanted", F.lit(""))).select(F.col("doc_id").alias("key"), "scopes")
    wanted = F.explode(F.coalesce("scopes", F.array(F.lit("")))).alias("wanted")
    statements = spans.join(scopes, "key", "left").select("doc_id", "span", "key", "statement_type", F.col("scope").alias("span_scope"), "anchor_page", "end_page", wanted)
    statements = statements.withColumn("scope", F.when(F.col("wanted") != "", F.col("wanted")).otherwise(F.col("span_scope"))).withColumn("statement_id", F.concat_ws(":", "key", "wanted"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("span", "wanted"))
    statements = kept(statement_slots(statements.withColumn("seq", seq)), "statements")
    named = statements.select("key", F.col("wanted").alias("wanted"), "statement_id")
    typed = read.join(named, F.col("doc_id") == F.col("key")).withColumn("doc_id", F.col("statement_id")).drop("key", "statement_id")
    raw, told = assemble(kept(typed, "statement-cells"))
    place = statements.select(F.col("statement_id").alias("_id"), F.col("doc_id").alias("_doc"), "span", F.col("scope").alias("_scope"), "slot")
    facts = raw.join(place, F.col("doc_id") == F.col("_id")).withColumns({"doc_id": F.col("_doc"), "scope": F.col("_scope")}).drop("_id", "_doc", "_scope")
    facts = kept(facts, "extracted")

    page_of = kept(typed.groupBy("doc_id", "table_no").agg(F.min("source_page").alias("page")), "table-pages")
    on_table = told.join(page_of, ["doc_id", "table_no"]).groupBy("doc_id", "warning", F.col("page").cast("string").alias("detail")).agg(F.count("*").alias("n"))
    on_table = on_table.join(place, F.col("doc_id") == F.col("_id")).select(F.col("_doc").alias("doc_id"), "span", F.col("_scope").alias("scope"), "warning", "detail", "n")
    clash = conflicting_pairs(facts.withColumn("scope", F.concat_ws(":", "span", "scope")))
    clash = clash.groupBy("doc_id", F.split("scope", ":")[0].cast("int").alias("span"), F.split("scope", ":")[1].alias("scope"), F.concat_ws(" ", "canonical_name", "year").alias("detail")).agg(F.count("*").alias("n"))
    clash = clash.select("doc_id", "span", "scope", F.lit("CONFLICT").alias("warning"), "detail", "n")
    counts = facts.groupBy("doc_id", "span", "scope").agg(F.count("*").alias("n_facts"))
    counted = statements.join(counts, ["doc_id", "span", "scope"], "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))
    without = counted.where("n_facts = 0").select("doc_id", "span", "scope", F.lit("NO_ROWS").alias("warning"), F.col("statement_type").alias("detail"), F.lit(1).cast("long").alias("n"))
    documents = pages.groupBy("doc_id").agg(F.bool_or(F.coalesce("text", F.lit("")).contains("�")).alias("garbled"))
    kinds = statements.groupBy("doc_id").agg(F.collect_set("statement_type").alias("kinds"))
    known = documents.join(kinds, "doc_id", "left")
    whole = lambda rows, warning, detail: rows.select("doc_id", F.lit(None).cast("int").alias("span"), F.lit(None).cast("string").alias("scope"), F.lit(warning).alias("warning"), detail.alias("detail"), F.lit(1).cast("long").alias("n"))
    none = F.lit(None).cast("string")
    missing = known.where("kinds is not null").select("doc_id", F.explode(F.array_except(F.array(*map(F.lit, SLOTS)), "kinds")).alias("kind"))
    warnings = on_table.unionByName(clash).unionByName(without).unionByName(whole(known.where("garbled"), "GARBLED", none)).unionByName(whole(known.where("kinds is null"), "NO_RANGES", none))
    warnings = warnings.unionByName(whole(missing, "MISSING", F.col("kind")))
    if recognised is not None:
        warnings = warnings.unionByName(whole(recognised.select("doc_id").distinct(), "RECOGNISED", none))
    units = facts.where("slot = 'main' and currency <> ''").groupBy("doc_id").agg(F.collect_set("currency").alias("units"))
    told_of = counted.groupBy("doc_id").agg(F.count("*").alias("n_statements"), F.sum("n_facts").alias("n_facts"))
    reports = documents.select("doc_id").join(told_of, "doc_id", "left").join(units, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    reports = reports.select("doc_id", F.when(F.size("units") == 1, F.get("units", F.lit(0))).otherwise("").alias("currency"), zero("n_statements"), zero("n_facts"))
    return {"facts": facts, "warnings": warnings, "statements": counted.select("doc_id", "span", "statement_type", "scope", "slot", "anchor_page", "end_page", "n_facts"), "reports": reports}
