"""From table grids to facts.

cells: doc_id, table_no, source_page, method, context, row_no, col_no, cell (a grid in long form; rows may be ragged),
statement_type and wanted (the scope whose columns count; empty: none), which are alike in all cells of a document.
Every step is a window or an aggregate over (document, table), so documents spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_label, column_scope, detect_period, detect_unit, label_key, strip, value_type, with_number
from ..sources.scratch import kept
from .aliases import alias_table, resolve

TABLE = ["doc_id", "table_no"]
KIND = ["statement_type", "wanted"]
_MARKER = r"(?i)^\s*(?:restated|重述|调整后|重列|原列|合并|公司|母公司|consolidated|group|company|parent)\s*$"
_NO_PERIOD = r"(?i)notes?|附注|增减|变动|change|%"
_BLANK = r"(?i)^\s*(?:—|–|-{1,3}|N/?A)?\s*$"
_NOTE_ONLY = r"^\s*(?:\d{1,3}(?:\([a-z]\))?)?\s*$"
_DECLARES = r"(?i)单位|币种|currency|RMB|USD|HKD|SGD|million|thousand"


def of_kind(cells: DataFrame, statement: str, scope: str | None = None) -> DataFrame:
    """cells that are all of one kind of statement."""
    return cells.withColumns({"statement_type": F.lit(statement), "wanted": F.lit(scope or "")})


def header_rows(cells: DataFrame) -> DataFrame:
    """(table, header_end) of tables with a header: the first row (of 15) with a period and the period or marker rows after it."""
    period = detect_period(F.col("cell"), F.col("statement_type"))
    rows = cells.where("row_no < 15").withColumn("_p", period.isNotNull()).groupBy(*TABLE, "row_no").agg(
        F.bool_or("_p").alias("dated"), F.bool_or(F.col("cell").rlike(_MARKER)).alias("marker"), F.max(F.when(F.col("col_no") == 0, F.col("cell"))).alias("label")
    )
    dated = rows.where("dated").select(F.col("label")).distinct()
    named = resolve(dated).where("metric is not null").select(F.col("label").alias("_label"))
    rows = rows.join(named, F.col("label") == F.col("_label"), "left").withColumn("named", F.col("_label").isNotNull())
    first = rows.where("dated").groupBy(*TABLE).agg(F.min("row_no").alias("first"))
    after = rows.join(first, TABLE).where("row_no >= first")
    goes_on = (F.col("dated") & ~F.col("named")) | (~F.col("dated") & F.col("marker"))
    stop = after.groupBy(*TABLE, "first").agg(F.min(F.when(~goes_on, F.col("row_no"))).alias("stop"), F.max("row_no").alias("last"))
    return stop.select(*TABLE, (F.coalesce("stop", F.col("last") + 1) - 1).alias("header_end"), "first").where("header_end >= first").select(*TABLE, "header_end")


def dated_columns(cells: DataFrame) -> DataFrame:
    """(table, kind, col_no, header_end, header, period, col_scope) of the columns whose header names one period."""
    ends = header_rows(cells)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cell"))), lambda c: c["cell"]), " ")
    heads = cells.join(ends, TABLE).where("row_no <= header_end").groupBy(*TABLE, *KIND, "col_no", "header_end").agg(text.alias("header"))
    dated = heads.where(f"col_no > 0 and not header rlike '{_NO_PERIOD}'").withColumn("period", detect_period(F.col("header"), F.col("statement_type")))
    return dated.where("period is not null").withColumn("col_scope", column_scope(F.col("header")))


def table_scopes(cells: DataFrame) -> DataFrame:
    """(doc_id, scopes): the scopes that column headers of a document's tables name, in alphabetical order."""
    named = dated_columns(cells).where("col_scope <> 'unknown'")
    return named.groupBy("doc_id").agg(F.array_sort(F.collect_set("col_scope")).alias("scopes"))


def period_columns(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, refused): the period of each year column that may be used; tables left out, with a warning or without.

    Where headers name scopes, only columns of the wanted scope are used: a table without any is left out, with a warning
    if no scope is wanted.  A table with two columns of one period is left out too.
    """
    found = dated_columns(cells)
    table = Window.partitionBy(*TABLE)
    scoped = found.withColumn("scoped", F.bool_or(F.col("col_scope") != "unknown").over(table))
    scoped = scoped.withColumn("mine", ~F.col("scoped") | (F.col("col_scope") == F.col("wanted"))).withColumn("any_mine", F.bool_or("mine").over(table))
    same = Window.partitionBy(*TABLE, "period.year", "period.period_type", "period.end_date", "period.is_restated")
    counted = scoped.where("mine").withColumn("_n", F.count("*").over(same)).withColumn("twice", F.max("_n").over(table) > 1)
    warnings = counted.where("twice").select(*TABLE).distinct().withColumn("warning", F.lit("DUPLICATE_PERIODS"))
    unscoped = scoped.where("not any_mine").select(*TABLE, F.when(F.col("wanted") == "", "SCOPE_NEEDED").alias("warning")).distinct()
    return counted.where("not twice").select(*TABLE, "col_no", "period", "header_end"), warnings.unionByName(unscoped)


def with_inheritance(cells: DataFrame, columns: DataFrame, refused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, warnings): a table without a header takes the columns of the last table before it that has the same width."""
    width = cells.groupBy(*TABLE).agg((F.max("col_no") + 1).alias("width"))
    own = columns.groupBy(*TABLE, "header_end").agg(F.collect_list(F.struct("col_no", "period")).alias("cols"))
    tables = width.join(own, TABLE, "left").join(refused.select(*TABLE).distinct().withColumn("refused", F.lit(True)), TABLE, "left").where("refused is null")
    before = Window.partitionBy("doc_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("cols").isNotNull(), F.struct("cols", "width")), ignorenulls=True).over(before)
    got = tables.withColumn("last", last)
    taken = F.col("cols").isNull() & (F.col("last.width") == F.col("width"))
    got = got.withColumn("how", F.when(F.col("cols").isNotNull(), "own").when(taken, "inherited").otherwise("none")).withColumn("cols", F.coalesce("cols", F.when(taken, F.col("last.cols"))))
    warnings = got.where("how <> 'own'").select(*TABLE, F.when(F.col("how") == "inherited", "INHERITED_COLUMNS").otherwise("NO_YEAR_COLUMNS").alias("warning"))
    out = got.where("cols is not null").select(*TABLE, "width", F.coalesce("header_end", F.lit(-1)).alias("header_end"), F.explode("cols").alias("c")).select(*TABLE, "width", "header_end", "c.col_no", "c.period")
    return out, warnings


def table_units(cells: DataFrame) -> DataFrame:
    """(table, currency, multiplier): declared in the context, else as in the last table that declared any."""
    context = cells.groupBy(*TABLE).agg(F.max("context").alias("context"))
    currency, scale = detect_unit(F.coalesce("context", F.lit("")))
    found = context.select(*TABLE, F.struct(currency.alias("currency"), scale.alias("multiplier")).alias("unit"), F.coalesce(F.col("context").rlike(_DECLARES), F.lit(False)).alias("says"))
    declares = (F.col("unit.currency") != "") | F.col("unit.multiplier").isNotNull() | F.col("says")
    so_far = Window.partitionBy("doc_id").orderBy("table_no").rowsBetween(Window.unboundedPreceding, 0)
    unit = F.last(F.when(declares, F.col("unit")), ignorenulls=True).over(so_far)
    return found.select(*TABLE, unit.alias("u")).select(*TABLE, F.coalesce("u.currency", F.lit("")).alias("currency"), F.col("u.multiplier").alias("multiplier"))


def recovered_totals(rows: DataFrame) -> DataFrame:
    """rows with the section heading as label of a blank subtotal that its segments add up to in every year column.

    rows: table, row_no, label, heading (whether it opens a revenue section), named, numbers (array, null where none), complete.
    """
    order = Window.partitionBy(*TABLE).orderBy("row_no")
    grouped = rows.withColumn("part", F.sum(F.col("heading").cast("int")).over(order))
    note = F.col("label").rlike(_NOTE_ONLY)
    full = F.col("complete") & ~F.exists("numbers", lambda n: n.isNull())
    ends = ~F.col("heading") & F.col("complete") & (note | F.col("named") | ~full)
    stop = grouped.where("part > 0").groupBy(*TABLE, "part").agg(F.min(F.when(ends, F.col("row_no"))).alias("stop"), F.min("row_no").alias("head_row"), F.min_by("label", "row_no").alias("head_label"))
    inside = grouped.join(stop, [*TABLE, "part"]).where("row_no > head_row and row_no < stop and complete")
    sums = inside.select(*TABLE, "part", "row_no", F.posexplode("numbers").alias("i", "x")).groupBy(*TABLE, "part", "i").agg(F.sum(F.col("x").cast("decimal(28,6)")).cast("decimal(28,6)").alias("s"), F.count_distinct("row_no").alias("n"))
    totals = sums.groupBy(*TABLE, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda v: v["s"]).alias("sums"), F.max("n").alias("n"))
    at = grouped.join(stop, [*TABLE, "part"]).where((F.col("row_no") == F.col("stop")) & note & full).join(totals, [*TABLE, "part"]).where((F.col("n") >= 2) & (F.transform("numbers", lambda x: x.cast("decimal(28,6)")) == F.col("sums")))
    return rows.join(at.select(*TABLE, "row_no", F.col("head_label").alias("recovered")), [*TABLE, "row_no"], "left")


def canonical(rows: DataFrame, label: str) -> DataFrame:
    """rows (with statement_type) and canonical_name: the metric of that statement whose alias the whole label is.

    An equi join on the label's key with the fixed table of aliases; keys of two metrics stand for none.
    """
    one = alias_table(rows.sparkSession).groupBy(F.col("statement_type").alias("_kind"), F.col("key").alias("_key")).agg(F.count_distinct("metric").alias("_n"), F.min("metric").alias("canonical_name")).where("_n = 1")
    return rows.join(one, (F.col("statement_type") == F.col("_kind")) & (label_key(F.col(label)) == F.col("_key")), "left").drop("_kind", "_key", "_n")


def assemble(cells: DataFrame, statement: str | None = None, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, warnings) of table grids, of one kind of statement or of the kind that each document's cells name."""
    if statement:
        cells = of_kind(cells, statement, scope)
    # tables of columns, units and rows are read by several later steps, so each is written once
    columns, refused = (kept(x, "grid-columns") for x in period_columns(cells))
    columns, skipped = with_inheritance(cells, columns, refused)
    columns, units = kept(columns, "grid-columns"), kept(table_units(cells), "grid-units")
    unclear = units.where("currency = '' or multiplier is null").join(columns.select(*TABLE).distinct(), TABLE, "left_semi").select(*TABLE, F.lit("UNKNOWN_UNIT").alias("warning"))
    grid = cells.groupBy(*TABLE, *KIND, "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col_no", "cell"))).alias("m"), F.max("source_page").alias("source_page"), F.max("method").alias("method"), F.count("*").alias("n_cells")
    )
    head = columns.groupBy(*TABLE, "width", "header_end").agg(F.array_sort(F.collect_list(F.struct("col_no", "period"))).alias("cols"))
    rows = grid.join(head, TABLE).where("row_no > header_end").withColumn("label", F.coalesce(F.element_at("m", F.lit(0)), F.lit("")))
    rows = kept(canonical(rows.withColumn("clean", clean_label(F.col("label"))), "clean"), "grid-rows")
    income = rows.where("statement_type = 'income_statement'")
    any_ = resolve(income.select(F.col("clean").alias("label")).distinct()).select(F.col("label").alias("clean"), F.col("metric").alias("any_metric"), F.col("confidence").alias("any_confidence"))
    blank = ~F.exists("cols", lambda c: strip(F.coalesce(F.element_at("m", c["col_no"]), F.lit(""))) != "")
    complete = ~F.exists("cols", lambda c: F.element_at("m", c["col_no"]).isNull())
    flat = income.select(*TABLE, "row_no", "m", F.explode("cols").alias("c")).withColumn("raw", F.coalesce(F.element_at("m", F.col("c.col_no")), F.lit("")))
    numbers = with_number(flat, "raw", "value", "kind").groupBy(*TABLE, "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("c.col_no", "value"))), lambda v: v["value"]).alias("numbers"))
    state = income.join(any_, "clean", "left").join(numbers, [*TABLE, "row_no"]).select(
        *TABLE, "row_no", "label", complete.alias("complete"), F.col("any_metric").isNotNull().alias("named"), "numbers",
        F.coalesce(complete & blank & (F.col("any_metric") == "revenue") & (F.col("any_confidence") == "high"), F.lit(False)).alias("heading"),
    )
    back = kept(recovered_totals(kept(state, "grid-state")).where("recovered is not null").select(*TABLE, "row_no", "recovered"), "grid-totals")
    rows = rows.join(back, [*TABLE, "row_no"], "left").withColumn("label", F.coalesce("recovered", "label"))
    rows = rows.withColumn("canonical_name", F.when(F.col("recovered").isNotNull(), "revenue").otherwise(F.col("canonical_name"))).drop("recovered")
    named = rows.where(strip(F.col("label")) != "")
    ragged = named.where("n_cells <> width").select(*TABLE, F.lit("IRREGULAR_ROW").alias("warning"))
    percent = F.exists("cols", lambda c: F.coalesce(F.element_at("m", c["col_no"]), F.lit("")).contains("%"))
    # "Gross margin" without a percent sign is an amount
    renamed = F.when((F.col("canonical_name") == "gross_margin") & (F.lower(strip(F.col("label"))) == "gross margin") & ~percent, "gross_profit").otherwise(F.col("canonical_name"))
    filled = F.exists("cols", lambda c: strip(F.coalesce(F.element_at("m", c["col_no"]), F.lit(""))) != "")
    good = named.where("n_cells = width").where(filled).withColumn("canonical_name", renamed)
    cell = good.select(*TABLE, *KIND, "row_no", "label", "canonical_name", "source_page", "method", "m", F.explode("cols").alias("c")).withColumn("raw_value", F.element_at("m", F.col("c.col_no"))).where("raw_value is not null")
    # written, as a filter on the value would be pushed below the steps that parse it and repeat them
    parsed = kept(with_number(cell.drop("m"), "raw_value", "value", "kind"), "grid-values").where(F.col("value").isNotNull() | F.col("raw_value").rlike(_BLANK)).join(units, TABLE)
    type_ = value_type(F.col("label"), F.col("canonical_name"), F.col("kind"))
    scale = F.when(type_ != "monetary", F.lit(1.0)).otherwise(F.when(F.col("currency") != "", F.col("multiplier")))
    sure = F.col("canonical_name").isNotNull() & (F.col("currency") != "") & scale.isNotNull() & (F.col("method") != "local_ocr")
    facts = parsed.select(
        *TABLE, F.col("row_no").alias("metric_ordinal"), F.col("c.col_no").alias("col_no"), "statement_type", F.when(F.col("wanted") != "", F.col("wanted")).otherwise("unknown").alias("scope"), "canonical_name", F.col("label").alias("original_label"), "raw_value", "value",
        type_.alias("value_type"), "c.period.*", "currency", scale.alias("multiplier"), "source_page", F.col("method").alias("extraction_method"), F.when(sure, "medium").otherwise("low").alias("confidence"),
    )
    row = Window.partitionBy(*TABLE, "metric_ordinal")
    facts = facts.withColumn("_any", F.bool_or(F.col("value").isNotNull()).over(row)).where(F.col("_any") | F.col("canonical_name").isNotNull()).drop("_any")
    warnings = refused.where("warning is not null").unionByName(back.select(*TABLE).distinct().withColumn("warning", F.lit("RECOVERED_TOTAL"))) if statement is None else refused.where("warning is not null")
    for part in (skipped, unclear, ragged):
        warnings = warnings.unionByName(part)
    return facts, warnings


def duplicate_conflicts(facts: DataFrame) -> DataFrame:
    """Metrics that a document states twice for one period with different value, unit or scale."""
    key = ["doc_id", "statement_type", "scope", "canonical_name", "year", "period_type", "end_date", "is_restated"]
    told = facts.where("canonical_name is not null").groupBy(*key).agg(F.count_distinct(F.struct(F.coalesce("value", F.lit(float("nan"))), "currency", F.coalesce("multiplier", F.lit(-1.0)))).alias("versions"), F.count("*").alias("n"))
    return told.where("versions > 1")


def conflicting_pairs(facts: DataFrame) -> DataFrame:
    """One row per value and earlier value of a metric that differ, of one period, statement and document.

    Later rows are held against all rows before them in the statement; values of one row are not held against each other.
    Only values of one metric and period meet, in an equi join; both places are named.
    """
    period = ["year", "period_type", "end_date", "is_restated"]
    key = ["doc_id", "statement_type", "scope", "canonical_name"]
    told = facts.where("canonical_name is not null").select(*key, *period, F.struct("table_no", "metric_ordinal").alias("place"), "col_no", "source_page", F.struct("value", "currency", "multiplier").alias("stated"))
    earlier = told.select(*[F.col(c).alias(f"_{c}") for c in (*key, *period)], *[F.col(c).alias(f"earlier_{c}") for c in ("place", "col_no", "source_page", "stated")])
    same = F.lit(True)
    for c in (*key, *period):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    pairs = told.join(earlier, same & (F.col("earlier_place") < F.col("place")) & ~F.col("stated").eqNullSafe(F.col("earlier_stated")))
    return pairs.select(
        *key, *period, F.col("place.table_no").alias("table_no"), F.col("place.metric_ordinal").alias("metric_ordinal"), "source_page", F.col("stated.value").alias("value"),
        F.col("earlier_place.table_no").alias("earlier_table_no"), F.col("earlier_place.metric_ordinal").alias("earlier_ordinal"), "earlier_source_page", F.col("earlier_stated.value").alias("earlier_value"),
    )


def statement_slots(statements: DataFrame) -> DataFrame:
    """The main statement of each kind per document: consolidated before unknown before parent, the earliest of equals.

    statements: doc_id, statement_id, statement_type, scope, seq.
    """
    rank = F.when(F.col("scope") == "consolidated", 2).when(F.col("scope") == "unknown", 1).otherwise(0)
    order = Window.partitionBy("doc_id", "statement_type").orderBy(rank.desc(), "seq")
    return statements.withColumn("slot", F.when(F.row_number().over(order) == 1, "main").otherwise("alternative"))


def page_lines(pages: DataFrame) -> DataFrame:
    """Cells of page text without tables: each line that is not blank, cut at tabs and runs of two or more spaces."""
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", r"\R")).alias("line_no", "line")).where("trim(line) <> ''")
    order = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    return lines.withColumn("row_no", F.row_number().over(order) - 1).select("doc_id", F.col("page_number").alias("table_no"), "row_no", F.posexplode(F.split(strip(F.col("line")), r"\t+| {2,}")).alias("col_no", "cell"))


def _dated_pages(cells: DataFrame, by: list[str]) -> DataFrame:
    """Pages with a table whose first rows hold a usable year column."""
    dated = cells.where(f"row_no < 15 and col_no > 0 and not cell rlike '{_NO_PERIOD}'").withColumn("period", detect_period(F.col("cell"), F.lit("income_statement")))
    return dated.where("period is not null").select(*by).distinct()


def choose_scan(native: DataFrame, positional: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, method): which of three scans of a page to use.

    Native tables with year columns count, unless labels are merged into one cell or most of four figure rows or more have
    none; then positions do, if they show year columns.  Without year columns positions come first, then native tables
    (they may continue a table before), then lines of text.  Each scan has doc_id, page_number, table_no, row_no, col_no, cell.
    """
    page = ["doc_id", "page_number"]
    blank = F.trim(F.coalesce("cell", F.lit(""))) == ""
    rows = native.groupBy(*page, "table_no", "row_no").agg(F.max(F.when(F.col("col_no") == 0, F.col("cell"))).alias("label"), F.bool_or((F.col("col_no") > 0) & ~blank).alias("figures"))
    marked = rows.groupBy(*page).agg(
        F.bool_or(F.col("figures") & F.col("label").rlike(r"(?s)\S.*\R.*\S|\R.*\S")).alias("merged"), F.count_if((F.col("row_no") > 0) & F.col("figures")).alias("n"), F.count_if((F.col("row_no") > 0) & F.col("figures") & (F.trim(F.coalesce("label", F.lit(""))) == "")).alias("bare")
    )
    flag = lambda df, name: df.select(*page).distinct().withColumn(name, F.lit(True))
    every = native.select(*page).union(positional.select(*page)).union(lines.select(*page)).distinct()
    met = every.join(marked, page, "left").join(flag(_dated_pages(native, page), "native_dated"), page, "left").join(flag(_dated_pages(positional, page), "place_dated"), page, "left").join(flag(positional.where("col_no > 0"), "placed"), page, "left")
    poor = F.col("merged") | ((F.col("n") >= 4) & (F.col("bare") * 2 > F.col("n")))
    method = (
        F.when(F.col("native_dated") & ~poor, "native").when(F.col("native_dated") & F.col("place_dated"), "positional").when(F.col("native_dated"), "native").when(F.col("placed"), "positional")
        .when(F.col("merged").isNotNull(), "native").otherwise("text")
    )
    return met.select(*page, method.alias("method"))
