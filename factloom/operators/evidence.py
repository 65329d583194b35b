"""Evidence for a written analysis, as tables: what a report says, what was computed and checked, and where it stands.

An evidence table has one row per entry (id, kind, pages ...); a package is the table with its size gate; an analysis may
cite only ids of its package.  Calling a language model is left to the user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import kept
from .inputs import REPORT, select_values
from .metrics import compute_metrics
from .validation import run_all

#: Fixed limits of a package.
VALUES, POINTS, PAGES, PAGES_EACH, PAGE_CHARS, PAGE_CHARS_EACH, PACKAGE_CHARS = 160, 180, 8, 4, 2000, 1200, 120_000
#: Statements in the order in which a report lists them.
ORDER = {"balance_sheet": 0, "income_statement": 1, "cash_flow": 2}


def _in_order(statement: str = "statement_type"):
    return F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col(statement))


def _numbered(df: DataFrame, by: list[str], order: list, prefix: str, most: int | None = None) -> DataFrame:
    """df with ids prefix1, prefix2 ... in the given order, and how many rows the cap leaves out."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    total = F.count("*").over(Window.partitionBy(*by))
    out = df.withColumn("_n", n).withColumn("_total", total)
    out = out.where(F.col("_n") <= most) if most else out
    return out.withColumn("id", F.concat(F.lit(prefix), "_n")).withColumn("omitted", F.greatest(F.lit(0), F.col("_total") - (most or 0)) if most else F.lit(0)).drop("_n", "_total")


def reported_values(facts: DataFrame) -> DataFrame:
    """The first values of each report as entries R1, R2 ... with the number of values left out."""
    own = facts.where("canonical_name is not null")
    order = [_in_order(), "metric_ordinal", "year", "is_restated", "raw_value", "multiplier"]
    return _numbered(own, REPORT, order, "R", VALUES).select(
        *REPORT, "id", F.lit("reported_value").alias("kind"), F.col("canonical_name").alias("name"), F.col("original_label").alias("label"), "year", F.col("raw_value").alias("value"),
        F.coalesce("currency", F.lit("")).alias("unit"), F.lit("").alias("status"), F.lit("").alias("reason"), F.array("source_page").alias("pages"), "omitted",
    )


def build_evidence(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, scope, id, kind, name, label, year, value, unit, status, reason, pages, text) of every report.

    pages: doc_id, page_number, text.  A metric and a check cite the pages of all figures they rest on; excerpts are the
    first pages that any entry cites.  Selected values are written once, as metrics and checks both read them.
    """
    selected = kept(select_values(facts), "selected")
    printed = lambda c: F.when(c.isNull(), "").otherwise(F.format_string("%.6f", c))
    computed = _numbered(compute_metrics(facts, selected=selected, with_pages=True), REPORT, [F.col("year").desc(), "metric", "period_type", "is_restated"], "M").select(
        *REPORT, "id", F.lit("computed_metric").alias("kind"), F.col("metric").alias("name"), F.lit("").alias("label"), "year", printed(F.col("value")).alias("value"), "unit", F.lit("").alias("status"), "reason", "pages",
    )
    checks = _numbered(run_all(facts, selected, with_pages=True), REPORT, ["rule", F.coalesce("year", F.lit(0)), "item", "period_type", "is_restated"], "C").select(
        *REPORT, "id", F.lit("validation").alias("kind"), F.col("rule").alias("name"), F.col("item").alias("label"), "year", F.lit("").alias("value"), F.lit("").alias("unit"), "status", "reason", "pages",
    )
    values = reported_values(facts).drop("omitted").withColumn("pages", F.col("pages").cast("array<int>"))
    entries = kept(values.unionByName(computed).unionByName(checks).withColumn("text", F.lit(None).cast("string")), "entries")
    cited = entries.select(*REPORT, F.explode("pages").alias("page_number")).where("page_number > 0").distinct()
    cited = cited.withColumn("_n", F.row_number().over(Window.partitionBy(*REPORT).orderBy("page_number"))).where(F.col("_n") <= PAGES)
    excerpts = cited.join(pages, ["doc_id", "page_number"]).select(
        *REPORT, F.concat(F.lit("P"), "page_number").alias("id"), F.lit("source_excerpt").alias("kind"), F.lit("").alias("name"), F.lit("").alias("label"), F.lit(None).cast("int").alias("year"), F.lit("").alias("value"), F.lit("").alias("unit"),
        F.when(F.length("text") > PAGE_CHARS, "truncated").otherwise("").alias("status"), F.lit("").alias("reason"), F.array("page_number").alias("pages"), F.substring("text", 1, PAGE_CHARS).alias("text"),
    )
    return entries.unionByName(excerpts)


def comparison_evidence(points: DataFrame) -> DataFrame:
    """Points of two reports as entries T1, T2 ..., conflicts first, with the number of points left out."""
    calm = ~F.col("status").isin("conflict", "incompatible")
    return _numbered(points, ["pair_id", "scope"], [calm, "canonical_name", "year", "statement_type"], "T", POINTS).select(
        "pair_id", "scope", "id", F.col("canonical_name").alias("name"), "statement_type", "year", "status", "reason", "value", "change", "growth_percent", "change_reason", "currency", "n_sources", "omitted"
    )


def comparison_excerpts(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Excerpts D1_P5 ... of the first cited pages of each document of a pair. sources: pair_id, document_id, source_page."""
    cited = sources.select("pair_id", "document_id", F.col("source_page").alias("page_number")).distinct()
    cited = cited.withColumn("_n", F.row_number().over(Window.partitionBy("pair_id", "document_id").orderBy("page_number"))).where(F.col("_n") <= PAGES_EACH)
    met = cited.join(pages.withColumnRenamed("doc_id", "pair_id"), ["pair_id", "page_number"])
    return met.select("pair_id", F.concat("document_id", F.lit("_P"), "page_number").alias("id"), "page_number", (F.length("text") > PAGE_CHARS_EACH).alias("truncated"), F.substring("text", 1, PAGE_CHARS_EACH).alias("text"))


def comparison_package(points: DataFrame, values: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, scope, id, kind, name, label, year, value, status, reason, pages, sources, text): two reports in one package.

    Points of both come first (T1, T2 ...), then the checks of each document (D1_C1 ...) and the first pages that its
    figures stand on (D1_P3 ...).  sources: (document_id, page, raw_value, currency, multiplier, period_type, restated,
    value_type) of every figure behind a point; checks and excerpts name document and page only.

    points: compare_reports(values); values: facts of both documents with pair_id and document_id; pages: doc_id (that of
    the pair), page_number, text.
    """
    point = ["pair_id", "scope", "statement_type", "canonical_name", "year"]
    own = values.where(F.col("canonical_name").isNotNull() & F.col("period_type").isin("annual", "point_in_time")).withColumn("source_page", F.col("source_page").cast("int"))
    detail = F.struct(
        "document_id", F.col("source_page").alias("page"), "metric_ordinal", F.coalesce("raw_value", F.lit("")).alias("raw_value"), F.coalesce("currency", F.lit("")).alias("currency"), F.col("multiplier").cast("double").alias("multiplier"),
        "period_type", F.col("is_restated").alias("restated"), "value_type",
    )
    behind = own.groupBy(*point).agg(F.array_sort(F.collect_set("source_page")).alias("pages"), F.array_sort(F.collect_list(detail)).alias("sources"))
    bare = lambda s: F.struct(*[s[f].alias(f) for f in ("document_id", "page", "raw_value", "currency", "multiplier", "period_type", "restated", "value_type")])
    place = lambda document, page: F.struct(
        document.alias("document_id"), page.alias("page"), *[F.lit(None).cast(t).alias(n) for n, t in (("raw_value", "string"), ("currency", "string"), ("multiplier", "double"), ("period_type", "string"), ("restated", "boolean"), ("value_type", "string"))]
    )
    empty = lambda n, t="string": F.lit(None).cast(t).alias(n)
    told = comparison_evidence(points).join(behind.withColumnRenamed("canonical_name", "name"), ["pair_id", "scope", "statement_type", "name", "year"])
    told = told.select(
        "pair_id", "scope", "id", F.lit("multi_report_comparison").alias("kind"), "name", F.col("statement_type").alias("label"), "year", F.format_string("%.6f", "value").alias("value"), "status", "reason", "pages",
        F.transform("sources", bare).alias("sources"), empty("text"),
    ).withColumn("value", F.when(F.col("value") != "null", F.col("value")))
    each = values.withColumn("doc_id", F.concat_ws(":", "pair_id", "document_id")).drop("pair_id", "document_id")
    named = each.select("doc_id", "scope").distinct().join(values.select(F.concat_ws(":", "pair_id", "document_id").alias("doc_id"), "pair_id", "document_id").distinct(), "doc_id")
    checks = _numbered(run_all(each, kept(select_values(each), "selected"), with_pages=True), REPORT, ["rule", F.coalesce("year", F.lit(0)), "item", "period_type", "is_restated"], "C").join(named, REPORT)
    checks = checks.select(
        "pair_id", "scope", F.concat("document_id", F.lit("_"), "id").alias("id"), F.lit("validation").alias("kind"), F.col("rule").alias("name"), F.col("item").alias("label"), "year", empty("value"), "status", "reason", "pages",
        F.transform("pages", lambda p: place(F.col("document_id"), p)).alias("sources"), empty("text"),
    )
    cited = own.select("pair_id", "scope", "document_id", F.col("source_page").alias("page_number")).distinct()
    cited = cited.withColumn("_n", F.row_number().over(Window.partitionBy("pair_id", "scope", "document_id").orderBy("page_number"))).where(F.col("_n") <= PAGES_EACH)
    met = cited.join(pages.withColumnRenamed("doc_id", "pair_id"), ["pair_id", "page_number"])
    excerpts = met.select(
        "pair_id", "scope", F.concat("document_id", F.lit("_P"), "page_number").alias("id"), F.lit("source_excerpt").alias("kind"), F.lit("").alias("name"), F.lit("").alias("label"), empty("year", "int"), empty("value"),
        F.when(F.length("text") > PAGE_CHARS_EACH, "truncated").otherwise("").alias("status"), F.lit("").alias("reason"), F.array("page_number").alias("pages"), F.array(place(F.col("document_id"), F.col("page_number"))).alias("sources"),
        F.substring("text", 1, PAGE_CHARS_EACH).alias("text"),
    )
    return told.unionByName(checks).unionByName(excerpts)


def packages(entries: DataFrame, by: list[str]) -> DataFrame:
    """One JSON text per report with its key (SHA-256) and whether it is small enough to be sent.

    Entries stand in the order of their ids' letters and numbers, their fields in the order of columns, nulls included: equal
    packages have equal texts and keys wherever they are made.  A package has some hundred entries by its caps.
    """
    fields = [c for c in entries.columns if c not in by]
    order = F.struct(F.regexp_replace("id", r"\d+$", "").alias("l"), F.regexp_extract("id", r"(\d+)$", 1).cast("int").alias("n"), F.struct(*fields).alias("e"))
    made = entries.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["e"]).alias("evidence"))
    json = F.to_json(F.struct(*by, "evidence"), {"ignoreNullFields": "false"})
    made = made.select(*by, F.size("evidence").alias("n_entries"), json.alias("json"))
    return made.select(*by, "n_entries", F.length("json").alias("chars"), (F.length("json") <= PACKAGE_CHARS).alias("fits"), F.sha2("json", 256).alias("key"), "json")


#: What an answer must look like.
ANALYSIS = T.StructType([
    T.StructField("claims", T.ArrayType(T.StructType([T.StructField("topic", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("evidence_ids", T.ArrayType(T.StringType()))]))),
    T.StructField("limitations", T.ArrayType(T.StringType())),
])


def judge_analyses(answers: DataFrame, entries: DataFrame, by: list[str], most_claims: int = 12) -> DataFrame:
    """(by, reason, n_claims): whether an answer may be shown; an empty reason accepts it.

    answers: by, status, answer (JSON).  Every claim needs a text and ids, all of them in the package of its report.
    """
    parsed = answers.withColumn("a", F.from_json("answer", ANALYSIS))
    claims = parsed.select(*by, F.posexplode("a.claims").alias("no", "claim"))
    flawed = claims.where((F.trim(F.coalesce("claim.text", F.lit(""))) == "") | (F.coalesce(F.size("claim.evidence_ids"), F.lit(-1)) < 1)).select(*by).distinct().withColumn("flawed", F.lit(True))
    unknown = claims.select(*by, F.explode("claim.evidence_ids").alias("id")).join(entries.select(*by, "id").distinct(), [*by, "id"], "left_anti").select(*by).distinct().withColumn("unknown", F.lit(True))
    n = F.coalesce(F.size("a.claims"), F.lit(0))
    judged = parsed.join(flawed, by, "left").join(unknown, by, "left")
    reason = (
        F.when((F.col("status") != "completed") | F.col("status").isNull() | F.col("a").isNull(), "INCOMPLETE").when((n < 1) | (n > most_claims), "FORMAT")
        .when(F.col("flawed"), "EMPTY_CLAIM").when(F.col("unknown"), "UNKNOWN_ID").otherwise("")
    )
    return judged.select(*by, reason.alias("reason"), F.greatest(n, F.lit(0)).alias("n_claims"))


def claim_sources(answers: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, claim_no, topic, ids, pages): the pages that each claim of an answer rests on."""
    claims = answers.select(*by, F.posexplode(F.from_json("answer", ANALYSIS)["claims"]).alias("claim_no", "claim"))
    cited = claims.select(*by, "claim_no", "claim.topic", F.posexplode("claim.evidence_ids").alias("at", "id"))
    met = cited.join(entries.select(*by, "id", F.explode_outer("pages").alias("page")), [*by, "id"])
    return met.groupBy(*by, "claim_no", "topic").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("at", "id"))), lambda x: x["id"])).alias("ids"), F.array_sort(F.collect_set("page")).alias("pages")
    )
