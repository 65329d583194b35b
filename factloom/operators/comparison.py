"""Two reports of one company side by side, and change over the years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inputs import amount


def signature(kind: Column, start: Column, end: Column, restated: Column) -> Column:
    """A period without its year."""
    return F.concat_ws("|", kind, F.substring(F.coalesce(start, F.lit("")), 5, 100), F.substring(F.coalesce(end, F.lit("")), 5, 100), restated.cast("string"))


def check_sources(sources: DataFrame) -> DataFrame:
    """Per pair: whether it may be compared. sources: pair_id, document_id, content_hash, company_name, confirmed."""
    name = F.nullif(F.trim("company_name"), F.lit(""))
    got = sources.groupBy("pair_id").agg(
        F.count("*").alias("n"), F.count_distinct("document_id").alias("ids"), F.count_distinct(F.nullif("content_hash", F.lit(""))).alias("hashes"),
        F.count(F.nullif("content_hash", F.lit(""))).alias("hashed"), F.bool_and("confirmed").alias("confirmed"), F.count_distinct(name).alias("companies"),
    )
    reason = (
        F.when(F.col("n") != 2, "NOT_TWO").when(F.col("ids") != 2, "SAME_DOCUMENT").when((F.col("hashed") == 2) & (F.col("hashes") == 1), "SAME_CONTENT")
        .when(~F.col("confirmed"), "NOT_CONFIRMED").when(F.col("companies") > 1, "COMPANIES_DIFFER").otherwise("")
    )
    return got.select("pair_id", reason.alias("reason"))


def compare_reports(values: DataFrame) -> DataFrame:
    """One point per (pair, scope, statement, metric, year) with status, reason, value and change to the year before.

    values: facts of both documents with pair_id and document_id.
    """
    own = values.where(F.col("canonical_name").isNotNull() & F.col("period_type").isin("annual", "point_in_time"))
    own = own.withColumn("amount", amount(F.col("value"), F.col("multiplier"))).withColumn("sig", F.concat_ws("|", signature(F.col("period_type"), F.col("start_date"), F.col("end_date"), F.col("is_restated")), "value_type"))
    key = ["pair_id", "scope", "statement_type", "canonical_name", "year"]
    got = own.groupBy(*key).agg(
        F.count("*").alias("n_sources"), F.count_distinct("document_id").alias("docs"), F.min("is_restated").alias("r0"), F.max("is_restated").alias("r1"), F.min("sig").alias("s0"), F.max("sig").alias("s1"),
        F.min("currency").alias("c0"), F.max("currency").alias("c1"), F.bool_or(F.coalesce(F.col("value_type") == "unknown", F.lit(True))).alias("untyped"), F.min("value_type").alias("value_type"),
        F.bool_or(F.col("multiplier").isNull() | (F.col("multiplier") <= 0)).alias("unscaled"), F.bool_or(F.col("amount").isNull()).alias("gone"), F.min("amount").alias("a0"), F.max("amount").alias("a1"),
    )
    code = (
        F.when(F.col("scope") == "unknown", "CMP_UNKNOWN_SCOPE").when(F.col("r0") != F.col("r1"), "CMP_RESTATED_MIX").when(F.col("s0") != F.col("s1"), "CMP_PERIOD_MIX")
        .when((F.col("c0") != F.col("c1")) | (F.coalesce("c0", F.lit("")) == ""), "CMP_CURRENCY").when(F.col("untyped"), "CMP_TYPE").when(F.col("unscaled"), "CMP_MULTIPLIER").when(F.col("gone"), "CMP_MISSING")
        .when(F.col("a0") != F.col("a1"), "CMP_AMOUNT").otherwise("")
    )
    status = (
        F.when(F.col("code").isin("CMP_RESTATED_MIX", "CMP_AMOUNT"), "conflict").when(F.col("code") == "CMP_MISSING", "missing").when(F.col("code") != "", "incompatible")
        .when(F.col("docs") == 2, "matched").otherwise("single")
    )
    points = got.withColumn("code", code).select(
        *key, "n_sources", status.alias("status"), F.col("code").alias("reason"), F.when(F.col("code") == "", F.col("a0")).alias("amount"),
        F.when(F.col("c0") == F.col("c1"), F.col("c0")).otherwise("").alias("currency"), F.when(F.col("code") == "", F.col("s0")).alias("sig"), "value_type",
    )
    # the adjacent year by equi join: years may have gaps, so a lag over rows would be wrong
    before = points.select("pair_id", "scope", "statement_type", "canonical_name", (F.col("year") + 1).alias("year"), F.col("amount").alias("b"), F.col("currency").alias("b_currency"), F.col("sig").alias("b_sig"), F.lit(True).alias("found"))
    joined = points.join(before, key, "left")
    blocked = (
        F.when(F.col("found").isNull(), "CHG_NO_PRIOR").when(F.col("amount").isNull() | F.col("b").isNull(), "CHG_UNUSABLE").when((F.col("currency") != F.col("b_currency")) | (F.col("sig") != F.col("b_sig")), "CHG_INCOMPARABLE")
        .when(F.col("value_type") != "monetary", "CHG_NOT_MONETARY").otherwise("")
    )
    change = F.when(blocked == "", F.col("amount") - F.col("b"))
    growth = F.when((blocked == "") & (F.col("b") > 0), F.try_divide(change.cast("double"), F.col("b").cast("double")) * 100)
    return joined.select(
        *key, "n_sources", "status", "reason", F.round(F.col("amount").cast("double"), 6).alias("value"), F.round(change.cast("double"), 6).alias("change"), F.round(growth, 6).alias("growth_percent"),
        F.when((blocked == "") & (F.col("b") <= 0), "NONPOSITIVE_BASE").otherwise(blocked).alias("change_reason"), "currency", "sig",
    )


def comparison_warnings(points: DataFrame) -> DataFrame:
    """Per pair: fewer than three years, and no metric on which both reports agree."""
    return points.groupBy("pair_id", "scope").agg((F.count_distinct("year") < 3).alias("few_years"), (~F.bool_or(F.col("status") == "matched")).alias("no_overlap"))


def trend_eligibility(points: DataFrame) -> DataFrame:
    """Metrics whose years follow each other without a gap, with one currency and one kind of period, three at least."""
    got = points.groupBy("pair_id", "scope", "statement_type", "canonical_name").agg(
        F.count("*").alias("n_years"), (F.max("year") - F.min("year") + 1 == F.count("*")).alias("consecutive"), F.bool_and(F.col("value").isNotNull()).alias("complete"),
        (F.count_distinct("currency") == 1).alias("one_currency"), (F.count_distinct("sig") == 1).alias("one_signature"),
    )
    return got.select("*", (F.col("consecutive") & F.col("complete") & F.col("one_currency") & F.col("one_signature") & (F.col("n_years") >= 3)).alias("can_trend"))


def two_documents(facts: DataFrame) -> DataFrame:
    """Facts read as two annual reports each: D1 shows 1998 to 2001, D2 shows 1995 to 1999 with some figures changed."""
    late = facts.where("year >= 1998").withColumn("document_id", F.lit("D1"))
    early = facts.where("year <= 1999").withColumn("document_id", F.lit("D2"))
    moved = (F.col("doc_id") % 3 == 1) & (F.col("year") == 1999) & (F.col("canonical_name") == "total_assets")
    early = early.withColumn("value", F.when(moved, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(28,6)"))
    early = early.withColumn("currency", F.when((F.col("doc_id") % 5 == 2) & (F.col("canonical_name") == "operating_profit"), "USD").otherwise(F.col("currency")))
    return late.unionByName(early).withColumnRenamed("doc_id", "pair_id")


#: compare_reports over two_documents in DuckDB, over ``facts``.
POINTS_SQL = """
two AS (
    SELECT *, 'D1' AS document_id FROM facts WHERE year >= 1998 UNION ALL
    SELECT * REPLACE (CASE WHEN doc_id % 3 = 1 AND year = 1999 AND canonical_name = 'total_assets' THEN value + 1 ELSE value END AS value,
                      CASE WHEN doc_id % 5 = 2 AND canonical_name = 'operating_profit' THEN 'USD' ELSE currency END AS currency), 'D2' FROM facts WHERE year <= 1999
), pts AS (
    SELECT *, CASE WHEN code IN ('CMP_RESTATED_MIX', 'CMP_AMOUNT') THEN 'conflict' WHEN code = 'CMP_MISSING' THEN 'missing' WHEN code <> '' THEN 'incompatible' WHEN docs = 2 THEN 'matched' ELSE 'single' END AS status,
           CASE WHEN code = '' THEN a0 END AS amount, CASE WHEN c0 = c1 THEN c0 ELSE '' END AS currency, CASE WHEN code = '' THEN s0 END AS sig
    FROM (SELECT *, CASE WHEN scope = 'unknown' THEN 'CMP_UNKNOWN_SCOPE' WHEN r0 <> r1 THEN 'CMP_RESTATED_MIX' WHEN s0 <> s1 THEN 'CMP_PERIOD_MIX' WHEN c0 <> c1 OR c0 = '' THEN 'CMP_CURRENCY' WHEN gone THEN 'CMP_MISSING' WHEN a0 <> a1 THEN 'CMP_AMOUNT' ELSE '' END AS code
          FROM (SELECT doc_id AS pair_id, scope, statement_type, canonical_name, year, count(*) AS n_sources, count(DISTINCT document_id) AS docs, min(is_restated) AS r0, max(is_restated) AS r1,
                       min(period_type || '||' || substr(end_date, 5) || '|' || is_restated || '|' || value_type) AS s0, max(period_type || '||' || substr(end_date, 5) || '|' || is_restated || '|' || value_type) AS s1,
                       min(currency) AS c0, max(currency) AS c1, bool_or(value IS NULL) AS gone, min(value * multiplier) AS a0, max(value * multiplier) AS a1
                FROM two WHERE canonical_name IS NOT NULL GROUP BY ALL))
), points AS (
    SELECT p.pair_id, p.scope, p.statement_type, p.canonical_name, p.year, p.n_sources, p.status, p.code AS reason, round(p.amount::DOUBLE, 6) AS value,
           CASE WHEN blocked = '' THEN round((p.amount - b_amount)::DOUBLE, 6) END AS change, CASE WHEN blocked = '' AND b_amount > 0 THEN round((p.amount - b_amount)::DOUBLE / b_amount::DOUBLE * 100, 6) END AS growth_percent,
           CASE WHEN blocked = '' AND b_amount <= 0 THEN 'NONPOSITIVE_BASE' ELSE blocked END AS change_reason, p.currency, p.sig
    FROM (SELECT p.*, b.amount AS b_amount, CASE WHEN b.pair_id IS NULL THEN 'CHG_NO_PRIOR' WHEN p.amount IS NULL OR b.amount IS NULL THEN 'CHG_UNUSABLE' WHEN p.currency <> b.currency OR p.sig <> b.sig THEN 'CHG_INCOMPARABLE' ELSE '' END AS blocked
          FROM pts p LEFT JOIN pts b ON b.pair_id = p.pair_id AND b.scope = p.scope AND b.statement_type = p.statement_type AND b.canonical_name = p.canonical_name AND b.year = p.year - 1) p
)"""
