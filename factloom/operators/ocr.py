"""Recognised words and pages as tables: doubtful figures, statement headings, and the pages worth recognising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: What stands for a doubtful figure, the score under which one is doubtful, and how many pages are looked at.
DOUBTFUL, LEAST_SCORE, CANDIDATES, MOST_PAGES, AHEAD = "OCR待核对", 0.90, 160, 20, 3
#: About so many words are put in order by one task, however many there are.
TASK_WORDS = 100_000
#: A line without white space that is a statement's heading and nothing else.
KINDS = (
    ("income", r"(?:合并|综合)?(?:损益表|利润表|收益表|综合收益表)(?:[（(]?续[）)]?)?|(?i:(?:Consolidated)?(?:IncomeStatement|StatementofProfitorLoss))"),
    ("balance", r"(?:合并|综合)?(?:资产负债表|财务状况表)(?:[（(]?续[）)]?)?|(?i:(?:Consolidated)?(?:BalanceSheet|StatementofFinancialPosition))"),
    ("cash", r"(?:合并|综合)?现金流量表(?:[（(]?续[）)]?)?|(?i:(?:Consolidated)?(?:CashFlowStatement|StatementofCashFlows))"),
)
_BRACKETED, _FIGURE = r"^[\[（(][\d, .]+[\]）)]$", r"^[\d,.()（）\[\]−–—+%\-\s]+$"
_GROUPED, _YEAR = r"\d{1,3}(?:,\d{3})+", r"(?<!\d)(20\d{2})(?!\d)"


def heading_kind(text: Column) -> Column:
    """income, balance or cash by the first line that is nothing but a statement's heading; null if there is none."""
    bare = F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    kind = lambda x: F.coalesce(*[F.when(x.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS])
    return F.get(F.filter(F.transform(bare, kind), lambda k: k.isNotNull()), F.lit(0))


def checked_words(words: DataFrame) -> DataFrame:
    """Recognised words with brackets made equal, doubtful figures replaced, and their place in reading order.

    words: doc_id, page_number, x0, y0, x1, y1, text, score.  Lines are bands of three units of height.
    """
    bracketed = F.col("text").rlike(_BRACKETED)
    plain = F.when(bracketed, F.concat(F.lit("("), F.substring("text", F.lit(2), F.length("text") - 2), F.lit(")"))).otherwise(F.col("text"))
    low = plain.rlike(_FIGURE) & (F.col("score") < LEAST_SCORE)
    band = F.bround((F.col("y0") + F.col("y1")) / 2 / 3)
    place = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("band", "x0", "text"))
    out = words.select("doc_id", "page_number", "x0", "y0", "x1", "y1", F.when(low, DOUBTFUL).otherwise(plain).alias("text"), low.alias("doubtful"), band.alias("band"))
    # as many parts as the words ask for: the number of shuffle partitions does not grow with the input
    return out.repartition(words.count() // TASK_WORDS + 1, "doc_id", "page_number").withColumn("place", place)


def candidate_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, kind) of the first pages of a document that are nearly empty or full of figures of two years.

    pages: doc_id, page_number, text, header (what a look at the top of the page recognises).
    """
    text = F.coalesce("text", F.lit(""))
    years = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(_YEAR), F.lit(1))))
    wanted = (F.length(strip(text)) < 80) | ((F.regexp_count(text, F.lit(_GROUPED)) >= 12) & (years >= 2))
    order = Window.partitionBy("doc_id").orderBy("page_number")
    met = pages.where(wanted).select("doc_id", "page_number", heading_kind(F.coalesce("header", F.lit(""))).alias("kind"))
    return met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= CANDIDATES).drop("_n")


def locate_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, reason): the pages to recognise, each heading's page and three more, or why there are none.

    The search ends at the page that completes the three kinds of statements.
    """
    last = pages.groupBy("doc_id").agg(F.max("page_number").alias("n_pages"))
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    found = candidate_pages(pages).where("kind is not null").withColumn("seen", F.size(F.collect_set("kind").over(before))).where("seen < 3")
    each = found.join(last, "doc_id").select("doc_id", F.explode(F.sequence("page_number", F.least(F.col("page_number") + AHEAD, F.col("n_pages")))).alias("page"))
    got = last.join(each.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages")), "doc_id", "left")
    reason = F.when(F.col("pages").isNull(), "NOT_FOUND").when(F.size("pages") > MOST_PAGES, "TOO_MANY").otherwise("")
    return got.select("doc_id", F.when(reason == "", F.col("pages")).alias("pages"), reason.alias("reason"))
