"""Tables from the places of words on a page: lines by height, columns by the bands around the years of the header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aliases import resolve

PAGE = ["doc_id", "page_number"]
#: Words up to this much lower than the first word of a line belong to it.
LINE = 3
#: Fixed patterns: a year header, note numbers after a label, a footer, and labels that never go on in the next line.
_YEAR = r"^(?:19|20)\d{2}(?:年度|年)?$"
_NOTE = r"\s+(?:\d{1,3}(?:\s*[,，]\s*\d{1,3})*(?:\([a-z]\))?|[（(][一二三四五六七八九十\d]+[）)])$"
_FOOTER = r"(?i)^Annual Report\b"
_CLOSED = r"(?i)^(?:Note|Revenues|Attributable to|Cash flows from)\b"


def _texts(words, sign: str = " "):
    return F.array_join(F.transform(words, lambda w: w["text"]), sign)


def lines_of(words: DataFrame) -> DataFrame:
    """words (doc_id, page_number, x0, y0, x1, y1, text) with their middle (x, y) and the number of their line from 0.

    Words come from top to bottom, and one that is not near a line opens the next.  The newest of the lines before is
    the nearest, so a word asks only how far it is from the first word of that: a fold over a page's heights, whose state
    is where the line began.  Text that drifts downwards is cut where it has drifted too far, not where a gap is wide.
    """
    mid = words.withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    opens = lambda so_far, y: F.when((F.size(so_far) == 0) | (y - F.get(so_far, F.size(so_far) - 1) > LINE), F.concat(so_far, F.array(y))).otherwise(so_far)
    heights = mid.groupBy(*PAGE).agg(F.array_sort(F.collect_set("y")).alias("ys"))
    starts = heights.select(*PAGE, F.aggregate("ys", F.array().cast("array<double>"), opens).alias("starts"))
    return mid.join(starts, PAGE).withColumn("line", F.size(F.filter("starts", lambda s: s <= F.col("y"))) - 1).drop("starts")


def header_bands(lines: DataFrame) -> DataFrame:
    """(page, head, titles, bands): the first line with two years or more and no metric beside them, and its year columns.

    A band reaches half way to its neighbours; outside, half the smallest distance of two years.
    """
    year = F.col("text").rlike(_YEAR)
    told = lines.groupBy(*PAGE, "line").agg(
        F.array_sort(F.collect_list(F.when(year, F.struct("x0", "x", "text")))).alias("years"), F.array_sort(F.collect_list(F.when(~year, F.struct("y", "x0", "text")))).alias("others")
    ).where(F.size("years") >= 2).withColumn("label", _texts("others"))
    named = resolve(told.select("label").distinct()).where("metric is not null").select("label")
    first = told.join(named, "label", "left_anti").groupBy(*PAGE).agg(F.min_by("years", "line").alias("years"), F.min("line").alias("head"))
    at = lambda i: F.get("years", i)["x"]
    last = F.size("years") - 1
    gap = F.array_min(F.transform(F.sequence(F.lit(1), last), lambda i: at(i) - at(i - 1)))
    first = first.withColumn("gap", gap)
    band = lambda _, i: F.struct(
        F.when(i == 0, at(i) - F.col("gap") / 2).otherwise((at(i) + at(i - 1)) / 2).alias("lo"), F.when(i == last, at(i) + F.col("gap") / 2).otherwise((at(i) + at(i + 1)) / 2).alias("hi"), (i + 1).alias("col_no")
    )
    return first.select(*PAGE, "head", F.transform("years", lambda y: y["text"]).alias("titles"), F.transform("years", band).alias("bands"))


def with_wrapped_labels(rows: DataFrame) -> DataFrame:
    """rows (page, line, label, figures) with labels that go on in the next line joined to it.

    A row without figures goes on if it ends with a comma or the next begins in lower case; a joined row may go on again.
    Labels that never go on are judged by their first line.  So among rows in a run, where each could go on in the next,
    all from the first that may are one row: a minimum over the run says where that is, however long the run.
    """
    down = Window.partitionBy(*PAGE).orderBy("line")
    before, bare = F.lag("label").over(down), F.lag(F.forall("figures", lambda f: f == "")).over(down)
    goes_on = bare & (before != "") & (F.col("label") != "") & (before.endswith(",") | F.col("label").rlike("^[a-z]"))
    runs = rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(down))
    start = F.min(F.when(~F.col("label").rlike(_CLOSED), F.col("line"))).over(Window.partitionBy(*PAGE, "run"))
    chained = runs.withColumn("first", F.when(F.col("line") >= start, start).otherwise(F.col("line")))
    parts = F.array_sort(F.collect_list(F.struct("line", "label")))
    whole = chained.groupBy(*PAGE, "first").agg(F.array_join(F.transform(parts, lambda p: p["label"]), " ").alias("label"), F.max_by("figures", "line").alias("figures"))
    return whole.withColumnRenamed("first", "line")


def positional_cells(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, row_no, col_no, cell) of the pages with a line of years; every row has all columns.

    words: doc_id, page_number, x0, y0, x1, y1, text.  Row 0 holds the years.
    """
    lines = lines_of(words)
    heads = header_bands(lines)
    body = lines.join(heads, PAGE).where("line > head")
    col = F.when(F.col("x") < F.get("bands", F.lit(0))["lo"], F.lit(0)).otherwise(F.get(F.filter("bands", lambda b: (b["lo"] <= F.col("x")) & (F.col("x") < b["hi"])), F.lit(0))["col_no"])
    placed = body.withColumn("col_no", col).groupBy(*PAGE, "line").agg(F.max(F.size("titles")).alias("n"), F.array_sort(F.collect_list(F.struct("x0", "y", "text", "col_no"))).alias("words"))
    of = lambda c: _texts(F.filter("words", lambda w: w["col_no"] == c))
    rows = placed.select(*PAGE, "line", F.regexp_replace(of(F.lit(0)), _NOTE, "").alias("label"), F.transform(F.sequence(F.lit(1), F.col("n")), of).alias("figures"))
    joined = with_wrapped_labels(rows.where(~F.col("label").rlike(_FOOTER)))
    table = joined.unionByName(heads.select(*PAGE, F.col("head").alias("line"), F.lit("").alias("label"), F.col("titles").alias("figures")))
    numbered = table.withColumn("row_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line")) - 1)
    return numbered.select(*PAGE, "row_no", F.posexplode(F.concat(F.array("label"), F.col("figures"))).alias("col_no", "cell"))
