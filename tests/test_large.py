"""What once grew faster than its input."""

import re
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.sql import _let

SF = "/root/testdata/sf0.001"


def test_nested_lets_take_linear_time(spark):
    """Twenty-two levels: a step that asks twice for the type of the next takes minutes for these rows."""
    nested = lambda n, x: T.let(x + 1, lambda y: nested(n - 1, y) if n else y)
    began = time.perf_counter()
    rows = spark.range(400).repartition(2).select("id", nested(21, F.col("id")).alias("v")).collect()
    sql = "z"
    for _ in range(22):
        sql = _let("z", "z + 1", sql)
    called = spark.range(400).repartition(2).withColumnRenamed("id", "z").selectExpr("z", f"{sql} AS v").collect()
    assert time.perf_counter() - began < 30
    assert all(r.v == r.id + 22 for r in rows) and all(r.v == r.z + 22 for r in called)


def _selected(text, page_count, most=20):
    """Pages and reason in plain Python."""
    text = text.strip()
    parts = re.split(r"[,，\s]+", text) if text else []
    if any(not re.fullmatch(r"\d+([-–]\d+)?", p) for p in parts):
        return None, "FORMAT"
    ends = [(int(m[0]), int(m[-1])) for m in (re.split("[-–]", p) for p in parts)]
    if any(a < 1 or b < a or b > page_count for a, b in ends):
        return None, "BOUNDS"
    pages = sorted({n for a, b in ends for n in range(a, b + 1)})
    return (None, "TOO_MANY") if len(pages) > most or any(b - a >= most for a, b in ends) else (pages, "")


def test_page_selection_on_odd_texts(spark):
    texts = ["", "  ", "3", "3-5", "3–5，4 7", "x3", "3-", "-3", "3,", ",3", "0-4", "5-4", "1-100", "1-20", "1-21", "1-15,20-30", "7,7-7,7", "99-101", "1 - 3", "　3-4　", "3--5", "3-4-5"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    pages, reason = T.page_selection(F.col("t"), F.lit(100))
    assert [(r.p, r.r) for r in df.select(pages.alias("p"), reason.alias("r")).collect()] == [_selected(x, 100) for x in texts]
    plan = df.select(pages.alias("p"), reason.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2, "the parts are cut once for each of the two columns at most"


def test_loads_of_a_stream_have_several_files(spark, monkeypatch, tmp_path):
    """Four loads are four batches, and each lies in as many files as tasks wrote it."""
    from factloom.plans import streams

    monkeypatch.setattr(streams, "fresh", lambda _, tag: f"file://{tmp_path}/{tag}")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert streams._streamed(spark, SF).count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(list((tmp_path / "arriving").glob("part-*.parquet"))) >= 8
    assert {x.name for x in (tmp_path / "consensus/progress/commits").iterdir() if x.name.isdigit()} >= {"0", "1", "2", "3"}


@pytest.mark.parametrize("each", [500, 10**9])
def test_words_are_dealt_by_their_number(spark, monkeypatch, each):
    from factloom.operators import ocr

    monkeypatch.setattr(ocr, "TASK_WORDS", each)
    n = F.col("id")
    words = spark.range(5000).select((n % 40).alias("doc_id"), (n % 3).alias("page_number"), *[(n * k % 50).cast("double").alias(c) for k, c in ((7, "x0"), (3, "y0"), (7, "x1"), (3, "y1"))], F.concat(F.lit("w"), n).alias("text"), F.lit(1.0).alias("score"))
    got = ocr.checked_words(words)
    assert got.rdd.getNumPartitions() == 5000 // each + 1
    rows = [r for r in got.collect() if r.doc_id == 7 and r.page_number == 1]
    assert [r.place for r in sorted(rows, key=lambda r: (r.band, r.x0, r.text))] == list(range(1, len(rows) + 1)) and len(rows) > 30


def test_tables_of_few_bytes_are_read_by_several_tasks(spark, monkeypatch):
    """Rows that compress to nothing lie in files of bounded length, as a small file is one task's."""
    from factloom.sources import scratch

    rows = spark.range(4000).select(F.lit("x").alias("x")).coalesce(1)
    monkeypatch.setattr(scratch, "FILE_ROWS", 500, raising=False)
    table = scratch.kept(rows, "few-bytes")
    assert table.count() == 4000 and len(table.inputFiles()) == 8 and table.rdd.getNumPartitions() >= 2


def test_order_lines_are_read_once(spark):
    """Texts, cells and words of reports are filled from one table of numbers."""
    from factloom.plans import grids

    plans = [grids.sums(spark, SF).inputFiles() for _ in range(2)]
    assert plans[0] == plans[1] and not any("lineitem" in f for f in plans[0])
