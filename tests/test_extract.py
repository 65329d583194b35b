"""Lines, wrapped labels and whole extraction on small reports."""

import random
import re

from pyspark.sql import functions as F

from factloom.operators import extract, positional, tables


def _lines(heights):
    """Number of the line of each height, heights ascending: the newest of the last four lines that is near."""
    starts, out = [], []
    for y in heights:
        near = next((i for i in range(len(starts) - 1, max(len(starts) - 5, -1), -1) if abs(starts[i] - y) <= 3), None)
        if near is None:
            near = len(starts)
            starts.append(y)
        out.append(near)
    return out


def test_lines_against_a_loop(spark):
    rng = random.Random(4)
    words, expected = [], {}
    for page in range(6):
        heights = sorted(rng.choice([rng.uniform(0, 60), float(rng.randrange(60))]) for _ in range(page * 15))
        for i, (y, line) in enumerate(zip(heights, _lines(heights), strict=True)):
            words.append((1, page, 0.0, y - 1, 1.0, y + 1, f"w{i}"))
            expected[page, f"w{i}"] = line
    df = spark.createDataFrame(words, "doc_id int, page_number int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.page_number, r.text): r.line for r in positional.lines_of(df).collect()}
    # the middle of a box may differ from the height drawn in the last bit
    assert sum(got[k] != expected[k] for k in got) == 0 and len(got) == len(expected)


def test_wrapped_labels_against_a_loop(spark):
    rng = random.Random(5)
    labels = ["", "Total,", "of which", "Note 3", "note three", "Revenues:", "Salaries", "and wages,", "Cash flows from operations"]
    rows = [(page, i, rng.choice(labels), [rng.choice(["", "", "5"]), rng.choice(["", "", "6"])]) for page in range(60) for i in range(12)]
    expected = []
    for page in range(60):
        done = []
        for _, _, label, figures in (r for r in rows if r[0] == page):
            last = done[-1] if done else None
            if last and last[0] and not any(last[1]) and label and (last[0].endswith(",") or re.match("[a-z]", label)) and not re.match(r"(?i)(note|revenues|attributable to|cash flows from)\b", last[0]):
                label = done.pop()[0] + " " + label
            done.append((label, figures))
        expected += [(page, *d) for d in done]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, page_number int, line int, label string, figures array<string>")
    got = [(r.page_number, r.label, r.figures) for r in positional.with_wrapped_labels(df).orderBy("page_number", "line").collect()]
    assert got == expected


def test_later_values_meet_all_earlier_ones(spark):
    rows = [(1, 0, 0, 1.0), (1, 0, 0, 9.0), (1, 0, 3, 2.0), (1, 1, 0, 1.0), (1, 1, 1, None), (2, 0, 0, 5.0), (2, 0, 1, 5.0)]
    facts = spark.createDataFrame(rows, "doc_id int, table_no int, metric_ordinal int, value double").selectExpr(
        "*", "'income_statement' statement_type", "'unknown' scope", "'revenue' canonical_name", "2025 year", "'annual' period_type", "cast(null as string) end_date", "false is_restated", "1 col_no", "4 source_page", "'CNY' currency", "1e6 multiplier"
    )
    got = sorted((r.doc_id, r.table_no, r.metric_ordinal, r.value, r.earlier_value) for r in tables.conflicting_pairs(facts).collect() if r.value is not None)
    assert got == [(1, 0, 3, 2.0, 1.0), (1, 0, 3, 2.0, 9.0), (1, 1, 0, 1.0, 2.0), (1, 1, 0, 1.0, 9.0)]
    assert tables.conflicting_pairs(facts).where("value is null").count() == 4


def test_recognised_pages_are_of_low_confidence(spark):
    figures = " / ".join(f"1,{i:03d}" for i in range(1, 23))
    pages = spark.createDataFrame([(1, 1, f"利润表\n单位：人民币百万元\n2025年 2024年\n{figures}"), (2, 1, None), (3, 1, "")], "doc_id int, page_number int, text string")
    grid = [["项目", "2025年", "2024年"], ["营业收入", "10", "9"]]
    cells = spark.createDataFrame([(1, 1, "native", 0, r, c, x) for r, row in enumerate(grid) for c, x in enumerate(row)], "doc_id int, page_number int, method string, table_no int, row_no int, col_no int, cell string")
    made = extract.extract(pages, cells, pages.where("doc_id = 1"))
    assert {(r.extraction_method, r.confidence, r.value) for r in made["facts"].collect()} == {("local_ocr", "low", 10.0), ("local_ocr", "low", 9.0)}
    warned = {(r.doc_id, r.warning) for r in made["warnings"].collect()}
    assert warned == {(1, "RECOGNISED"), (1, "MISSING"), (2, "NO_RANGES"), (3, "NO_RANGES")}
    empty = extract.extract(pages.where("false"), cells.where("false"))
    assert [empty[k].count() for k in ("facts", "warnings", "statements", "reports")] == [0, 0, 0, 0]
    assert made["reports"].where("doc_id = 1").first().currency == "CNY"
    assert pages.where(F.col("text").isNull()).count() == 1
