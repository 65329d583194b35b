"""Queries that once did less than their whole job."""

from pyspark.sql import functions as F

from factloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_counts_of_every_statement(spark, duck):
    """A report of every supplier, scope and year has ten metrics; only gross profits and net incomes are left out by rule."""
    line = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y"), "l_linestatus").distinct().collect()
    reports = {("consolidated", r.s, r.y) for r in line} | {("parent", r.s, r.y) for r in line if r.l_linestatus == "F"}
    expected = sum(10 - (s % 3 != 0) - (s % 10 == 9 and y == 1997) for _, s, y in reports)
    assert sum(r.n for r in catalog.QUERIES["comparison_status_counts"](spark, SF).collect()) == expected
    assert sum(r[3] for r in duck.sql(catalog.ORACLES["comparison_status_counts"]).fetchall()) == expected
