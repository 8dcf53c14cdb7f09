
import json

from pyspark.sql import functions as F

from docsmelt.sources import store


def test_report_keeps_every_row_in_order(spark, tmp_path):
    papers = spark.range(2500).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("half")).orderBy(F.desc("id"))
    store.write_report({"papers": papers, "none": papers.limit(0), "one": spark.sql("SELECT 'a' AS x")}, str(tmp_path / "r"), spark)
    rows = [json.loads(line) for f in (tmp_path / "r").glob("part-*") for line in f.read_text().splitlines()]
    got = sorted((r["part"], r["row"], json.loads(r["value"])["id"]) for r in rows if r["part"] == "papers")
    assert got == [("papers", i, 2499 - i) for i in range(2500)]
    assert [(r["part"], r["row"], r["value"]) for r in rows if r["part"] != "papers"] == [("one", 0, '{"x":"a"}')]
