"""Cells of labelled rows are not gathered in one task."""

from pyspark.sql import functions as F

from lexspark.llm import quality_rules
from lexspark.llm.common import table
from tests.conftest import SF


def test_cells_keep_their_partitions(spark, monkeypatch):
    stored = []
    whole = quality_rules.materialise
    monkeypatch.setattr(quality_rules, "materialise", lambda df, name: stored.append((name, df)) or whole(df, name))
    docs = table(spark, SF, "documents").withColumn("label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    quality_rules.judge(docs.select("doc_id", "text"), docs.select("doc_id", F.col("label").alias("quality")))
    (cells,) = [df for name, df in stored if name == "quality-cells"]
    assert "Coalesce" not in cells._jdf.queryExecution().executedPlan().toString()
