"""The driver sends examples; the index is made where texts are scored."""

from pyspark.sql import functions as F

from wellspring.llm import toxicity


def test_the_driver_makes_no_index(spark, monkeypatch):
    rows = [(i, f"bad awful w{i % 9}" if i % 2 else f"good fine w{i % 7}") for i in range(80)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.range(80).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    made = []
    monkeypatch.setattr(toxicity.Index, "__init__", lambda self, *a: made.append(a))  # of this process; workers import their own
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    assert not made
    assert got == {i: i % 2 for i in range(80)}
