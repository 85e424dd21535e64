import pytest
from pyspark.sql import functions as F

from corpusmill import session


@pytest.mark.parametrize("most", [10**6, 0])
def test_attached_is_a_join(spark, most):
    rows = spark.range(5_000).withColumn("text", F.repeat(F.lit("x"), 50)).withColumn("k", F.when(F.col("id") % 11 != 0, F.col("id") % 700))
    found = session.cut(spark.createDataFrame([(i, f"v{i}") for i in range(0, 3_000, 7)] + [(None, "null")], "k long, v string"))
    got = session.attached(rows, found, ["k"], F.length("v"), most)
    assert sorted((r.id, r.v) for r in got.collect()) == sorted((r.id, r.v) for r in rows.join(found, "k").collect()) and got.columns == ["k", "id", "text", "v"]
    if not most:  # what the bitmap leaves is little more than what is joined
        plan = got._jdf.queryExecution().toString()
        assert "_bits" in plan and session.attached(rows, found.limit(0), ["k"], None, -1).count() == 0


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkSession = type("S", (), {"sparkContext": Context(), "conf": type("C", (), {"get": staticmethod(lambda *a: None)})})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.cut(Fake())
