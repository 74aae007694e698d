"""What a fold sends to the driver."""

from __future__ import annotations

from pyspark.sql.classic.dataframe import DataFrame

from limnos.functions.folds import fold


def test_the_driver_gets_one_array(spark, monkeypatch):
    sent = []
    gather = DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: sent.append(gather(self)) or sent[-1])
    df = spark.range(0, 4000, 1, 40).selectExpr("array(cast(id AS double), 1D) AS v")
    total = fold(df, "v", lambda x: x.sum(axis=0))
    assert total.tolist() == [3999 * 2000.0, 4000.0] and [t.num_rows for t in sent] == [1]
    assert fold(df.limit(0), "v", lambda x: x.sum(axis=0)) is None
