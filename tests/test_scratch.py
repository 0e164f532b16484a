import os

from rangevec.sources import scratch


def test_scratch_tables_stay_until_cleared(spark):
    df = scratch.materialize(spark.range(10).selectExpr("id", "id % 2 AS odd"), "numbers", ["odd"])
    assert df.count() == 10 and df.where("odd = 1").count() == 5
    top = scratch.shared_dir(spark).removeprefix("file://") + f"/rangevec/{spark.sparkContext.applicationId}"
    assert os.path.isdir(top)
    scratch.clear(spark)
    assert not os.path.exists(top)
