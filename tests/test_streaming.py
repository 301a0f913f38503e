"""Row-wise operators on a streaming table give what they give on a table."""

from pyspark.sql import functions as F

from checks.bindings import COLS
from regiometra.domain import LAGGING
from regiometra.operators import cleaning as cl
from regiometra.operators import features as ft
from regiometra.operators import filters as fl


def derive(df):
    typed = cl.drop_invalid(cl.coerce_columns(df, ["iks", "ike", "ikl"]), "iks")
    scored = typed.withColumn("idm", (F.col("iks") + F.col("ike") + F.col("ikl")) / 3)
    return fl.filter_members(scored.withColumn("status", ft.classify_by_threshold("idm")), {"status": LAGGING}).select(
        "id", "status", ft.arg_min_column(COLS.dimension_of).alias("weakest"),
        ft.near_upgrade_band("idm", "status").alias("band"), ft.abs_difference("iks", "ike").alias("gap"))


def test_row_wise_operators_on_a_stream(spark, tmp_path):
    rows = [(i, str(i % 10 / 10) if i % 7 else "closed", str(i % 9 / 9), str(i % 8 / 8)) for i in range(200)]
    schema = "id int, iks string, ike string, ikl string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = derive(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination(60)
    want = derive(spark.createDataFrame(rows, schema))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert want.count() > 0 and sorted(got.collect()) == sorted(want.collect())
