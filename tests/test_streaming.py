import uuid

from tabscope.streaming.live import running_kpis


def test_running_kpis_over_file_stream(spark, tmp_path):
    src = tmp_path / "landing"
    df = spark.range(100).selectExpr("id", "id * 2.0 AS amount")
    df.write.parquet(str(src / "batch1"))
    stream = spark.readStream.schema(df.schema).parquet(str(src / "batch1"))
    name = f"k_{uuid.uuid4().hex[:6]}"
    q = (running_kpis(stream).writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    row = spark.table(name).first()
    assert row["rows"] == 100 and row["sum_amount"] == 9900.0 and row["mean_id"] == 49.5
