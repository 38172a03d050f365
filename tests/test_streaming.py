import datetime as dt

from pyspark.sql import functions as F

from tidegrid.streaming.tokens import stream_tokens

SCHEMA = "session_id string, ts timestamp, heading_deg double, pitch_deg double, roll_deg double, speed_mps double, rpm double, gear double"


def shown(df):
    """Sorted rows; means are rounded, as their sums come in another order."""
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [("D_A", start + dt.timedelta(milliseconds=17 * i), float(i % 90), 1.0, 2.0, float("nan") if i % 50 == 3 else 3.0 + i, 4.0, float(i % 6)) for i in range(600)]
    # a last row far ahead moves the watermark past everything else
    data.append(("D_A", start + dt.timedelta(hours=1), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    df = spark.createDataFrame(data, SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = stream_tokens(stream).writeStream.outputMode("append").format("memory").queryName("tokens").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = stream_tokens(df).where(F.col("token_start") < F.lit(start + dt.timedelta(minutes=1)))
    assert shown(spark.table("tokens")) == shown(want)
