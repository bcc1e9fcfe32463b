from pyspark.sql import functions as F

from assayer.streaming import windowed_scores


def test_stream_gives_the_batch_numbers(spark, tmp_path):
    rows = [(i, float(i % 3), 0.5 + i % 4, -1.0 if i == 5 else 1.0 + i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, y double, mu double, w double").withColumn("t", F.timestamp_seconds(F.col("i") * 60))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    score = lambda d: windowed_scores(d, "y", "mu", "poisson", "t", "10 minutes", "1 hour", "w")
    q = score(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("scores").outputMode("complete").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    stream, batch = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()) for d in (spark.table("scores"), score(df)))
    assert stream == batch and len(batch) == 4 and sum(r[3] for r in batch) == 1
