from pyspark.sql import functions as F

from tallychain.operators import chain
from tallychain.streaming.append import append_stream, read_chain


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.range(40).select(F.col("id").alias("ord"), (F.col("id") + 1700000000).alias("ts"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("data"))
    for part in (rows.where("ord < 25"), rows.where("ord >= 25")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        append_stream(stream, sink, mark).awaitTermination(120)
    own = read_chain(spark, sink).drop("batch_id")
    batch = chain.fold(rows.withColumnRenamed("ord", "block_index"))
    assert sorted(map(tuple, own.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert chain.verify(own).first().is_valid
