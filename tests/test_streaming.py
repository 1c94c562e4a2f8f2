from pyspark.sql import functions as F

from tandem.streaming.running import CALLS, arriving, genotypes_on_arrival, running_counts, windowed_depth


def calls(spark, n, count):
    return spark.createDataFrame([("L", f"r{i}", "spanning", [count]) for i in range(n)], CALLS)


def test_counts_and_genotypes(spark, tmp_path):
    path, got = str(tmp_path / "in"), []
    calls(spark, 6, 10).write.parquet(path)
    q = genotypes_on_arrival(arriving(spark, path), lambda df, i: got.append(df.select("locus_id", "n_reads", "is_significant").collect()), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        calls(spark, 6, 17).unionByName(spark.createDataFrame([("M", "m", "spanning", [3])], CALLS)).write.mode("append").parquet(path)
        q.processAllAvailable()
        spark.createDataFrame([("M", "n", "spanning", [3])], CALLS).write.mode("append").parquet(path)
        q.processAllAvailable()
    finally:
        q.stop()
    assert [sorted((r.locus_id, r.n_reads, r.is_significant) for r in batch) for batch in got] == [[("L", 6, False)], [("L", 12, True), ("M", 1, False)], [("M", 2, False)]]
    counts = running_counts(spark.read.schema(CALLS).parquet(path))
    assert sorted((r.kmer_count[0], r.n) for r in counts.collect()) == [(3, 2), (10, 6), (17, 6)]


def test_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(20).select(F.lit("L").alias("locus_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts")).write.parquet(path)
    stream = spark.readStream.schema("locus_id string, ts timestamp").parquet(path)
    q = windowed_depth(stream, "ts", "5 minutes", "1 minute").writeStream.format("memory").queryName("depth").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.n for r in spark.table("depth").orderBy("start").collect()] == [5, 5, 5]
