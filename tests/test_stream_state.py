"""The set of ids on a stream: a million of them, and a restart."""

from pyspark.sql import functions as F

from valuescout.streaming import cleaning as st


def test_a_million_ids_and_a_restart(spark, tmp_path):
    ids, out, log = (str(tmp_path / name) for name in ("ids", "out", "log"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def arrive(first, last):
        new = spark.range(first, last).select(F.concat(F.lit("  "), F.col("id"), F.lit(".0 ")).alias("listing_id"))
        corrupt = spark.createDataFrame([("x1",), (None,)], "listing_id string")
        new.union(new.limit(500)).union(corrupt).write.mode("append").parquet(ids)

    def run():
        stream = spark.readStream.schema("listing_id string").parquet(ids)
        st.append_available(st.distinct_id_stream(stream), out, log)
        return spark.read.parquet(out)

    arrive(0, 600_000)
    assert run().count() == 600_000
    arrive(400_000, 1_000_000)  # a third of them seen before
    found = run()
    assert found.count() == found.distinct().count() == 1_000_000
    assert found.agg(F.min(F.col("listing_id").cast("long")), F.max(F.col("listing_id").cast("long"))).first() == (0, 999_999)
    assert run().count() == 1_000_000  # nothing new
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == st.STATE_SETTINGS["spark.sql.streaming.stateStore.providerClass"]
    assert any(f.suffix in (".changelog", ".zip") for f in (tmp_path / "log" / "state").rglob("*"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
