"""A source that fails beside one that doesn't."""

from chronolake.streaming.supervise import Supervisor


def test_failing_source_is_given_up_and_others_go_on(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    tries, seen = [], []

    def source(name, each):
        def make():
            tries.append(name)
            s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
            return s.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()

        return make

    def shaky(df, n):
        if tries.count("shaky") < 3:
            raise ValueError("not yet")
        seen.append(("shaky", df.count()))

    sup = Supervisor(spark)
    try:
        sup.start("sound", source("sound", lambda df, n: seen.append(("sound", df.count()))))
        sup.start("bad", source("bad", lambda df, n: 1 / 0))
        sup.start("shaky", source("shaky", shaky))
        sup.start("absent", lambda: 1 / 0)
        assert sup.wait(120)
    finally:
        sup.stop()
    assert sup.given_up() == ["absent", "bad"] and tries.count("bad") == 3 and tries.count("sound") == 1 and tries.count("shaky") == 3
    assert sorted(seen) == [("shaky", 5), ("sound", 5)] and sup.breaker.failures["shaky"] == 0
