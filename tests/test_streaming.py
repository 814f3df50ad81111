import pytest

from loomstat.streaming import incremental


def test_batches_merge_to_the_whole(spark, tmp_path):
    rows = [(k, float(k % 7) - 3, None if k % 5 == 0 else "x") for k in range(100)]
    whole = spark.createDataFrame(rows, "id long, v double, s string")
    for part in range(4):
        whole.where(f"id % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.profile_stream(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = {r["column"]: r for r in incremental.merged(spark, str(tmp_path / "state")).collect()}
    values = [r[1] for r in rows]
    assert got["v"]["number_count"] == 100 and got["v"]["sum"] == pytest.approx(sum(values))
    assert got["v"]["variance"] == pytest.approx(sum(x * x for x in values) / 100 - (sum(values) / 100) ** 2)
    assert (got["s"]["count"], got["s"]["null_count"], got["s"]["number_count"]) == (100, 20, 0)
