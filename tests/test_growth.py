"""Work that must be shared by tasks, and results that must not depend on how it's shared."""

import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from loomstat.plans.queries import _round
from loomstat.plans.surface import standardisation_documents
from loomstat.sources import sinks
from loomstat.sources.cells import frame, variant_cell
from loomstat.sources.readers import read


@pytest.mark.parametrize("kind", ["csv", "jsonl"])
def test_one_file_of_lines_comes_from_all_tasks(spark, tmp_path, kind):
    rows = spark.range(0, 40, 1, 4).select("id", F.spark_partition_id().alias("task"))
    path = str(tmp_path / f"x.{kind}")
    for _ in range(2):  # what stands there is replaced
        sinks.write(frame(rows), path)
    lines = (tmp_path / f"x.{kind}").read_text().splitlines()
    found = [tuple(map(int, x.split(","))) for x in lines[1:]] if kind == "csv" else [tuple(json.loads(x).values()) for x in lines]
    assert found == [(k, k // 10) for k in range(40)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == [f"x.{kind}"]
    sinks.write(frame(rows.where("id < 0")), path)
    assert (tmp_path / f"x.{kind}").read_text() == ("id,task\n" if kind == "csv" else "")


LINES = ["a,b"] + [f'{k},"x ""{k}"", y"' for k in range(400)]


@pytest.mark.parametrize("extra, split", [([], True), (['7,"two\nlines"'], False), (['"a"",""b",7'], True), (['7,"a, b\nc,d"'], False), (["7,a\rb"], False)])
def test_csv_is_split_where_lines_are_rows(spark, tmp_path, extra, split):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(LINES[:200] + extra + LINES[200:]) + "\n", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        data = read(spark, str(path))
        if split:
            assert data.dealt().rdd.getNumPartitions() > 1
        whole = spark.read.csv(str(path), header=True, quote='"', escape='"', multiLine=True)
        assert sorted(map(tuple, data.dealt().collect())) == sorted(map(tuple, whole.collect()))
        assert data.count() == 400 + len(extra)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_values_are_taken_by_path(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(
        '{"n": 1, "x": 1, "t": "a", "b": true, "big": 9223372036854775807, "m": 1, "dot.ted": 2}\n'
        ' {"n": 2, "x": 1.50, "t": null, "b": null, "big": 1, "m": "s", "dot.ted": 3, "o": {"z": 1}}\n'
    )
    flat, kinds = sinks.tabular(read(spark, str(tmp_path / "t.jsonl")))
    assert kinds == {"n": "int64", "x": "float64", "t": "utf8", "b": "boolean", "big": "float64", "m": "utf8", "dot.ted": "int64", "o": "utf8"}
    assert sorted((r.asDict() for r in flat.collect()), key=lambda r: r["n"]) == [
        {"b": True, "big": 2.0**63, "dot.ted": 2, "m": "1", "n": 1, "o": None, "t": "a", "x": 1.0},
        {"b": None, "big": 1.0, "dot.ted": 3, "m": "s", "n": 2, "o": '{"z":1}', "t": None, "x": 1.5},
    ]
    (tmp_path / "u.jsonl").write_text('{"n": 1, "t": "a"}\n')
    flat, _ = sinks.tabular(read(spark, str(tmp_path / "u.jsonl")))
    assert "map<" not in flat._jdf.queryExecution().optimizedPlan().toString()


def test_kinds_of_variants_need_no_caught_errors(spark):
    texts = ["1", "1.0", "1.50", "9223372036854775808", "1e10", '"a"', "true", "null", "[1]", '{"a": 1}']
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, j string").select("k", F.parse_json("j").alias("v"))
    found = rows.select("k", variant_cell(F.col("v")).alias("c"))
    assert [(r["c"]["kind"], r["c"]["is_int"], r["c"]["label"]) for r in found.orderBy("k").collect()] == [
        ("number", True, "1"), ("number", False, "1.0"), ("number", False, "1.5"), ("number", True, "9223372036854775808"),
        ("number", False, "1.0E10"), ("string", False, "a"), ("boolean", False, "true"), ("null", False, None),
        ("array", False, None), ("object", False, None),
    ]
    assert "regexp_extract" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nine_digits_are_rounded_as_printf_does(spark, tmp_path):
    halves = [k / 40_000 for k in range(99_133_001, 99_134_001)] + [12345678.25, 123456789.5, 123456790.5, -2478.347325, 1.000000005e-9, 3.0, 0.0]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(halves)], "k int, x double")
    assert [r["x"] for r in sorted(_round(df).collect())] == [float(f"{x:.8e}") for x in halves]
    # 40,000 documents whose mean length is a half that lies below its decimal text
    total = next(k for k in range(99_133_001, 99_135_001) if f"{k / 40_000:.8e}" != f"{Decimal(repr(k / 40_000)).quantize(Decimal('1e-5'), ROUND_HALF_UP):.8e}")
    extra = total % 40_000
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), (total // 40_000 + (F.col("id") < extra).cast("int")).alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = standardisation_documents(spark, str(tmp_path)).first()
    assert found["mean_n_chars"] == float(f"{total / 40_000:.8e}")
    assert found["constant_spread"] == 1.0  # deviations of 40,000 threes, merged, weren't quite 0
