import json

import pytest
from pyspark.sql import functions as F

from loomstat.functions import text
from loomstat.operators import diff, evaluate, pairs, profile, ranking, structure
from loomstat.sources import sinks
from loomstat.sources.cells import cells, frame
from loomstat.sources.readers import read


def stored(tmp_path, rows):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def test_json_kinds_labels_and_absence(spark, tmp_path):
    path = tmp_path / "n.jsonl"
    path.write_text('{"v":1}\n{"v":1.0}\n\n{"v":1e3}\n{"v":"1"}\n{"v":true}\n{"v":null}\n{}\n{"v":18446744073709551615}\n')
    data = read(spark, str(path))
    rows = cells(data).collect()
    assert [r["label"] for r in rows if r["label"]] == ["1", "1.0", "1000.0", "1", "true", "18446744073709551615"]
    assert [r["is_int"] for r in rows if r["kind"] == "number"] == [True, False, False, True]
    row = profile.column_profile(cells(data), data.count()).first()
    assert (row["non_null_count"], row["null_count"], row["missing_count"], row["distinct_count"]) == (6, 1, 1, 6)


def test_rows_must_be_objects(spark, tmp_path):
    for name, body in (("a.json", "[1, 2]"), ("b.jsonl", '{"a":1}\n3')):
        (tmp_path / name).write_text(body)
        with pytest.raises(Exception, match="expected a JSON object"):
            cells(read(spark, str(tmp_path / name))).collect()
    (tmp_path / "one.json").write_text('{"a": 1}')
    assert read(spark, str(tmp_path / "one.json")).count() == 1


def test_dominant_kind_ties_go_to_the_later_kind(spark, tmp_path):
    data = read(spark, stored(tmp_path, [{"v": 1}, {"v": "a"}, {"w": None}]))
    found = {r["column"]: r["dominant_type"] for r in profile.presence(cells(data), 3).collect()}
    assert found == {"v": "string", "w": "null"}


def nums(spark, values):
    return spark.createDataFrame([(k, "x", float(v)) for k, v in enumerate(values)], "row_id long, column string, num double")


def test_single_and_constant_values(spark):
    row = profile.numeric_moments(nums(spark, [4])).first()
    assert row["is_constant"] and row["skewness"] == 0 and row["kurtosis_excess"] == 0
    flags = profile.numeric_monotone(nums(spark, [4])).first()
    assert flags["monotonic_increasing"] and flags["monotonic_decreasing"]
    order = profile.numeric_order(nums(spark, [4])).first()
    assert (order["median"], order["mad"], order["iqr"]) == (4, 0, 0)


def test_order_statistics_match_numpy(spark):
    import numpy as np

    values = np.random.default_rng(1).normal(0, 10, 3001).round(1)
    row = profile.numeric_order(nums(spark, values)).first()
    for share, name in ((25, "p25"), (50, "p50"), (75, "p75"), (95, "p95")):
        assert row[name] == pytest.approx(np.percentile(values, share))
    assert row["mad"] == pytest.approx(np.median(np.abs(values - np.median(values))))
    assert row["duplicate_count"] == len(values) - len(set(values.tolist()))


def test_order_statistics_over_many_ranges(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranking, "RANGE", 40)
    values = np.random.default_rng(2).integers(-500, 500, 1200) / 4
    row = profile.numeric_order(nums(spark, values)).first()
    assert row["p95"] == pytest.approx(np.percentile(values, 95)) and row["mad"] == pytest.approx(np.median(np.abs(values - np.median(values))))
    counts = spark.createDataFrame([(k % 3, float(k), 1 + k % 2) for k in range(300)], "key long, v double, n long")
    for key in range(3):
        mine = [(k, 1 + k % 2) for k in range(300) if k % 3 == key]
        got = [r["rank"] for r in ranking.average_ranks(counts, ["key"], "v").where(f"key = {key}").orderBy("v").collect()]
        assert got == [sum(m for j, m in mine if j < k) + (n + 1) / 2 for k, n in mine]


@pytest.mark.parametrize("size", [10**6, 64])
def test_monotone_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(ranking, "RANGE", size)
    up = [k // 2 for k in range(1000)]
    for values, want in ((up, (True, False)), (up[::-1], (False, True)), (up[:500] + [0] + up[500:], (False, False))):
        row = profile.numeric_monotone(nums(spark, values)).first()
        assert (row["monotonic_increasing"], row["monotonic_decreasing"]) == want


def test_tied_ranks(spark):
    counts = spark.createDataFrame([("k", 1.0, 2), ("k", 2.0, 1), ("k", 3.0, 3)], "key string, v double, n long")
    assert [r["rank"] for r in ranking.average_ranks(counts, ["key"], "v").orderBy("v").collect()] == [1.5, 3.0, 5.0]


def test_constant_pair(spark):
    df = spark.createDataFrame([(1.0, float(k)) for k in range(5)], "a double, b double")
    row = pairs.pair_numeric(pairs.paired(frame(df))).first()
    assert (row["pearson_correlation"], row["slope"], row["intercept"]) == (0, 0, 2)
    assert pairs.pair_spearman(pairs.paired(frame(df))).first()["spearman_correlation"] == 0


def test_labels_with_the_separator(spark):
    df = spark.createDataFrame([("a | b", "c"), ("a", "b | c"), ("a", "c")], "l string, r string")
    p = pairs.paired(frame(df))
    row = pairs.pair_categorical(p).first()
    assert row["distinct_pair_count"] == 3
    assert row["chi_square"] == pytest.approx(1 / 3 * (1 / 4) + (1 - 2 / 3) ** 2 / (2 / 3) + (1 - 4 / 3) ** 2 / (4 / 3) - 1 / 12 + (1 - 2 / 3) ** 2 / (2 / 3), abs=0.5)


CASES = {
    text.email_like: ({"a@b.c", " a@b.c "}, {"a@b", "@b.c", "a@@b.c", ""}),
    text.ip_like: ({"1.2.3.4", "::1", "fe80::1:2", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4"}, {"01.2.3.4", "1.2.3", "256.1.1.1", " 1.2.3.4", "1:2:3", "1::2::3"}),
    text.uuid_like: ({"550e8400-e29b-41d4-a716-446655440000", "550e8400e29b41d4a716446655440000", "{550e8400-e29b-41d4-a716-446655440000}", "urn:uuid:550e8400-e29b-41d4-a716-446655440000"}, {"550e8400", "550e8400-e29b41d4a716446655440000"}),
    text.url_like: ({"HTTP://x", "www.x", " https://a\nb"}, {"ftp://x", "http:/x"}),
    text.phone_like: ({"+1 555 123 4567", "(555) 123-4567"}, {"5551234567", "2024-01-05", "1.2.3.4", "555-12", "555 1234 ext 5"}),
    text.json_like: ({"{}", " [1]\n", "{not json}"}, {"{", "[}", ""}),
    text.numeric_like: ({"1", " 1e5 ", "-.5", "inf", "NaN", "+Infinity", "1."}, {"1d", "", "1,5", "0x1"}),
    text.boolean_like: ({"Yes", " n ", "0", "TRUE"}, {"2", "on", ""}),
    text.hex_like: ({"0xBEEF", "abcd"}, {"abc", "0x12g4"}),
    text.base64_like: ({"YWJjZGVm", "YWJjZA=="}, {"YWJj", "YWJjZ===", "YWJj ZGV"}),
    text.mac_like: ({"00:1a:2B:3c:4d:5e", "00-1a-2b-3c-4d-5e"}, {"00:1a:2b-3c:4d:5e", "00:1a:2b:3c:4d"}),
    text.zip_like: ({"12345", "12345-6789"}, {"1234", "12345-", "１２３４５"}),
    text.date_like: ({"2024-01-05", "2016-02-03T07:55:29Z", "2024-01-05T10:00:00+02:00"}, {"2024", "2024-13-45", "2024-02-30", "2024-1-5"}),
    text.whitespace_only: ({" ", "　\n"}, {"", "a"}),
    text.ascii_only: ({"", "abc\n"}, {"é"}),
}


@pytest.mark.parametrize("like", CASES, ids=lambda f: f.__name__)
def test_predicates(spark, like):
    yes, no = CASES[like]
    df = spark.createDataFrame([(s,) for s in sorted(yes | no)], "s string")
    assert {r["s"] for r in df.where(like(F.col("s"))).collect()} == yes


def test_times_are_utc(spark):
    df = spark.createDataFrame([("2024-01-05T10:00:00+02:00",)], "s string")
    got = df.select(F.date_format(text.parse_datetime(F.col("s")), "yyyy-MM-dd HH:mm").alias("t")).first()["t"]
    assert got == "2024-01-05 08:00"


def test_empty_inputs(spark, tmp_path):
    empty = spark.createDataFrame([], "a double, b string")
    assert profile.numeric_summary(cells(frame(empty))).count() == 0
    assert evaluate.distance_summary(spark.createDataFrame([], "d double")).first().asDict() == {
        "count": 0, "min": 0.0, "p5": 0.0, "median": 0.0, "mean": 0.0, "p95": 0.0, "max": 0.0
    }
    (tmp_path / "h.csv").write_text("a,b\n")
    data = read(spark, str(tmp_path / "h.csv"))
    assert data.columns() == ["a", "b"] and data.count() == 0


def test_nearest_neighbours(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [3.0])], "row_no long, x array<double>")
    got = {r["row_no"]: (r["d1"], r["d2"]) for r in evaluate.nearest_two(df, df, exclude_self=True, block=2).collect()}
    assert got == {0: (0.0, 3.0), 1: (0.0, 3.0), 2: (3.0, 3.0)}
    one = evaluate.nearest_two(df, df.where("row_no = 0"))
    assert {r["d"] for r in evaluate.distance_ratio(one).collect()} == {1.0}


def test_propensity_both_ways(spark, monkeypatch):
    a = spark.createDataFrame([(k, [float(k % 5), float(k % 3)]) for k in range(40)], "row_no long, x array<double>")
    b = spark.createDataFrame([(k, [float(k % 5) + 1, float(k % 3)]) for k in range(40)], "row_no long, x array<double>")
    small = evaluate.propensity(a, b)
    monkeypatch.setattr(evaluate, "IN_MEMORY_CELLS", 0)
    monkeypatch.setattr(evaluate, "STEPS", 5)
    few = evaluate.propensity(a, b)
    assert small["auc"] > 0.6 and set(few) == set(small) and few["auc"] > 0.5


def test_diff_of_frames(spark):
    before = nums(spark, [1, 2, 3])
    after = nums(spark, [2, 4, 6])
    one = lambda n: profile.numeric_moments(n).join(profile.numeric_order(n), "column")
    row = diff.numeric_diff(one(before), one(after)).first()
    assert (row["min_delta"], row["mean_delta"], row["sum_delta"], row["median_delta"]) == (1, 2, 6, 2)


def test_names_with_dots_keep_their_paths(spark, tmp_path):
    data = read(spark, stored(tmp_path, [{"a.b": 1, "a": {"b": [{"c": None}]}}]))
    steps = {tuple(r["steps"]): r["kind"] for r in structure.path_stats(data).collect()}
    assert steps[(".a.b",)] == "number" and steps[(".a", ".b", "[]", ".c")] == "null"


def test_the_last_of_columns_of_one_name_counts(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,a,a\n1,"x\ny",2\n3,z,4\n')
    data = read(spark, str(path))
    assert data.columns() == ["a", "id"]
    assert sorted((r["id"], r["a"]) for r in data.rows.collect()) == [("1", "2"), ("3", "4")]
    (tmp_path / "r.csv").write_text("id,a,a\n1,2\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ"):
        read(spark, str(tmp_path / "r.csv")).rows.collect()


def test_large_csv_files_can_be_split(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id,s\n" + "".join(f"{k},{'v' * 40}\n" for k in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert read(spark, str(path)).rows.rdd.getNumPartitions() == 1
        data = read(spark, str(path), multi_line=False)
        assert data.rows.rdd.getNumPartitions() > 4 and data.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parts_that_nobody_sees_are_an_error(spark, tmp_path, monkeypatch):
    path = tmp_path / "out.jsonl"
    path.write_text("what was there\n")
    lines = spark.createDataFrame([("{}",)], "value string")
    with pytest.raises(OSError, match="doesn't see"):
        sinks._one_file(lines, str(path), lambda writer, folder: None)
    assert path.read_text() == "what was there\n"
    sinks._one_file(lines, str(path), lambda writer, folder: writer.text(folder))
    assert path.read_text() == "{}\n" and sorted(x.name for x in tmp_path.iterdir()) == ["out.jsonl"]


def test_sinks_of_no_rows_and_of_parts(spark, tmp_path):
    empty = frame(spark.createDataFrame([], "a long, b string"))
    for kind in ("json", "jsonl", "csv", "avro", "parquet"):
        sinks.write(empty, str(tmp_path / f"none.{kind}"))
        assert read(spark, str(tmp_path / f"none.{kind}")).count() == 0
    assert json.loads((tmp_path / "none.json").read_text()) == []
    many = frame(spark.range(100).repartition(3))
    for kind in ("jsonl", "csv", "parquet", "json"):
        sinks.write(many, str(tmp_path / f"many.{kind}"), single=False)
        assert read(spark, str(tmp_path / f"many.{kind}")).count() == 100


def test_columns_of_nulls_are_not_reviewed(spark):
    a = spark.createDataFrame([(None, "x", 1.0), (None, None, 2.0)], "u string, v string, w double")
    assert evaluate.scalar_columns(a, a, ["u", "v", "w"]) == ["v"]


def test_nearest_of_many_blocks_matches_brute_force(spark):
    import numpy as np

    from loomstat.operators.neighbours import nearest

    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, (70, 3)).astype(float) * 1e4, rng.integers(0, 9, (90, 3)).astype(float) * 1e4
    table = lambda v: spark.createDataFrame([(k, list(map(float, p))) for k, p in enumerate(v)], "row_no long, x array<double>")
    for block in (8, 1000):
        got = {r["row_no"]: (r["gaps"], r["near"]) for r in nearest(table(x), table(y), 5, block=block).collect()}
        for k, p in enumerate(x):
            gaps = np.sqrt(((y - p) ** 2).sum(axis=1))
            order = np.lexsort((np.arange(90), gaps))[:5]
            assert got[k][1] == order.tolist() and got[k][0] == gaps[order].tolist()
    assert nearest(table(x[:0]), table(y), 2).count() == 0
    assert [r["near"] for r in nearest(table(x[:1]), table(y[:0]), 2).collect()] == [[]]


def test_places_follow_row_order(spark):
    from loomstat.operators import synth

    df = spark.range(0, 500, 1, 7)
    assert [r["place"] for r in synth.numbered(df).orderBy("id").collect()] == list(range(500))
    assert synth.numbered(df.where("id < 0")).count() == 0
