import json

import numpy as np
import pytest

from loomstat import cli
from loomstat.operators import diffusion, evaluate, synth
from loomstat.plans import report, schema
from loomstat.sources.cells import frame
from loomstat.sources.readers import detect_format, read
from loomstat.sources.sinks import write
from tests import fixtures


@pytest.fixture
def stored(tmp_path):
    def store(rows, name="seed lots.json"):
        path = tmp_path / name
        path.write_text(json.dumps(rows) if name.endswith("json") else "\n\n".join(map(json.dumps, rows)) + "\n")
        return str(path)

    return store


def test_a_report_of_flat_rows(spark, stored):
    stats = report.analyze(read(spark, stored(fixtures.LOTS)))
    columns = {c["name"]: c for c in stats["columns"]}
    assert (stats["row_count"], stats["column_count"], stats["format"]) == (4, 8, "json")
    assert list(columns) == sorted(fixtures.LOTS[0])
    grams = columns["grams"]["numeric_summary"]
    values = np.array([r["grams"] for r in fixtures.LOTS], float)
    assert (grams["sum"], grams["mean"], grams["median"]) == (400, 100, 125)
    assert grams["stddev"] == pytest.approx(values.std()) and grams["p95"] == pytest.approx(np.percentile(values, 95))
    assert grams["monotonic_decreasing"] and not grams["monotonic_increasing"]
    assert (grams["positive_count"], grams["negative_count"], grams["zero_count"], grams["duplicate_count"]) == (3, 1, 0, 0)
    species = columns["species"]
    assert (species["non_null_count"], species["null_count"], species["missing_count"], species["distinct_count"]) == (3, 1, 0, 2)
    assert species["top_values"][0] == {"value": "rye", "count": 2, "ratio": pytest.approx(2 / 3)}
    found = {c: {k: columns[c]["string_summary"][f"{k}_count"] for k in ("date_like", "email_like", "url_like", "json_like", "empty")} for c in ("sown", "keeper", "page", "extra")}
    assert found["sown"] == {"date_like": 3, "email_like": 0, "url_like": 0, "json_like": 0, "empty": 1}
    assert found["keeper"]["email_like"] == 2 and found["page"]["url_like"] == 3 and found["extra"]["json_like"] == 3
    assert columns["sown"]["temporal_summary"] == {"count": 3, "min": "2023-03-14T00:00:00+00:00", "max": "2023-04-02T00:00:00+00:00"}


def test_a_report_of_pairs(spark, stored):
    stats = report.analyze(read(spark, stored(fixtures.LOTS)))
    pairs = {(p["left"], p["right"]): p for p in stats["column_pairs"]}
    assert len(pairs) == 28
    x, y = (np.array([r[c] for r in fixtures.LOTS], float) for c in ("grams", "lot"))
    numeric = pairs[("grams", "lot")]["numeric_relationship"]
    slope, intercept = np.polyfit(x, y, 1)
    assert numeric["pearson_correlation"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert (numeric["slope"], numeric["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    assert numeric["spearman_correlation"] == pytest.approx(-1)
    both = pairs[("species", "store")]
    assert (both["paired_non_null_count"], both["both_null_or_missing_count"], both["shared_distinct_scalar_count"]) == (3, 0, 0)
    assert both["categorical_relationship"]["distinct_pair_count"] == 2
    assert both["categorical_relationship"]["cramers_v"] > 0
    text = report.to_markdown(stats)
    assert "# Dataset Statistics Report" in text and "## Numeric Column Pairs" in text and f"| grams | lot | 4 | {numeric['pearson_correlation']:.4f} |" in text
    assert json.loads(report.to_json(stats))["column_count"] == 8


def test_structure(spark, stored):
    s = report.analyze(read(spark, stored(fixtures.SENSORS)))["structure"]
    paths = {f["path"]: f for f in s["nested_fields"]}
    assert set(paths) == {"mount", "mount.height", "mount.wall", "mount.wall.owner", "mount.wall.side", "readings", "readings[]", "sensor"}
    assert s["nested_field_count"] == 8
    assert paths["mount.height"] == {"path": "mount.height", "occurrence_count": 3, "null_count": 1, "observed_types": {"null": 1, "number": 2}}
    assert paths["readings[]"]["observed_types"] == {"null": 1, "number": 3}
    columns = {c["name"]: c for c in s["columns"]}
    readings = columns["readings"]["array_summary"]
    assert (readings["min_length"], readings["max_length"], readings["average_length"]) == (0, 3, pytest.approx(4 / 3))
    assert columns["mount"]["object_summary"]["top_keys"] == [{"value": k, "count": 3, "ratio": 1.0} for k in ("height", "wall")]
    assert s["dataset_type_counts"] == {"array": 3, "object": 3, "string": 3}


def test_schema_renderers(spark, stored):
    root = schema.infer(read(spark, stored(fixtures.SENSORS)))
    assert list(dict(root.sorted_fields())) == ["mount", "readings", "sensor"] and root.required("sensor")
    wall = root.fields["mount"].fields["wall"]
    assert wall.required("side") and not wall.required("owner") and not root.fields["mount"].required("height")
    name = schema.type_name("glass-house 7")
    assert name == "GlassHouse7"
    shown = {k: schema.render(root, name, "json", k) for k in cli.SCHEMA_OUTPUTS}
    assert json.loads(shown["openapi"])["components"]["schemas"][name]["type"] == "object"
    js = json.loads(shown["json-schema"])
    assert js["required"] == ["mount", "readings", "sensor"] and js["properties"]["readings"]["items"]["type"] == ["null", "number"]
    owner = js["properties"]["mount"]["properties"]["wall"]["properties"]["owner"]
    assert owner == {"type": "string", "x-semantic-hints": ["email_like"]}
    avro = json.loads(shown["avro"])
    assert avro["name"] == name and avro["fields"][0]["type"]["name"] == f"{name}Mount"
    assert avro["fields"][1]["type"] == {"type": "array", "items": ["null", "double"]}
    assert f"export interface {name} {{" in shown["typescript"] and "readings: (null | number)[];" in shown["typescript"]
    assert f"class {name}(TypedDict, total=False):" in shown["python"]
    compile(shown["python"], "x", "exec")
    assert "| $.mount.wall.owner | no | string | email_like |" in shown["markdown"]
    assert json.loads(shown["json"])["root"]["object"]["fields"][2]["name"] == "sensor"


def test_csv_to_parquet_keeps_integers(spark, tmp_path):
    source, target = tmp_path / "in.csv", tmp_path / "new" / "t.parquet"
    source.write_text('bed,note,width\n9,"two, or ""three""",-4\n12,,0\n')
    done = cli.transform_dataset(spark, str(source), str(target))
    assert (done["row_count"], done["column_count"]) == (2, 3)
    df = spark.read.parquet(str(target))
    assert dict(df.dtypes) == {"bed": "bigint", "note": "string", "width": "bigint"}
    assert sorted(map(tuple, df.collect())) == [(9, 'two, or "three"', -4), (12, None, 0)]


def test_json_to_avro_and_back(spark, stored, tmp_path):
    target = str(tmp_path / "glass house.avro")
    cli.transform_dataset(spark, stored(fixtures.SENSORS), target)
    rows = {r["sensor"]: r for r in report.head(read(spark, target))["rows"]}
    assert json.loads(rows["s-2"]["mount"]) == fixtures.SENSORS[1]["mount"] and rows["s-2"]["readings"] == "[]"


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl", "parquet", "avro"])
def test_every_format_round_trips(spark, stored, tmp_path, kind):
    rows = [{"dry": True, "k": 7, "mm": 0.25, "say": "wind|rain\nsun"}, {"dry": False, "k": -1, "mm": 3.0, "say": "x"}]
    path = str(tmp_path / f"t.{kind}")
    write(read(spark, stored(rows)), path)
    got = report.head(read(spark, path))
    assert got["rows"] == rows and got["total_row_count"] == 2
    assert "wind\\|rain\\nsun" in report.head_markdown(got)


def test_head(spark, stored):
    got = report.head(read(spark, stored(fixtures.BEDS, "beds.jsonl")), 4)
    assert (got["total_row_count"], got["returned_row_count"], got["columns"]) == (6, 4, ["bed", "crop", "light"])
    assert [r["bed"] for r in got["rows"]] == [4, 8, 12, 16]
    assert report.head_markdown(got).startswith("# Dataset Head\n")


def test_smote_rows_lie_between_near_rows(spark, stored, tmp_path):
    out = str(tmp_path / "out.json")
    got = cli.smote_dataset(spark, stored(fixtures.TIDES), out, "tide", k=1, seed=5)
    assert (got["synthetic_row_count"], got["output_row_count"], got["minority_label"], got["feature_columns"]) == (10, 20, "spring", ["level", "wind"])
    made = [r for r in json.loads(open(out).read()) if r["tide"] == "spring"][3:]
    nearest = {3.0: 6.0, 6.0: 3.0, 12.0: 6.0}  # one neighbour each
    for k, row in enumerate(made):
        seed = [3.0, 6.0, 12.0][[f"w{w}" for w in (3, 6, 12)].index(row["watch"])]
        low, high = sorted((seed, nearest[seed]))
        assert low <= row["wind"] <= high and row["level"] == pytest.approx(40 + 2 * row["wind"])
    assert len(made) == 10 and len({r["wind"] for r in made}) == 10
    assert got["evaluation"]["privacy"]["rare_value_alerts"]["threshold"] == 5
    assert len(got["evaluation"]["caveats"]) == 3 and len(got["evaluation"]["references"]) == 3
    assert got["stats_diff"]["row_count_delta"] == 10
    again = cli.smote_dataset(spark, stored(fixtures.TIDES), out, "tide", seed=5, target_rows=12)
    assert (again["synthetic_row_count"], again["output_row_count"]) == (10, 12)


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(8)
    points = rng.integers(0, 12, (90, 2)).astype(float)  # with ties
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "row_no long, a double, b double")
    got = {r["row_no"]: r["near"] for r in synth.neighbours(df, ["a", "b"], 4).collect()}
    for k, p in enumerate(points):
        gaps = np.sqrt(((points - p) ** 2).sum(axis=1))
        gaps[k] = np.inf
        assert got[k] == np.lexsort((np.arange(90), gaps))[:4].tolist()


def test_smote_errors(spark):
    df = spark.createDataFrame([(4.0, "p"), (5.0, "q"), (6.0, "q"), (7.0, "q")], "v double, kind string")
    for options in ({"k": 0}, {"samples": 0}, {}, {"label": "r"}):
        with pytest.raises(ValueError):
            synth.smote(df, "kind", **options)
    with pytest.raises(ValueError):
        synth.minority_label(df.union(spark.createDataFrame([(1.0, None)], df.schema)), "kind")
    with pytest.raises(ValueError):
        synth.exactly(df, 5)


def test_exactly_takes_whole_rows_without_replacement(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k")
    for n in (0, 1, 333, 999, 1000):
        ids = [r["id"] for r in synth.exactly(df, n, 3).collect()]
        assert len(ids) == len(set(ids)) == n
    first = {r["id"] for r in synth.exactly(df, 500, 3).collect()}
    assert first != {r["id"] for r in synth.exactly(df, 500, 4).collect()} and 150 < len(first & set(range(500))) < 350


def test_dp_noise(spark, stored, tmp_path):
    got = cli.dp_noise_dataset(spark, stored(fixtures.BEDS), str(tmp_path / "out.csv"), seed=9)
    assert got["row_count"] == 6 and got["noisy_columns"] == ["bed", "light"]
    assert len(got["evaluation"]["caveats"]) == 4
    alerts = got["evaluation"]["privacy"]["rare_value_alerts"]
    assert (alerts["reviewed_columns"], alerts["columns_with_alerts"]) == (1, 1)
    rows = spark.read.option("header", True).csv(str(tmp_path / "out.csv")).collect()
    assert [r["crop"] for r in rows] == [b["crop"] for b in fixtures.BEDS]
    assert all(4 <= int(r["bed"]) <= 24 and 0.5 <= float(r["light"]) <= 3 for r in rows)
    with pytest.raises(ValueError):
        synth.dp_noise(spark.createDataFrame(fixtures.BEDS), 0)


def test_laplace_noise_has_its_distribution(spark):
    from pyspark.sql import functions as F

    noise = spark.range(40_000).select(synth.laplace(F.rand(3), F.lit(2.0)).alias("x")).toPandas()["x"].to_numpy()
    x = np.sort(noise)
    want = np.where(x < 0, np.exp(x / 2) / 2, 1 - np.exp(-x / 2) / 2)
    assert np.abs(want - np.arange(1, len(x) + 1) / len(x)).max() < 0.01
    edges = spark.createDataFrame([(0.25,), (0.5,), (0.75,)], "u double").select(synth.laplace(F.col("u"), F.lit(2.0)).alias("x")).collect()
    assert [r["x"] for r in edges] == pytest.approx([-2 * np.log(2), 0, 2 * np.log(2)])


def test_rare_values(spark):
    frame_of = lambda text: spark.createDataFrame([(0.0, v) for v in text], "v double, blood string")
    row = evaluate.rare_value_alerts(frame_of("OOOOOOPPPQR"), frame_of("OOOOOPQQS"), ["blood"]).first()
    assert (row["reference_distinct_value_count"], row["synthetic_distinct_value_count"]) == (4, 4)
    assert (row["reference_unique_value_count"], row["synthetic_unique_value_count"]) == (2, 2)
    assert (row["reference_rare_value_count"], row["synthetic_rare_value_count"]) == (3, 3)
    assert (row["overlapping_unique_value_count"], row["overlapping_unique_examples"]) == (1, ["P"])
    assert (row["overlapping_rare_value_count"], row["overlapping_rare_examples"]) == (2, ["P", "Q"])


def test_diffusion(spark, stored, tmp_path):
    model, out = str(tmp_path / "m.df.json"), str(tmp_path / "made.json")
    source = stored(fixtures.BEDS)
    got = cli.train_diffusion(spark, source, model, timesteps=24, examples=3, seed=6)
    assert got["numeric_columns"] == ["bed", "light"] and got["passthrough_columns"] == ["crop"]
    made = cli.generate_diffusion(spark, model, source, out, rows=9, seed=2)
    rows = json.loads(open(out).read())
    assert made["row_count"] == len(rows) == 9
    assert all(4 <= r["bed"] <= 24 and 0.5 <= r["light"] <= 3 and r["crop"] in ("leek", "kale") for r in rows)
    artifact = json.loads(open(model).read())
    assert artifact["version"] == "0.1.0" and artifact["method"] == "tabular_gaussian_ddpm_linear"
    flat, n, m = artifact["denoiser"]["weights"]
    assert (n, m, len(flat)) == (5, 2, 10) and len(artifact["schedule"]["betas"]) == 24
    for options in ({"timesteps": 1}, {"examples": 0}, {"alpha": 0}, {"columns": ["crop"]}):
        with pytest.raises(ValueError):
            cli.train_diffusion(spark, source, model, **options)


def test_ridge_matches_numpy(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (200, 3)), rng.normal(0, 1, (200, 2))
    df = spark.createDataFrame(np.c_[x, y].tolist(), ["a", "b", "c", "d", "e"])
    sums = diffusion.gram(df, [F.col(n) for n in "abc"], [F.col(n) for n in "de"]).first()
    want = np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ y)
    assert diffusion.ridge(sums, 3, 2, 0.5) == pytest.approx(want)
    schedule = diffusion.Schedule.linear(3)
    assert schedule.betas == pytest.approx([1e-4, 0.01005, 0.02])
    assert schedule.alpha_bars == pytest.approx([0.9999, 0.9999 * 0.98995, 0.9999 * 0.98995 * 0.98])


def test_sampling_follows_the_reverse_process(spark):
    """A denoiser of zeros and one step leave standard noise, scaled back and clipped."""
    model = diffusion.Model(1, ["v"], [], [10.0], [2.0], [4.0], [16.0], diffusion.Schedule([0.0], [1.0], [0.5]), np.zeros((4, 1)))
    values = diffusion.sample(spark, model, 5000, 1).toPandas()["v"].to_numpy()
    assert values.mean() == pytest.approx(10, abs=0.15) and values.std() == pytest.approx(2, abs=0.1)
    assert values.min() >= 4 and values.max() <= 16


def test_formats_by_extension(spark, stored, tmp_path):
    assert detect_format("x/Lots.NdJson") == "jsonl"
    for path in ("lots", "x.d/lots", "lots.txt"):
        with pytest.raises(ValueError):
            detect_format(path)
    target = str(tmp_path / "rows.bin")
    assert cli.transform_dataset(spark, stored(fixtures.BEDS), target, "parquet")["output_format"] == "parquet"
    assert spark.read.parquet(target).count() == 6


def test_command_line(spark, stored, tmp_path):
    path = stored(fixtures.BEDS, "herb beds.json")
    assert "- Rows: `6`" in cli.main(["stats", path], spark)
    assert json.loads(cli.main(["head", path, "--rows", "2", "--output", "json"], spark))["returned_row_count"] == 2
    assert "HerbBeds" in cli.main(["schema", path, "--output", "typescript"], spark)
    assert json.loads(cli.main(["transform", path, str(tmp_path / "x.csv")], spark))["row_count"] == 6
    made = json.loads(cli.main(["synth", "dp-noise", path, str(tmp_path / "y.json"), "--epsilon", "3", "--seed", "1"], spark))
    assert made["epsilon"] == 3.0


def test_a_diff_of_reports(spark):
    before = report.analyze(frame(spark.createDataFrame(fixtures.BEDS)))
    after = report.analyze(frame(spark.createDataFrame([{**r, "light": r["light"] + 1} for r in fixtures.BEDS[:5]])))
    found = report.compare(before, after)
    light = next(c for c in found["columns"] if c["name"] == "light")
    assert found["row_count_delta"] == -1 and light["non_null_delta"] == -1
    assert (light["numeric_summary"]["min_delta"], light["numeric_summary"]["max_delta"]) == (1, 0.5)
    pair = next(p for p in found["column_pairs"] if (p["left"], p["right"]) == ("bed", "light"))
    assert pair["numeric_relationship"]["intercept_delta"] == pytest.approx(1) and pair["paired_non_null_delta"] == -1
