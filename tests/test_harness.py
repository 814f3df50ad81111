import json

from loomstat.plans import harness


def test_bulk_job(spark, tmp_path):
    rows = [{"a": k * 1.5, "b": (k * 7) % 11 + 0.5, "kind": "x" if k % 4 else "y", "note": f"n{k}"} for k in range(40)]
    source = tmp_path / "in.json"
    source.write_text(json.dumps(rows))
    found = harness.run(spark, str(tmp_path / "out"), [str(source)])[0]
    assert found["smote"]["target"] == "kind" and found["smote"]["minority"] == "y"
    assert 0 <= found["diffusion"]["exact_replay_ratio"] <= 1 and found["diffusion"]["dcr_median"] > 0
    assert 0.2 < found["smote"]["exact_replay_ratio"] < 0.8
    assert (tmp_path / "out" / "in_json.md").read_text().startswith("# Dataset Statistics Report")
    assert "### smote" in (tmp_path / "out" / "evaluation.md").read_text()
