"""A bulk job: profiles of many files, and a quality and privacy table of what the generators make of them.

    python -m loomstat.plans.harness OUT FILE...
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.cli import table_of
from loomstat.operators import diffusion, evaluate, synth
from loomstat.plans import report
from loomstat.session import session
from loomstat.sources.readers import read

TRAIN_SEED, GENERATE_SEED = 42, 7


def pick_target(df: DataFrame) -> str | None:
    """The first text or boolean column, by name, without nulls and with 2 to 20 values."""
    names = sorted(f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "boolean"))
    if not names:
        return None
    wanted = [x for n in names for x in (F.countDistinct(F.col(f"`{n}`")), F.count_if(F.col(f"`{n}`").isNull()))]
    row = df.agg(*[w.alias(f"w{k}") for k, w in enumerate(wanted)]).first()
    return next((n for k, n in enumerate(names) if 2 <= row[2 * k] <= 20 and not row[2 * k + 1]), None)


def score(real: DataFrame, made: DataFrame, features: list[str]) -> dict[str, float]:
    """Distance to the closest real row, replay ratios and correlation drift of generated rows."""
    total = max(1, made.count())
    columns = sorted(set(real.columns) & set(made.columns))
    rows = evaluate.matches(real, made, evaluate.row_signature(columns, real), evaluate.row_signature(columns, made)).first()["n"]
    same = evaluate.matches(real, made, evaluate.feature_signature(features), evaluate.feature_signature(features)).first()["n"]
    scale = evaluate.standardisation(real, features)
    near = evaluate.nearest_two(evaluate.vectors(made, features, *scale), evaluate.vectors(real, features, *scale))
    distances = evaluate.distance_summary(evaluate.closest_distance(near)).first()
    drift = evaluate.drift_summary(evaluate.correlation_drift(real, made, features)).first()
    return {
        "dcr_median": distances["median"],
        "dcr_p5": distances["p5"],
        "exact_replay_ratio": rows / total,
        "exact_numeric_replay_ratio": same / total,
        "mean_absolute_pearson_delta": drift["mean_absolute_pearson_delta"],
        "max_absolute_pearson_delta": drift["max_absolute_pearson_delta"],
    }


def evaluate_file(spark: SparkSession, path: str) -> dict:
    """Both generators on one file, with as many rows as it has."""
    df = table_of(read(spark, path)).persist()
    features = evaluate.numeric_columns(df)
    model, mse = diffusion.train(df, seed=TRAIN_SEED, source=path)
    made = diffusion.generate(model, df, seed=GENERATE_SEED).persist()
    found = {"path": path, "rows": df.count(), "diffusion": {"training_mse": mse, **score(df, made, features)}}
    made.unpersist()
    target = pick_target(df)
    if target:
        rows, _, names, label = synth.smote(df, target, seed=TRAIN_SEED)
        mixed = synth.exactly(synth.append(df, rows), df.count(), TRAIN_SEED).persist()
        found["smote"] = {"target": target, "minority": label, **score(df, mixed, names)}
        mixed.unpersist()
    df.unpersist()
    return found


def to_markdown(results: list[dict]) -> str:
    lines = ["# Synthetic data evaluation"]
    for r in results:
        lines += ["", f"## {Path(r['path']).name} ({r['rows']} rows)"]
        for method in ("diffusion", "smote"):
            if method in r:
                lines += ["", f"### {method}", "", "| metric | value |", "| --- | ---: |"]
                lines += [f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in r[method].items()]
    return "\n".join(lines) + "\n"


def run(spark: SparkSession, out: str, paths: list[str]) -> list[dict]:
    """Writes a profile of each file as Markdown and JSON, and one evaluation of all."""
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    results = []
    for path in paths:
        name = Path(path).name.replace(".", "_")
        stats = report.analyze(read(spark, path))
        (folder / f"{name}.md").write_text(report.to_markdown(stats))
        (folder / f"{name}.json").write_text(report.to_json(stats))
        results.append(evaluate_file(spark, path))
    (folder / "evaluation.md").write_text(to_markdown(results))
    (folder / "evaluation.json").write_text(json.dumps(results, indent=2, default=str))
    return results


if __name__ == "__main__":
    run(session(), sys.argv[1], sys.argv[2:])
