"""Command line: stats, schema, head, transform, synth smote, synth dp-noise, train df, gen df."""

from __future__ import annotations

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomstat.operators import diffusion, evaluate, synth
from loomstat.plans import report, schema
from loomstat.session import session
from loomstat.sources.cells import Dataset, frame
from loomstat.sources.readers import FORMATS, detect_format, read
from loomstat.sources.sinks import tabular, transform, write

SCHEMA_OUTPUTS = ("markdown", "json", "json-schema", "openapi", "avro", "typescript", "python")


def table_of(data: Dataset) -> DataFrame:
    """A dataset as a flat typed DataFrame."""
    return data.rows if data.shape == "typed" else tabular(data)[0]


def analyze_dataset(spark: SparkSession, source: str | DataFrame, format: str | None = None) -> dict:
    return report.analyze(frame(source) if isinstance(source, DataFrame) else read(spark, source, format))


def analyze_schema(spark: SparkSession, source: str | DataFrame, format: str | None = None) -> schema.Node:
    return schema.infer(frame(source) if isinstance(source, DataFrame) else read(spark, source, format))


def transform_dataset(spark: SparkSession, source: str, target: str, format: str | None = None, single: bool = True) -> dict:
    return transform(spark, source, target, None, format, single)


def _finish(spark: SparkSession, before: DataFrame, after: DataFrame, path: str, kind: str) -> tuple[dict, int]:
    """Writes the result, and compares both profiles."""
    write(frame(after, path), path, kind)
    written = frame(table_of(read(spark, path, kind)))
    return report.compare(report.analyze(frame(before)), report.analyze(written)), written.count()


def smote_dataset(
    spark: SparkSession, source: str, target: str, column: str, k: int = 5, samples: int | None = None,
    target_rows: int | None = None, label: str | None = None, seed: int | None = None, format: str | None = None,
) -> dict:
    """Oversamples the minority of ``column``, writes all rows (or exactly ``target_rows`` of them) and reports."""
    data = read(spark, source)
    kind = FORMATS[format] if format else detect_format(target)
    df = table_of(data).persist()
    chosen = 0 if seed is None else seed
    made, minority, features, found = synth.smote(df, column, k, samples, label, chosen)
    made = made.persist()
    out = synth.append(df, made)
    if target_rows is not None:
        out = synth.exactly(out, target_rows, chosen)
    diff, rows = _finish(spark, df, out, target, kind)
    return {
        "source_path": source, "source_format": data.format, "output_path": target, "output_format": kind,
        "target_column": column, "minority_label": found, "feature_columns": features, "original_row_count": df.count(),
        "synthetic_row_count": made.count(), "output_row_count": rows, "k": k, "seed": seed, "stats_diff": diff,
        "evaluation": evaluate.evaluate(minority, made, features, f"minority rows of {column} = {found}", synth.SMOTE_CAVEATS),
    }


def dp_noise_dataset(spark: SparkSession, source: str, target: str, epsilon: float = 1.0, seed: int | None = None, format: str | None = None) -> dict:
    data = read(spark, source)
    kind = FORMATS[format] if format else detect_format(target)
    df = table_of(data).persist()
    noisy, names = synth.dp_noise(df, epsilon, 0 if seed is None else seed)
    noisy = noisy.persist()
    diff, rows = _finish(spark, df, noisy, target, kind)
    return {
        "source_path": source, "source_format": data.format, "output_path": target, "output_format": kind, "epsilon": epsilon,
        "row_count": rows, "noisy_columns": names, "seed": seed, "stats_diff": diff,
        "evaluation": evaluate.evaluate(df, noisy, names, "all rows", synth.NOISE_CAVEATS),
    }


def train_diffusion(
    spark: SparkSession, source: str, model_path: str | None = None, timesteps: int = 100, examples: int = 8,
    alpha: float = 1e-3, columns: list[str] | None = None, seed: int | None = None,
) -> dict:
    data = read(spark, source)
    path = model_path or f"models/{Path(source).stem}.df.json"
    df = table_of(data)
    model, mse = diffusion.train(df, timesteps, examples, alpha, columns, 0 if seed is None else seed, source)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    Path(path).write_text(model.to_json())
    return {
        "source_path": source, "source_format": data.format, "model_path": path, "row_count": df.count(), "timesteps": timesteps,
        "training_examples": df.count() * examples, "numeric_columns": model.numeric_columns,
        "passthrough_columns": model.passthrough_columns, "training_mse": mse, "seed": seed,
        "references": diffusion.CITATIONS, "caveats": diffusion.CAVEATS,
    }


def generate_diffusion(
    spark: SparkSession, model_path: str, source: str, target: str | None = None, rows: int | None = None,
    seed: int | None = None, format: str | None = None,
) -> dict:
    path = target or f"datasets/generated/{Path(model_path).name.split('.')[0]}-{Path(source).stem}.json"
    kind = FORMATS[format] if format else detect_format(path)
    model = diffusion.Model.from_json(Path(model_path).read_text())
    made = diffusion.generate(model, table_of(read(spark, source)), rows, 0 if seed is None else seed)
    write(frame(made, path), path, kind)
    stats = report.analyze(read(spark, path, kind))  # of the format that was written, whatever the extension
    return {"model_path": model_path, "source_path": source, "output_path": path, "output_format": kind, "row_count": stats["row_count"], "seed": seed, "stats": stats}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomstat", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(of, name: str, *paths: str) -> argparse.ArgumentParser:
        p = of.add_parser(name)
        for path in paths:
            p.add_argument(path.rstrip("?"), nargs="?" if path.endswith("?") else None)
        return p

    p = verb(verbs, "stats", "path")
    p.add_argument("--output", choices=("markdown", "json"), default="markdown")
    p = verb(verbs, "schema", "path")
    p.add_argument("--output", choices=SCHEMA_OUTPUTS, default="markdown")
    p.add_argument("--name")
    p = verb(verbs, "head", "path")
    p.add_argument("--rows", type=int, default=5)
    p.add_argument("--output", choices=("markdown", "json"), default="markdown")
    p = verb(verbs, "transform", "input", "output")
    p.add_argument("--format", choices=sorted(FORMATS))
    p.add_argument("--parts", action="store_true", help="write a folder of parts, each by a task of its own")
    methods = verbs.add_parser("synth").add_subparsers(dest="method", required=True)
    p = verb(methods, "smote", "input", "output")
    p.add_argument("--target", required=True)
    for name, kind, default in (("--k", int, 5), ("--samples", int, None), ("--target-rows", int, None), ("--seed", int, None)):
        p.add_argument(name, type=kind, default=default)
    p.add_argument("--minority-label")
    p.add_argument("--format", choices=sorted(FORMATS))
    p = verb(methods, "dp-noise", "input", "output")
    p.add_argument("--epsilon", type=float, default=1.0)
    p.add_argument("--seed", type=int)
    p.add_argument("--format", choices=sorted(FORMATS))
    p = verb(verbs.add_parser("train").add_subparsers(dest="method", required=True), "df", "input", "model?")
    for name, kind, default in (("--timesteps", int, 100), ("--examples-per-row", int, 8), ("--alpha", float, 1e-3), ("--seed", int, None)):
        p.add_argument(name, type=kind, default=default)
    p.add_argument("--columns", nargs="+")
    p = verb(verbs.add_parser("gen").add_subparsers(dest="method", required=True), "df", "model", "input", "output?")
    for name in ("--rows", "--seed"):
        p.add_argument(name, type=int)
    p.add_argument("--format", choices=sorted(FORMATS))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(args)
    spark = spark or session()
    dump = lambda x: json.dumps(x, indent=2, ensure_ascii=False, default=str)
    if a.verb == "stats":
        stats = report.analyze(read(spark, a.path))
        out = report.to_markdown(stats) if a.output == "markdown" else report.to_json(stats)
    elif a.verb == "schema":
        data = read(spark, a.path)
        out = schema.render(schema.infer(data), schema.type_name(a.name or Path(a.path).stem), data.format, a.output)
    elif a.verb == "head":
        preview = report.head(read(spark, a.path), a.rows)
        out = report.head_markdown(preview) if a.output == "markdown" else dump(preview)
    elif a.verb == "transform":
        out = dump(transform_dataset(spark, a.input, a.output, a.format, not a.parts))
    elif a.verb == "synth" and a.method == "smote":
        out = dump(smote_dataset(spark, a.input, a.output, a.target, a.k, a.samples, a.target_rows, a.minority_label, a.seed, a.format))
    elif a.verb == "synth":
        out = dump(dp_noise_dataset(spark, a.input, a.output, a.epsilon, a.seed, a.format))
    elif a.verb == "train":
        out = dump(train_diffusion(spark, a.input, a.model, a.timesteps, a.examples_per_row, a.alpha, a.columns, a.seed))
    else:
        out = dump(generate_diffusion(spark, a.model, a.input, a.output, a.rows, a.seed, a.format))
    return out


if __name__ == "__main__":
    print(main())
