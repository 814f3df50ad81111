"""Sinks: a dataset as one CSV, JSON, JSONL, Parquet or Avro file (or, with ``single`` off, a folder of parts)."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomstat.functions.text import csv_cell, let
from loomstat.operators.structure import as_variants
from loomstat.plans.schema import type_name
from loomstat.sources import avro
from loomstat.sources.cells import Dataset, finite, normalised, variant_cell
from loomstat.sources.readers import FORMATS, detect_format, read

SPARK_TYPES = {"boolean": "boolean", "int64": "long", "float64": "double", "utf8": "string"}
AVRO_TYPES = {"boolean": "boolean", "int64": "long", "float64": "double", "utf8": "string"}


def tabular(data: Dataset, empty_nulls: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Flat typed columns in name order, and their types. Nested values are JSON text. ``empty_nulls``: an explicit null of a
    text column becomes an empty string, a missing value stays null.

    Types come from one pass without labels or canonical texts, values from the source's own columns."""
    flat = {"typed": _of_typed, "text": _of_text, "dynamic": _of_dynamic}[data.shape]
    return flat(data, empty_nulls)


def _kinds(data: Dataset, flags: dict[str, tuple[Column, Column, Column, Column]]) -> dict[str, str]:
    """Types of columns from (there, is boolean, is a whole number of 64 bits, is a number) of their cells."""
    if not flags:
        return {}
    every = lambda there, c: F.coalesce(F.bool_and(F.when(there, c)), F.lit(False))
    wanted = [F.array(*[every(there, c) for c in rest]).alias(f"w{k}") for k, (there, *rest) in enumerate(flags.values())]
    found = data.rows.agg(*wanted).first()
    return {n: next((t for t, yes in zip(("boolean", "int64", "float64"), row) if yes), "utf8") for n, row in zip(flags, found)}


def _whole(num: Column) -> Column:
    return (num >= -(2.0**63)) & (num < 2.0**63)


def _of_typed(data: Dataset, empty_nulls: bool) -> tuple[DataFrame, dict[str, str]]:
    sorts = {f.name: normalised(F.col(f"`{f.name}`"), f.dataType) for f in data.rows.schema.fields}
    no, flags = F.lit(False), {}
    for n in data.columns():
        value, sort = sorts[n]
        flags[n] = (
            value.isNotNull(), F.lit(sort == "boolean"), _whole(value.cast("double")) if sort == "integer" else no,
            F.lit(sort in ("integer", "float")),
        )
    kinds = _kinds(data, flags)

    def column(n: str) -> Column:
        value, sort = sorts[n]
        if kinds[n] != "utf8":
            return value.cast(SPARK_TYPES[kinds[n]])
        text = F.to_json(F.to_variant_object(value)) if sort in ("array", "object") else value.cast("string")
        return F.coalesce(text, F.lit("")) if empty_nulls else text

    return data.rows.select(*[column(n).alias(n) for n in flags]), kinds


def _of_text(data: Dataset, empty_nulls: bool) -> tuple[DataFrame, dict[str, str]]:
    names = data.columns()
    # Lean structs, computed once for each cell and pass.
    slim = lambda c: F.struct(c["kind"].alias("kind"), c["is_int"].alias("is_int"), c["num"].alias("num"))
    seen = data.dealt().select(*[let(csv_cell(F.col(f"`{n}`")), slim).alias(f"c{k}") for k, n in enumerate(names)])
    flags = {}
    for k, n in enumerate(names):
        kind, num = F.col(f"c{k}.kind"), F.col(f"c{k}.num")
        flags[n] = (kind != "null", kind == "boolean", (kind == "number") & F.col(f"c{k}.is_int") & _whole(num), kind == "number")
    kinds = _kinds(Dataset(seen, "typed"), flags)

    def column(n: str) -> Column:
        def value(c: Column) -> Column:
            if kinds[n] == "boolean":
                return c["label"].cast("boolean")
            if kinds[n] == "int64":
                return c["label"].cast("long")
            if kinds[n] == "float64":
                return c["num"] + F.lit(0.0)  # no zero below zero
            # Numbers among texts read as they do in JSON.
            number = let(variant_cell(F.parse_json(c["label"])), lambda x: x["label"])
            shown = F.when((c["kind"] == "number") & ~c["is_int"], number).otherwise(c["label"])
            return F.when(c["kind"] == "null", F.lit("")).otherwise(shown) if empty_nulls else shown

        return let(csv_cell(F.col(f"`{n}`")), value)

    return data.dealt().select(*[column(n).alias(n) for n in names]), kinds


def _of_dynamic(data: Dataset, empty_nulls: bool) -> tuple[DataFrame, dict[str, str]]:
    """One pass finds the columns with their kinds of values, one gives the values."""
    entries = data.rows.select(F.explode(F.expr("map_entries(try_cast(v AS map<string, variant>))")).alias("e"))
    each = entries.select(F.col("e.key").alias("column"), F.col("e.value").alias("x"), F.schema_of_variant("e.value").alias("s"))
    wide = F.col("s").startswith("DECIMAL") & F.col("s").endswith(",0)") & (F.length("s") >= 13)  # 19 digits or more
    whole = F.when((F.col("s") == "BIGINT") | wide, _whole(F.try_variant_get("x", "$", "double")))
    finite_ = F.when(F.col("s").isin("DOUBLE", "FLOAT"), finite(F.try_variant_get("x", "$", "double")).isNotNull())
    short = F.substring_index(F.substring_index("s", "<", 1), "(", 1)
    found = each.select("column", short.alias("s"), F.coalesce(whole, F.lit(False)).alias("whole"), finite_.alias("finite"))
    found = found.groupBy("column", "s").agg(F.bool_and("whole").alias("whole"), F.bool_and("finite").alias("finite")).collect()
    of = defaultdict(dict)
    for r in found:
        of[r["column"]][r["s"]] = r["whole"]
    names = data.names = data.names or sorted(of)
    kinds, texts = {}, set()
    for n in names:
        there = {s: w for s, w in of[n].items() if s != "VOID"}
        number = bool(there) and not set(there) & {"BOOLEAN", "STRING", "ARRAY", "OBJECT"}
        kinds[n] = "boolean" if set(there) == {"BOOLEAN"} else "int64" if number and all(there.values()) else "float64" if number else "utf8"
        if set(there) <= {"STRING"}:
            texts.add(n)
    by_path = lambda n: re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", n)
    entry = F.expr("try_cast(v AS map<string, variant>)")
    plain = {n for n in names if by_path(n) and (kinds[n] != "utf8" or (n in texts and not empty_nulls))}

    def column(n: str) -> Column:
        if n in plain:
            return F.try_variant_get("v", f"$.{n}", SPARK_TYPES[kinds[n]])
        v = F.try_element_at("m", F.lit(n))
        if kinds[n] != "utf8":
            return F.try_variant_get(v, "$", SPARK_TYPES[kinds[n]])

        def text(c: Column) -> Column:
            scalar = F.coalesce(c["str"], c["label"], c["canon"])
            return F.when(c["kind"] == "null", F.lit("")).otherwise(scalar) if empty_nulls else scalar

        return F.when(v.isNotNull(), let(variant_cell(v), text))

    rows = data.rows if len(plain) == len(names) else data.rows.select("v", entry.alias("m"))
    return rows.select(*[column(n).alias(n) for n in names]), kinds


def _files(spark: SparkSession, path: str):
    """The file system of a path, as Hadoop sees it, and a maker of its paths. A local one leaves no checksum files."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    system = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        system = system.getRawFileSystem()
    return system, to_path


def _parts(files, folder) -> list:
    """The part files of a folder, in the order of their partitions."""
    found = [f for f in files.listStatus(folder)] if files.exists(folder) else []
    return sorted((f for f in found if f.getPath().getName().startswith("part-")), key=lambda f: (len(f.getPath().getName()), f.getPath().getName()))


def _one_file(df: DataFrame, path: str, how) -> None:
    """Lets ``how`` write a folder of one part beside ``path`` and moves that part to ``path``. What stood there goes only
    when the new file is complete; a part that can't be seen from here is an error."""
    files, to_path = _files(df.sparkSession, path)
    target, folder = to_path(path), to_path(f"{path}.parts")
    if target.getParent():
        files.mkdirs(target.getParent())
    files.delete(folder, True)
    how(df.coalesce(1).write.mode("overwrite"), folder.toString())
    parts = [f.getPath() for f in _parts(files, folder)]
    if len(parts) > 1 or (not parts and not df.isEmpty()):
        raise OSError(f"{len(parts)} part files in {folder.toString()}: the driver doesn't see what the executors wrote")
    _put(files, to_path, path, parts[0] if parts else None)
    files.delete(folder, True)


def _put(files, to_path, path: str, made) -> None:
    """Moves a complete file (None: an empty one) to ``path``."""
    target, old = to_path(path), to_path(f"{path}.old")
    if files.exists(target):
        files.delete(old, True)
        files.rename(target, old)
    done = files.rename(made, target) if made else files.createNewFile(target)
    if not done:
        files.rename(old, target)
        raise OSError(f"can't move the output to {path}")
    files.delete(old, True)


def _one_text_file(df: DataFrame, path: str, how, head=None) -> None:
    """One file of lines: all tasks write parts (``how``) beside ``path``, whose bytes are then put together in the order of
    partitions, after what ``head`` writes of no rows. Each partition's part must be seen from here."""
    spark = df.sparkSession
    files, to_path = _files(spark, path)
    target, folder, first = to_path(path), to_path(f"{path}.parts"), to_path(f"{path}.head")
    if target.getParent():
        files.mkdirs(target.getParent())
    for f in (folder, first):
        files.delete(f, True)
    # Rows are numbered from 0 in each partition, in the lower 33 bits.
    place, seen = "_loomstat_place", Observation()
    numbered = df.withColumn(place, F.monotonically_increasing_id())
    counted = numbered.observe(seen, F.count_if(F.col(place) % F.lit(2**33) == 0).alias("n")).drop(place)
    how(counted.write.mode("overwrite"), folder.toString())
    parts = [f.getPath() for f in _parts(files, folder) if f.getLen()]
    if len(parts) != seen.get["n"]:
        raise OSError(f"{len(parts)} of {seen.get['n']} part files in {folder.toString()}: the driver doesn't see what the executors wrote")
    if head:
        head(spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite"), first.toString())
        parts = [f.getPath() for f in _parts(files, first)] + parts
    made = to_path(f"{path}.part")
    out = files.create(made, True)
    try:
        for part in parts:
            source = files.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    _put(files, to_path, path, made)
    for f in (folder, first):
        files.delete(f, True)


def _pretty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one JSON array, from a partition of compact objects."""
    before = "["
    for batch in batches:
        lines = []
        for value in batch.column("value").to_pylist():
            text = json.dumps(json.loads(value), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            lines.append(f"{before}\n  {text}")
            before = ","
        if lines:
            # A line feed follows each row, so a row ends where the next one's comma stands.
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array([f"{before}\n]" if before == "[" else "]"], pa.string())], ["value"])


def write(data: Dataset, path: str, format: str | None = None, single: bool = True, empty_nulls: bool = False) -> None:
    """Overwrites ``path``: one file, or with ``single`` off a folder of as many parts as there are partitions. One file of CSV
    or JSONL is put together from parts, others are written by one task. Missing folders are made."""
    kind = FORMATS[format.lower()] if format else detect_format(path)
    if kind in ("json", "jsonl"):
        lines = as_variants(data).select(F.to_json("v").alias("value"))
        if kind == "json":  # an array in each part
            lines = (lines.coalesce(1) if single else lines).mapInArrow(_pretty, "value string")
        elif single:
            return _one_text_file(lines, path, lambda w, to: w.text(to))
        return _save(lines, path, single, lambda w, to: w.text(to))
    flat, kinds = tabular(data, empty_nulls)
    if kind == "parquet":
        return _save(flat, path, single, lambda w, to: w.parquet(to))
    if kind == "csv":
        options = {"header": "true", "nullValue": "", "emptyValue": "", "quote": '"', "escape": '"'}
        with_head = lambda w, to: w.options(**options).csv(to)
        if single:
            return _one_text_file(flat, path, lambda w, to: w.options(**options | {"header": "false"}).csv(to), with_head)
        return _save(flat, path, single, with_head)
    stem = os.path.splitext(os.path.basename(path))[0]
    return _avro_file(flat, path, type_name(stem), [(n, AVRO_TYPES[kinds[n]]) for n in flat.columns])


def _avro_file(flat: DataFrame, path: str, record: str, columns: list[tuple[str, str]]) -> None:
    """Tasks encode and pack blocks; the driver appends one block after the other, and holds one at a time."""
    files, to_path = _files(flat.sparkSession, path)
    sync, target, made = os.urandom(16), to_path(path), to_path(f"{path}.part")
    if target.getParent():
        files.mkdirs(target.getParent())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, avro.BLOCK):
                rows = zip(*(c.to_pylist() for c in batch.slice(at, avro.BLOCK).columns))
                yield pa.RecordBatch.from_arrays([pa.array([avro.block(rows, columns, sync)], pa.binary())], ["block"])

    out = files.create(made, True)
    try:
        out.write(avro.header(record, columns, sync))
        for row in flat.mapInArrow(encode, "block binary").toLocalIterator() if columns else ():
            out.write(bytes(row["block"]))
    finally:
        out.close()
    files.delete(target, True)
    if not files.rename(made, target):
        raise OSError(f"can't move the output to {path}")


def _save(df: DataFrame, path: str, single: bool, how) -> None:
    if single:
        _one_file(df, path, how)
    else:
        how(df.write.mode("overwrite"), path)


def transform(
    spark, source: str, target: str, source_format: str | None = None, target_format: str | None = None, single: bool = True
) -> dict:
    """Converts a file; the report says what was converted."""
    data = read(spark, source, source_format)
    kind = FORMATS[target_format.lower()] if target_format else detect_format(target)
    write(data, target, kind, single)
    return {
        "source_path": source,
        "source_format": data.format,
        "output_path": target,
        "output_format": kind,
        "row_count": data.count(),
        "column_count": len(data.columns()),
    }
