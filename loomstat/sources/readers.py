"""Sources: CSV, JSON, JSONL, Parquet and Avro as datasets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat import scratch
from loomstat.sources import avro
from loomstat.sources.cells import Dataset

FORMATS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "avro": "avro"}


def detect_format(path: str) -> str:
    """By the lower-cased extension; none or an unknown one is an error."""
    extension = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if not extension:
        raise ValueError(f"dataset path has no extension: {path}")
    if extension not in FORMATS:
        raise ValueError(f"unsupported dataset format: {extension}")
    return FORMATS[extension]


def read(spark: SparkSession, path: str, format: str | None = None, multi_line: bool = True) -> Dataset:
    """A dataset from a path. A format that is given holds, whatever the extension. ``multi_line`` off: no quoted CSV cell
    holds a line feed, so that large files can be split without a look at their lines."""
    kind = FORMATS[format.lower()] if format else detect_format(path)
    if kind == "csv":
        return read_csv(spark, path, multi_line)
    return {"json": read_json, "jsonl": read_jsonl, "parquet": read_parquet, "avro": read_avro}[kind](spark, path)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> Dataset:
    """A header row, then rows as wide as it. Cells keep their text; types are found cell by cell. Of columns of one name
    the last one counts. Work on whole tables splits files where lines are rows; otherwise one task parses a file, once."""
    reader = lambda multi: spark.read.options(quote='"', escape='"', mode="FAILFAST", multiLine=str(multi).lower())
    head = reader(multi_line).options(header="false").csv(path).first()
    names = [n or "" for n in head] if head else []

    def table(multi: bool) -> DataFrame:
        if len({n.lower() for n in names}) == len(names):
            return reader(multi).options(header="true", enforceSchema="false").csv(path)
        places = {n: k for k, n in enumerate(names)}
        rows = reader(multi).options(header="true").schema(", ".join(f"c{k} string" for k in range(len(names)))).csv(path)
        return rows.select(*[F.col(f"c{k}").alias(n) for n, k in places.items()])

    deal = lambda: table(False) if _lines_are_rows(spark, path) else scratch.written(table(True), "parsed")
    return Dataset(table(multi_line), "text", "csv", path, deal=deal if multi_line and names else None)


def _lines_are_rows(spark: SparkSession, path: str) -> bool:
    """Whether each line of CSV files is a row of its own: quotes stand around whole cells and close in their line, so the next
    line starts outside of quotes. Lines that the two ways of parsing could tell apart (carriage returns, a byte order mark,
    nothing but white space) don't count as such."""
    value = F.col("value")
    outer = F.filter(F.split(value, '"', -1), lambda _, k: k % 2 == 0)
    last = F.size(outer) - 1
    before = lambda x, k: (x == "") | (k == last) | x.endswith(",")
    after = lambda x, k: (x == "") | (k == 0) | x.startswith(",")
    at_edges = F.forall(F.transform(outer, lambda x, k: before(x, k) & after(x, k)), lambda ok: ok)
    even = (F.length(value) - F.length(F.replace(value, F.lit('"')))) % 2 == 0
    odd = value.contains("\r") | value.startswith("\ufeff") | ((value != "") & ~value.rlike("[^\\x00-\\x20]"))
    closed = F.when(value.contains('"'), even & at_edges).otherwise(F.lit(True))
    return spark.read.text(path, lineSep="\n").where(odd | ~closed).isEmpty()


def _variants(texts: DataFrame) -> DataFrame:
    return texts.select(F.parse_json("value").alias("v"))


def _objects(rows: DataFrame) -> DataFrame:
    """Rows must be JSON objects."""
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    wrong = F.raise_error(F.concat(F.lit("expected a JSON object for each row, found "), F.schema_of_variant("v")))
    return rows.select(F.when(is_object, F.col("v")).otherwise(wrong.cast("string").cast("variant")).alias("v"))


def read_json(spark: SparkSession, path: str) -> Dataset:
    """A document: an array of objects, or one object, which is one row."""
    whole = spark.read.text(path, wholetext=True)
    document = _variants(whole)
    as_rows = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.expr("try_cast(v AS array<variant>)")).otherwise(F.array("v"))
    return Dataset(_objects(document.select(F.explode(as_rows).alias("v"))), "dynamic", "json", path)


def read_jsonl(spark: SparkSession, path: str) -> Dataset:
    """An object a line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    wrong = F.raise_error(F.concat(F.lit("expected a JSON object for each row, found "), F.schema_of_variant(F.parse_json("value"))))
    # A text that parses is an object if it starts as one.
    v = F.when(F.col("value").rlike("^[ \\t]*\\{"), F.parse_json("value")).otherwise(wrong.cast("string").cast("variant"))
    return Dataset(lines.select(v.alias("v")), "dynamic", "jsonl", path)


def read_parquet(spark: SparkSession, path: str) -> Dataset:
    return Dataset(spark.read.parquet(path), "typed", "parquet", path)


def read_avro(spark: SparkSession, path: str) -> Dataset:
    """Object container files, decoded in Python workers a file at a time, into the dynamic shape: unions are unwrapped, enums
    and UUIDs text, bytes arrays of numbers, dates and times numbers."""
    files = spark.read.format("binaryFile").load(path).select("content")
    texts = files.mapInArrow(avro.decode_batches, "value string")
    return Dataset(_variants(texts), "dynamic", "avro", path)
