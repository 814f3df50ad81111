"""The long relation that profiling works on: one row for each present cell of a dataset.

    row_id long, column string, kind string, num double, is_int boolean, label string, str string, canon string

``kind`` is null, boolean, number, string, array or object; a missing key has no row, an explicit null has one. ``label``
is the text of a scalar, ``canon`` a text that differs for different values of any kind (compact JSON).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.text import csv_cell, let

KINDS = ("null", "boolean", "number", "string", "array", "object")
CELL = "struct<kind:string,num:double,is_int:boolean,label:string,str:string,canon:string>"


@dataclass
class Dataset:
    """Rows of a source. ``shape``: typed (a column for each field), text (CSV: all cells are strings) or dynamic (one
    VARIANT column ``v`` for each row)."""

    rows: DataFrame
    shape: str
    format: str = "parquet"
    path: str = ""
    names: list[str] = field(default_factory=list)
    deal: Callable[[], DataFrame] | None = None

    def dealt(self) -> DataFrame:
        """The rows for work on the whole table: in the same order, but read by many tasks where the source allows it."""
        if self.deal:
            self.rows, self.deal = self.deal(), None
        return self.rows

    def columns(self) -> list[str]:
        """Sorted union of keys over all rows."""
        if self.shape != "dynamic":
            return sorted(self.rows.columns)
        if not self.names:
            keys = self.rows.select(F.explode(F.expr("map_keys(try_cast(v AS map<string, variant>))")).alias("k"))
            self.names = sorted(r["k"] for r in keys.distinct().collect())  # as many as there are columns
        return self.names

    def count(self) -> int:
        return self.dealt().count()


def _cell(kind, num=None, is_int=None, label=None, text=None, canon=None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        kind.alias("kind"),
        (null("double") if num is None else num.cast("double")).alias("num"),
        (F.lit(False) if is_int is None else is_int).alias("is_int"),
        (null("string") if label is None else label).alias("label"),
        (null("string") if text is None else text).alias("str"),
        (null("string") if canon is None else canon).alias("canon"),
    )


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1)


def finite(x: Column) -> Column:
    """A number that JSON can hold; an error otherwise."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("encountered a non-finite float"))).otherwise(x)


def normalised(column: Column, kind: T.DataType) -> tuple[Column, str]:
    """A typed column as the data model sees it, and its kind. Timestamps and dates are numbers (epoch microseconds and
    days), decimals and binaries are text, maps are arrays of entries."""
    if isinstance(kind, T.BooleanType):
        return column, "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long"), "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return finite(column.cast("double")), "float"
    if isinstance(kind, T.DecimalType):
        return column.cast("string"), "string"
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(column.cast("timestamp"), F.current_timezone())), "integer"
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column), "integer"
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long"), "integer"
    if isinstance(kind, T.BinaryType):
        return F.base64(column), "string"
    if isinstance(kind, T.MapType):
        return F.map_entries(column), "array"
    if isinstance(kind, T.ArrayType):
        return column, "array"
    if isinstance(kind, T.StructType):
        return column, "object"
    return column.cast("string"), "string"


def typed_cell(column: Column, kind: T.DataType) -> Column:
    value, sort = normalised(column, kind)
    of = F.lit({"integer": "number", "float": "number"}.get(sort, sort))
    kind_ = F.when(value.isNull(), F.lit("null")).otherwise(of)
    if sort in ("array", "object"):
        return _cell(kind_, canon=F.to_json(value, {"ignoreNullFields": "false"}))
    text = value.cast("string")
    canon = _quoted(text) if sort == "string" else text
    return _cell(
        kind_,
        num=value if sort in ("integer", "float") else None,
        is_int=(value.isNotNull() if sort == "integer" else None),
        label=text,
        text=text if sort == "string" else None,
        canon=canon,
    )


def variant_cell(v: Column) -> Column:
    def shaped(v: Column) -> Column:
        shape = F.schema_of_variant(v)
        # By the shape's text: casting what a pattern doesn't find raises and catches an error for each value.
        whole = shape.startswith("DECIMAL(") & shape.endswith(",0)")
        kind = (
            F.when(F.is_variant_null(v), "null")
            .when(shape == "BOOLEAN", "boolean")
            .when(shape == "STRING", "string")
            .when(shape.startswith("ARRAY"), "array")
            .when(shape.startswith("OBJECT"), "object")
            .otherwise("number")
        )
        is_int = (shape == "BIGINT") | (whole & (F.length(shape) >= len("DECIMAL(19,0)")))
        # 1.0 is kept apart from 1
        point = F.when(whole & ~is_int, F.lit(".0")).otherwise(F.lit(""))
        return F.struct(v.alias("v"), kind.alias("kind"), is_int.alias("is_int"), point.alias("point"))

    def labelled(s: Column) -> Column:
        scalar = F.when(~s["kind"].isin("array", "object", "null"), F.concat(s["v"].cast("string"), s["point"]))
        return F.struct(s.alias("s"), scalar.alias("label"))

    def cell(x: Column) -> Column:
        s, label = x["s"], x["label"]
        kind = s["kind"]
        return _cell(
            kind,
            num=F.when(kind == "number", let(F.try_variant_get(s["v"], "$", "double"), finite)),
            is_int=s["is_int"],
            label=label,
            text=F.when(kind == "string", label),
            canon=F.when(kind == "number", label).when(kind != "null", F.to_json(s["v"])),
        )

    return let(let(let(v, shaped), labelled), cell)


def cells(data: Dataset, columns: list[str] | None = None) -> DataFrame:
    """The long relation of ``columns`` (all by default), in one pass over the rows. Needed columns only are read."""
    names = columns if columns is not None else data.columns()
    id_ = F.monotonically_increasing_id().alias("row_id")
    if data.shape == "dynamic":
        rows = data.rows.select(id_, F.explode(F.expr("map_entries(try_cast(v AS map<string, variant>))")).alias("e"))
        long = rows.select("row_id", F.col("e.key").alias("column"), variant_cell(F.col("e.value")).alias("c"))
        if columns is not None:
            long = long.where(F.col("column").isin(columns))
    else:
        kinds = {f.name: f.dataType for f in data.rows.schema.fields}
        if data.shape == "text":
            one = lambda n: _with_canon(csv_cell(F.col(f"`{n}`")))
        else:
            one = lambda n: typed_cell(F.col(f"`{n}`"), kinds[n])
        each = [F.struct(F.lit(n).alias("column"), one(n).alias("c")) for n in names]
        long = data.dealt().select(id_, F.explode(F.array(*each)).alias("x")).select("row_id", "x.column", "x.c")
    return long.select("row_id", "column", "c.*")


def _with_canon(cell: Column) -> Column:
    return let(cell, _canon)


def _canon(cell: Column) -> Column:
    canon = F.when(cell["kind"] == "string", _quoted(cell["str"])).when(cell["kind"] != "null", cell["label"])
    return F.struct(
        *[cell[c].alias(c) for c in ("kind", "num", "is_int", "label", "str")], canon.alias("canon")
    )


def frame(df: DataFrame, path: str = "") -> Dataset:
    """A DataFrame as a dataset."""
    return Dataset(df, "typed", "parquet", path)
