"""Structure of nested values: kinds, lengths, keys and paths at every depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions import text
from loomstat.functions.text import csv_cell, let
from loomstat.operators.profile import top_of
from loomstat.sources.cells import Dataset, normalised

ITEM = "[]"
#: Hints that a string value can give to a schema node, in name order.
VALUE_HINTS = {
    "email_like": text.email_like,
    "ip_like": text.ip_like,
    "json_like": text.json_like,
    "mac_like": text.mac_like,
    "phone_like": text.phone_like,
    "temporal": text.date_like,
    "url_like": text.url_like,
    "uuid_like": text.uuid_like,
    "zip_like": text.zip_like,
}


def as_variants(data: Dataset) -> DataFrame:
    """One VARIANT object ``v`` for each row, whatever the shape of the source. Typed nulls are explicit."""
    if data.shape == "dynamic":
        return data.rows
    if data.shape == "text":
        cell = lambda n: csv_cell(F.col(f"`{n}`"))
        quoted = lambda c: F.to_json(F.array(c["str"]))
        raw = lambda c: F.when(c["kind"] == "string", F.regexp_extract(quoted(c), "(?s)^\\[(.*)\\]$", 1)).otherwise(
            F.coalesce(c["label"], F.lit("null"))
        )
        parts = [F.concat(F.lit(_json_key(n) + ":"), let(cell(n), raw)) for n in data.rows.columns]
        return data.dealt().select(F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))).alias("v"))
    fields = [normalised(F.col(f"`{f.name}`"), f.dataType)[0].alias(f.name) for f in data.rows.schema.fields]
    return data.rows.select(F.to_variant_object(F.struct(*fields)).alias("v"))


def _json_key(name: str) -> str:
    import json

    return json.dumps(name)


MAP, ARRAY = "map<string, variant>", "array<variant>"


def depth(data: Dataset) -> int:
    """How deep containers nest under the root: from the schema of a typed source, otherwise from one aggregation."""
    if data.shape == "typed":
        return 1 + max((_depth_of(f.dataType) for f in data.rows.schema.fields), default=0)
    if data.shape == "text":
        return 1
    shape = as_variants(data).agg(F.schema_of_variant_agg("v").alias("s")).first()["s"] or ""
    if "VARIANT" not in shape:
        deep = most = 0
        for c in shape:
            deep += (c == "<") - (c == ">")
            most = max(most, deep)
        return max(1, most)
    # Kinds differ somewhere, so the merged shape ends there: look level by level.
    found = 1
    while not _nodes(data, found).where((F.size("steps") == found) & F.col("kind").isin("array", "object")).isEmpty():
        found += 1
    return found


def _depth_of(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return 1 + max((_depth_of(f.dataType) for f in kind.fields), default=0)
    if isinstance(kind, T.ArrayType):
        return 1 + _depth_of(kind.elementType)
    if isinstance(kind, T.MapType):  # an array of entries
        return 2 + _depth_of(kind.valueType)
    return 0


def variant_kind(v: Column) -> Column:
    scalar = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null")
        .when(v.try_cast(MAP).isNotNull(), "object")
        .when(v.try_cast(ARRAY).isNotNull(), "array")
        .otherwise(F.when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "boolean").otherwise("number"))
    )


def _below(v: Column, steps: Column, levels_: int) -> Column:
    """array<struct<steps, v>> of a value and of everything in it, ``levels_`` deep."""
    own = F.array(F.struct(steps.alias("steps"), v.alias("v")))
    if not levels_:
        return own
    none = F.array().cast("array<struct<steps: array<string>, v: variant>>")

    def field(e: Column) -> Column:
        return F.struct(F.concat(steps, F.array(F.concat(F.lit("."), e["key"]))).alias("steps"), e["value"].alias("v"))

    def item(x: Column) -> Column:
        return F.struct(F.concat(steps, F.array(F.lit(ITEM))).alias("steps"), x.alias("v"))

    fields = F.coalesce(F.transform(F.map_entries(v.try_cast(MAP)), field), none)
    items = F.coalesce(F.transform(v.try_cast(ARRAY), item), none)
    deeper = F.transform(F.concat(fields, items), lambda k: _below(k["v"], k["steps"], levels_ - 1))
    return F.concat(own, F.flatten(deeper))


def _nodes(data: Dataset, levels_: int) -> DataFrame:
    """steps (path from the root), v, kind of all values of all rows, in one pass."""
    root = F.array().cast("array<string>")
    rows = as_variants(data).select(F.explode(_below(F.col("v"), root, levels_)).alias("x")).select("x.steps", "x.v")
    return rows.withColumn("kind", variant_kind(F.col("v")))


def path_stats(data: Dataset) -> DataFrame:
    """steps, kind, n, and for strings whether any value gives a hint; [] is the root, '.name' a field, '[]' an item."""
    text_ = F.when(F.col("kind") == "string", F.col("v").cast("string"))
    nodes = _nodes(data, depth(data)).select("steps", "kind", text_.alias("s"))
    hints = [F.coalesce(F.bool_or(like(F.col("s"))), F.lit(False)).alias(name) for name, like in VALUE_HINTS.items()]
    return nodes.groupBy("steps", "kind").agg(F.count("*").alias("n"), *hints)


def _top(data: Dataset) -> DataFrame:
    """column, v of every present top-level cell."""
    entries = F.explode(F.map_entries(F.col("v").try_cast(MAP))).alias("e")
    return as_variants(data).select(entries).select(F.col("e.key").alias("column"), F.col("e.value").alias("v"))


def path_name(steps: Column) -> Column:
    """a, a.b, a[], a[].b"""
    return F.regexp_replace(F.array_join(steps, ""), "^\\.", "")


def nested_fields(data: Dataset) -> DataFrame:
    """path, occurrence_count, null_count, types ("kind:count, ..." in kind order) of all paths, top ones included."""
    nodes = _nodes(data, depth(data)).where(F.size("steps") > 0)
    stats = nodes.groupBy(path_name(F.col("steps")).alias("path"), "kind").agg(F.count("*").alias("n"))
    kinds = F.sort_array(F.collect_list(F.concat("kind", F.lit(":"), F.col("n").cast("string"))))
    return stats.groupBy("path").agg(
        F.sum("n").alias("occurrence_count"),
        F.sum(F.when(F.col("kind") == "null", F.col("n")).otherwise(0)).alias("null_count"),
        F.array_join(kinds, ", ").alias("types"),
    )


def array_summary(data: Dataset) -> DataFrame:
    """Of top-level columns that hold arrays: rows, lengths, kinds of elements."""
    arrays = _top(data).select("column", F.col("v").try_cast(ARRAY).alias("items")).where("items is not null")
    size = F.size("items").cast("long")
    found = arrays.groupBy("column").agg(
        F.count("*").alias("row_count_with_arrays"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.avg(size).alias("average_length"),
    )
    elements = arrays.select("column", F.explode("items").alias("v")).select("column", variant_kind(F.col("v")).alias("kind"))
    kinds = elements.groupBy("column", "kind").agg(F.count("*").alias("n")).groupBy("column").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("kind", F.lit(":"), F.col("n").cast("string")))), ", ").alias("element_types")
    )
    return found.join(kinds, "column", "left").withColumn("element_types", F.coalesce("element_types", F.lit("")))


def object_summary(data: Dataset) -> tuple[DataFrame, DataFrame]:
    """Of top-level columns that hold objects: rows and key counts; and their commonest keys."""
    objects = _top(data).select("column", F.map_keys(F.col("v").try_cast(MAP)).alias("keys")).where("keys is not null")
    size = F.size("keys").cast("long")
    found = objects.groupBy("column").agg(
        F.count("*").alias("row_count_with_objects"),
        F.min(size).alias("key_count_min"),
        F.max(size).alias("key_count_max"),
        F.avg(size).alias("average_key_count"),
    )
    counts = objects.select("column", F.explode("keys").alias("value")).groupBy("column", "value").agg(F.count("*").alias("n"))
    named = counts.join(found.select("column", "row_count_with_objects"), "column")
    best = top_of(named, ["column"], "value", F.col("row_count_with_objects"))
    return found, best.select("column", "place", "value", "n", "ratio")


def kind_totals(cells: DataFrame) -> DataFrame:
    """kind, n over all cells; missing cells aren't counted."""
    return cells.groupBy("kind").agg(F.count("*").alias("n"))


def tabular_types(cells: DataFrame) -> DataFrame:
    """The column type that a flat file gets: Boolean, Int64, Float64 or Utf8."""
    whole = F.col("is_int") & (F.col("num") >= -(2.0**63)) & (F.col("num") < 2.0**63)
    there = cells.where("kind != 'null'")
    found = there.groupBy("column").agg(
        F.bool_and(F.col("kind") == "boolean").alias("b"),
        F.bool_and((F.col("kind") == "number") & whole).alias("i"),
        F.bool_and(F.col("kind") == "number").alias("f"),
    )
    of = F.when(F.col("b"), "boolean").when(F.col("i"), "int64").when(F.col("f"), "float64").otherwise("utf8")
    every = cells.select("column").distinct()
    return every.join(found.select("column", of.alias("t")), "column", "left").select("column", F.coalesce("t", F.lit("utf8")).alias("tabular_type"))
