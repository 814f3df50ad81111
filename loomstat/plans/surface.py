"""Registered queries of whole reports, schemas, sources, sinks and drivers: each goes through the entry point that a user
calls, on whole tables. Where a result is text of a fixed form, the SQL builds the same text from the tables' counts."""

from __future__ import annotations

import json


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat import cli, scratch
from loomstat.operators import diffusion, evaluate, synth
from loomstat.plans import harness, report, schema
from loomstat.plans.queries import _PREDICATES_SQL, _events, _round, _sig, _summary_sql, _table, query
from loomstat.sources import sinks
from loomstat.sources.cells import frame
from loomstat.sources.readers import read


def _rows(spark, rows: list[tuple], kinds: str) -> DataFrame:
    """A frame of a row for each column, pair or line of a report."""
    return _round(spark.createDataFrame(rows, kinds))


# Reports

_HINTS = {h: c for h, c in report.COLUMN_HINTS if c in _PREDICATES_SQL}


def _column_sql(name: str, kind: str) -> str:
    """A profile of one column of customer."""
    x = f"CAST({name} AS DOUBLE)" if kind == "number" else "NULL::DOUBLE"
    if kind == "number":
        steps = "(SELECT bool_and(g >= 0) AS up, bool_and(g <= 0) AS down FROM (SELECT {0} - lag({0}) OVER (ORDER BY rowid) AS g FROM c))".format(name)
        hints = f"(SELECT concat_ws(',', CASE WHEN up THEN 'monotonic_increasing' END, CASE WHEN down THEN 'monotonic_decreasing' END) FROM {steps})"
        length = "NULL::DOUBLE"
    else:
        t = f"(SELECT {name} AS x, trim({name}) AS t FROM c)"
        each = [f"CASE WHEN (SELECT count(*) FROM {t} WHERE {_PREDICATES_SQL[c]}) > 0 THEN '{h}' END" for h, c in _HINTS.items()]
        hints, length = f"(SELECT concat_ws(',', {', '.join(each)}))", f"{_sig(f'avg(length({name}))')}"
    counts = f"(SELECT {name}, count(*) AS n FROM c GROUP BY {name})"
    entropy = f"(SELECT -sum(n / t * log2(n / t)) FROM (SELECT n, sum(n) OVER () AS t FROM {counts}))"
    return f"""SELECT '{name}' AS column_name, '{kind}' AS dominant_type, count({name}) AS non_null_count, count(*) - count({name}) AS null_count,
 count(DISTINCT {name}) AS distinct_count, (SELECT max(n) FROM {counts}) AS mode_count, {_sig(entropy)} AS entropy,
 {_sig(f'avg({x})')} AS mean, {_sig(f'quantile_cont({x}, 0.95)')} AS p95, {length} AS average_length, {hints} AS hints FROM c"""


_CUSTOMER = {"c_acctbal": "number", "c_custkey": "number", "c_mktsegment": "string", "c_name": "string", "c_nationkey": "number"}


@query("WITH c AS (SELECT row_number() OVER () AS rowid, * FROM customer) " + " UNION ALL ".join(_column_sql(n, k) for n, k in _CUSTOMER.items()))
def report_columns_customer(spark, sf_dir):
    stats = report.analyze(frame(_table(spark, sf_dir, "customer")), ["c_custkey"])
    hints = {c["name"]: ",".join(h for h in c["semantic_hints"] if h != "phone_like") for c in stats["structure"]["columns"]}
    rows = []
    for c in stats["columns"]:
        n, s = c["numeric_summary"] or {}, c["string_summary"] or {}
        rows.append((c["name"], c["dominant_type"], c["non_null_count"], c["null_count"], c["distinct_count"], c["mode_count"], c["entropy"], n.get("mean"), n.get("p95"), s.get("average_length"), hints[c["name"]]))
    kinds = "column_name string, dominant_type string, non_null_count long, null_count long, distinct_count long, mode_count long, entropy double, mean double, p95 double, average_length double, hints string"
    return _rows(spark, rows, kinds)


_SUPPLIER_PAIRS = "WITH p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS l, '{b}' AS r, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM supplier"
    for a, b in (("s_acctbal", "s_nationkey"), ("s_acctbal", "s_suppkey"), ("s_nationkey", "s_suppkey"))
) + """), k AS (SELECT *, rank() OVER (PARTITION BY l, r ORDER BY x) + (count(*) OVER (PARTITION BY l, r, x) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY l, r ORDER BY y) + (count(*) OVER (PARTITION BY l, r, y) - 1) / 2.0::DOUBLE AS b FROM p) """


@query(
    _SUPPLIER_PAIRS
    + f"""SELECT l AS "left", r AS "right", count(*) AS paired_non_null_count, {_sig('corr(x, y)')} AS pearson, {_sig('corr(a, b)')} AS spearman,
 {_sig('regr_slope(y, x)')} AS slope, count(DISTINCT (x, y)) AS distinct_pair_count FROM k GROUP BY l, r"""
)
def report_pairs_supplier(spark, sf_dir):
    found = report.pair_report(frame(_table(spark, sf_dir, "supplier")), ["s_acctbal", "s_nationkey", "s_suppkey"])
    rows = []
    for p in found:
        n = p["numeric_relationship"]
        rows.append((p["left"], p["right"], p["paired_non_null_count"], n["pearson_correlation"], n["spearman_correlation"], n["slope"], p["categorical_relationship"]["distinct_pair_count"]))
    return _rows(spark, rows, "left string, right string, paired_non_null_count long, pearson double, spearman double, slope double, distinct_pair_count long")


@query(
    """SELECT '| n_name | string | ' || count(*) || ' | 0 | 0 | ' || count(DISTINCT n_name) || ' | min_len=' || min(length(n_name)) || ', max_len=' || max(length(n_name))
 || ', avg_len=' || printf('%.2f', avg(length(n_name))) || ', empty=0, date_like=0, email_like=0, ip_like=0, url_like=0, json_like=0 |' AS line FROM nation
UNION ALL SELECT '| n_name | string:' || count(*) || ' | flat scalar | - |' FROM nation UNION ALL SELECT '| n_name | ' || count(*) || ' | 0 | string:' || count(*) || ' |' FROM nation
UNION ALL SELECT '- Rows: `' || count(*) || '`' FROM nation UNION ALL SELECT '- Columns: `2`' UNION ALL SELECT '# Dataset Statistics Report'
UNION ALL SELECT '| Column | Dominant Type | Non-Null | Null | Missing | Distinct | Notes |'"""
)
def report_markdown_nation(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("land of "), "n_name").substr(9, 100).alias("n_name"), "n_regionkey")
    lines = report.to_markdown(report.analyze(frame(nation))).splitlines()
    wanted = ("| n_name |", "- Rows", "- Columns", "# Dataset", "| Column | Dominant")
    return spark.createDataFrame([(x,) for x in lines if x.startswith(wanted)], "line string")


_PARTED = """WITH a AS (SELECT * FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT * FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey < 20),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) """


@query(
    _PARTED
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, nb - na AS non_null_delta, (SELECT count(DISTINCT {c}) FROM b) - (SELECT count(DISTINCT {c}) FROM a) AS distinct_delta,
 {_sig(f'(SELECT avg({c}) FROM b) - (SELECT avg({c}) FROM a)')} AS mean_delta, {_sig(f'(SELECT stddev_pop({c}) FROM b) - (SELECT stddev_pop({c}) FROM a)')} AS stddev_delta,
 {_sig(f'(SELECT median({c}) FROM b) - (SELECT median({c}) FROM a)')} AS median_delta, nb - na AS row_count_delta,
 {_sig('(SELECT corr(c_acctbal, c_nationkey) FROM b) - (SELECT corr(c_acctbal, c_nationkey) FROM a)')} AS pearson_delta,
 {_sig('(SELECT regr_intercept(c_nationkey, c_acctbal) FROM b) - (SELECT regr_intercept(c_nationkey, c_acctbal) FROM a)')} AS intercept_delta FROM n"""
        for c in ("c_acctbal", "c_nationkey")
    )
)
def report_diff_customer(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", "c_custkey")
    a, b = customer.where("c_custkey % 2 = 0").drop("c_custkey"), customer.where("c_custkey % 2 = 1 AND c_nationkey < 20").drop("c_custkey")
    found = report.compare(report.analyze(frame(a)), report.analyze(frame(b)))
    pair = found["column_pairs"][0]["numeric_relationship"]
    rows = []
    for c in found["columns"]:
        n = c["numeric_summary"]
        rows.append((c["name"], c["non_null_delta"], c["distinct_delta"], n["mean_delta"], n["stddev_delta"], n["median_delta"], found["row_count_delta"], pair["pearson_correlation_delta"], pair["intercept_delta"]))
    kinds = "column_name string, non_null_delta long, distinct_delta long, mean_delta double, stddev_delta double, median_delta double, row_count_delta long, pearson_delta double, intercept_delta double"
    return _rows(spark, rows, kinds)


@query(
    f"""WITH k AS (SELECT len(json_keys(props)) AS n FROM events), kinds AS (SELECT count(*) AS n FROM events)
SELECT 'props' AS column_name, count(*) AS row_count_with_objects, min(n)::BIGINT AS key_count_min, max(n)::BIGINT AS key_count_max, {_sig('avg(n)')} AS average_key_count,
 'number:' || count(*) || ',object:' || count(*) || ',string:' || count(*) AS dataset_types, 3 + (SELECT count(DISTINCT x) FROM (SELECT unnest(json_keys(props)) AS x FROM events)) AS nested_field_count FROM k"""
)
def report_structure_events(spark, sf_dir):
    data = _events(spark, sf_dir)
    stats = report.analyze(data, ["value"])["structure"]
    o = next(c["object_summary"] for c in stats["columns"] if c["name"] == "props")
    types = ",".join(f"{k}:{n}" for k, n in stats["dataset_type_counts"].items())
    rows = [("props", o["row_count_with_objects"], o["key_count_min"], o["key_count_max"], o["average_key_count"], types, stats["nested_field_count"])]
    kinds = "column_name string, row_count_with_objects long, key_count_min long, key_count_max long, average_key_count double, dataset_types string, nested_field_count long"
    return _rows(spark, rows, kinds)


# Schemas

_TREE = {
    "markdown": """# Dataset Schema

- Name: `Events`
- Source Format: `jsonl`
- Root Types: object:{n}

## Fields

| Path | Required | Types | Semantic Hints |
| --- | --- | --- | --- |
| $ | - | object | - |
| $.event_type | yes | string | - |
| $.props | yes | object | - |
| $.props.k | yes | number | - |
| $.value | yes | number | - |
""",
    "typescript": "export interface Events {\n  event_type: string;\n  props: {\n  k: number;\n};\n  value: number;\n}",
    "python": """from typing import Any, Dict, List, Optional, TypedDict


class Events(TypedDict, total=False):
    event_type: str
    props: Dict[str, Any]  # nested object with 1 fields
    value: float
""",
    "avro": '{"type":"record","name":"Events","fields":[{"name":"event_type","type":"string"},{"name":"props","type":{"type":"record","name":"EventsProps","fields":[{"name":"k","type":"double"}]}},{"name":"value","type":"double"}]}',
    "json-schema": '{"$schema":"https://json-schema.org/draft/2020-12/schema","title":"Events","type":"object","properties":{"event_type":{"type":"string"},"props":{"properties":{"k":{"type":"number"}},"required":["k"],"type":"object"},"value":{"type":"number"}},"required":["event_type","props","value"]}',
    "openapi": '{"openapi":"3.1.0","info":{"title":"Events","version":"1.0.0"},"components":{"schemas":{"Events":{"properties":{"event_type":{"type":"string"},"props":{"properties":{"k":{"type":"number"}},"required":["k"],"type":"object"},"value":{"type":"number"}},"required":["event_type","props","value"],"type":"object"}}}}',
    "json": '{"name":"Events","format":"jsonl","root":{"kinds":{"object":{n}},"nullable":false,"semantic_hints":[],"object":{"fields":[{"name":"event_type","required":true,"schema":{"kinds":{"string":{n}},"nullable":false,"semantic_hints":[],"object":null,"array":null}},{"name":"props","required":true,"schema":{"kinds":{"object":{n}},"nullable":false,"semantic_hints":[],"object":{"fields":[{"name":"k","required":true,"schema":{"kinds":{"number":{n}},"nullable":false,"semantic_hints":[],"object":null,"array":null}}]},"array":null}},{"name":"value","required":true,"schema":{"kinds":{"number":{n}},"nullable":false,"semantic_hints":[],"object":null,"array":null}}]},"array":null}}',
}


def _schema_query(output: str):
    def run(spark, sf_dir):
        text = schema.render(schema.infer(_events(spark, sf_dir)), schema.type_name("events"), "jsonl", output)
        if output not in ("markdown", "typescript", "python"):
            text = json.dumps(json.loads(text), separators=(",", ":"))
        return spark.createDataFrame([(text,)], "text string")

    run.__name__ = f"schema_{output.replace('-', '_')}_events"
    text = "'" + _TREE[output].replace("'", "''").replace("{n}", "' || n || '") + "'"
    return query(f"SELECT {text} AS text FROM (SELECT count(*) AS n FROM events)")(run)


for _output in cli.SCHEMA_OUTPUTS:
    _schema_query(_output)


@query(
    """WITH s AS (SELECT unnest(['url', 'html']) AS path), u AS (SELECT count(*) AS n, count(*) FILTER (regexp_matches(url, '^(https?://|www\\.)')) AS url FROM pages)
SELECT path, CASE WHEN path = 'url' AND url > 0 THEN 'url_like' ELSE '' END AS hints, n AS occurrences FROM s, u WHERE path = 'url'"""
)
def schema_hints_pages(spark, sf_dir):
    root = schema.infer(frame(_table(spark, sf_dir, "pages").select("url")))
    return _rows(spark, [(n, ",".join(c.hints), c.occurrences()) for n, c in root.sorted_fields()], "path string, hints string, occurrences long")


# Sources and sinks

_MICROS = "epoch_us(o_orderdate) AS o_orderdate"
_ORDERS = f"SELECT o_orderkey, o_custkey, o_orderstatus, {_sig('o_totalprice')} AS o_totalprice, {_MICROS}, o_orderpriority FROM orders"
_SUPPLIER = f"SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, {_sig('s_acctbal')} AS s_acctbal FROM supplier"


def _round_trip(kind: str, name: str, sql: str, single: bool):
    """A table written by a sink and read by its source, as flat typed columns."""

    def run(spark, sf_dir):
        path = scratch.place(spark, f"{name}.{kind}")
        sinks.write(frame(_table(spark, sf_dir, name)), path, single=single)
        return _round(cli.table_of(read(spark, path)))

    run.__name__ = f"round_trip_{kind}_{name}"
    return query(sql)(run)


_round_trip("csv", "orders", _ORDERS, True)
_round_trip("jsonl", "orders", _ORDERS, False)
_round_trip("parquet", "orders", _ORDERS, False)
_round_trip("json", "supplier", _SUPPLIER, True)
_round_trip("avro", "supplier", _SUPPLIER, True)


@query(
    """SELECT n_name AS name, '{"key":' || n_nationkey || ',"region":' || n_regionkey || '}' AS at, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS half,
 n_nationkey % 3 = 0 AS third FROM nation"""
)
def csv_sink_nested_nation(spark, sf_dir):
    shown = _table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        F.struct(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region")).alias("at"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("half"),
        (F.col("n_nationkey") % 3 == 0).alias("third"),
    )
    path = scratch.place(spark, "nation.csv")
    sinks.write(frame(shown), path)
    return cli.table_of(read(spark, path))


@query(
    """SELECT name, kind, "default" FROM (VALUES ('n_name', 'string', 'null'), ('n_nationkey', 'long', 'null'), ('n_regionkey', 'long', 'null'), ('_1st_half', 'double', 'null'),
 ('is_even', 'boolean', 'null')) AS t(name, kind, "default")"""
)
def avro_file_schema_nation(spark, sf_dir):
    shown = _table(spark, sf_dir, "nation").select("*", (F.col("n_nationkey") / 2).alias("1st half"), (F.col("n_nationkey") % 2 == 0).alias("is even"))
    _, kinds = sinks.tabular(frame(shown))
    made = sinks.avro.flat_schema(schema.type_name("all nations"), [(n, sinks.AVRO_TYPES[k]) for n, k in kinds.items()])
    assert made["name"] == "AllNations"
    return spark.createDataFrame([(f["name"], f["type"][1], json.dumps(f["default"])) for f in made["fields"]], "name string, kind string, default string")


@query("SELECT 'parquet' AS source_format, 'jsonl' AS output_format, (SELECT count(*) FROM part) AS row_count, 6::BIGINT AS column_count")
def transform_part(spark, sf_dir):
    done = cli.transform_dataset(spark, f"{sf_dir}/part.parquet", scratch.place(spark, "part.ndjson"), single=False)
    return spark.createDataFrame([tuple(done[k] for k in ("source_format", "output_format", "row_count", "column_count"))], "source_format string, output_format string, row_count long, column_count long")


@query(
    """SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, (SELECT count(*) FROM nation) AS total_row_count,
 'n_name,n_nationkey,n_regionkey' AS columns, '| ' || n_name || ' | ' || n_nationkey || ' | ' || n_regionkey || ' |' AS line FROM nation LIMIT 7"""
)
def head_nation(spark, sf_dir):
    preview = report.head(read(spark, f"{sf_dir}/nation.parquet"), 7)
    lines = report.head_markdown(preview).splitlines()[-7:]
    rows = [(r["n_nationkey"], r["n_name"], r["n_regionkey"], preview["total_row_count"], ",".join(preview["columns"]), x) for r, x in zip(preview["rows"], lines)]
    return spark.createDataFrame(rows, "n_nationkey long, n_name string, n_regionkey long, total_row_count long, columns string, line string")


@query("SELECT unnest(['export interface Region {', '  r_name: string;', '  r_regionkey: number;', '}']) AS line")
def command_line_schema_region(spark, sf_dir):
    text = cli.main(["schema", f"{sf_dir}/region.parquet", "--output", "typescript"], spark)
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


# Evaluation

_SIDES = """WITH real AS (SELECT s_suppkey AS id, s_acctbal AS acctbal, s_nationkey AS nationkey FROM supplier),
syn AS (SELECT c_custkey AS id, c_acctbal AS acctbal, c_nationkey AS nationkey FROM customer),
m AS (SELECT avg(acctbal) AS ma, stddev_pop(acctbal) AS sa, avg(nationkey) AS mn, stddev_pop(nationkey) AS sn FROM real),
a AS (SELECT id, (acctbal - ma) / sa AS x, (nationkey - mn) / sn AS y FROM real, m), b AS (SELECT id, (acctbal - ma) / sa AS x, (nationkey - mn) / sn AS y FROM syn, m) """


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    real = _table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
    made = _table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"))
    return real, made


_KS = """k{c} AS (SELECT max(abs(f)) AS ks FROM (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER () AS f
 FROM (SELECT x, sum(s = 1) AS a, sum(s = 2) AS b FROM (SELECT {c} AS x, 1 AS s FROM real UNION ALL SELECT {c}, 2 FROM syn) GROUP BY x)))"""


@query(
    _SIDES
    + ", " + _KS.format(c="acctbal") + ", " + _KS.format(c="nationkey")
    + f""", near AS (SELECT b.id, min(sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2)) AS d FROM b, a GROUP BY b.id),
own AS (SELECT p.id, min(sqrt((p.x - q.x) ^ 2 + (p.y - q.y) ^ 2)) AS d FROM a p JOIN a q ON p.id <> q.id GROUP BY p.id),
e AS (SELECT quantile_cont(d, 0.05) AS p5, quantile_cont(d, 0.5) AS m FROM own)
SELECT (SELECT count(*) FROM real) AS reference_row_count, (SELECT count(*) FROM syn) AS synthetic_row_count, 'acctbal,nationkey' AS features,
 {_sig('((SELECT ks FROM kacctbal) + (SELECT ks FROM knationkey)) / 2')} AS mean_ks, {_sig('greatest((SELECT ks FROM kacctbal), (SELECT ks FROM knationkey))')} AS max_ks,
 {_sig('abs((SELECT corr(acctbal, nationkey) FROM syn) - (SELECT corr(acctbal, nationkey) FROM real))')} AS pearson_drift,
 (SELECT count(*) FROM syn WHERE (acctbal, nationkey) IN (SELECT (acctbal, nationkey) FROM real)) AS exact_row_matches,
 (SELECT count(*) FROM near, e WHERE d <= p5) AS below_p5, (SELECT count(*) FROM near, e WHERE d <= m) AS below_median, 0::BIGINT AS reviewed_columns, 'acctbal|nationkey' AS top_drift"""
)
def evaluation_suppliers_and_customers(spark, sf_dir):
    real, made = _sides(spark, sf_dir)
    found = evaluate.evaluate(real, made, evaluate.numeric_columns(real), "suppliers", [])
    q, p = found["quality"], found["privacy"]
    drift = q["feature_correlation_drift"]
    top = drift["top_drift_pairs"][0]
    row = (
        found["reference_row_count"], found["synthetic_row_count"], ",".join(found["feature_columns"]), q["mean_univariate_ks_distance"],
        q["max_univariate_ks_distance"], drift["max_absolute_pearson_delta"], p["exact_row_match_count"], p["synthetic_below_real_dcr_p5_count"],
        p["synthetic_below_real_dcr_median_count"], p["rare_value_alerts"]["reviewed_columns"], f"{top['left']}|{top['right']}",
    )
    kinds = "reference_row_count long, synthetic_row_count long, features string, mean_ks double, max_ks double, pearson_drift double, exact_row_matches long, below_p5 long, below_median long, reviewed_columns long, top_drift string"
    return _rows(spark, [row], kinds)


def _five(x: str) -> str:
    return f"round({x}, 5)"


@query(
    _SIDES.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", d AS (SELECT x, y, 0.0::DOUBLE AS t FROM a UNION ALL SELECT x, y, 1.0::DOUBLE FROM b),
g(k, u, v, w) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
 SELECT k + 1, u - 0.1 * (avg((p - t) * x) + 0.0001 * u), v - 0.1 * (avg((p - t) * y) + 0.0001 * v), w - 0.1 * avg(p - t)
 FROM (SELECT k, u, v, w, x, y, t, 1 / (1 + exp(-(u * x + v * y + w))) AS p FROM g, d WHERE k < 400) GROUP BY k, u, v, w),
s AS (SELECT t, 1 / (1 + exp(-(u * x + v * y + w))) AS p FROM g, d WHERE k = 400), c AS (SELECT avg(t) AS q FROM d),
r AS (SELECT t, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM s)
SELECT {_five('avg((p - q) ^ 2)')} AS pmse, {_five('avg(((p >= 0.5) = (t = 1))::INT)')} AS accuracy,
 {_five('(avg((p >= 0.5)::INT) FILTER (t = 1) + avg((p < 0.5)::INT) FILTER (t = 0)) / 2')} AS balanced_accuracy FROM s, c"""
)
def propensity_suppliers_and_customers(spark, sf_dir):
    real, made = _sides(spark, sf_dir)
    names = ["acctbal", "nationkey"]
    scale = evaluate.standardisation(real, names)
    found = evaluate.propensity(evaluate.vectors(real, names, *scale), evaluate.vectors(made, names, *scale))
    row = tuple(round(found[k], 5) for k in ("pmse", "accuracy", "balanced_accuracy"))
    return spark.createDataFrame([row], "pmse double, accuracy double, balanced_accuracy double")


@query(
    f"""WITH m AS (SELECT avg(n_chars) AS a, stddev_pop(n_chars) AS s FROM documents)
SELECT {_sig('a')} AS mean_n_chars, {_sig('s')} AS spread_n_chars, {_sig('(SELECT max((n_chars - a) / s) FROM documents)')} AS largest, 1.0::DOUBLE AS constant_spread FROM m"""
)
def standardisation_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("n_chars", F.lit(3).alias("three"))
    means, spreads = evaluate.standardisation(docs, ["n_chars", "three"])
    largest = evaluate.vectors(docs, ["n_chars", "three"], means, spreads).agg(F.max(F.col("x")[0])).first()[0]
    return _rows(spark, [(float(means[0]), float(spreads[0]), largest, float(spreads[1]))], "mean_n_chars double, spread_n_chars double, largest double, constant_spread double")


# Synthesis

@query("SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang ORDER BY n, label LIMIT 1")
def minority_label_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    label = synth.minority_label(docs, "lang")
    return synth.label_counts(docs, "lang").where(F.col("label") == label)


@query("SELECT n_name AS name, n_regionkey::DOUBLE AS k FROM nation UNION ALL SELECT r_name, r_regionkey + 0.5 FROM region")
def union_append(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("k"))
    return synth.append(nation, _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 0.5).alias("k")))


@query(
    """WITH p AS (SELECT a.s_suppkey AS row_no, b.s_suppkey AS near, row_number() OVER (PARTITION BY a.s_suppkey
 ORDER BY sqrt((a.s_acctbal - b.s_acctbal) ^ 2 + (a.s_nationkey - b.s_nationkey) ^ 2), b.s_suppkey) AS place FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey)
SELECT row_no, (place - 1)::INT AS place, near FROM p WHERE place <= 5"""
)
def smote_neighbours_supplier(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "row_no")
    near = synth.neighbours(rows, ["s_acctbal", "s_nationkey"], 5)
    return near.select("row_no", F.posexplode("near").alias("place", "near"))


@query("SELECT count(*) // 3 AS row_count, count(*) // 3 AS distinct_keys, true AS all_known FROM orders")
def sample_exactly_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    some = synth.exactly(orders, orders.count() // 3, 11)
    known = orders.withColumn("known", F.lit(True))
    return some.join(known, "o_orderkey", "left").agg(
        F.count("*").alias("row_count"), F.count_distinct("o_orderkey").alias("distinct_keys"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known")
    )


@query(
    f"""SELECT unnest([{_sig('-2 * ln(2)')}, 0.0, {_sig('2 * ln(2)')}, {_sig('2 * ln(50)')}]) AS noise, unnest([0.25, 0.5, 0.75, 0.99])::DOUBLE AS u"""
)
def laplace_quantiles(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in (0.25, 0.5, 0.75, 0.99)], "u double")
    return _round(rows.select("u", synth.laplace(F.col("u"), F.lit(2.0)).alias("noise")))


# Diffusion

@query(
    f"""WITH b AS (SELECT t, 0.0001 + t * (0.02 - 0.0001) / 99 AS beta FROM range(100) AS r(t))
SELECT t::INT AS t, {_sig('beta')} AS beta, {_sig('exp(sum(ln(1 - beta)) OVER (ORDER BY t))')} AS alpha_bar FROM b"""
)
def diffusion_schedule(spark, sf_dir):
    s = diffusion.Schedule.linear(100)
    return _rows(spark, [(t, s.betas[t], s.alpha_bars[t]) for t in range(100)], "t int, beta double, alpha_bar double")


@query(
    f"""SELECT 's_acctbal' AS column_name, {_sig('avg(s_acctbal)')} AS mean, {_sig('stddev_pop(s_acctbal)')} AS stddev, {_sig('min(s_acctbal)')} AS min, {_sig('max(s_acctbal)')} AS max FROM supplier
UNION ALL SELECT 'one', 1.0, 1.0, 1.0, 1.0"""
)
def diffusion_column_statistics(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select("s_acctbal", F.lit(1).alias("one"))
    names = ["s_acctbal", "one"]
    s = diffusion.column_statistics(rows, names)
    return _rows(spark, [(n, s["means"][k], s["stddevs"][k], s["mins"][k], s["maxs"][k]) for k, n in enumerate(names)], "column_name string, mean double, stddev double, min double, max double")


@query(
    f"""SELECT t::INT AS t, {_sig('t / 8.0')} AS share, {_sig('sin(2 * pi() * t / 8)')} AS sine, {_sig('cos(2 * pi() * t / 8)')} AS cosine FROM range(8) AS r(t)"""
)
def diffusion_time_features(spark, sf_dir):
    share, sine, cosine = diffusion.time_features(F.col("t"), 8)
    return _round(spark.range(8).select(F.col("id").cast("int").alias("t")).select("t", share.alias("share"), sine.alias("sine"), cosine.alias("cosine")))


@query(
    f"""WITH s AS (SELECT sum(l_quantity * l_quantity) + 0.001 AS a, sum(l_quantity * l_tax) AS b, sum(l_tax * l_tax) + 0.001 AS d,
 sum(l_quantity * l_discount) AS p, sum(l_tax * l_discount) AS q FROM lineitem)
SELECT {_sig('(d * p - b * q) / (a * d - b * b)')} AS w_quantity, {_sig('(a * q - b * p) / (a * d - b * b)')} AS w_tax FROM s"""
)
def ridge_solution_lineitem(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    sums = diffusion.gram(items, [F.col("l_quantity"), F.col("l_tax")], [F.col("l_discount")]).first()
    w = diffusion.ridge(sums, 2, 1, 1e-3)
    return _rows(spark, [(float(w[0, 0]), float(w[1, 0]))], "w_quantity double, w_tax double")


@query(
    f"""SELECT {_sig('avg(s_acctbal)')} AS mean, 0.0::DOUBLE AS spread, count(*) AS n, 'Supplier' AS passthrough_kind, 2::BIGINT AS names FROM supplier"""
)
def diffusion_artifact_supplier(spark, sf_dir):
    """A model file read again generates from its own numbers: with a range of one point, that point."""
    supplier = _table(spark, sf_dir, "supplier").select("s_acctbal", F.lit("Supplier").alias("kind"))
    model, _ = diffusion.train(supplier, timesteps=4, examples=1, seed=3)
    again = diffusion.Model.from_json(model.to_json())
    again.mins = again.maxs = list(again.means)
    made = diffusion.generate(again, supplier, seed=5)
    return _round(made.agg(F.avg("s_acctbal").alias("mean"), F.stddev_pop("s_acctbal").alias("spread"), F.count("*").alias("n"), F.min("kind").alias("passthrough_kind"), F.lit(len(made.columns)).cast("long").alias("names")))


# The bulk job

@query(
    _SIDES
    + f""", near AS (SELECT b.id, min(sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2)) AS d FROM b, a GROUP BY b.id)
SELECT (SELECT c_mktsegment FROM customer WHERE false) AS target, {_sig('(SELECT count(*) FROM syn WHERE (acctbal, nationkey) IN (SELECT (acctbal, nationkey) FROM real)) / (SELECT count(*) FROM syn)')} AS exact_replay_ratio,
 {_sig('(SELECT median(d) FROM near)')} AS dcr_median"""
)
def bulk_scores(spark, sf_dir):
    real, made = _sides(spark, sf_dir)
    found = harness.score(real, made, ["acctbal", "nationkey"])
    return _rows(spark, [(harness.pick_target(real), found["exact_replay_ratio"], found["dcr_median"])], "target string, exact_replay_ratio double, dcr_median double")



