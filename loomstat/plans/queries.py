"""Registered queries: each applies operators to whole test tables; beside most stands the same result as DuckDB SQL.

Doubles are rounded to nine significant digits on both sides, because sums in another order differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import text
from loomstat.operators import diff, diffusion, evaluate, pairs, profile, structure, synth
from loomstat.operators.evaluate import nearest_two
from loomstat.sources.cells import Dataset, cells, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame) -> DataFrame:
    """Nine significant digits as C's printf gives them, which rounds the binary value itself; zeros of either sign are 0.

    Java's formatter rounds the shortest decimal text, so a number that prints with a ten-digit half could go the other way.
    Ten digits decide unless the last is 5; then the sign of what the number has beyond that half, which is exact."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    if not doubles:
        return df
    texts = {n: f"_ten_{k}" for k, n in enumerate(doubles)}
    tens = df.select("*", *[F.format_string("%.9e", F.abs(F.col(f"`{n}`"))).alias(t) for n, t in texts.items()])

    def product_error(a: Column, b: Column) -> Column:
        """a * b less its rounded value (Dekker)."""
        high = lambda c: c * 134217729.0 - (c * 134217729.0 - c)
        (ah, al), (bh, bl) = ((high(c), c - high(c)) for c in (a, b))
        return ((ah * bh - a * b) + ah * bl + al * bh) + al * bl

    def sig(n: str) -> Column:
        x, t = F.abs(F.col(f"`{n}`")), F.col(texts[n])
        digits = F.concat(F.substring(t, 1, 1), F.substring(t, 3, 9)).try_cast("long")
        power = F.lit(9) - F.substring(t, 13, 4).try_cast("int")
        scale = F.concat(F.lit("1e"), F.abs(power).cast("string")).try_cast("double")
        half = digits.cast("double")
        beyond = F.when(power >= 0, (x * scale - half) + product_error(x, scale)).otherwise((x - half * scale) - product_error(half, scale))
        nine = F.floor(digits / 10)
        up = (beyond > 0) | ((beyond == 0) & (nine % 2 == 1))
        settled = F.concat((nine + F.when(up, 1).otherwise(0)).cast("string"), F.lit("e"), (F.lit(1) - power).cast("string")).try_cast("double")
        tie = F.substring(t, 11, 1) == "5"
        own = F.format_string("%.8e", x).try_cast("double")
        value = F.when(tie & (F.abs(power) <= 22), settled).otherwise(own)
        return F.when(x < 1e-9, 0.0).when(F.col(f"`{n}`") < 0, -value).otherwise(value)

    return tens.select(*[sig(n).alias(n) if n in texts else F.col(f"`{n}`") for n in df.columns])


def _sig(x: str) -> str:
    """The same in SQL."""
    return f"CASE WHEN abs({x}) < 1e-9 THEN 0.0 ELSE CAST(printf('%.8e', CAST({x} AS DOUBLE)) AS DOUBLE) END"


def _cells(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    return cells(frame(_table(spark, sf_dir, name).select(*columns)), list(columns))


def _long_sql(table: str, columns: tuple[str, ...], kind: str = "DOUBLE") -> str:
    parts = [f"SELECT '{c}' AS column_, CAST({c} AS {kind}) AS x FROM {table}" for c in columns]
    return " UNION ALL ".join(parts)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("column", "column_name")


@query(
    f"""WITH r AS ({_long_sql('lineitem', LINE)}), l AS (SELECT *, x - avg(x) OVER (PARTITION BY column_) AS g FROM r)
SELECT column_ AS column_name, count(*) AS count, {_sig('min(x)')} AS min, {_sig('max(x)')} AS max, {_sig('sum(x)')} AS sum,
 {_sig('avg(x)')} AS mean, {_sig('var_pop(x)')} AS variance, {_sig('stddev_pop(x)')} AS stddev, {_sig('max(x) - min(x)')} AS range,
 {_sig('CASE WHEN avg(x) = 0 THEN 0 ELSE stddev_pop(x) / abs(avg(x)) END')} AS coefficient_of_variation,
 count(*) FILTER (x = 0) AS zero_count, count(*) FILTER (x > 0) AS positive_count, count(*) FILTER (x < 0) AS negative_count,
 count(*) FILTER (abs(x - round(x)) < 1e-9) AS integer_like_count, abs(max(x) - min(x)) < 1e-12 AS is_constant,
 {_sig('avg(g*g*g) / avg(g*g)^1.5')} AS skewness, {_sig('avg(g*g*g*g) / avg(g*g)^2 - 3')} AS kurtosis_excess
FROM l GROUP BY column_"""
)
def numeric_profile_lineitem(spark, sf_dir):
    return _round(_named(profile.numeric_moments(profile.numbers(_cells(spark, sf_dir, "lineitem", LINE)))))


@query(
    f"""WITH l AS ({_long_sql('lineitem', LINE)}),
q AS (SELECT column_, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75,
  quantile_cont(x, 0.95) AS p95, mad(x) AS mad, count(*) - count(DISTINCT x) AS dup, count(*) AS n FROM l GROUP BY column_),
o AS (SELECT l.column_, count(*) FILTER (x < p25 - 1.5 * (p75 - p25) OR x > p75 + 1.5 * (p75 - p25)) AS outliers
  FROM l JOIN q USING (column_) GROUP BY l.column_)
SELECT column_ AS column_name, {_sig('p50')} AS median, {_sig('p25')} AS p25, {_sig('p50')} AS p50, {_sig('p75')} AS p75,
 {_sig('p95')} AS p95, {_sig('p75 - p25')} AS iqr, {_sig('mad')} AS mad, dup AS duplicate_count, {_sig('dup / n')} AS duplicate_ratio,
 outliers AS outlier_count_tukey FROM q JOIN o USING (column_)"""
)
def numeric_shape_lineitem(spark, sf_dir):
    return _round(_named(profile.numeric_order(profile.numbers(_cells(spark, sf_dir, "lineitem", LINE)))))


ORDERS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _presence_sql(table: str, columns: dict[str, str]) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, CASE WHEN count({e}) = 0 THEN 'null' ELSE '{k}' END AS dominant_type, count({e}) AS non_null_count, "
        f"count(*) - count({e}) AS null_count, 0::BIGINT AS missing_count, {_sig(f'count({e}) / count(*)')} AS completeness_ratio, "
        f"{_sig(f'(count(*) - count({e})) / count(*)')} AS null_ratio FROM {table}"
        for c, (e, k) in columns.items()
    ]
    return " UNION ALL ".join(parts)


@query(
    _presence_sql(
        "orders",
        {
            "o_orderstatus": ("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END", "string"),
            "o_totalprice": ("CASE WHEN o_totalprice > 1000 THEN o_totalprice END", "number"),
            "o_orderdate": ("o_orderdate", "number"),
            "flag": ("o_orderkey % 2 = 0", "boolean"),
            "nothing": ("NULL", "null"),
        },
    )
)
def presence_profile_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    shown = orders.select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        (F.col("o_orderkey") % 2 == 0).alias("flag"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return _round(_named(profile.presence(cells(frame(shown)), orders.count())))


VALUED = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query(
    f"""WITH l AS ({_long_sql('orders', VALUED, 'VARCHAR')}), c AS (SELECT column_, x, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_ ORDER BY n DESC, x) AS place, sum(n) OVER (PARTITION BY column_) AS total FROM c)
SELECT column_ AS column_name, place::INT AS place, x AS value, n, {_sig('n / total')} AS ratio FROM r WHERE place <= 5"""
)
def top_values_orders(spark, sf_dir):
    return _round(_named(profile.top_values(_cells(spark, sf_dir, "orders", VALUED))))


@query(
    f"""WITH l AS ({_long_sql('orders', VALUED, 'VARCHAR')}), c AS (SELECT column_, x, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY column_) AS total FROM c)
SELECT column_ AS column_name, max(n) AS mode_count, {_sig('max(n / total)')} AS mode_ratio, {_sig('-sum(n / total * log2(n / total))')} AS entropy
FROM t GROUP BY column_"""
)
def mode_entropy_orders(spark, sf_dir):
    return _round(_named(profile.mode_and_entropy(_cells(spark, sf_dir, "orders", VALUED))))


@query(
    f"""SELECT column_ AS column_name, count(DISTINCT x) AS distinct_count, {_sig('count(DISTINCT x) / count(x)')} AS distinct_ratio,
 {_sig('count(DISTINCT x) / count(x)')} AS uniqueness_ratio FROM ({_long_sql('orders', VALUED, 'VARCHAR')}) GROUP BY column_"""
)
def distinct_orders(spark, sf_dir):
    return _round(_named(profile.distinct_counts(_cells(spark, sf_dir, "orders", VALUED))))


@query(
    """WITH e AS (SELECT 'up' AS c, o_orderkey AS k, o_orderkey // 10 AS x FROM orders UNION ALL SELECT 'down', o_orderkey, -o_orderkey FROM orders
UNION ALL SELECT 'price', o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'same', o_orderkey, 7 FROM orders),
s AS (SELECT c, x, lag(x) OVER (PARTITION BY c ORDER BY k) AS p FROM e)
SELECT c AS column_name, coalesce(bool_and(x >= p), true) AS monotonic_increasing, coalesce(bool_and(x <= p), true) AS monotonic_decreasing
FROM s GROUP BY c"""
)
def monotonic_flags(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    values = {"up": F.floor(key / 10), "down": -key, "price": F.col("o_totalprice"), "same": F.lit(7)}
    each = F.array(*[F.struct(F.lit(n).alias("column"), v.cast("double").alias("num")) for n, v in values.items()])
    nums = orders.select(key.alias("row_id"), F.explode(each).alias("x")).select("row_id", "x.*")
    return _named(profile.numeric_monotone(nums))


_SPACE = r"\s"
_PREDICATES_SQL = {
    "date_like": r"regexp_full_match(t, '[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') AND try_cast(t AS DATE) IS NOT NULL",
    "email_like": r"regexp_full_match(t, '[^@]+@[^@]*\.[^@]*', 's')",
    "ip_like": r"regexp_full_match(x, '((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])')",
    "uuid_like": r"regexp_full_match(x, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{32}')",
    "url_like": r"regexp_full_match(lower(t), '(https?://|www\.).*', 's')",
    "json_like": r"regexp_full_match(t, '\{.*\}|\[.*\]', 's')",
    "numeric_like": r"regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan)')",
    "boolean_like": r"lower(t) IN ('true', 'false', 'yes', 'no', 'y', 'n', '0', '1')",
    "hex_like": r"regexp_full_match(t, '(0[xX])?[0-9a-fA-F]{4,}')",
    "base64_like": r"length(t) >= 8 AND length(t) % 4 = 0 AND regexp_full_match(t, '[A-Za-z0-9+/=]*') AND NOT ends_with(t, '===')",
    "mac_address_like": r"regexp_full_match(t, '[0-9a-fA-F]{2}(:[0-9a-fA-F]{2}){5}|[0-9a-fA-F]{2}(-[0-9a-fA-F]{2}){5}')",
    "zip_code_like": r"regexp_full_match(t, '[0-9]{5}(-[0-9]{4})?')",
}


def _strings_sql(source: str) -> str:
    counts = ", ".join(f"count(*) FILTER ({p}) AS {n}_count" for n, p in _PREDICATES_SQL.items())
    phone = (
        "count(*) FILTER (length(regexp_replace(t, '[^0-9]', '', 'g')) >= 7 AND regexp_full_match(t, '[0-9+\\-(). ]*') "
        f"AND regexp_matches(t, '[+\\-(). ]') AND NOT ({_PREDICATES_SQL['ip_like'].replace('(x,', '(t,', 1)}) AND NOT ({_PREDICATES_SQL['date_like']})) AS phone_like_count"
    )
    words = r"len(regexp_extract_all(x, '\S+'))"
    return f"""WITH l AS ({source}), t AS (SELECT *, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS t FROM l)
SELECT column_ AS column_name, count(*) AS count, min(length(x)) AS min_length, max(length(x)) AS max_length,
 {_sig('avg(length(x))')} AS average_length, {_sig('quantile_cont(length(x), 0.5)')} AS median_length, count(*) FILTER (x = '') AS empty_count,
 count(*) FILTER (x <> '' AND t = '') AS whitespace_only_count, {_sig(f'avg({words})')} AS average_word_count,
 max({words}) AS max_word_count, {counts}, {phone}, count(*) FILTER (regexp_full_match(x, '[\\x00-\\x7F]*', 's')) AS ascii_only_count
FROM t GROUP BY column_"""


@query(_strings_sql("SELECT 'documents_text' AS column_, text AS x FROM documents UNION ALL SELECT 'conversations_text', text FROM conversations"))
def string_profile_texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.lit("documents_text").alias("column"), F.col("text").alias("str"))
    turns = _table(spark, sf_dir, "conversations").select(F.lit("conversations_text").alias("column"), F.col("text").alias("str"))
    return _round(_named(profile.string_summary(docs.union(turns).where("str is not null").withColumn("kind", F.lit("string")))))


SEMANTIC = {
    "url": "SELECT url FROM pages",
    "c_name": "SELECT c_name FROM customer",
    "props": "SELECT props FROM events",
    "event_date": "SELECT strftime(ts, '%Y-%m-%d') FROM events",
    "zip": "SELECT lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') FROM customer",
    "phone": "SELECT '+1 (555) ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') FROM customer",
    "email": "SELECT 'u' || c_custkey || '@example.' || c_mktsegment FROM customer",
    "ip": "SELECT (s_suppkey % 300) || '.0.' || (s_nationkey) || '.1' FROM supplier",
    "price": "SELECT CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) FROM part",
    "hex": "SELECT md5(p_name) FROM part",
    "mac": "SELECT '0a:1b:2c:3d:4e:' || lpad(CAST(p_size AS VARCHAR), 2, '0') FROM part",
    "answer": "SELECT CASE WHEN toxic = 1 THEN ' Yes ' ELSE 'no' END FROM labels",
}


@query(_strings_sql(" UNION ALL ".join(f"SELECT '{n}' AS column_, * FROM ({s}) AS s(x)" for n, s in SEMANTIC.items())))
def semantic_counts(spark, sf_dir):
    t = lambda n: _table(spark, sf_dir, n)
    cust, part, sup, events = t("customer"), t("part"), t("supplier"), t("events")
    found = {
        "url": t("pages").select("url"),
        "c_name": cust.select("c_name"),
        "props": events.select("props"),
        "event_date": events.select(F.date_format("ts", "yyyy-MM-dd")),
        "zip": cust.select(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")),
        "phone": cust.select(F.concat(F.lit("+1 (555) "), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))),
        "email": cust.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example."), "c_mktsegment")),
        "ip": sup.select(F.concat((F.col("s_suppkey") % 300).cast("string"), F.lit(".0."), F.col("s_nationkey").cast("string"), F.lit(".1"))),
        "price": part.select(F.col("p_retailprice").cast("decimal(18,2)").cast("string")),
        "hex": part.select(F.md5("p_name")),
        "mac": part.select(F.concat(F.lit("0a:1b:2c:3d:4e:"), F.lpad(F.col("p_size").cast("string"), 2, "0"))),
        "answer": t("labels").select(F.when(F.col("toxic") == 1, " Yes ").otherwise("no")),
    }
    all_ = None
    for name, df in found.items():
        one = df.toDF("str").select(F.lit(name).alias("column"), "str", F.lit("string").alias("kind"))
        all_ = one if all_ is None else all_.union(one)
    return _round(_named(profile.string_summary(all_)))


@query(
    f"""WITH l AS (SELECT 'toxic' AS c, toxic = 1 AS b FROM labels UNION ALL SELECT 'quality', quality = 1 FROM labels)
SELECT c AS column_name, count(*) FILTER (b) AS true_count, count(*) FILTER (NOT b) AS false_count, {_sig('count(*) FILTER (b) / count(*)')} AS true_ratio
FROM l GROUP BY c"""
)
def boolean_profile_labels(spark, sf_dir):
    flags = _table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 1).alias("quality"))
    return _round(_named(profile.boolean_summary(cells(frame(flags)))))


@query(
    """SELECT 'ts' AS column_name, count(*) AS count, strftime(min(ts), '%Y-%m-%dT%H:%M:%S+00:00') AS min,
 strftime(max(ts), '%Y-%m-%dT%H:%M:%S+00:00') AS max, min(epoch_us(ts)) AS min_micros, max(epoch_us(ts)) AS max_micros FROM events"""
)
def temporal_profile_events(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    texts = events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    found = profile.temporal_summary(cells(frame(texts)))
    micros = profile.numbers(cells(frame(events.select("ts")))).groupBy("column").agg(
        F.min("num").cast("long").alias("min_micros"), F.max("num").cast("long").alias("max_micros")
    )
    return _named(found.join(micros, "column"))


PAIRED = ("o_orderpriority", "o_orderstatus", "o_custkey", "o_shippriority")


def _orders_pairs(spark, sf_dir) -> DataFrame:
    shown = _table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("state"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_custkey") % 11).alias("group"),
    )
    return pairs.paired(frame(shown))


_ORDER_PAIRS = """WITH o AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS state, o_orderpriority AS priority, CAST(o_custkey % 11 AS VARCHAR) AS "group" FROM orders),
p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS l, '{b}' AS r, \"{a}\" AS x, \"{b}\" AS y FROM o"
    for a, b in (("group", "priority"), ("group", "state"), ("group", "status"), ("priority", "state"), ("priority", "status"), ("state", "status"))
) + ") "


@query(
    _ORDER_PAIRS
    + f"""SELECT l AS "left", r AS "right", count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS paired_non_null_count,
 {_sig('count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*)')} AS overlap_ratio, count(*) FILTER (x IS NULL AND y IS NULL) AS both_null_or_missing_count,
 count(*) FILTER (x = y) AS equal_scalar_count, {_sig('count(*) FILTER (x = y) / count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)')} AS equal_scalar_ratio
FROM p GROUP BY l, r"""
)
def pair_presence_orders(spark, sf_dir):
    return _round(pairs.pair_presence(_orders_pairs(spark, sf_dir)))


@query(
    _ORDER_PAIRS
    + f""", b AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), v AS (SELECT l, r, x AS v, 1 AS s FROM b UNION SELECT l, r, y, 2 FROM b),
g AS (SELECT l, r, v, sum(s) AS s FROM v GROUP BY l, r, v)
SELECT l AS "left", r AS "right", count(*) FILTER (s = 3) AS shared_distinct_scalar_count, {_sig('count(*) FILTER (s = 3) / count(*)')} AS scalar_jaccard_index
FROM g GROUP BY l, r"""
)
def pair_overlap_orders(spark, sf_dir):
    return _round(pairs.pair_overlap(_orders_pairs(spark, sf_dir)))


_CATEGORICAL = """, j AS (SELECT l, r, x, y, count(*) AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY l, r) AS t, sum(n) OVER (PARTITION BY l, r, x) AS nx, sum(n) OVER (PARTITION BY l, r, y) AS ny FROM j),
h AS (SELECT l, r, any_value(t) AS t, count(*) AS distinct_pair_count, sum((n - nx * ny / t) ^ 2 / (nx * ny / t)) AS chi,
 -sum(n / t * log2(n / t)) AS hxy, -sum(n / t * log2(nx / t)) AS hx, -sum(n / t * log2(ny / t)) AS hy,
 least(count(DISTINCT x), count(DISTINCT y)) AS k FROM m GROUP BY l, r) """


@query(
    _ORDER_PAIRS
    + _CATEGORICAL
    + f"""SELECT l AS "left", r AS "right", distinct_pair_count, {_sig('greatest(0, hx + hy - hxy)')} AS mutual_information,
 {_sig('CASE WHEN hx * hy = 0 THEN 0 ELSE greatest(0, hx + hy - hxy) / sqrt(hx * hy) END')} AS normalized_mutual_information, {_sig('chi')} AS chi_square,
 {_sig('CASE WHEN k <= 1 THEN 0 ELSE sqrt(chi / (t * (k - 1))) END')} AS cramers_v FROM h"""
)
def pair_categorical_orders(spark, sf_dir):
    return _round(pairs.pair_categorical(_orders_pairs(spark, sf_dir)))


@query(
    _ORDER_PAIRS
    + f""", j AS (SELECT l, r, x || ' | ' || y AS value, count(*) AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY n DESC, value) AS place, sum(n) OVER (PARTITION BY l, r) AS t FROM j)
SELECT l AS "left", r AS "right", place::INT AS place, value, n, {_sig('n / t')} AS ratio FROM k WHERE place <= 5"""
)
def top_combinations_orders(spark, sf_dir):
    return _round(pairs.top_combinations(_orders_pairs(spark, sf_dir)))


_LINE_PAIRS = "WITH p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS l, '{b}' AS r, {a} AS x, {b} AS y FROM lineitem"
    for a, b in (
        ("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_discount", "l_tax"),
        ("l_extendedprice", "l_quantity"), ("l_extendedprice", "l_tax"), ("l_quantity", "l_tax"),
    )
) + ") "


def _line_pairs(spark, sf_dir) -> DataFrame:
    return pairs.paired(frame(_table(spark, sf_dir, "lineitem").select(*LINE)))


@query(
    _LINE_PAIRS
    + f"""SELECT l AS "left", r AS "right", {_sig('covar_pop(x, y)')} AS covariance, {_sig('corr(x, y)')} AS pearson_correlation,
 {_sig('covar_pop(x, y) / var_pop(x)')} AS slope, {_sig('avg(y) - covar_pop(x, y) / var_pop(x) * avg(x)')} AS intercept, {_sig('corr(x, y) ^ 2')} AS r_squared
FROM p GROUP BY l, r"""
)
def pair_numeric_lineitem(spark, sf_dir):
    return _round(pairs.pair_numeric(_line_pairs(spark, sf_dir)))


@query(
    _LINE_PAIRS
    + f""", k AS (SELECT l, r, rank() OVER (PARTITION BY l, r ORDER BY x) + (count(*) OVER (PARTITION BY l, r, x) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY l, r ORDER BY y) + (count(*) OVER (PARTITION BY l, r, y) - 1) / 2.0::DOUBLE AS b FROM p)
SELECT l AS "left", r AS "right", {_sig('corr(a, b)')} AS spearman_correlation FROM k GROUP BY l, r"""
)
def pair_spearman_lineitem(spark, sf_dir):
    return _round(pairs.pair_spearman(_line_pairs(spark, sf_dir)))


def _events(spark, sf_dir) -> Dataset:
    rows = _table(spark, sf_dir, "events").select(F.parse_json("props").alias("props"), F.col("event_type"), F.col("value"))
    each = F.create_map(
        F.lit("props"), F.col("props"),
        F.lit("event_type"), F.col("event_type").cast("variant"),
        F.lit("value"), F.col("value").cast("variant"),
    )
    return Dataset(rows.select(F.to_variant_object(each).alias("v")), "dynamic", "jsonl")


@query(
    """WITH e AS (SELECT 'event_type' AS path, 'string' AS k FROM events UNION ALL SELECT 'value', 'number' FROM events
UNION ALL SELECT 'props', 'object' FROM events UNION ALL SELECT 'props.' || key, CASE json_type(value) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
 WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END
 FROM (SELECT unnest(json_keys(props)) AS key, json_extract(props, '$.' || unnest(json_keys(props))) AS value FROM events)),
c AS (SELECT path, k, count(*) AS n FROM e GROUP BY path, k)
SELECT path, sum(n)::BIGINT AS occurrence_count, coalesce(sum(n) FILTER (k = 'null'), 0)::BIGINT AS null_count,
 string_agg(k || ':' || n, ', ' ORDER BY k || ':' || n) AS types FROM c GROUP BY path"""
)
def nested_paths_events(spark, sf_dir):
    return structure.nested_fields(_events(spark, sf_dir))


@query(
    f"""SELECT 'embedding' AS column_name, count(*) AS row_count_with_arrays, min(len(embedding)) AS min_length, max(len(embedding)) AS max_length,
 {_sig('avg(len(embedding))')} AS average_length, 'number:' || sum(len(embedding))::BIGINT AS element_types FROM embeddings"""
)
def array_structure_embeddings(spark, sf_dir):
    return _round(_named(structure.array_summary(frame(_table(spark, sf_dir, "embeddings").select("embedding")))))


@query(
    f"""WITH k AS (SELECT unnest(json_keys(props)) AS value FROM events), c AS (SELECT value, count(*) AS n FROM k GROUP BY value)
SELECT 'props' AS column_name, row_number() OVER (ORDER BY n DESC, value)::INT AS place, value, n, {_sig('n / (SELECT count(*) FROM events)')} AS ratio
FROM c ORDER BY n DESC, value LIMIT 5"""
)
def object_keys_events(spark, sf_dir):
    return _round(_named(structure.object_summary(_events(spark, sf_dir))[1]))


@query(
    """SELECT 'array' AS kind, count(*) AS n FROM embeddings UNION ALL SELECT 'number', count(label) + count(vec_id) FROM embeddings"""
)
def kind_totals_embeddings(spark, sf_dir):
    return structure.kind_totals(cells(frame(_table(spark, sf_dir, "embeddings"))))


@query(
    """SELECT column_name, tabular_type FROM (VALUES ('o_orderkey', 'int64'), ('o_totalprice', 'float64'), ('o_orderstatus', 'utf8'),
 ('o_orderdate', 'int64'), ('late', 'boolean'), ('nothing', 'utf8')) AS t(column_name, tabular_type)"""
)
def tabular_types_orders(spark, sf_dir):
    late = (F.col("o_orderstatus") == "O").alias("late")
    shown = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate", late, F.lit(None).cast("string").alias("nothing"))
    return _named(structure.tabular_types(cells(frame(shown))))


#: Texts of cells, and what they are.
CSV_CELLS = [
    ("007", "number", 7.0, True), ("+5", "number", 5.0, True), (" 5 ", "number", 5.0, True), ("1d", "string", None, False),
    ("nan", "string", None, False), ("inf", "string", None, False), ("TRUE", "boolean", None, False), ("", "null", None, False),
    ("18446744073709551615", "number", 1.8446744073709552e19, True), ("1e3", "number", 1000.0, False), ("abc ", "string", None, False),
    ("-0.5", "number", -0.5, False), ("1e999", "string", None, False), (".5", "number", 0.5, False), ("1.", "number", 1.0, False),
]


@query(
    "SELECT cell, kind, num, is_int FROM (VALUES "
    + ", ".join(f"('{c}', '{k}', {'NULL' if n is None else repr(n)}::DOUBLE, {str(i).lower()})" for c, k, n, i in CSV_CELLS)
    + ") AS t(cell, kind, num, is_int)"
)
def csv_cell_inference(spark, sf_dir):
    rows = spark.createDataFrame([(c,) for c, *_ in CSV_CELLS], "cell string")
    return rows.select("cell", text.csv_cell(F.col("cell")).alias("c")).select("cell", "c.kind", "c.num", "c.is_int")


@query(
    f"""WITH c AS (SELECT l_extendedprice AS x, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY x),
f AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER () AS gap FROM c)
SELECT 'l_extendedprice' AS column_name, {_sig('max(abs(gap))')} AS ks FROM f"""
)
def ks_distance_lineitem(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag") == "R"
    return _round(_named(evaluate.ks_distances(items.where(flag), items.where(~flag), ["l_extendedprice"])))


@query(
    f"""WITH s AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM s),
g AS (SELECT sum(r) FILTER (y = 1) AS r, count(*) FILTER (y = 1)::DOUBLE AS p, count(*) FILTER (y = 0)::DOUBLE AS q FROM k)
SELECT {_sig('(r - p * (p + 1) / 2) / (p * q)')} AS auc FROM g"""
)
def auc_rank_labels(spark, sf_dir):
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return _round(evaluate.auc(both, "n_chars", "quality"))


@query(
    """WITH a AS (SELECT DISTINCT lang, n_chars FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3'))
SELECT 'row' AS signature, count(*) AS n FROM documents d WHERE source NOT IN ('src0', 'src1', 'src2', 'src3') AND EXISTS (SELECT 1 FROM a WHERE a.lang = d.lang AND a.n_chars = d.n_chars)
UNION ALL SELECT 'features', count(*) FROM documents d WHERE source NOT IN ('src0', 'src1', 'src2', 'src3') AND n_chars IN (SELECT n_chars FROM a)"""
)
def exact_match_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    inside = F.col("source").isin("src0", "src1", "src2", "src3")
    a, b = docs.where(inside).select("lang", "n_chars"), docs.where(~inside).select("lang", "n_chars")
    names = ["lang", "n_chars"]
    rows = evaluate.matches(a, b, evaluate.row_signature(names, a), evaluate.row_signature(names, b))
    same = evaluate.matches(a, b, evaluate.feature_signature(["n_chars"]), evaluate.feature_signature(["n_chars"]))
    return rows.select(F.lit("row").alias("signature"), "n").union(same.select(F.lit("features"), "n"))


_NEAR = """WITH m AS (SELECT avg(s_acctbal) AS ma, stddev_pop(s_acctbal) AS sa, avg(s_nationkey) AS mn, stddev_pop(s_nationkey) AS sn FROM supplier),
real AS (SELECT s_suppkey AS id, (s_acctbal - ma) / sa AS x, (s_nationkey - mn) / sn AS y FROM supplier, m),
syn AS (SELECT c_custkey AS id, (c_acctbal - ma) / sa AS x, (c_nationkey - mn) / sn AS y FROM customer, m) """


def _summary_sql(kind: str, column: str, source: str) -> str:
    q = lambda p: _sig(f"quantile_cont({column}, {p})")
    return (
        f"SELECT '{kind}' AS kind, count(*) AS count, {_sig(f'min({column})')} AS min, {q(0.05)} AS p5, {q(0.5)} AS median, "
        f"{_sig(f'avg({column})')} AS mean, {q(0.95)} AS p95, {_sig(f'max({column})')} AS max FROM {source}"
    )


@query(
    _NEAR
    + """, d AS (SELECT s.id, sqrt((s.x - r.x) ^ 2 + (s.y - r.y) ^ 2) AS d FROM syn s, real r),
k AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS place FROM d),
n AS (SELECT id, max(d) FILTER (place = 1) AS d1, max(d) FILTER (place = 2) AS d2 FROM k WHERE place <= 2 GROUP BY id),
o AS (SELECT a.id, min(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS d1 FROM real a JOIN real b ON a.id <> b.id GROUP BY a.id),
r AS (SELECT CASE WHEN d2 = 0 THEN 1.0 ELSE d1 / d2 END AS d FROM n) """
    + " UNION ALL ".join([_summary_sql("dcr", "d1", "n"), _summary_sql("nndr", "d", "r"), _summary_sql("baseline", "d1", "o")])
)
def distance_metrics(spark, sf_dir):
    real = _table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"))
    made = _table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"))
    names = ["acctbal", "nationkey"]
    scale = evaluate.standardisation(real, names)
    a, b = evaluate.vectors(real, names, *scale), evaluate.vectors(made, names, *scale)
    near, own = nearest_two(b, a), nearest_two(a, a, exclude_self=True)
    found = {"dcr": evaluate.closest_distance(near), "nndr": evaluate.distance_ratio(near), "baseline": evaluate.closest_distance(own)}
    out = None
    for kind, distances in found.items():
        one = evaluate.distance_summary(distances).select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.union(one)
    return _round(out)


@query(
    """WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE 's' END AS side, lang, CAST(n_chars % 300 AS VARCHAR) AS size FROM documents),
v AS (SELECT 'lang' AS c, lang AS v, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 's') AS s FROM d GROUP BY v
 UNION ALL SELECT 'size', size, count(*) FILTER (side = 'r'), count(*) FILTER (side = 's') FROM d GROUP BY size),
g AS (SELECT c, count(*) FILTER (r > 0) AS a, count(*) FILTER (s > 0) AS b, count(*) FILTER (r = 1) AS e, count(*) FILTER (s = 1) AS f,
 count(*) FILTER (r > 0 AND r < 5) AS h, count(*) FILTER (s > 0 AND s < 5) AS i, count(*) FILTER (r > 0 AND s = 1) AS j,
 count(*) FILTER (r > 0 AND s > 0 AND s < 5) AS k, array_to_string(list_slice(list_sort(list(v) FILTER (r > 0 AND s = 1)), 1, 5), ',') AS l,
 array_to_string(list_slice(list_sort(list(v) FILTER (r > 0 AND s > 0 AND s < 5)), 1, 5), ',') AS m FROM v GROUP BY c)
SELECT c AS column_name, a AS reference_distinct_value_count, b AS synthetic_distinct_value_count, e AS reference_unique_value_count,
 f AS synthetic_unique_value_count, h AS reference_rare_value_count, i AS synthetic_rare_value_count, j AS overlapping_unique_value_count,
 k AS overlapping_rare_value_count, l AS overlapping_unique_examples, m AS overlapping_rare_examples FROM g WHERE j > 0 OR k > 0"""
)
def rare_value_alerts_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 300).cast("string").alias("size"))
    even = F.col("doc_id") % 2 == 0
    found = evaluate.rare_value_alerts(docs.where(even), docs.where(~even), ["lang", "size"])
    for c in ("overlapping_unique_examples", "overlapping_rare_examples"):
        found = found.withColumn(c, F.array_join(c, ","))
    return _named(found)


@query(
    _LINE_PAIRS.replace(" FROM lineitem", ", l_linestatus AS s FROM lineitem")
    + f""", k AS (SELECT *, rank() OVER (PARTITION BY l, r, s ORDER BY x) + (count(*) OVER (PARTITION BY l, r, s, x) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY l, r, s ORDER BY y) + (count(*) OVER (PARTITION BY l, r, s, y) - 1) / 2.0::DOUBLE AS b FROM p),
c AS (SELECT l, r, s, corr(x, y) AS p, corr(a, b) AS q FROM k GROUP BY l, r, s)
SELECT o.l AS "left", o.r AS "right", {_sig('f.p - o.p')} AS pearson_delta, {_sig('f.q - o.q')} AS spearman_delta
FROM c o JOIN c f ON o.l = f.l AND o.r = f.r AND o.s = 'O' AND f.s = 'F'"""
)
def correlation_drift_lineitem(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    open_, done = items.where("l_linestatus = 'O'"), items.where("l_linestatus = 'F'")
    return _round(evaluate.correlation_drift(open_, done, sorted(LINE)))


_HALVES = """WITH o AS (SELECT o_orderkey % 2 AS h, o_totalprice AS x FROM orders),
s AS (SELECT h, min(x) AS min, max(x) AS max, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_pop(x) AS stddev, sum(x) AS sum FROM o GROUP BY h) """


@query(
    _HALVES
    + "SELECT 'o_totalprice' AS column_name, "
    + ", ".join(f"{_sig(f'b.{n} - a.{n}')} AS {n}_delta" for n in diff.NUMERIC)
    + " FROM s a JOIN s b ON a.h = 0 AND b.h = 1"
)
def stats_diff_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    part = lambda h: profile.numeric_summary(cells(frame(orders.where(F.col("o_orderkey") % 2 == h).select("o_totalprice"))))
    return _round(_named(diff.numeric_diff(part(0), part(1))))


@query(
    """SELECT count(*) AS row_count, true AS in_range, true AS whole_numbers, true AS others_kept, 'o_custkey,o_orderkey,o_totalprice' AS noisy_columns FROM orders"""
)
def dp_noise_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    noisy, names = synth.dp_noise(orders, 1.0, 42)
    edge = orders.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
    inside = [F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in names]
    all_in = inside[0]
    for x in inside[1:]:
        all_in = all_in & x
    counts = noisy.join(F.broadcast(edge)).agg(F.count("*").alias("row_count"), F.bool_and(all_in).alias("in_range"))
    kept = orders.groupBy("o_orderstatus").count().exceptAll(noisy.groupBy("o_orderstatus").count()).isEmpty()
    whole = dict(noisy.dtypes)["o_orderkey"] == "bigint"
    return counts.select("row_count", "in_range", F.lit(whole).alias("whole_numbers"), F.lit(kept).alias("others_kept"), F.lit(",".join(names)).alias("noisy_columns"))


@query(
    """WITH c AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY label ORDER BY n, label LIMIT 1)
SELECT (SELECT count(*) FROM customer) AS synthetic_row_count, label AS minority_label, true AS in_hull, 'c_acctbal,c_custkey,c_nationkey' AS features,
 2 * (SELECT count(*) FROM customer) AS output_row_count FROM c"""
)
def smote_customer(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    made, minority, features, label = synth.smote(customer, "c_mktsegment", seed=42)
    edge = minority.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in features for k, f in (("lo", F.min), ("hi", F.max))])
    inside = [F.col(c).between(F.col(f"lo_{c}") - 1e-9, F.col(f"hi_{c}") + 1e-9) for c in features]
    all_in = inside[0]
    for x in inside[1:]:
        all_in = all_in & x
    total = synth.append(customer, made).agg(F.count("*").alias("output_row_count"))
    found = made.join(F.broadcast(edge)).groupBy(F.col("c_mktsegment").alias("minority_label")).agg(
        F.count("*").alias("synthetic_row_count"), F.bool_and(all_in).alias("in_hull")
    )
    return found.withColumn("features", F.lit(",".join(features))).join(F.broadcast(total))


@query(
    """SELECT count(*) AS row_count, true AS in_range, 's_acctbal,s_nationkey,s_suppkey' AS numeric_columns, 's_name' AS passthrough_columns, true AS names_known,
 true AS error_is_small FROM supplier"""
)
def diffusion_supplier(spark, sf_dir):
    supplier = _table(spark, sf_dir, "supplier")
    model, mse = diffusion.train(supplier, seed=42)
    made = diffusion.generate(diffusion.Model.from_json(model.to_json()), supplier, seed=7)
    inside = [F.col(c).between(lo - 1e-9, hi + 1e-9) for c, lo, hi in zip(model.numeric_columns, model.mins, model.maxs)]
    all_in = inside[0]
    for x in inside[1:]:
        all_in = all_in & x
    known = supplier.select("s_name").distinct().withColumn("known", F.lit(True))
    return made.join(known, "s_name", "left").agg(
        F.count("*").alias("row_count"),
        F.bool_and(all_in).alias("in_range"),
        F.lit(",".join(model.numeric_columns)).alias("numeric_columns"),
        F.lit(",".join(model.passthrough_columns)).alias("passthrough_columns"),
        F.bool_and(F.coalesce("known", F.lit(False))).alias("names_known"),
        F.lit(mse < 1.0).alias("error_is_small"),
    )


_GRAM = [(a, b) for i, a in enumerate(LINE) for b in LINE[i:]]


@query(
    "SELECT "
    + ", ".join(
        [f"{_sig(f'sum({a} * {b})')} AS xx_{LINE.index(a)}_{LINE.index(b)}" for a, b in _GRAM]
        + [f"{_sig(f'sum({a} * l_linenumber)')} AS xy_{i}_0" for i, a in enumerate(LINE)]
    )
    + " FROM lineitem"
)
def ridge_gram_lineitem(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    return _round(diffusion.gram(items, [F.col(c) for c in LINE], [F.col("l_linenumber")]))
