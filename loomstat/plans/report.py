"""The dataset report: all statistics assembled from profile frames, as a dict, JSON or Markdown.

Only frames of a row for each column, pair, path or top value reach the driver.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators import diff as diff_
from loomstat.operators import pairs as pairs_
from loomstat.operators import profile, structure
from loomstat.sources.cells import Dataset, cells

#: Hints of a column, in report order, by the counter that gives them.
COLUMN_HINTS = (
    ("temporal", "date_like"),
    ("email_like", "email_like"),
    ("ip_like", "ip_like"),
    ("uuid_like", "uuid_like"),
    ("url_like", "url_like"),
    ("phone_like", "phone_like"),
    ("json_like", "json_like"),
    ("hex_like", "hex_like"),
    ("base64_like", "base64_like"),
    ("mac_like", "mac_address_like"),
    ("zip_like", "zip_code_like"),
)


def _by(df: DataFrame, key: str = "column") -> dict[str, dict]:
    rows = [r.asDict() for r in df.collect()]
    return {r.pop(key): r for r in rows}


def _lists(df: DataFrame, keys: tuple[str, ...]) -> dict:
    found = defaultdict(list)
    for r in df.orderBy(*keys, "place").collect():
        found[tuple(r[k] for k in keys)].append({"value": r["value"], "count": r["n"], "ratio": r["ratio"]})
    return found


def analyze(data: Dataset, pair_columns: list[str] | None = None) -> dict:
    """The full report. ``pair_columns`` limits the pairs; by default all columns are paired."""
    names, rows = data.columns(), data.count()
    long = cells(data).persist()
    columns = _by(profile.column_profile(long, rows))
    kinds = defaultdict(dict)
    for r in profile.kind_counts(long).collect():
        kinds[r["column"]][r["kind"]] = r["n"]
    top = _lists(profile.top_values(long), ("column",))
    numeric, strings = _by(profile.numeric_summary(long)), _by(profile.string_summary(long))
    booleans, times = _by(profile.boolean_summary(long)), _by(profile.temporal_summary(long))
    long.unpersist()
    out = []
    for n in names:
        c = columns.get(n, {"dominant_type": "null", "non_null_count": 0, "null_count": 0, "missing_count": rows})
        found = {k: v for k, v in kinds[n].items() if k != "null"}
        out.append(
            {"name": n, **c, "value_type_counts": dict(sorted(found.items())), "top_values": top[(n,)]}
            | {"numeric_summary": numeric.get(n), "string_summary": strings.get(n)}
            | {"boolean_summary": booleans.get(n), "temporal_summary": times.get(n)}
        )
    return {
        "source_path": data.path,
        "format": data.format,
        "row_count": rows,
        "column_count": len(names),
        "structure": structure_report(data, out, kinds),
        "columns": out,
        "column_pairs": pair_report(data, pair_columns),
    }


def structure_report(data: Dataset, columns: list[dict], kinds: dict[str, dict[str, int]]) -> dict:
    totals: dict[str, int] = defaultdict(int)
    for of_column in kinds.values():
        for kind, n in of_column.items():
            totals[kind] += n
    nested, arrays, objects = [], {}, {}
    if columns:
        for r in structure.nested_fields(data).orderBy("path").collect():
            types = {k: int(n) for k, n in (x.rsplit(":", 1) for x in r["types"].split(", "))}
            nested.append({"path": r["path"], "occurrence_count": r["occurrence_count"], "null_count": r["null_count"], "observed_types": types})
    if totals.get("array"):
        arrays = _by(structure.array_summary(data))
        for a in arrays.values():
            text = a.pop("element_types")
            a["element_type_counts"] = {k: int(n) for k, n in (x.rsplit(":", 1) for x in text.split(", "))} if text else {}
    if totals.get("object"):
        sizes, keys = structure.object_summary(data)
        objects, commonest = _by(sizes), _lists(keys, ("column",))
        for n, o in objects.items():
            o["top_keys"] = commonest[(n,)]
    return {
        "dataset_type_counts": dict(sorted(totals.items())),
        "nested_field_count": len(nested),
        "nested_fields": nested,
        "columns": [
            {
                "name": c["name"],
                "observed_types": dict(sorted(kinds[c["name"]].items())),
                "array_summary": arrays.get(c["name"]),
                "object_summary": objects.get(c["name"]),
                "semantic_hints": column_hints(c),
            }
            for c in columns
        ],
    }


def column_hints(column: dict) -> list[str]:
    """Of numbers: constant, rising, falling; of strings: everything that one value at least looks like."""
    n, s = column["numeric_summary"], column["string_summary"]
    hints = []
    if n:
        flags = (("constant_numeric", "is_constant"), ("monotonic_increasing", "monotonic_increasing"), ("monotonic_decreasing", "monotonic_decreasing"))
        hints += [hint for hint, flag in flags if n[flag]]
    if s:
        hints += [hint for hint, counter in COLUMN_HINTS if s[f"{counter}_count"]]
    return hints


def pair_report(data: Dataset, columns: list[str] | None = None) -> list[dict]:
    names = sorted(columns or data.columns())
    if len(names) < 2:
        return []
    pairs = pairs_.paired(data, names).persist()
    keys = ["left", "right"]

    def by(df: DataFrame) -> dict:
        return {(r["left"], r["right"]): {k: v for k, v in r.asDict().items() if k not in keys} for r in df.collect()}

    numeric = by(pairs_.pair_numeric(pairs).join(pairs_.pair_spearman(pairs), keys))
    categorical, top = by(pairs_.pair_categorical(pairs)), _lists(pairs_.top_combinations(pairs), ("left", "right"))
    overlap, out = by(pairs_.pair_overlap(pairs)), []
    for pair, found in sorted(by(pairs_.pair_presence(pairs)).items()):
        c = categorical.get(pair)
        out.append(
            {"left": pair[0], "right": pair[1], **found, **overlap[pair], "numeric_relationship": numeric.get(pair)}
            | {"categorical_relationship": c and {**c, "top_combinations": top[pair]}}
        )
    pairs.unpersist()
    return out


def compare(before: dict, after: dict) -> dict:
    """Differences of two reports: after minus before, of columns and pairs that both have."""
    minus = lambda a, b, names: {to: b[n] - a[n] for n, to in names.items()}
    numeric = {n: f"{n}_delta" for n in diff_.NUMERIC}
    text = {"average_length": "average_length_delta", "median_length": "median_length_delta", "empty_count": "empty_count_delta"}
    ours, out = {c["name"]: c for c in before["columns"]}, []
    for b in after["columns"]:
        if a := ours.get(b["name"]):
            part = lambda key, names: minus(a[key], b[key], names) if a[key] and b[key] else None
            out.append(
                {"name": b["name"], "dominant_type_before": a["dominant_type"], "dominant_type_after": b["dominant_type"]}
                | minus(a, b, diff_.COUNTS)
                | {"top_values_before": a["top_values"], "top_values_after": b["top_values"]}
                | {"numeric_summary": part("numeric_summary", numeric), "string_summary": part("string_summary", text)}
            )
    known, pairs = {(p["left"], p["right"]): p for p in before["column_pairs"]}, []
    plain = {"paired_non_null_count": "paired_non_null_delta", "overlap_ratio": "overlap_ratio_delta", "equal_scalar_ratio": "equal_scalar_ratio_delta"}
    of_numbers = {n: f"{n}_delta" for n in ("covariance", "pearson_correlation", "spearman_correlation", "slope", "intercept", "r_squared")}
    of_values = {n: f"{n}_delta" for n in ("mutual_information", "normalized_mutual_information", "chi_square", "cramers_v")}
    for q in after["column_pairs"]:
        if p := known.get((q["left"], q["right"])):
            part = lambda key, names: minus(p[key], q[key], names) if p[key] and q[key] else None
            pairs.append(
                {"left": q["left"], "right": q["right"], **minus(p, q, plain)}
                | {"numeric_relationship": part("numeric_relationship", of_numbers)}
                | {"categorical_relationship": part("categorical_relationship", of_values)}
            )
    sizes = {}
    for what in ("row", "column"):
        a, b = before[f"{what}_count"], after[f"{what}_count"]
        sizes |= {f"original_{what}_count": a, f"generated_{what}_count": b, f"{what}_count_delta": b - a}
    return {**sizes, "columns": out, "column_pairs": pairs}


def _number(x: float) -> str:
    """As short as it goes: 3 for 3.0."""
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def _notes(c: dict) -> str:
    if n := c["numeric_summary"]:
        shown = [f"min={_number(n['min'])}", f"max={_number(n['max'])}"]
        shown += [f"{k}={n[k]:.3f}" for k in ("mean", "median", "p95")]
        return ", ".join([*shown, f"dup_ratio={n['duplicate_ratio']:.2f}", f"outliers={n['outlier_count_tukey']}", f"entropy={c['entropy']:.2f}"])
    if s := c["string_summary"]:
        shown = [f"min_len={s['min_length']}", f"max_len={s['max_length']}", f"avg_len={s['average_length']:.2f}", f"empty={s['empty_count']}"]
        return ", ".join(shown + [f"{k}={s[f'{k}_count']}" for k in ("date_like", "email_like", "ip_like", "url_like", "json_like")])
    if b := c["boolean_summary"]:
        return f"true={b['true_count']}, false={b['false_count']}, true_ratio={b['true_ratio']:.2f}"
    return _counts(c["value_type_counts"]) or "no non-null values"


def _counts(kinds: dict[str, int]) -> str:
    return ", ".join(f"{k}:{n}" for k, n in kinds.items())


def _shape(c: dict) -> str:
    if a := c["array_summary"]:
        return f"array rows={a['row_count_with_arrays']}, len {a['min_length']}..{a['max_length']}, avg_len={a['average_length']:.2f}"
    if o := c["object_summary"]:
        return f"object rows={o['row_count_with_objects']}, keys {o['key_count_min']}..{o['key_count_max']}, avg_keys={o['average_key_count']:.2f}"
    return "flat scalar"


def _table(head: list[str], rows: list[list], right: int = 0) -> list[str]:
    """Columns from the third on, ``right`` of them, are aligned to the right."""
    rule = ["---:" if 2 <= k < 2 + right else "---" for k in range(len(head))]
    return [f"| {' | '.join(map(str, cells_))} |" for cells_ in (head, rule, *rows)]


def to_markdown(report: dict) -> str:
    s = report["structure"]
    facts = {"Source": report["source_path"], "Format": report["format"], "Rows": report["row_count"], "Columns": report["column_count"]}
    facts |= {"Column Pairs": len(report["column_pairs"]), "Nested Fields": s["nested_field_count"]}
    lines = ["# Dataset Statistics Report", "", *[f"- {k}: `{v}`" for k, v in facts.items()], "", "## Structure Overview", ""]
    lines += [f"- Dataset Types: {_counts(s['dataset_type_counts'])}", ""]
    rows = [[c["name"], _counts(c["observed_types"]), _shape(c), ", ".join(c["semantic_hints"]) or "-"] for c in s["columns"]]
    lines += _table(["Column", "Observed Types", "Structure", "Semantic Hints"], rows)
    if s["nested_fields"]:
        rows = [[f["path"], f["occurrence_count"], f["null_count"], _counts(f["observed_types"])] for f in s["nested_fields"][:25]]
        lines += ["", "## Nested Fields", "", "| Path | Occurrences | Nulls | Observed Types |", "| --- | ---: | ---: | --- |"]
        lines += [f"| {' | '.join(map(str, r))} |" for r in rows]
    counts = ("dominant_type", "non_null_count", "null_count", "missing_count", "distinct_count")
    rows = [[c["name"], *[c.get(k, 0) for k in counts], _notes(c)] for c in report["columns"]]
    lines += ["", *_table(["Column", "Dominant Type", "Non-Null", "Null", "Missing", "Distinct", "Notes"], rows, 4)]
    numeric = [p for p in report["column_pairs"] if p["numeric_relationship"]]
    if numeric:
        head = ["Left", "Right", "Paired Rows", "Pearson", "Covariance", "Equal Scalars"]
        rows = []
        for p in numeric:
            r = p["numeric_relationship"]
            rows.append([p["left"], p["right"], p["paired_non_null_count"], f"{r['pearson_correlation']:.4f}", f"{r['covariance']:.4f}", p["equal_scalar_count"]])
        lines += ["", "## Numeric Column Pairs", "", *_table(head, rows, 4)]
    return "\n".join(lines) + "\n"


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=str)


def head(data: Dataset, rows: int = 5) -> dict:
    """The first rows as JSON objects, and how many there are."""
    names = data.columns()
    some = structure.as_variants(data).select(F.to_json("v").alias("j")).limit(rows).collect()
    records = [json.loads(r["j"]) for r in some]
    return {
        "source_path": data.path,
        "format": data.format,
        "total_row_count": data.count(),
        "returned_row_count": len(records),
        "column_count": len(names),
        "columns": names,
        "rows": records,
    }


def _plain(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) if isinstance(x, (list, dict)) else str(x)


def head_markdown(preview: dict) -> str:
    facts = {"Source": "source_path", "Format": "format", "Total Rows": "total_row_count", "Returned Rows": "returned_row_count", "Columns": "column_count"}
    lines = ["# Dataset Head", "", *[f"- {k}: `{preview[v]}`" for k, v in facts.items()], ""]
    names = preview["columns"]
    if not names:
        return "\n".join([*lines, "Dataset has no columns."]) + "\n"
    show = lambda x: _plain(x).replace("\n", "\\n").replace("|", "\\|")
    lines += _table(names, [[show(r.get(n)) for n in names] for r in preview["rows"]])
    return "\n".join(lines) + "\n"
