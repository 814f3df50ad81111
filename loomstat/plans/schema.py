"""Inferred schemas: a tree folded from path counts, and its renderings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from loomstat.operators.structure import ITEM, VALUE_HINTS, path_stats
from loomstat.sources.cells import Dataset


@dataclass
class Node:
    """What is known of the values at a path."""

    kinds: dict[str, int] = field(default_factory=dict)
    hints: list[str] = field(default_factory=list)
    fields: dict[str, Node] | None = None  # of objects
    item: Node | None = None  # of arrays

    @property
    def nullable(self) -> bool:
        return self.kinds.get("null", 0) > 0

    def occurrences(self) -> int:
        return sum(self.kinds.values())

    def labels(self) -> list[str]:
        return sorted(self.kinds)

    def primary(self) -> str:
        """The commonest kind that isn't null; the last by name on ties; string if there's none."""
        real = [(n, k) for k, n in self.kinds.items() if k != "null"]
        return max(real)[1] if real else "string"

    def required(self, name: str) -> bool:
        """A field that each object has, and that is never null."""
        child = self.fields[name]
        return child.occurrences() == self.kinds.get("object", 0) and not child.nullable

    def sorted_fields(self) -> list[tuple[str, Node]]:
        return sorted((self.fields or {}).items())


def infer(data: Dataset) -> Node:
    """The schema of all rows. As many numbers reach the driver as there are paths and kinds."""
    root = Node()
    for row in sorted(path_stats(data).collect(), key=lambda r: len(r["steps"])):
        node = root
        for step in row["steps"]:
            if step == ITEM:
                node.item = node.item or Node()
                node = node.item
            else:
                node.fields = {} if node.fields is None else node.fields
                node = node.fields.setdefault(step[1:], Node())
        node.kinds[row["kind"]] = node.kinds.get(row["kind"], 0) + row["n"]
        node.hints = sorted({*node.hints, *(h for h in VALUE_HINTS if row[h])})
    _close(root)
    root.fields = root.fields or {}
    return root


def _close(node: Node) -> None:
    """Containers that were always empty still have fields or an item."""
    if "object" in node.kinds and node.fields is None:
        node.fields = {}
    if "array" in node.kinds and node.item is None:
        node.item = Node()
    for _, child in node.sorted_fields():
        _close(child)
    if node.item:
        _close(node.item)


def type_name(name: str) -> str:
    """CamelCase of ASCII letters and digits."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in name).split()
    return "".join(w[0].upper() + w[1:] for w in words) or "DatasetSchema"


def _walk(path: str, node: Node, required: str) -> Iterator[tuple[str, str, str, str]]:
    yield path, required, " | ".join(node.labels()), ", ".join(node.hints) or "-"
    if node.item is not None:
        yield from _walk(f"{path}[]", node.item, "-")
    for name, child in node.sorted_fields():
        yield from _walk(f"{path}.{name}", child, "yes" if node.required(name) else "no")


def to_markdown(root: Node, name: str, format: str) -> str:
    kinds = ", ".join(f"{k}:{root.kinds[k]}" for k in root.labels())
    lines = ["# Dataset Schema", "", f"- Name: `{name}`", f"- Source Format: `{format}`", f"- Root Types: {kinds}", ""]
    lines += ["## Fields", "", "| Path | Required | Types | Semantic Hints |", "| --- | --- | --- | --- |"]
    lines += [f"| {' | '.join(cells)} |" for cells in _walk("$", root, "-")]
    return "\n".join(lines) + "\n"


def as_tree(node: Node) -> dict:
    fields = [{"name": n, "required": node.required(n), "schema": as_tree(c)} for n, c in node.sorted_fields()]
    return {
        "kinds": {k: node.kinds[k] for k in node.labels()},
        "nullable": node.nullable,
        "semantic_hints": node.hints,
        "object": None if node.fields is None else {"fields": fields},
        "array": None if node.item is None else {"item": as_tree(node.item)},
    }


def to_json(root: Node, name: str, format: str) -> str:
    return _dump({"name": name, "format": format, "root": as_tree(root)})


def _dump(x) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False)


def json_schema_of(node: Node) -> dict:
    labels = node.labels()
    out: dict = {"type": labels[0] if len(labels) == 1 else labels}
    if node.hints:
        out["x-semantic-hints"] = node.hints
    if node.fields is not None:
        out["properties"] = {n: json_schema_of(c) for n, c in node.sorted_fields()}
        out["required"] = [n for n, _ in node.sorted_fields() if node.required(n)]
    if node.item is not None:
        out["items"] = json_schema_of(node.item)
    return dict(sorted(out.items()))


def to_json_schema(root: Node, name: str) -> str:
    body = json_schema_of(root)
    head = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name, "type": "object"}
    return _dump({**head, "properties": body.get("properties", {}), "required": body.get("required", [])})


def to_openapi(root: Node, name: str) -> str:
    info = {"title": name, "version": "1.0.0"}
    return _dump({"openapi": "3.1.0", "info": info, "components": {"schemas": {name: json_schema_of(root)}}})


#: Avro types of scalar kinds.
AVRO = {"boolean": "boolean", "number": "double", "string": "string"}


def avro_of(node: Node, name: str):
    if node.fields is not None:
        fields = [{"name": n, "type": avro_of(c, f"{name}_{n}")} for n, c in node.sorted_fields()]
        kind: object = {"type": "record", "name": type_name(name), "fields": fields}
    elif node.item is not None:
        kind = {"type": "array", "items": avro_of(node.item, f"{name}_item")}
    else:
        kind = AVRO.get(node.primary(), "string")
    return ["null", kind] if node.nullable else kind


def to_avro(root: Node, name: str) -> str:
    return _dump(avro_of(root, name))


def _typescript(node: Node) -> str:
    if node.fields is not None:
        lines = [f"  {n}{'' if node.required(n) else '?'}: {_typescript(c)};" for n, c in node.sorted_fields()]
        return "\n".join(["{", *lines, "}"])
    if node.item is not None:
        inner = _typescript(node.item)
        return f"({inner})[]" if " | " in inner and not inner.startswith("{") else f"{inner}[]"
    known = ("boolean", "null", "number", "string")
    return " | ".join(k if k in known else "unknown" for k in node.labels()) or "unknown"


def to_typescript(root: Node, name: str) -> str:
    return f"export interface {type_name(name)} {_typescript(root)}"


#: Python types of scalar kinds.
PYTHON = {"boolean": "bool", "number": "float", "string": "str"}


def _python(node: Node, optional: bool) -> str:
    if node.fields is not None:
        kind = "Dict[str, Any]"
    elif node.item is not None:
        kind = f"List[{_python(node.item, False)}]"
    else:
        kind = PYTHON.get(node.primary(), "Any")
    return f"Optional[{kind}]" if optional or node.nullable else kind


def to_python(root: Node, name: str) -> str:
    lines = []
    for n, child in root.sorted_fields():
        note = f"  # nested object with {len(child.fields)} fields" if child.fields is not None else ""
        lines.append(f"    {n}: {_python(child, not root.required(n))}{note}")
    head = "from typing import Any, Dict, List, Optional, TypedDict"
    return "\n".join([head, "", "", f"class {type_name(name)}(TypedDict, total=False):", *(lines or ["    pass"])]) + "\n"


def render(root: Node, name: str, format: str, output: str) -> str:
    """``output``: markdown, json, json-schema, openapi, avro, typescript or python."""
    if output in ("markdown", "json"):
        return {"markdown": to_markdown, "json": to_json}[output](root, name, format)
    kinds = {"json-schema": to_json_schema, "openapi": to_openapi, "avro": to_avro, "typescript": to_typescript, "python": to_python}
    return kinds[output](root, name)
