"""Avro object container files: a reader of all types and a writer of flat nullable records."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa

MAGIC = b"Obj\x01"


class _Input:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        found = self.data[self.at : self.at + n]
        if len(found) < n:
            raise ValueError("an Avro file ends too early")
        self.at += n
        return found

    def long(self) -> int:
        shift = result = 0
        while True:
            b = self.take(1)[0]
            result |= (b & 0x7F) << shift
            if not b & 0x80:
                return (result >> 1) ^ -(result & 1)
            shift += 7

    def bytes(self) -> bytes:
        return self.take(self.long())


def _names(schema, known: dict, space: str = "") -> None:
    """Collects named types for later references."""
    if isinstance(schema, list):
        for s in schema:
            _names(s, known, space)
    elif isinstance(schema, dict):
        if schema["type"] in ("record", "enum", "fixed", "error"):
            space = schema.get("namespace", space)
            known[schema["name"]] = known[f"{space}.{schema['name']}"] = schema
        for f in schema.get("fields", []):
            _names(f["type"], known, space)
        for inner in ("items", "values"):
            if inner in schema:
                _names(schema[inner], known, space)
        if isinstance(schema["type"], (dict, list)):
            _names(schema["type"], known, space)


def _read(schema, data: _Input, known: dict):
    if isinstance(schema, list):
        return _read(schema[data.long()], data, known)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _read(kind, data, known)
    if kind == "null":
        return None
    if kind == "boolean":
        return data.take(1) != b"\0"
    if kind in ("int", "long"):
        return data.long()
    if kind in ("float", "double"):
        x = struct.unpack("<f" if kind == "float" else "<d", data.take(4 if kind == "float" else 8))[0]
        if x != x or x in (float("inf"), float("-inf")):
            raise ValueError("encountered a non-finite float")
        return x
    if kind in ("bytes", "fixed"):
        raw = data.bytes() if kind == "bytes" else data.take(schema["size"])
        logical = schema.get("logicalType") if isinstance(schema, dict) else None
        if logical == "decimal":
            return str(int.from_bytes(raw, "big", signed=True) / 10 ** schema.get("scale", 0))
        return list(raw)
    if kind == "string":
        return data.bytes().decode()
    if kind == "enum":
        return schema["symbols"][data.long()]
    if kind == "array" or kind == "map":
        items, pairs = [], {}
        while n := data.long():
            if n < 0:
                n = -n
                data.long()
            for _ in range(n):
                if kind == "array":
                    items.append(_read(schema["items"], data, known))
                else:
                    key = data.bytes().decode()
                    pairs[key] = _read(schema["values"], data, known)
        return items if kind == "array" else pairs
    if kind in ("record", "error"):
        return {f["name"]: _read(f["type"], data, known) for f in schema["fields"]}
    return _read(known[kind], data, known)


def _unpacked(raw: bytes, codec: str) -> bytes:
    if codec == "null":
        return raw
    if codec == "deflate":
        return zlib.decompress(raw, -15)
    if codec == "snappy":
        size = shift = 0
        for b in raw:  # the unpacked size stands first, seven bits a byte
            size |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                break
        return pa.Codec("snappy").decompress(raw[:-4], size).to_pybytes()
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    raise ValueError(f"unsupported Avro codec: {codec}")


def records(content: bytes) -> Iterator[dict]:
    data = _Input(content)
    if data.take(4) != MAGIC:
        raise ValueError("not an Avro object container file")
    meta = _read({"type": "map", "values": "bytes"}, data, {})
    schema = json.loads(bytes(meta["avro.schema"]))
    codec = bytes(meta.get("avro.codec", list(b"null"))).decode()
    known: dict = {}
    _names(schema, known)
    if not isinstance(schema, dict) or schema.get("type") != "record":
        raise ValueError("expected Avro records at the top level")
    sync = data.take(16)
    while data.at < len(data.data):
        n = data.long()
        block = _Input(_unpacked(data.bytes(), codec))
        for _ in range(n):
            yield _read(schema, block, known)
        if data.take(16) != sync:
            raise ValueError("an Avro block has the wrong sync marker")


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            held: list[str] = []
            for record in records(content):
                held.append(json.dumps(record, ensure_ascii=False))
                if len(held) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def safe_name(name: str) -> str:
    """Letters, digits and underscores, none of the digits first."""
    found = re.sub("[^A-Za-z0-9_]", "_", name)
    if not found:
        return "_field"
    return found if re.match("[A-Za-z_]", found) else f"_{found}"


def flat_schema(record: str, columns: list[tuple[str, str]]) -> dict:
    """Of nullable boolean, long, double and string fields."""
    return {
        "type": "record",
        "name": record,
        "fields": [{"name": safe_name(n), "type": ["null", t], "default": None} for n, t in columns],
    }


def _long(x: int) -> bytes:
    x = (x << 1) ^ (x >> 63)
    out = bytearray()
    while x > 0x7F:
        out.append((x & 0x7F) | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def _value(x, kind: str) -> bytes:
    if x is None:
        return _long(0)
    if kind == "boolean":
        body = b"\1" if x else b"\0"
    elif kind == "long":
        body = _long(int(x))
    elif kind == "double":
        body = struct.pack("<d", float(x))
    else:
        raw = str(x).encode()
        body = _long(len(raw)) + raw
    return _long(1) + body


BLOCK = 4096  # rows


def header(record: str, columns: list[tuple[str, str]], sync: bytes) -> bytes:
    """What a file of Snappy blocks begins with."""
    meta = {"avro.schema": json.dumps(flat_schema(record, columns)).encode(), "avro.codec": b"snappy"}
    pairs = (_long(len(k)) + k.encode() + _long(len(v)) + v for k, v in meta.items())
    return MAGIC + _long(len(meta)) + b"".join(pairs) + _long(0) + sync


def block(rows: Iterable[tuple], columns: list[tuple[str, str]], sync: bytes) -> bytes:
    """One block of rows (tuples in the order of columns)."""
    kinds, held, n = [kind for _, kind in columns], bytearray(), 0
    for row in rows:
        for x, kind in zip(row, kinds):
            held += _value(x, kind)
        n += 1
    packed = pa.Codec("snappy").compress(bytes(held), asbytes=True) + struct.pack(">I", zlib.crc32(held))
    return _long(n) + _long(len(packed)) + packed + sync
