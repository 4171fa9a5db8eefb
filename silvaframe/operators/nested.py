"""Deeply nested records into related flat tables.

Method: single-pass tagged emission.  A depth-first visitor walks each document
once and emits a row per object: table tag, primary key, parent key, payload.
The tagged rows are written partitioned by tag; each table is then read from
its own folder and gets its schema.  One parse serves all tables, no table is
joined to find its parent, and a document is never held by more than one task.

Defined cases.  A payload that is null or not valid JSON (a leading byte order
mark aside; ``NaN`` and ``Infinity`` are not JSON) emits nothing.  The lists may
stand at the top or one level deeper, and a top-level list is a list of
documents.  Absent, null or wrongly typed lists are empty; list members that are
no objects are skipped.  Keys come as text in one spelling: integral numbers
without fraction or leading zeros, other text trimmed.  An object without a key is
emitted with a null key.  Objects listed twice within a document come once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime as R

#: Rows in one emitted batch.
BATCH = 65536


def key_text(v: Any) -> str | None:
    """One spelling per key: 7, 7.0, "7" and " 07 " are all ``7``."""
    if v is None or isinstance(v, (bool, dict, list)):
        return None
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == v and abs(v) < 2**63 and v == int(v) else str(v)
    s = v.strip()
    whole, dot, rest = s.partition(".")
    if whole.lstrip("-").isdecimal() and whole.isascii() and not rest.strip("0"):
        digits = whole.lstrip("-").lstrip("0") or "0"
        return f"-{digits}" if whole[0] == "-" and digits != "0" else digits
    return s or None


def listed(value: Any) -> Iterator[tuple[Any, Any]]:
    """(key, object) of the objects in a list, keyed by their ``id``."""
    for o in value if isinstance(value, list) else ():
        if isinstance(o, dict):
            yield key_text(o.get("id")), o


def polygons(value: Any) -> Iterator[tuple[Any, Any]]:
    """(position, polygon) of a segmentation in any of its forms.

    A flat list of numbers and a run-length object are position 0; null, absent
    and empty ones have none, and empty members of a list keep their position free.
    """
    if isinstance(value, dict) and value:
        yield "0", value
    elif isinstance(value, list) and value:
        if isinstance(value[0], (int, float)):
            yield "0", value
        else:
            for i, part in enumerate(value):
                if isinstance(part, (list, dict)) and part:
                    yield str(i), part


@dataclass(frozen=True)
class Table:
    """One table of the result: where its objects are, and which key their parent has.

    ``parent_field``: the object's own field that names its parent; without it the
    parent is the object (or document) that holds it.
    """

    tag: str
    name: str
    members: Callable[[Any], Iterator[tuple[Any, Any]]] = listed
    parent_field: str | None = None
    nested: tuple["Table", ...] = field(default=())


COCO = (
    Table("category", "categories"),
    Table("image", "images"),
    Table("annotation", "annotations", parent_field="image_id", nested=(Table("segment", "segmentation", polygons),)),
)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def documents(text: str | None, spec: tuple[Table, ...]) -> list[dict]:
    """The objects that hold the lists of ``spec``; none for invalid JSON."""
    if text is None:
        return []
    try:
        top = json.loads(text[1:] if text[:1] == "﻿" else text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return []
    names = {t.name for t in spec}
    out = []
    for d in top if isinstance(top, list) else [top]:
        if not isinstance(d, dict):
            continue
        if names & d.keys():
            out.append(d)
        else:
            out += [v for v in d.values() if isinstance(v, dict) and names & v.keys()]
    return out


def visit(doc: dict, own_key: str, spec: tuple[Table, ...], payload: bool) -> Iterator[tuple]:
    """(tag, key, parent key, payload) of every object, depth first, each once.

    What was emitted is remembered by a digest, so long payloads are not held.
    """
    seen = set()

    def walk(holder: dict, holder_key: str | None, tables: tuple[Table, ...]) -> Iterator[tuple]:
        for t in tables:
            for key, o in t.members(holder.get(t.name)):
                parent = key_text(o.get(t.parent_field)) if t.parent_field else holder_key
                text = None
                if payload:
                    nested = {n.name for n in t.nested}
                    text = json.dumps({k: v for k, v in o.items() if k not in nested} if nested else o, ensure_ascii=False, separators=(",", ":"))
                row = (t.tag, key, parent, text)
                mark = hashlib.blake2b(f"{t.tag}\0{key}\0{parent}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if mark not in seen:
                    seen.add(mark)
                    yield row
                if t.nested:
                    yield from walk(o, key, t.nested)

    return walk(doc, own_key, spec)


TAGGED = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("tag", "pk", "parent", "payload"))])


#: The tag of the row that says which lists a document has.
DOCUMENT = "document"


def flatten(df: DataFrame, doc_id: str, text: str, spec: tuple[Table, ...] = COCO, payload: bool = True, lists: bool = False) -> DataFrame:
    """Tagged rows (doc_id, tag, pk, parent, payload) of all documents in one pass.

    ``payload`` false leaves the payload null: enough for the links alone.  ``lists`` adds a row per
    document, tagged ``document``, whose payload names the lists it has.
    """
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("tag", "pk", "parent", "payload"))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list[tuple] = []

        def full() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in cols)], schema=arrow)
            ids.clear(), rows.clear()
            return out

        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                k = keys[i].as_py()
                for d in documents(texts[i].as_py(), spec):
                    if lists:
                        ids.append(k)
                        rows.append((DOCUMENT, key_text(k), None, json.dumps(sorted({t.name for t in spec} & d.keys()))))
                    for row in visit(d, key_text(k), spec, payload):
                        ids.append(k)
                        rows.append(row)
                        if len(rows) >= BATCH:
                            yield full()
        yield full()

    return R.pick(df, k=doc_id, v=text).mapInArrow(emit, TAGGED)


def write_tables(tagged: DataFrame, path: str | None = None) -> str:
    """Write the tagged rows partitioned by tag; the folder."""
    path = path or R.scratch(tagged.sparkSession, "nested")
    tagged.write.partitionBy("tag").parquet(path)
    return path


def read_links(spark, path: str) -> DataFrame:
    """Keys and tags of all tables of ``write_tables``: (doc_id, tag, pk, parent); payloads are not read."""
    cols = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("pk", "parent", "tag"))])
    return spark.read.schema(cols).parquet(path)


def read_table(spark, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """One table of ``write_tables`` with its keys and, by ``schema``, the payload's fields.

    A table without any rows is empty, with the same columns.
    """
    cols = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("pk", "parent", "payload"))])
    there = f"tag={tag}" in R.children(spark, path)
    t = spark.read.schema(cols).parquet(f"{path}/tag={tag}") if there else spark.createDataFrame([], cols)
    if schema is None:
        return t
    return t.withColumn("o", F.from_json("payload", schema)).drop("payload")


def links(tagged: DataFrame) -> DataFrame:
    """Every parent-child link once: (doc_id, tag, parent, pk) as numbers; links with an absent end do not exist."""
    t = tagged.select("doc_id", "tag", F.expr("try_cast(parent as bigint)").alias("parent"), F.expr("try_cast(pk as bigint)").alias("pk"))
    return t.where("parent is not null and pk is not null").distinct()
