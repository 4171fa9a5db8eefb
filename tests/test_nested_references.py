import datetime as dt
import json

import pytest

from silvaframe.operators import nested as N
from silvaframe.operators import references as X

DOC = {"images": [{"id": "7", "file_name": "a"}, {"id": 7.0, "file_name": "b"}], "categories": [{"id": 1}], "annotations": [{"id": 3, "image_id": " 07", "segmentation": [[0, 0, 1, 0, 1, 1], [], [2, 2, 3, 2, 3, 3]]}, {"id": 4, "image_id": 9, "segmentation": [0, 0, 1, 0, 1, 1]}, {"id": 5, "segmentation": {"counts": "x", "size": [1, 1]}}, {"id": None, "image_id": 7}, 17]}
LINKS = {("image", 1, 7), ("category", 1, 1), ("annotation", 7, 3), ("annotation", 9, 4), ("segment", 3, 0), ("segment", 3, 2), ("segment", 4, 0), ("segment", 5, 0)}


def links(spark, payloads):
    t = spark.createDataFrame([(i + 1, p, "x") for i, p in enumerate(payloads)], "export_id long, payload string, tag string")
    return {tuple(r) for r in N.links(N.flatten(t, "export_id", "payload", payload=False)).collect()}


@pytest.mark.parametrize("wrap", [lambda d: json.dumps(d), lambda d: "﻿" + json.dumps(d, indent=1), lambda d: json.dumps({"version": 2, "coco": d}), lambda d: json.dumps([d])])
def test_links_in_every_wrapping(spark, wrap):
    assert links(spark, [wrap(DOC)]) == {(1, *x) for x in LINKS}


def test_payloads_that_hold_nothing(spark):
    bad = [None, "", "{", json.dumps(DOC)[:-5], "NaN", '{"images": [{"id": NaN}]}', "7", "null", "{}", json.dumps({"images": None, "annotations": {}, "categories": "x"}), "[" * 100000]
    assert links(spark, bad) == set()


def test_empty_table(spark):
    t = spark.createDataFrame([], "export_id long, payload string")
    assert N.links(N.flatten(t, "export_id", "payload")).count() == 0
    path = N.write_tables(N.flatten(t, "export_id", "payload"))
    assert N.read_table(spark, path, "image", "file_name string").columns == ["doc_id", "pk", "parent", "o"]


def test_tables_keep_payloads(spark):
    t = spark.createDataFrame([(1, json.dumps(DOC)), (1, json.dumps(DOC))], "export_id long, payload string")
    path = N.write_tables(N.flatten(t, "export_id", "payload"))
    im = N.read_table(spark, path, "image", "file_name string")
    assert sorted(r[0] for r in im.select("o.file_name").distinct().collect()) == ["a", "b"]
    seg = N.read_table(spark, path, "segment").where("pk = '2'").first()
    assert json.loads(seg["payload"]) == [2, 2, 3, 2, 3, 3]


def test_long_payload(spark):
    d = {"images": [{"id": i} for i in range(50000)], "annotations": []}
    assert len(links(spark, [json.dumps(d)])) == 50000


def day(d):
    return dt.datetime(2024, 1, d)


def frames(spark):
    rows = spark.createDataFrame([(1, 10, day(5)), (2, 11, day(5)), (3, 12, day(5)), (4, 12, day(20)), (5, None, day(5)), (6, 13, day(5)), (6, 13, day(5)), (7, 14, None), (8, 15, day(5))], "row_key long, value long, time timestamp_ntz")
    targets = spark.createDataFrame([(10, day(1), None), (11, day(1), day(5)), (12, day(9), None), (14, day(1), day(2)), (15, day(1), day(2)), (15, day(3), None)], "value long, created timestamp_ntz, deleted timestamp_ntz")
    return rows, targets


def test_states(spark):
    rows, targets = frames(spark)
    got = {(r["row_key"], r["state"]) for r in X.direct(X.Reference("t", "f", rows, targets)).collect()}
    assert got == {(2, "deleted"), (3, "late"), (6, "missing")}


def test_cascade_and_cycle(spark):
    rows, targets = frames(spark)
    kid = spark.createDataFrame([(100, 6, day(6)), (101, 1, day(6)), (102, None, day(6))], "row_key long, parent_key long, time timestamp_ntz")
    grand = spark.createDataFrame([(1000, 100, day(40 - 20)), (1001, 101, day(7))], "row_key long, parent_key long, time timestamp_ntz")
    loop = spark.createDataFrame([(1, 1000, day(8))], "row_key long, parent_key long, time timestamp_ntz")
    out = X.cascade([X.Reference("t", "f", rows, targets)], [X.Child("kid", "t", "t", kid), X.Child("grand", "k", "kid", grand), X.Child("t", "g", "grand", loop)])
    got = {(r["ref_table"], r["row_key"], r["level"]) for r in out.collect()}
    assert got == {("t", 2, 0), ("t", 3, 0), ("t", 6, 0), ("kid", 100, 1), ("grand", 1000, 2), ("t", 1, 3), ("kid", 101, 4), ("grand", 1001, 5)}
    rep = {(r["ref_table"], r["state"]): (r["n_direct"], r["n_inherited"]) for r in X.by_period(out).collect()}
    assert rep["t", "missing"] == (1, 0) and rep["grand", "inherited"] == (0, 2)


def test_empty_references(spark):
    rows, targets = frames(spark)
    assert X.cascade([X.Reference("t", "f", rows.where("false"), targets)]).count() == 0
    assert {r["state"] for r in X.cascade([X.Reference("t", "f", rows, targets.where("false"))]).collect()} == {"missing"}
