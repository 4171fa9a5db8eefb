import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaframe.operators import ml
from silvaframe.sinks import writers as Wr
from silvaframe.sources import coco, labels, tables
from silvaframe.streaming import incremental as I

LINES = ["1 0 0 1 0 1 1", "2.0 0 0 1 0 1 1", "", "x 0 0 1 0 1 1", "1 0 0 1 0", "1 0 0 1 0 1 1 0.5", "99 0 0 1 0 1 1", "1 0 0 1 0 1 q", "3"]


def lines(spark, rows=LINES):
    t = spark.createDataFrame([("f", i, x) for i, x in enumerate(rows)], "file string, label_idx int, line string")
    return t.where("trim(line) <> ''")


@pytest.mark.parametrize(
    ("mode", "want"),
    [("evaluation", [0, 1, 6]), ("vectors", [0, 4, 5, 6, 8]), ("dissimilarity", [0, 5]), ("overlap", [0]), ("small_filter", [0, 1, 3, 4, 5, 6, 7, 8])],
)
def test_modes(spark, mode, want):
    got = labels.parse_label_lines(lines(spark), mode, classes=14)
    assert sorted(r["label_idx"] for r in got.collect()) == want


def test_raising_modes(spark):
    ok = lines(spark, ["1 0 0 1 0 1 1 0.5", "1 0 0 1 1"])
    r = {x["label_idx"]: x for x in labels.parse_label_lines(ok, "proximity").collect()}
    assert len(r[0]["coords"]) == 6 and len(r[1]["coords"]) == 4
    with pytest.raises(Exception, match="bad label line"):
        labels.parse_label_lines(lines(spark, ["x 0 0 1 1"]), "proximity").collect()


def test_small_polygons(spark):
    t = labels.parse_label_lines(lines(spark, ["1 0 0 1 0 1 1", "1 0 0 .01 0 .01 .01", "junk"]), "small_filter")
    assert [r["label_idx"] for r in labels.drop_small(t).orderBy("label_idx").collect()] == [0, 2]
    size = spark.createDataFrame([("f", 100, 100)], "file string, width int, height int")
    assert [r["label_idx"] for r in labels.flag_small(t, size).collect()] == [1]


def test_label_files_on_disk(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0 0 1 0 1 1\r\n\n2 0 0 1 0 1 1\n")
    got = labels.read_label_lines(spark, str(tmp_path)).orderBy("label_idx").collect()
    assert [(r["label_idx"], r["line"][0]) for r in got] == [(0, "1"), (2, "2")]


def test_class_names(spark, tmp_path):
    p = tmp_path / "data.yaml"
    p.write_text("names: {1: '10', 0: a}")
    assert [tuple(r) for r in labels.class_names(spark, str(p)).orderBy("class_id").collect()] == [(0, "a"), (1, "10")]
    p.write_text("names: ['5', vx]")
    assert [r["name"] for r in labels.class_names(spark, str(p)).orderBy("class_id").collect()] == ["5", "vx"]
    p.write_text("x: 1")
    with pytest.raises(ValueError):
        labels.class_names(spark, str(p))


def test_listing_and_paths(spark, tmp_path):
    for n in ("x/b.JPG", "a.png", "c.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"1")
    got = [r["path"].rsplit("/", 1)[1] for r in labels.scan_images(spark, str(tmp_path)).collect()]
    assert got == ["a.png", "b.JPG"]
    rec = spark.createDataFrame([("r", ["no", "d/2", "d/1"]), ("s", ["no"])], "k string, c array<string>")
    ls = spark.createDataFrame([("d/1",), ("d/2",)], "path string")
    assert {r["k"]: r["resolved"] for r in labels.resolve_paths(rec, "k", F.col("c"), ls).collect()} == {"r": "d/2", "s": None}
    p = spark.createDataFrame([("d\\images\\x\\1.jpg",)], "p string").select(labels.label_of_image(F.col("p"))).first()[0]
    assert p == "d/labels/x/1.txt"


def test_split_tables(spark, tmp_path):
    t = spark.createDataFrame([("a\\b.jpg", "nan", "0012 x"), ("c.jpg", "0007", None), (None, "1", None), (" ", "1", None)], "image string, species string, task string")
    assert [tuple(r) for r in labels.split_records(t).orderBy("image").collect()] == [("a/b.jpg", None, "0012"), ("c.jpg", None, "0007")]
    with pytest.raises(ValueError):
        labels.split_records(t.select("task"))
    (tmp_path / "l.txt").write_text("a.jpg\n\n  b.jpg \n")
    assert labels.split_list(spark, str(tmp_path / "l.txt")).count() == 2


def test_coco_read(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a", "width": 4, "height": 3}], "categories": [{"id": 2, "name": "10"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "segmentation": [[0, 0, 1, 0, 1, 1]], "bbox": [0, 0, 1, 1]}]}
    p = tmp_path / "x.json"
    p.write_text("﻿" + json.dumps(doc, indent=2), encoding="utf-8")
    assert coco.resolve(str(tmp_path)) == coco.resolve(str(tmp_path / "x")) == str(p)
    c = coco.read(spark, str(p))
    assert coco.class_table(c.categories).first()["class_id"] == 1
    a = c.annotations.withColumn("parts", coco.polygons_of(F.col("segmentation"))).first()
    assert (a["id"], a["image_id"], a["parts"]) == (5, 1, [[0, 0, 1, 0, 1, 1]])
    p.write_text('{"images": []}')
    with pytest.raises(ValueError, match="annotations"):
        coco.read(spark, str(p))
    with pytest.raises(FileNotFoundError):
        coco.resolve(str(tmp_path / "none"))


def test_matrix_and_maps(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",0009,10,x\n9,0,1,2\n0010,1,0,3\nx,2,3,0\n")
    got = {(r["a"], r["b"]): r["d"] for r in tables.read_matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert got["0009", "0010"] == 1 and got["x", "0009"] == 2 and len(got) == 9
    (tmp_path / "s.json").write_text('{"3": "A", "0003": "B", "0700": "C"}')
    assert {r[0]: r[1] for r in tables.read_species_map(spark, str(tmp_path / "s.json")).collect()} == {"0003": "B", "0700": "C"}
    (tmp_path / "t.csv").write_text("file_name,true_species_id\na.jpg,0001\na.jpg,0002\n,3\n")
    assert [tuple(r) for r in tables.read_true_labels(spark, str(tmp_path / "no"), str(tmp_path / "t.csv")).collect()] == [("a.jpg", "0002")]
    assert tables.read_true_labels(spark, str(tmp_path / "no")).count() == 0


def test_writers(spark, tmp_path):
    m = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, d double")
    Wr.matrix_files(m, str(tmp_path / "m"))
    assert np.load(tmp_path / "m.npz")["matrix"].tolist() == [[0, 0.5], [0.5, 0]]
    assert tables.read_matrix(spark, str(tmp_path / "m.csv")).where("a = 'a' and b = 'b'").first()["d"] == 0.5
    Wr.csv_file(m, str(tmp_path / "x.csv"), bom=True)
    assert tables.read_csv(spark, str(tmp_path / "x.csv")).columns == ["a", "b", "d"]
    Wr.json_file(m, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text())["d"] == 0.5
    Wr.table(m, str(tmp_path / "t"))
    Wr.table(m, str(tmp_path / "t"), mode="append")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and Wr.done(None, str(tmp_path / "t"))
    Wr.replace_folder(m, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    Wr.wide_features(m, str(tmp_path / "w"), ["a"], str(tmp_path / "w.json"))
    assert "hit@5" in Wr.latex_table({"m_1": (0.1, 0.2, 0.3)})


def test_overwrite_guard(tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.txt").write_text("")
    Wr.overwrite_guard(str(tmp_path), 3)
    with pytest.raises(ValueError):
        Wr.overwrite_guard(str(tmp_path), 1)


def test_label_text_and_files(spark, tmp_path):
    t = spark.createDataFrame([(1, 2, 0, [0.0, 0.0, 5.0, 0.0, 5.0, 5.0], 10, 10), (1, 1, 3, [0.0, 0.0, 1.0, 0.0, 1.0, 1.0], 10, 10), (2, 9, 0, None, 10, 10), (3, 8, 0, None, 0, 10)], "image_id long, annotation_id long, class_id int, points array<double>, width int, height int")
    out = Wr.label_lines(t, 1)
    got = {r["image_id"]: r["text"] for r in out.collect()}
    assert got == {1: "3 0.0 0.0 0.1 0.0 0.1 0.1\n0 0.0 0.0 0.5 0.0 0.5 0.5", 2: ""}
    Wr.label_files(out, str(tmp_path / "l"))
    assert sorted(p.name for p in (tmp_path / "l").glob("*.txt")) == ["1.txt", "2.txt"]


def test_rename_plan(spark):
    t = spark.createDataFrame([("d", "b.jpg"), ("d", "a.jpg"), ("d", "S.jpg")], "folder string, name string")
    got = {r["old"]: (r["new"], r["change"]) for r in Wr.rename_plan(t, F.lit("S.jpg")).collect()}
    assert got == {"S.jpg": ("S.jpg", False), "a.jpg": ("S_1.jpg", True), "b.jpg": ("S_2.jpg", True)}


def test_square_confusion(spark):
    c = spark.createDataFrame([("a", "b", 2)], "gt_label string, pred_label string, n long")
    assert [tuple(r) for r in Wr.square_confusion(c, ["a", "b"]).collect()] == [("a", 0, 2), ("b", 0, 0)]


def test_streams(spark, tmp_path):
    t = spark.createDataFrame([("s", 1, 2), ("s", 1, 2), ("t", 1, 3)], "species_id string, a int, b int")
    for i in range(2):
        t.write.mode("append").parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in I.available_now(I.pair_counts(I.file_stream(spark, str(tmp_path / "in"), per_trigger=1)), "s").collect()}
    assert got == {("s", 1, 2, 4), ("t", 1, 3, 2)}


def test_counts_go_on_where_they_stopped(spark, tmp_path):
    t = spark.createDataFrame([("s", 1, 2), ("s", 1, 2), ("t", 1, 3)], "species_id string, a int, b int")
    src, state = str(tmp_path / "in"), f"file://{tmp_path}/state"
    run = lambda: {tuple(r) for r in I.resumed_counts(I.file_stream(spark, src), ["species_id", "a", "b"], state, 3).collect()}
    t.write.parquet(src)
    assert run() == {("s", 1, 2, 2), ("t", 1, 3, 1)}
    spark.createDataFrame([("s", 1, 2), ("u", 5, 6)], t.schema).write.mode("append").parquet(src)
    want = {("s", 1, 2, 3), ("t", 1, 3, 1), ("u", 5, 6, 1)}
    assert run() == want and run() == want


def test_interrupted_replacement_loses_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    Wr.replace_folder(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash between the two renames
    assert Wr.recover_folder(spark, path) and spark.read.parquet(path).count() == 3
    Wr.replace_folder(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not Wr.recover_folder(spark, path)


def test_classifier(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], float(rng.normal(3 * (i % 2))), None if i == 4 else float(rng.normal(-3 * (i % 2)))) for i in range(120)]
    t = spark.createDataFrame(rows, "k long, y string, u double, v double")
    make = lambda: ml.random_forest(["u", "v"], "y", trees=10, depth=4)
    cv = ml.cross_validate(ml.cross_predict(t, make, "y", "k", 3)).collect()
    assert len(cv) == 3 and min(r["accuracy"] for r in cv) > 0.9
    assert ml.introspect(make().fit(ml.balanced(t, "y"))) == (["u_f", "v_f"], ["a", "b"])
    f, names = ml.fourier_features(t, ["u", "v"], 64)
    p = ml.probabilities(ml.linear_model(names, "y").fit(ml.balanced(f, "y")), f, "k")
    assert p.groupBy("image_id").agg(F.sum("prob").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    assert ml.best_model({"b": 1.0, "a": 1.0, "c": 0.2}) == "a"
