import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaframe.functions import geometry as G
from silvaframe.functions import raster
from silvaframe.functions import species as S
from silvaframe.functions import text as X
from silvaframe.functions import vectors as V


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


RECT = (0, 0, 10, 0, 10, 5, 0, 5)


def test_rectangle(spark):
    p = arr(*RECT)
    t = G.with_descriptors(spark.range(1).select(p.alias("points"), F.lit(100).alias("width"), F.lit(50).alias("height"))).first()
    assert one(spark, G.area(p), G.perimeter(p), G.elongation(p))[:] == pytest.approx((50, 30, 2))
    assert t["sphericity"] == pytest.approx(0.6981317008)
    assert t["log_aspect"] == pytest.approx(0.6931471806)
    assert (t["bbox_extent"], t["area_frac"]) == pytest.approx((1, 0.01))


def test_moved_and_reversed(spark):
    moved = [v + (100 if i % 2 == 0 else 7) for i, v in enumerate(RECT)]
    back = np.array(RECT).reshape(-1, 2)[::-1].ravel()
    for q in (moved, back):
        assert one(spark, G.area(arr(*q)), G.perimeter(arr(*q)), G.elongation(arr(*q)))[:] == pytest.approx((50, 30, 2))
    assert one(spark, G.signed_area(arr(*back)))[0] == pytest.approx(-50)


def test_trapezoid(spark):
    p = arr(1, 1, 4, 1, 4, 9, 2, 9)
    assert one(spark, G.area(p), G.perimeter(p), G.elongation(p))[:] == pytest.approx((20, 21.0622577483, 3.1514943539))


def test_degenerate_polygons_are_dropped(spark):
    rows = [([0.0, 0.0, 1.0, 1.0],), ([0.0, 0.0, 1.0, 1.0, 2.0, 2.0],), (None,), ([],), ([0.0, 0.0, 1.0, None, 2.0, 0.0],), ([0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 5.0],)]
    t = spark.createDataFrame(rows, "points array<double>").select("points", F.lit(10).alias("width"), F.lit(10).alias("height"))
    assert G.with_descriptors(t).count() == 0
    assert [r[0] for r in t.select(G.area(F.col("points"))).collect()] == [0] * 6


def test_parts(spark):
    a, b = [0.0, 0, 2, 0, 2, 2, 0, 2], [0.0, 0, 3, 0, 3, 3, 0, 3]
    t = spark.createDataFrame([([list(map(float, a)), list(map(float, b))],)], "p array<array<double>>")
    p = F.col("p")
    r = t.select(G.largest(p).alias("l"), F.size(G.multipart(p, "split")), F.size(G.multipart(p, "skip")), F.size(G.multipart(p, "concat"))).first()
    assert r["l"] == b and tuple(r[1:]) == (2, 0, 1)
    with pytest.raises(ValueError):
        G.multipart(p, "other")


def test_boxes(spark):
    a, b = G.box(arr(*RECT)), G.box(arr(5, 0, 15, 0, 15, 5, 5, 5))
    assert one(spark, G.box_iou(a, b), G.box_containment(a, b), G.min_vertex_distance(arr(*RECT), arr(13, 0, 20, 0, 20, 5)))[:] == pytest.approx((1 / 3, 0.5, 3))


def test_label_line(spark):
    assert one(spark, G.label_line(F.lit(3), arr(0, 5, 20, 10), F.lit(10), F.lit(20), 2))[0] == "3 0.00 0.25 1.00 0.50"
    assert one(spark, G.label_line(F.lit(3), arr(0, 5, 20), F.lit(10), F.lit(20), 2))[0] == ""


@pytest.mark.parametrize(
    ("name", "want"),
    [("0003-1.jpg", ("0003", "0003", "0003")), ("a\\b\\0030_x.png", ("0030", "a\\b\\0030_x.png", None)), ("1.jpg", ("1", "1.jpg", None)), ("-x.jpg", ("unknown", "", None))],
)
def test_species_tokens(spark, name, want):
    c = F.lit(name)
    assert one(spark, X.species_token(c), X.species_token_loose(c), X.species_token_strict(c))[:] == want


def test_species_ids(spark):
    rows = [("686.0", "x/0001-2.jpg"), (" 0686", None), ("nan", "x\\0042-7.JPG"), (None, "0042_7.jpg"), ("", "IMG_1.jpg"), ("12345", None), (None, None), ("X12", "0009-1.jpg")]
    t = spark.createDataFrame(rows, "s string, p string").select(S.species_of(F.col("s"), F.col("p")))
    assert [r[0] for r in t.collect()] == ["0686", "0686", "0042", "0042", None, "12345", None, "0009"]


def test_names(spark):
    n = "Lophira alata Banks  ex "
    assert one(spark, S.composed_name(F.lit(n)), S.composed_name(F.lit("é  x")), S.composed_name(F.lit(" NaN ")))[:] == ("Lophira alata Banks ex", "é x", None)
    assert one(spark, X.slug(F.lit("Áb c, d")), X.genus(F.lit("")), X.binomial(F.lit("A b c")), X.safe_name(F.lit("%%")))[:] == ("Ab_c_d", "?", "A b", "feat_unknown")
    assert one(spark, X.list_cell(F.lit('["a, b", "c"]')), X.list_cell(F.lit("a; 'b'|c,")), X.list_cell(F.lit(None).cast("string")))[:] == (["a, b", "c"], ["a", "b", "c"], None)
    r = one(spark, X.task_parts(F.lit("0012 Some name")), X.task_parts(F.lit("other")))
    assert tuple(r[0]) == ("0012", "Some name") and tuple(r[1]) == ("", "other")
    assert one(spark, X.canonical_id(F.lit("7")), X.canonical_id(F.lit("nan")), X.short_id(F.lit("0000")), X.default_name(F.lit(None).cast("string"), F.lit("0007")))[:] == ("0007", None, "0", "Especie_Desconocida_0007")


def test_distances(spark):
    a, b, z = arr(1, 0), arr(0, 1), arr(0, 0)
    assert one(spark, V.cosine_distance(a, b), V.cosine_distance(z, a), V.js_distance(a, b), V.l1_distance(a, b))[:] == pytest.approx((1, 1, 0.8325546111, 2))
    assert one(spark, V.l1_normalized(z))[0] == [0, 0]


def test_schedules(spark):
    t = spark.createDataFrame([(n,) for n in (0, 1, 2, 14, 15)], "n int").select(V.seed_quota(F.col("n")), V.reliability(F.col("n")))
    assert [tuple(r) for r in t.collect()] == [(0, 0.0), (0, 0.2), (1, 0.4), (3, 1.0), (0, 1.0)]
    w = spark.createDataFrame([(29,), (55,), (80,)], "e int").select(V.weight_schedule(F.col("e"), 0.5))
    assert [r[0] for r in w.collect()] == pytest.approx([0, 0.25, 0.5])


def test_fill():
    m = raster.fill(RECT, 20, 10)
    assert m.sum() == 11 * 6 and m[0, 0] and m[5, 10] and not m[6, 0]
    assert raster.fill([0, 0, 5, 5], 9, 9).sum() == 0
    assert raster.iou(RECT, RECT) == 1 and raster.iou(RECT, None) == 0
    assert raster.overlap_pct(RECT, (0, 0, 20, 0, 20, 5, 0, 5)) == pytest.approx(100 * 66 / 126)


def test_fill_against_points_in_polygon():
    rng = np.random.default_rng(1)
    for _ in range(30):
        p = rng.integers(0, 30, 12).astype(float)
        m = raster.fill(p, 30, 30)
        q = p.reshape(-1, 2)
        for _ in range(50):
            x, y = rng.integers(0, 30, 2)
            inside, edge = False, False
            for (xa, ya), (xb, yb) in zip(q, np.roll(q, -1, 0), strict=True):
                if (ya <= y) != (yb <= y):
                    c = xa + (y - ya) * (xb - xa) / (yb - ya)
                    inside ^= x > c
                    edge |= abs(x - c) < 1.01
                d = max(abs(xb - xa), abs(yb - ya), 1)
                edge |= min(math.hypot(xa + (xb - xa) * t / d - x, ya + (yb - ya) * t / d - y) for t in range(int(d) + 1)) < 1.01
            assert edge or m[y, x] == inside


def test_run_lengths():
    m = raster.rle_mask([2, 3, 1], 2, 3)
    assert m.tolist() == [[False, True, True], [False, True, False]]
    assert raster.cells(RECT, 100, 50, 10) and raster.cells(None, 1, 1) == []


def test_outlines_of_masks():
    rng = np.random.default_rng(4)
    for _ in range(40):
        m = rng.random((9, 11)) < 0.6
        parts = raster.outlines(m, least=0, eps=0)
        back = np.zeros_like(m)
        for p in parts:  # pixel centres inside of an outer outline
            q = np.array(p).reshape(-1, 2)
            for y, x in np.ndindex(m.shape):
                n = 0
                for (xa, ya), (xb, yb) in zip(q, np.roll(q, -1, 0), strict=True):
                    if (ya <= y + 0.5) != (yb <= y + 0.5):
                        n += xa + (y + 0.5 - ya) * (xb - xa) / (yb - ya) > x + 0.5
                back[y, x] |= n % 2 == 1
        assert (back | ~m).all()  # every set pixel lies in an outline
    square = np.zeros((10, 10), bool)
    square[2:7, 3:8] = True
    square[0, 0] = True
    assert raster.outlines(square) == [[3.0, 2.0, 8.0, 2.0, 8.0, 7.0, 3.0, 7.0]]


def test_run_length_objects_on_a_column(spark):
    t = spark.createDataFrame([('{"counts": [0, 25], "size": [5, 5]}',), ('{"counts": 3}',), ("x",), (None,), ('{"counts": "05", "size": [1, 5]}',)], "s string")
    got = [r[0] for r in t.select(raster.rle_parts("s")).collect()]
    assert got[0] == [[0, 0, 5, 0, 5, 5, 0, 5]] and got[1:4] == [[], [], []]
