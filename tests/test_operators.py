import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaframe import runtime as R
from silvaframe.functions import geometry as G
from silvaframe.functions import vectors as V
from silvaframe.operators import confidence as C
from silvaframe.operators import distance as D
from silvaframe.operators import evaluation as E
from silvaframe.operators import features as O
from silvaframe.operators import matrix as M
from silvaframe.operators import proximity as P
from silvaframe.operators import splits as S


def test_ranked(spark):
    t = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(500)], "k int, v int")
    got = R.ranked(t, ["k"], "v", shards=8).collect()
    for k in (None, 0, 1, 2):
        r = sorted(x["rank"] for x in got if x["k"] == k)
        assert r == list(range(len(r)))


def test_trait_scores(spark):
    im = spark.createDataFrame([(1, "s"), (2, "s")], "image_id long, species_id string")
    an = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 2), (2, 1)], "image_id long, class_id int")
    got = {(r["image_id"], r["class_id"]): r["score"] for r in O.trait_scores(im, an, [1, 2, 3]).collect()}
    assert got == {(1, 1): 0.583333, (1, 2): 0.75, (2, 1): 0.666667, (2, 2): 0, (1, 3): 0, (2, 3): 0}
    with pytest.raises(ValueError):
        O.trait_scores(im, an, [1], weights=(0.5, 0.5, 0.5))


def test_deviations(spark):
    im = spark.createDataFrame([(1, "s", 1), (2, "s", 1), (3, "s", 0)], "image_id long, species_id string, img_area long")
    an = spark.createDataFrame([(1, 1, 3.0), (2, 1, 1.0), (2, 1, 3.0)], "image_id long, class_id int, area_frac double")
    got = {r["image_id"]: r for r in O.class_features(im, an, [1]).collect()}
    assert (got[1]["area_std"], got[2]["area_std"], got[3]["n"], got[3]["density_pct"]) == pytest.approx((0, 1.414214, 0, 0), abs=1e-6)
    for k in O.SHAPES:
        an = an.withColumn(k, F.col("area_frac"))
    prox = {r["image_id"]: r for r in O.proximity_features(an, [1]).collect()}
    assert (prox[1]["sphericity_std"], prox[2]["sphericity_std"]) == (0, 1) and 3 not in prox


def test_spatial(spark):
    box = lambda x, y: (x - 1.0, y - 1.0, x + 1.0, y + 1.0)
    rows = [(1, 1, 1, 10.0, 10.0, box(10, 10)), (1, 2, 1, 10.0, 40.0, box(10, 40)), (1, 3, 2, 50.0, 10.0, box(50, 10)), (2, 4, 1, 1.0, 1.0, box(1, 1))]
    t = spark.createDataFrame(rows, "image_id long, annotation_id long, class_id int, cx double, cy double, box struct<x0:double,y0:double,x1:double,y1:double>").withColumn("diagonal", F.lit(2**0.5 * 100))
    got = {(r["image_id"], r["a"], r["b"]): (r["reldist"], r["closefrac"]) for r in O.spatial_b4(t, 0.25, G.box_iou, G.box_containment).collect()}
    assert got.keys() == {(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2)}
    assert got[1, 1, 1] == pytest.approx((0.75, 1)) and got[1, 1, 2] == pytest.approx((1.125, 0)) and got[1, 2, 2] == (0, 1)


def test_diagnostic_weights(spark):
    t = spark.createDataFrame([(s, 1, 1.0, a) for s, a in zip("xyz", (0.1, 0.2, 0.3), strict=True)] + [("x", 2, 0.05, 0.9)], "species_id string, class_id int, presence double, area double")
    got = {(r["species_id"], r["class_id"]): r["weight"] for r in O.diagnostic_weights(t).collect()}
    assert [got[s, 1] for s in "xyz"] == pytest.approx([1.816496, 1, 1.816496], abs=1e-5) and got["x", 2] == 1


def cand(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "image_id long, gt_id long, pred_id long, iou double")


def test_greedy(spark):
    got = E.greedy(cand(spark, [(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.7), (2, 2, 0.5)])).collect()
    assert {(r["gt_id"], r["pred_id"]) for r in got} == {(0, 0), (1, 1), (2, 2)}
    tie = E.greedy(cand(spark, [(g, p, 0.6) for g in (0, 1) for p in (0, 1)])).collect()
    assert {(r["gt_id"], r["pred_id"]) for r in tie} == {(0, 0), (1, 1)}


def test_greedy_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, g, p, rng.choice([0.5, 0.6, 0.7, 0.8])) for i in range(20) for g in range(5) for p in range(5) if rng.random() < 0.6]
    t = spark.createDataFrame(rows, "image_id long, gt_id long, pred_id long, iou double")
    want = set()
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])), key=lambda r: r[0]):
        us, them = set(), set()
        for r in g:
            if r[1] not in us and r[2] not in them:
                us.add(r[1]), them.add(r[2]), want.add(r[:3])
    assert {(r["image_id"], r["gt_id"], r["pred_id"]) for r in E.greedy(t).collect()} == want


def test_confusion_and_metrics(spark):
    gt = spark.createDataFrame([(1, 0, "A"), (1, 1, "B")], "image_id long, gt_id long, label string")
    pr = spark.createDataFrame([(1, 0, "B"), (1, 1, "C")], "image_id long, pred_id long, label string")
    pairs = E.instance_pairs(gt, pr, cand(spark, [(0, 0, 0.9)]))
    conf = {(r["gt_label"], r["pred_label"]): r["n"] for r in E.confusion(pairs).collect()}
    assert conf == {("A", "B"): 1, ("B", "background"): 1, ("background", "C"): 1}
    m = {r["label"]: r for r in E.class_metrics(E.confusion(pairs)).collect()}
    assert (m["A"]["fn"], m["B"]["fp"], m["B"]["fn"], m["C"]["fp"], m["C"]["support"]) == (1, 1, 1, 1, 0)
    g = E.global_metrics(E.class_metrics(E.confusion(pairs))).first()
    assert g["labels"] == 2 and g["macro_f1"] == 0


def test_spread_and_severity(spark):
    m = spark.createDataFrame([("a", "b", 0.2), ("a", "c", 0.4), ("b", "c", 0.6)], "a string, b string, d double")
    p = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "b", 0.3), (1, 3, "c", 0.2), (2, 1, "a", 1.0)], "image_id long, rank int, species string, prob double")
    s = {r["image_id"]: r["spread"] for r in C.spread(p, m).collect()}
    assert s[1] == pytest.approx(0.341935, abs=1e-6) and s[2] is None
    f = spark.createDataFrame([(1, "a", "a"), (2, "b", "a"), (3, "z", "a")], "image_id long, true_species string, predicted_species string")
    m2 = spark.createDataFrame([("a", "b", 0.3), ("a", "c", 0.6)], "a string, b string, d double")
    assert {r["image_id"]: r["severity"] for r in C.severity(f, m2).collect()} == {1: 0, 2: 0.5, 3: None}
    e = C.expected_distance(p, spark.createDataFrame([(1, "a")], "image_id long, true_species string"), m).first()
    assert e["expected"] == pytest.approx(0.3 * 0.2 + 0.2 * 0.4)


def test_hit_rates(spark):
    p = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "b", 0.1), (2, 1, "b", 1.0)], "image_id long, rank int, species string, prob double")
    t = spark.createDataFrame([(1, "b"), (2, "q"), (3, "a")], "image_id long, true_species string")
    r = C.hit_rates(C.true_ranks(p, t), p.select("species")).first()
    assert (r["labelled"], r["out_of_catalogue"], r["hit_1"], r["hit_3"], r["hit_3_catalogue"]) == pytest.approx((3, 1, 0, 1 / 3, 1 / 2))


def test_group_distances_without_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(24, 6))
    v[5] = 0
    g = ["x" if i % 3 else "y" for i in range(24)]
    t = spark.createDataFrame([(i, g[i], v[i].tolist()) for i in range(24)], "k long, g string, v array<double>")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - (v / np.where(n > 0, n, 1)) @ (v / np.where(n > 0, n, 1)).T
    ix = {k: [i for i in range(24) if g[i] == k] for k in "xy"}
    assert D.inter(t, "g").first()["inter"] == pytest.approx(d[np.ix_(ix["x"], ix["y"])].mean())
    got = {r["g"]: r for r in D.intra(t, "g").join(D.intra_spread(t, "g", "k"), "g").collect()}
    for k in "xy":
        tri = d[np.ix_(ix[k], ix[k])][np.triu_indices(len(ix[k]), 1)]
        assert (got[k]["intra_mean"], got[k]["intra_std"], got[k]["intra_max"]) == pytest.approx((tri.mean(), tri.std(), tri.max()))


def test_average_ranks(spark):
    x, y = (1, 2, 2, 3, 9), (5, 6, 7, 7, 1)
    t = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    r = D.average_rank(D.average_rank(t, "x", "rx"), "y", "ry").agg(F.corr("rx", "ry")).first()[0]
    assert r == pytest.approx(-0.1315789474)


def test_matrix_statistics(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    _, err = M.procrustes(d[:, :2], d[:, :2] * 3 + 1)
    assert err < 1e-9
    y = M.classical_mds(d)
    assert np.linalg.norm(y[:, None] - y[None], axis=2) == pytest.approx(d)
    merges = M.average_linkage(d)
    assert len(merges) == 7 and sorted(M.leaf_order(merges, 8)) == list(range(8)) and merges[-1][3] == 8
    assert [m[2] for m in merges] == sorted(m[2] for m in merges)
    t = spark.createDataFrame([(str(i), str(j), float(d[i, j])) for i in range(8) for j in range(i + 1, 8)], "a string, b string, d double")
    r = M.mantel(t, t, 199).first()
    assert r["pearson"] == pytest.approx(1) and r["p_value"] <= 0.02
    mean, sd = M.random_spread(d, 3, 200)
    assert mean == pytest.approx(d[np.triu_indices(8, 1)].mean(), rel=0.15) and sd > 0


def test_nearest_and_flips(spark):
    m = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 3.0)], "a string, b string, d double")
    got = [(r["a"], r["rank"], r["b"]) for r in D.nearest(m, 1).orderBy("a").collect()]
    assert got == [("a", 1, "b"), ("b", 1, "a"), ("c", 1, "a")]
    assert D.rank_flips(m, m, 5).agg(F.max(F.abs("rank_delta"))).first()[0] == 0
    assert D.matrix(spark.createDataFrame([], "k string, v array<double>"), "k", V.l1_distance).count() == 0


def test_splits(spark):
    rng = random.Random(1)
    masks = [rng.choice([1, 3, 3, 5, 7, 7, 7]) | (8 if i in (5, 6, 7, 8) else 0) for i in range(400)]
    t = spark.createDataFrame(list(enumerate(masks)), "k long, mask long")
    s = S.assign(t, "k", 4)
    rows = {r["k"]: r["split"] for r in s.collect()}
    n = {x: sum(v == x for v in rows.values()) for x in ("train", "val", "test")}
    assert len(rows) == 400 and n == {"train": 280, "val": 60, "test": 60}
    parts = [s.where(F.col("split") == x) for x in n]
    S.check_partition(parts, t, "k")
    for x in ("val", "test"):
        assert any(rows[k] == x for k in (5, 6, 7, 8))  # the rare class is seeded
        for bit in range(3):
            share = sum(m >> bit & 1 for m in masks) / 400
            assert abs(sum(masks[k] >> bit & 1 for k, v in rows.items() if v == x) / n[x] - share) < 0.06
    with pytest.raises(ValueError):
        S.check_partition([parts[0], parts[0]], t, "k")
    with pytest.raises(ValueError):
        S.assign(t.limit(2), "k", 4)
    f = S.folds(t.withColumn("y", F.col("mask") % 2), "y", "k").groupBy("fold").count().collect()
    assert len(f) == 5 and max(r["count"] for r in f) - min(r["count"] for r in f) <= 2


def test_alignment_of_columns(spark):
    t = spark.createDataFrame([(1, 2.0, None)], "k int, b double, c double")
    out, missing, left = S.align(t, ["a", "c"], ("k",))
    assert (out.first()[:], missing, left) == ((1, 0.0, 0.0), ["a"], ["b"])


def test_near_pairs_and_duplicates(spark):
    sq = lambda x, y, s=10: [float(v) for v in (x, y, x + s, y, x + s, y + s, x, y + s)]
    rows = [(1, 1, 5, sq(0, 0)), (1, 2, 5, sq(25, 0)), (1, 3, 5, sq(100, 100)), (1, 4, 6, sq(1, 1)), (1, 5, 5, [*sq(0, 0), 0.0, 5.0]), (2, 6, 5, sq(0, 0))]
    t = spark.createDataFrame(rows, "image_id long, annotation_id long, class_id int, points array<double>")
    got = {(r["a"], r["b"]): r["distance"] for r in P.near_pairs(t, 20).collect()}
    assert got == {(1, 2): 15.0, (1, 5): 0.0, (2, 5): 15.0}
    dup = P.duplicates(t).collect()
    assert [(r["annotation_id"], r["kept_id"]) for r in dup] == [(1, 5)]
    log = spark.createDataFrame([(1, "delete", 1), (1, "keep", 2), (2, "delete", 3)], "annotation_id long, decision string, step int")
    assert {r[0] for r in P.apply_decisions(t, log).select("annotation_id").collect()} == {1, 3, 4, 5, 6}


def test_empty_frames(spark):
    im = spark.createDataFrame([], "image_id long, species_id string, img_area long")
    an = spark.createDataFrame([], "annotation_id long, image_id long, class_id int, area_frac double")
    assert O.class_features(im, an, [1, 2]).count() == 0
    assert O.trait_scores(im, an, [1]).count() == 0
    assert O.empty_guard(im, an) == 0
    assert E.greedy(cand(spark, [])).count() == 0


def test_guards_and_ids(spark):
    cover = spark.createDataFrame([("val", "a", 0), ("test", "a", 3)], "split string, class_name string, images long")
    with pytest.raises(ValueError, match="val has 0"):
        S.assert_coverage(cover)
    S.assert_coverage(cover.where("images > 0"))
    with pytest.raises(ValueError, match="zz"):
        S.required_columns(cover, ["split", "zz"])
    t = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(10000), 3000)], "v int").repartition(5)
    got = [r["id"] for r in S.sequential_ids(t, ["v"]).orderBy("v").collect()]
    assert got == list(range(1, 3001))


def test_sql_functions(spark):
    from silvaframe.functions import registry

    names = registry.register(spark)
    r = spark.sql("""SELECT species_token('a/0003-1.jpg') AS a, canonical_id(' 30.0 ') AS b, polygon_area(array(0D, 0D, 10D, 0D, 10D, 5D, 0D, 5D)) AS c, polygon_perimeter(array(0D, 0D, 10D, 0D, 10D, 5D, 0D, 5D)) AS d,
        cosine_distance(array(1D, 0D), array(0D, 1D)) AS e, list_cell('a; b') AS f, safe_name('x y') AS g, mask_iou(array(0D, 0D, 9D, 0D, 9D, 9D), array(0D, 0D, 9D, 0D, 9D, 9D)) AS h""").first()
    assert r[:] == ("0003", "0030", 50.0, 30.0, 1.0, ["a", "b"], "feat_x_y", 1.0) and "genus" in names


def test_prior_divergence(spark):
    s = "species_id string, class_id int, presence double, area double"
    a = spark.createDataFrame([("s", 1, 0.5, 0.1), ("s", 2, 1.0, 0.2)], s)
    b = spark.createDataFrame([("s", 1, 0.25, 0.1), ("t", 1, 1.0, 0.0)], s)
    assert {r["species_id"]: r["presence_l1"] for r in E.prior_divergence(a, b).collect()} == {"s": 1.25, "t": 1.0}


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_percentiles_against_numpy(spark, most):
    import numpy as np

    rng = np.random.default_rng(1)
    own = {1: rng.random(200), 2: np.concatenate([np.zeros(51), np.full(49, 9.0)]), 3: np.full(40, 2.5), 4: np.array([7.0]), 5: np.concatenate([rng.random(30), 1e6 + rng.random(30)])}
    t = spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v] + [(1, None)], "k int, v double")
    for q in (0.1, 0.5):
        got = {r["k"]: r["p"] for r in O.percentiles(t, "k", "v", q, cells=16, most=most).collect()}
        assert got == pytest.approx({k: float(np.quantile(v, q)) for k, v in own.items()})
