"""Queries of the distance operators: species signatures from annotations, and embeddings by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from ..functions import vectors as V
from ..operators import distance as D
from ..operators import features as O
from ..operators import matrix as M
from . import adapters as A
from . import features as Q

LEAST = 3  # images of a species that takes part
WEIGHTS = {"b1": 0.4, "b2": 0.3, "b3": 0.3}


def points(spark: SparkSession, sf: str, lo: int = 0, hi: int = 64) -> DataFrame:
    """vec_id, label, v: (a slice of) the embeddings as doubles."""
    v = F.slice(F.col("embedding").cast("array<double>"), lo + 1, hi - lo)
    return A.table(spark, sf, "embeddings").select("vec_id", "label", v.alias("v"))


def centres(p: DataFrame) -> DataFrame:
    """label, v: mean vectors."""
    t = p.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return D.vectors(t, "label", ["i"], "x")


def _matrix(spark: SparkSession, sf: str, metric, share: bool = False, **cut) -> DataFrame:
    c = centres(points(spark, sf, **cut))
    if share:
        c = c.withColumn("v", V.l1_normalized(F.transform("v", lambda x: F.abs(x))))
    return D.matrix(c, "label", metric)


def _r(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def cosine_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_matrix(spark, sf, V.cosine_distance), "d")


def l1_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_matrix(spark, sf, V.l1_distance, share=True), "d")


def js_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_matrix(spark, sf, V.js_distance, share=True), "d")


def combined_distance(spark: SparkSession, sf: str) -> DataFrame:
    im = O.min_images(A.images(spark, sf).where("species_id is not null"), LEAST)
    an = A.annotations(spark, sf)
    prox = R.written(O.proximity_features(an, A.IDS), "prox")
    b1 = O.signature_b1(prox, im)
    s = b1.groupBy("species_id").agg(F.sum("presence").alias("s"))
    b1 = b1.join(s, "species_id").select("species_id", "class_id", F.explode(F.map_from_arrays(F.array(F.lit("p"), F.lit("q")), F.array(F.coalesce(F.try_divide("presence", "s"), F.lit(0.0)), F.col("area_share")))).alias("k", "x"))
    keys = [k for m in O.SHAPES for k in (m, f"{m}_std")]
    b2 = O.signature_b2(prox, im).unpivot(["species_id", "class_id"], keys, "k", "x")
    b3 = O.signature_b3(an, im).select("species_id", "a", "b", F.col("jaccard").alias("x"))
    pairs = spark.createDataFrame([(a, b) for a in A.IDS for b in A.IDS if a <= b], "a int, b int")
    sig = {
        "b1": D.vectors(b1, "species_id", ["class_id", "k"], "x"),
        "b2": D.vectors(D.z_scored(b2, ["class_id", "k"], "x"), "species_id", ["class_id", "k"], "x"),
        "b3": D.vectors(b3, "species_id", ["a", "b"], "x", pairs),
    }
    return _r(D.combined({n: (R.written(s, n), WEIGHTS[n]) for n, s in sig.items()}, "species_id"), "d_b1", "d_b2", "d_b3", "d")


def inter_intra(spark: SparkSession, sf: str) -> DataFrame:
    return _r(D.inter(points(spark, sf), "label"), "inter")


def intra_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return _r(D.intra(p, "label").join(D.intra_spread(p, "label", "vec_id"), "label"), "intra_mean", "intra_std", "intra_max")


def separability(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return _r(D.separability(D.inter(p, "label"), D.intra(p, "label"), "label"), "inter", "intra_a", "intra_b", "contrast")


def topk_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return _r(D.nearest(_matrix(spark, sf, V.cosine_distance), 5), "d")


def closest_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """ST-4: a top-k report."""
    return _r(_matrix(spark, sf, V.cosine_distance).orderBy("d", "a", "b").limit(10), "d")


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two matrices of the same labels, from the first and the last 32 dimensions."""
    return _matrix(spark, sf, V.cosine_distance, lo=0, hi=32), _matrix(spark, sf, V.cosine_distance, lo=32, hi=64)


def delta_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _r(D.changed_pairs(*_two(spark, sf), 30), "d1", "d2", "delta")


def rank_flips(spark: SparkSession, sf: str) -> DataFrame:
    return D.rank_flips(*_two(spark, sf), 30)


def species_movement(spark: SparkSession, sf: str) -> DataFrame:
    return _r(D.movement(*_two(spark, sf)), "mean_delta", "abs_mean_delta", "max_abs_delta")


def matrix_corr(spark: SparkSession, sf: str) -> DataFrame:
    return _r(D.correlation(*_two(spark, sf)), "pearson", "spearman")


def mantel_test(spark: SparkSession, sf: str) -> DataFrame:
    return M.mantel(*_two(spark, sf), permutations=1000)


def mds_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """DV-8, DV-9, DV-10: coordinates of two matrices, the second fitted onto the first, and the leaf order."""
    m1, m2 = _two(spark, sf)
    labels, a = M.square(m1)
    _, b = M.square(m2)
    x = M.classical_mds(a)
    y, _ = M.procrustes(x, M.classical_mds(b))
    order = M.leaf_order(M.average_linkage(a), len(a))
    rows = [(n, *map(float, x[i]), *map(float, y[i]), order.index(i)) for i, n in enumerate(labels)]
    return spark.createDataFrame(rows, "label string, x double, y double, fitted_x double, fitted_y double, leaf int")


QUERIES = {f.__name__: f for f in (cosine_matrix, l1_matrix, js_matrix, combined_distance, inter_intra, intra_dispersion, separability, topk_neighbors, closest_pairs, delta_pairs, rank_flips, species_movement, matrix_corr, mantel_test, mds_coordinates)}

_E = "WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2)"


def _cos(src: str, out: str, where: str = "TRUE") -> str:
    return f"""{out} AS (SELECT p.label AS a, q.label AS b, 1 - least(1, greatest(-1, coalesce(sum(p.x * q.x) / nullif(sqrt(sum(p.x * p.x)) * sqrt(sum(q.x * q.x)), 0), 0))) AS d FROM {src} p JOIN {src} q ON p.i = q.i AND p.label < q.label WHERE {where.format("p.i")} GROUP BY 1, 2)"""


_SH = ", s0 AS (SELECT label, i, abs(x) / sum(abs(x)) OVER (PARTITION BY label) AS x FROM c)"
_U = ", u AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e), sv AS (SELECT label, i, sum(x) AS x FROM u GROUP BY 1, 2), nl AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), it AS (SELECT p.label AS a, q.label AS b, 1 - sum(p.x * q.x) / (max(np.n) * max(nq.n)) AS inter FROM sv p JOIN sv q ON p.i = q.i AND p.label < q.label JOIN nl np ON np.label = p.label JOIN nl nq ON nq.label = q.label GROUP BY 1, 2)"
_PW = ", pw AS (SELECT p.label, p.vec_id AS v, q.vec_id AS w, 1 - sum(p.x * q.x) AS d FROM u p JOIN u q ON p.label = q.label AND p.i = q.i AND p.vec_id < q.vec_id GROUP BY 1, 2, 3), ia AS (SELECT nl.label, max(n) AS n, coalesce(avg(d), 0) AS m, coalesce(stddev_pop(d), 0) AS s, coalesce(max(d), 0) AS x FROM nl LEFT JOIN pw ON pw.label = nl.label GROUP BY 1)"
_TWO = _E + ", " + _cos("c", "m1", "{} < 32") + ", " + _cos("c", "m2", "{} >= 32") + ", y1 AS (SELECT a, b, d FROM m1 UNION ALL SELECT b, a, d FROM m1), y2 AS (SELECT a, b, d FROM m2 UNION ALL SELECT b, a, d FROM m2)"
_KEYS = [k for m in O.SHAPES for k in (m, f"{m}_std")]
_COMB = Q._PROX + f""", big AS (SELECT species_id FROM img WHERE species_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST}), ip AS (SELECT prox.*, img.species_id FROM prox JOIN img USING (image_id) JOIN big USING (species_id)),
m1 AS (SELECT species_id, class_id, avg(presence) AS p, avg(area) AS q FROM ip GROUP BY 1, 2),
l1 AS (SELECT species_id AS label, 'p' || class_id AS i, p / sum(p) OVER (PARTITION BY species_id) AS x FROM m1 UNION ALL SELECT species_id, 'q' || class_id, q / sum(q) OVER (PARTITION BY species_id) FROM m1),
m2 AS ({" UNION ALL ".join(f"SELECT species_id AS label, '{k}' || class_id AS i, coalesce(avg({k}) FILTER (presence = 1), 0) AS x FROM ip GROUP BY species_id, class_id" for k in _KEYS)}),
l2 AS (SELECT label, i, (x - avg(x) OVER (PARTITION BY i)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY i) > 0 THEN stddev_pop(x) OVER (PARTITION BY i) ELSE 1 END AS x FROM m2),
pc AS (SELECT DISTINCT species_id, image_id, class_id FROM va JOIN img USING (image_id) JOIN big USING (species_id)), cn AS (SELECT species_id, class_id, count(*) AS n FROM pc GROUP BY 1, 2),
jj AS (SELECT x.species_id, x.class_id AS a, y.class_id AS b, count(*) AS nb FROM pc x JOIN pc y ON x.image_id = y.image_id AND x.class_id <= y.class_id GROUP BY 1, 2, 3),
j3 AS (SELECT jj.species_id, jj.a, jj.b, nb / (ca.n + cb.n - nb) AS x FROM jj JOIN cn ca ON ca.species_id = jj.species_id AND ca.class_id = a JOIN cn cb ON cb.species_id = jj.species_id AND cb.class_id = b),
l3 AS (SELECT s.species_id AS label, ca.class_id * 100 + cb.class_id AS i, coalesce(j3.x, 0) AS x FROM (SELECT DISTINCT species_id FROM j3) s JOIN cat ca ON TRUE JOIN cat cb ON ca.class_id <= cb.class_id LEFT JOIN j3 ON j3.species_id = s.species_id AND j3.a = ca.class_id AND j3.b = cb.class_id),
""" + ", ".join(_cos(f"l{n}", f"d{n}") for n in (1, 2, 3))
SQL = {
    "cosine_matrix": f"{_E}, {_cos('c', 'm')} SELECT a, b, round(d, 8) AS d FROM m",
    "l1_matrix": f"{_E}{_SH} SELECT p.label AS a, q.label AS b, round(sum(abs(p.x - q.x)), 8) AS d FROM s0 p JOIN s0 q ON p.i = q.i AND p.label < q.label GROUP BY 1, 2",
    "js_matrix": f"{_E}{_SH}, s1 AS (SELECT label, i, (x + 1e-12) / sum(x + 1e-12) OVER (PARTITION BY label) AS x FROM s0) SELECT p.label AS a, q.label AS b, round(sqrt(greatest(0, (sum(p.x * (ln(p.x) - ln((p.x + q.x) / 2))) + sum(q.x * (ln(q.x) - ln((p.x + q.x) / 2)))) / 2)), 8) AS d FROM s1 p JOIN s1 q ON p.i = q.i AND p.label < q.label GROUP BY 1, 2",
    "combined_distance": _COMB + f" SELECT d1.a, d1.b, round(d1.d, 8) AS d_b1, round(d2.d, 8) AS d_b2, round(d3.d, 8) AS d_b3, round(0.4 * d1.d + 0.3 * d2.d + 0.3 * d3.d, 8) AS d FROM d1 JOIN d2 USING (a, b) JOIN d3 USING (a, b)",
    "inter_intra": f"{_E}{_U} SELECT a, b, round(inter, 8) AS inter FROM it",
    "intra_dispersion": f"{_E}{_U}{_PW} SELECT label, n, round(m, 8) AS intra_mean, round(s, 8) AS intra_std, round(x, 8) AS intra_max FROM ia",
    "separability": f"{_E}{_U}{_PW} SELECT a, b, round(inter, 8) AS inter, round(x.m, 8) AS intra_a, round(y.m, 8) AS intra_b, round(inter - greatest(x.m, y.m), 8) AS contrast FROM it JOIN ia x ON x.label = a JOIN ia y ON y.label = b",
    "topk_neighbors": f"{_E}, {_cos('c', 'm')}, y AS (SELECT a, b, d FROM m UNION ALL SELECT b, a, d FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM y) SELECT a, b, round(d, 8) AS d, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "closest_pairs": f"{_E}, {_cos('c', 'm')} SELECT a, b, round(d, 8) AS d FROM m ORDER BY m.d, a, b LIMIT 10",
    "delta_pairs": f"{_TWO} SELECT m1.a, m1.b, round(m1.d, 8) AS d1, round(m2.d, 8) AS d2, round(m2.d - m1.d, 8) AS delta FROM m1 JOIN m2 USING (a, b) ORDER BY abs(m2.d - m1.d) DESC, a, b LIMIT 30",
    "rank_flips": f"{_TWO}, r AS (SELECT y1.a, y1.b, row_number() OVER (PARTITION BY y1.a ORDER BY y1.d, y1.b) AS rank_1, row_number() OVER (PARTITION BY y1.a ORDER BY y2.d, y1.b) AS rank_2 FROM y1 JOIN y2 USING (a, b)) SELECT a, b, CAST(rank_1 AS INT) AS rank_1, CAST(rank_2 AS INT) AS rank_2, CAST(rank_2 - rank_1 AS INT) AS rank_delta FROM r ORDER BY abs(rank_2 - rank_1) DESC, a, b LIMIT 30",
    "species_movement": f"{_TWO} SELECT a, round(avg(y2.d - y1.d), 8) + 0.0 AS mean_delta, round(avg(abs(y2.d - y1.d)), 8) AS abs_mean_delta, round(max(abs(y2.d - y1.d)), 8) AS max_abs_delta FROM y1 JOIN y2 USING (a, b) GROUP BY 1",
    "matrix_corr": f"{_TWO}, t AS (SELECT m1.d AS d1, m2.d AS d2 FROM m1 JOIN m2 USING (a, b)), r AS (SELECT *, rank() OVER (ORDER BY d1) + (count(*) OVER (PARTITION BY d1) - 1) / 2 AS r1, rank() OVER (ORDER BY d2) + (count(*) OVER (PARTITION BY d2) - 1) / 2 AS r2 FROM t) SELECT round(corr(d1, d2), 8) AS pearson, round(corr(r1, r2), 8) AS spearman, count(*) AS n_pairs FROM r",
}
