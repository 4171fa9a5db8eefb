import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaframe.llm import overlap as O
from silvaframe.llm import q_overlap as Q

FORMS = ["data/macro/lote0005/0555-19.jpg", "..\\data\\Macro\\LOTE_5\\0555_00019.JPG", "file:///srv//lote0005/0555 - 19.tif ", "x/lote0005/555-19 (1).png", "x/lote0005/0555-19-copia.jpeg", "x/lote0005/0555-19~2.jpg", "x/lote0005/0555-19_rot90.jpg", "x/lote0005/0555-19.orig.jpg", "x/lote0005/0555%20-%2019_v2.jpg", "x/lote0005/0555-19_aug03_flip (2).png"]
OTHER = ["data/macro/lote0006/0555-19.jpg", "data/macro/lote0005/0555-190.jpg", "data/macro/lote0005/0556-19.jpg", "data/macro/lote0005/IMG_19.jpg"]


def keys(spark, paths):
    t = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    return [r["k"] for r in t.select("i", Q.photo_key(F.col("p")).alias("k")).orderBy("i").collect()]


def test_one_photograph_in_many_spellings(spark):
    k = keys(spark, FORMS)
    assert set(k) == {"lote-5/555-19"}
    assert len({*keys(spark, OTHER), k[0]}) == 5
    assert keys(spark, [None, "", "name.jpg", "/", "lote1/%zz-1.jpg"])[:4] == [None] * 4


def test_shared_runs_share_a_fingerprint():
    rng = np.random.default_rng(0)
    for k, w in ((3, 4), (5, 1), (8, 8)):
        for _ in range(200):
            run = rng.integers(0, 5, k + w - 1)
            a = np.concatenate([rng.integers(0, 5, rng.integers(0, 20)), run, rng.integers(0, 5, rng.integers(0, 20))])
            b = np.concatenate([rng.integers(0, 5, rng.integers(0, 20)), run, rng.integers(0, 5, rng.integers(0, 20))])
            of, _, h = O.winnow(np.concatenate([a, b]), np.array([len(a), len(b)]), k, w)
            assert set(h[of == 0]) & set(h[of == 1])


def test_short_and_empty_sequences():
    of, pos, h = O.winnow(np.array([1, 2, 1, 2, 3]), np.array([2, 0, 2, 1]), 4, 3)
    assert of.tolist() == [0, 2, 3] and h[0] == h[1] != h[2] and pos.tolist() == [0, 0, 0]
    assert len(O.winnow(np.zeros(0), np.zeros(0), 3, 2)[0]) == 0


def test_density_is_bounded():
    n, k, w = 20000, 8, 10
    of, *_ = O.winnow(np.random.default_rng(1).integers(0, 50, n), np.array([n]), k, w)
    assert n / w < len(of) < 2.5 * n / (w + 1)


def test_chain_and_extension():
    assert O.chain([(0, 5), (3, 1), (4, 2), (4, 2), (9, 3)]) == [(3, 1), (4, 2), (9, 3)]
    assert O.chain([]) == []
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8])
    b = np.array([9, 2, 3, 4, 0, 6, 7, 8])
    assert O.extend(a, b, [(1, 1)], 3) == (6, 6)


def test_near_records_and_copies(spark):
    rng = random.Random(2)
    base = [rng.randrange(1000) for _ in range(60)]
    near = base[:30] + [5555] + base[31:]
    rows = lambda x: spark.createDataFrame(x, "seq_id long, tokens array<int>")
    left = rows([(1, base), (2, [rng.randrange(1000) for _ in range(60)]), (3, None), (4, [])])
    got = O.overlaps(left, rows([(7, near), (8, base), (9, base[:20])]), 5, 4).collect()
    cover = {(r["seq_a"], r["seq_b"]): (round(r["cover_a"], 3), round(r["cover_b"], 3)) for r in got}
    assert cover == {(1, 7): (0.983, 0.983), (1, 8): (1, 1), (1, 9): (0.333, 1)}


def side(spark, rows):
    full = [(r, p, [*c, *[0] * (14 - len(c))], [*a, *[0.0] * (14 - len(a))]) for r, p, c, a in rows]
    lot, name, marks = Q._split_path(F.col("path"))
    return spark.createDataFrame(full, "record_id long, path string, counts array<int>, areas array<double>").select("record_id", F.lit("x").alias("split"), lot.alias("lot"), name.alias("name"), marks.alias("marks"), "counts", "areas").cache()


def test_rules(spark):
    tr = [(1, "a/l1/5-1.jpg", [3, 2], [0.1, 0.2]), (2, None, [0, 0], [0.0, 0.0]), (3, "a/l1/5-2.jpg", [3, None], [0.1, 0.2]), (4, None, [3, 2], [0.1, float("nan")])]
    te = [(10, "b/L01/0005_01 (1).png", [1, 1], [0.3, 0.3]), (11, None, [3, 2], [0.1009, 0.1985]), (12, None, [3, 2], [0.102, 0.2]), (13, "b/l2/5-1.jpg", [0, 0], [0.0, 0.0]), (14, "b/l1/5-1 copia 2 (3).jpg", [0], [0.0])]
    got = {(r["ra"], r["rb"], r["rule"]) for r in Q._pairs(side(spark, tr), side(spark, te)).collect()}
    assert got == {(1, 10, "path"), (1, 14, "path"), (1, 11, "traits")}
    assert Q._pairs(side(spark, tr), side(spark, te[:0])).count() == 0


def test_near_copies_that_no_equality_finds(spark):
    """Areas moved by up to 1 % each: the sequences differ, every pair is found all the same."""
    rng = random.Random(5)
    tr, te, want = [], [], set()
    for i in range(120):
        n = rng.choice([1, 2, 3, 5, 6, 8, 14])
        at = rng.sample(range(14), n)
        c = [rng.randint(1, 5) if j in at else 0 for j in range(14)]
        a = [rng.uniform(0.001, 0.2) if x else 0.0 for x in c]
        tr.append((i, None, c, a))
        for k, far in enumerate((0.0099, 0.0099, 0.02)):
            b = [x * (1 - rng.choice([0.0, 0.3, 1.0]) * far) for x in a]
            te.append((1000 + 10 * i + k, None, c, b))
    ok = lambda x, y: x[2] == y[2] and any(x[2]) and all(abs(p - q) <= 0.01 * max(p, q) for p, q in zip(x[3], y[3], strict=True))
    want = {(x[0], y[0]) for x in tr for y in te if ok(x, y)}
    left, right = side(spark, tr), side(spark, te)
    got = {(r["ra"], r["rb"]) for r in Q._pairs(left, right).collect()}
    assert got == want and len(want) > 240
    equal = Q._trait_docs(left).join(Q._trait_docs(right).select("seq_id"), "seq_id").count()
    assert equal < 0.8 * len(want)


def test_coverage_against_brute_force(spark):
    """Every record that matches one of the other side in 0.8 of its places is found, with that share."""
    rng = random.Random(11)
    base = []
    for i in range(40):
        c = [rng.choice([0, 1, 2, 3]) for _ in range(14)]
        base.append((i, None, c, [rng.uniform(0.001, 0.1) if x else 0.0 for x in c]))
    held = []
    for i, _, c, a in base:
        for j in range(4):  # one class, or two, with another count
            c2 = list(c)
            for at in rng.sample([x for x in range(14) if c[x]], min(1 + j // 2, sum(map(bool, c)))):
                c2[at] += 7 + j
            held.append((1000 + 10 * i + j, None, c2, a))
    left, right = side(spark, base), side(spark, held)
    tokens = lambda t: {r["record_id"]: r["tokens"] for r in Q._trait_docs(t).collect()}
    a, b = tokens(left), tokens(right)
    share = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x) if len(x) == len(y) else 0.0
    want = {r: max(share(y, x) for x in a.values()) for r, y in b.items()}
    got = {r["record_id"]: r["cover_traits"] for r in Q._coverage(left, right).collect()}
    assert all(got[r] is not None and got[r] >= round(w, 6) for r, w in want.items() if w >= 0.8 - 1e-9)
    assert all(got[r] is None or want[r] > 0.6 for r in want)
    assert sum(w >= 0.8 - 1e-9 for w in want.values()) > 60 and sum(w < 0.8 for w in want.values()) > 5


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, same, name):
    same(spark, Q.QUERIES[name], Q.SQL[name], "/root/testdata/sf0.01")
