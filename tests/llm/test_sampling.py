import numpy as np
import pandas as pd
import pytest

from silvaframe.llm import q_sampling as Q
from silvaframe.llm import sampling as S


def photos(spark, n=600):
    rows = [(f"k{i}", "hot" if i % 3 == 0 else f"g{i % 5}", (i % 7 == 0) | (i % 2) << 1) for i in range(n)]
    rows += [(None, "hot", 1), ("kx", None, 3)]
    return spark.createDataFrame([(k, g, int(m)) for k, g, m in rows], "key string, grp string, mask int")


def test_quotas_and_shares(spark):
    t = S.Target("val", 100, {"hot": (5000, 0), "g1": (2000, 3), "g2": (10, 4), "zz": (1000, 2)}, (20, 50))
    u = S.Target("test", 50, {"hot": (5000, 0), "g3": (5000, 0)}, (5, 25))
    state = S.reservoirs(photos(spark), [t, u])
    cells = S.cell_counts(state)
    assert cells["n"].sum() == 601
    out = S.draw(state, S.plans(cells, [t, u]), [t, u]).toPandas()
    n = out.groupby(["split", "grp"]).size().to_dict()
    assert n == {("val", "hot"): 50, ("val", "g1"): 20, ("val", "g2"): 4, ("test", "hot"): 25, ("test", "g3"): 25}
    assert out["key"].is_unique  # there is enough for both splits
    masks = out[out["split"] == "val"]["mask"].to_numpy()
    have = [(masks >> b & 1).mean() for b in (0, 1)]
    assert have == pytest.approx([0.2, 0.5], abs=0.06)
    assert S.exhausted(cells, ["a", "b"], [t, u]) == [("val", "species", "zz", 10, 0)]
    again = S.draw(S.reservoirs(photos(spark).repartition(7), [t, u]), S.plans(cells, [t, u]), [t, u]).toPandas()
    assert set(map(tuple, again[["split", "key"]].to_numpy())) == set(map(tuple, out[["split", "key"]].to_numpy()))


def test_exhausted_groups_give_all_they_have(spark):
    t = S.Target("val", 1000, {"g1": (5000, 0), "g2": (5000, 0)}, (700, 10))
    state = S.reservoirs(photos(spark, 100), [t])
    cells = S.cell_counts(state)
    out = S.draw(state, S.plans(cells, [t]), [t])
    supply = cells[cells["grp"].isin(["g1", "g2"])]["n"].sum()
    assert out.count() == supply
    assert {x[2] for x in S.exhausted(cells, ["a", "b"], [t])} == {"g1", "g2", "a"}


def test_allotment_adds_up():
    rng = np.random.default_rng(0)
    for _ in range(50):
        k = int(rng.integers(1, 40))
        cells = pd.DataFrame({"grp": rng.choice(list("abc"), k), "mask": rng.integers(0, 8, k), "n": rng.integers(1, 30, k)}).drop_duplicates(["grp", "mask"], ignore_index=True)
        t = S.Target("v", 60, {g: (int(rng.integers(0, 9000)), int(rng.integers(0, 9))) for g in cells["grp"].unique()}, tuple(rng.integers(0, 40, 3)))
        take = S.allot(cells, t)
        assert (take >= 0).all() and (take <= cells["n"]).all()
        for g, d in cells.assign(t=take).groupby("grp"):
            assert d["t"].sum() == min(S.quota(*(t.groups[g][0], 60, t.groups[g][1])), d["n"].sum())


def test_empty(spark):
    t = S.Target("val", 10, {"a": (10000, 1)}, (1,))
    state = S.reservoirs(photos(spark).where("false"), [t])
    cells = S.cell_counts(state)
    assert S.draw(state, S.plans(cells, [t]), [t]).count() == 0 and S.draw(state, [], []).count() == 0
    assert {x[2] for x in S.exhausted(cells, ["l"], [t])} == {"a", "l"}


def test_against_sql(spark, same):
    same(spark, Q.p3_found, Q.SQL["p3_found"], "/root/testdata/sf0.01")
    same(spark, Q.p3_found, Q.SQL["p3_found"], "/root/testdata/sf0.001")


def test_shortfall_comes_from_other_groups(spark):
    t = S.Target("val", 300, {"g1": (5000, 0), "g2": (3000, 0), "hot": (2000, 0)}, (60, 150), fill=True)
    state = S.reservoirs(photos(spark), [t])
    cells = S.cell_counts(state)
    supply = cells.groupby("grp")["n"].sum()
    assert supply["g1"] < 150 and supply["g2"] < 90 and supply["hot"] > 60
    n = S.draw(state, S.plans(cells, [t]), [t]).toPandas().groupby("grp").size().to_dict()
    assert n == {"g1": supply["g1"], "g2": supply["g2"], "hot": 300 - supply["g1"] - supply["g2"]}
    assert {x[2] for x in S.exhausted(cells, ["a", "b"], [t]) if x[1] == "species"} == {"g1", "g2"}


def test_sample_has_its_size(spark):
    sf = "/root/testdata/sf0.01"
    drawn = {r["split"]: r["count"] for r in Q.p3_sample(spark, sf).groupBy("split").count().collect()}
    assert drawn == {t.split: t.size for t in Q.targets(spark, sf)}


def test_three_splits_are_disjoint_where_there_are_enough(spark):
    ts = [S.Target(n, 30, {"hot": (10000, 0)}, (4, 15)) for n in ("a", "b", "c")]
    state = S.reservoirs(photos(spark), ts)
    cells = S.cell_counts(state)
    out = S.draw(state, S.plans(cells, ts), ts).toPandas()
    assert out.groupby("split").size().to_dict() == {"a": 30, "b": 30, "c": 30} and out["key"].is_unique


def test_state_is_bounded_and_counts_everything(spark):
    t = spark.range(20000).selectExpr("concat('p', id) AS key", "if(id % 3 = 0, 'hot', 'x') AS grp", "cast(id % 2 as int) AS mask").repartition(4)
    state = S.reservoirs(t, [S.Target("v", 10, {"hot": (10000, 0)}, (0,))])
    assert state.count() <= 4 * (2 * 10 + 2)  # tasks x (capacity of two hot cells, one row of each other)
    assert S.cell_counts(state)["n"].sum() == 20000


def test_unmet_targets_have_their_bound():
    import pandas as pd

    cells = pd.DataFrame({"grp": ["a", "a", "b"], "mask": [0, 1, 1], "n": [50, 2, 40]})
    t = S.Target("v", 20, {"a": (9000, 0), "b": (1000, 0)}, (10,))
    plan = S.plans(cells, [t])
    assert S.report(cells, ["l"], [t], plan)[-1] == ("v", "class", "l", 10, 42, 4)  # 2 of a, and b's quota of 2
    assert plan[0]["take"].sum() == 20
