"""Samples that match target proportions of categories.

Method: mergeable per-category reservoirs in one pass, trimmed to quotas.  A reservoir is
the bottom-k of a seeded hash within its category, so two reservoirs merge by keeping the
k least of both, and any prefix of one is a uniform sample.  A category here is a *cell*:
a group (species) with a set of labels (trait classes, as a bit mask).  Each task keeps its
own reservoirs and counts while its rows pass; only these leave it.  After the final counts
each group gets its feasible quota, what exhausted groups lack of the sample's size is
dealt to the others where the target says so, and each group's rows are dealt to the
group's cells so that the label targets are met as well as they can be (iterative
proportional fitting of one factor per label, shortfall and excess counting alike), and every
reservoir is trimmed to its cell's share.  Targets that are not met are reported with the reason.

Scale.  What is shuffled beyond the removal of doubled keys is at most tasks x cells x
capacity, whatever the number of rows.  The driver sees only cell counts: at most ``groups
x 2**labels`` rows however large the data.

Defined cases.  Rows with a null key are ignored; rows with a null group are
counted for the labels but never sampled.  A key that comes
several times counts once.  A quota is max(least, share * size), never more than
the supply.  Ties of the hash are broken by the key.  Empty data or targets give
empty results.  The samples of several splits take consecutive pieces of one order, so
they share a row only where a cell has too few for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime as R


@dataclass(frozen=True)
class Target:
    """What one split wants: its size, (share, least number) per group, number of rows per label.

    ``fill``: what exhausted groups lack of the size comes from the others, and label targets stay those of the whole size.
    """

    split: str
    size: int
    groups: dict[str, tuple[float, int]]
    labels: tuple[int, ...]
    fill: bool = False


def quota(share_bp: int, size: int, least: int) -> int:
    """max(least, share of the size, rounded half up); shares in 1/10,000."""
    return max(least or 0, (share_bp * size + 5000) // 10000)


def allot(cells: pd.DataFrame, target: Target, rounds: int = 60) -> np.ndarray:
    """Rows to take of each cell (columns grp, mask, n).

    Per group the numbers add up to its feasible quota; within the group cells are
    weighted by a product of label factors, which are fitted to the label targets; the
    round with the least relative deviation over all labels counts.
    """
    if not len(cells):
        return np.zeros(0, np.int64)
    names, g = np.unique(cells["grp"].to_numpy(str), return_inverse=True)
    n = cells["n"].to_numpy(np.float64)
    want = _deal(target, dict(zip(names, np.bincount(g, n).astype(np.int64).tolist(), strict=True)))
    want = np.array([want[x] for x in names], np.float64)
    bits = (cells["mask"].to_numpy(np.int64)[:, None] >> np.arange(len(target.labels))) & 1
    # without fill, shares are of the rows that can be drawn
    goal = np.array(target.labels, np.float64) * (1 if target.fill else want.sum() / max(target.size, 1))
    goal = np.minimum(goal, n @ bits)
    factor, best = np.ones(len(goal)), (np.inf, None)
    for _ in range(rounds):
        take = _fill(g, n, want, n * np.exp(bits @ np.log(factor)))
        have = take @ bits
        off = float((np.abs(goal - have) / np.maximum(goal, 1)).sum())
        if off < best[0]:
            best = (off, take)
        factor = np.clip(factor * np.clip(((goal + 0.5) / (have + 0.5)) ** 0.7, 0.5, 2.0), 1e-3, 1e3)
    take = best[1]
    # whole numbers: floors, then the largest remainders of each group
    whole = np.floor(take + 1e-9)
    rest = (want - np.bincount(g, whole, len(names))).round().astype(np.int64)
    order = np.lexsort((np.arange(len(n)), -(take - whole), g))
    spare = (n - whole)[order] > 0
    rank = np.arange(len(n))
    rank[order] = np.where(spare, 0, 1)  # rows without spare supply come last
    order = np.lexsort((np.arange(len(n)), -(take - whole), rank, g))
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n)) - np.searchsorted(g[order], g[order])
    whole += place < rest[g]
    return np.minimum(whole, n).astype(np.int64)


def _deal(target: Target, supply: dict[str, int]) -> dict[str, int]:
    """Rows per group: its feasible quota, and with ``fill`` what is missing to the size from the groups with supply left.

    The missing rows are dealt in proportion to the targets, by largest remainders, again until
    the size is reached or nothing is left.
    """
    goal = {g: quota(*_share(target, g)) for g in sorted(supply)}
    take = {g: min(q, supply[g]) for g, q in goal.items()}
    while target.fill and (short := target.size - sum(take.values())) > 0:
        free = [g for g in take if goal[g] > 0 and take[g] < supply[g]]
        whole = sum(goal[g] for g in free)
        if not free:
            break
        add = {g: short * goal[g] // whole for g in free}
        for g in sorted(free, key=lambda g: (-(short * goal[g] % whole), g))[: short - sum(add.values())]:
            add[g] += 1
        for g in free:
            take[g] = min(take[g] + add[g], supply[g])
    return take


def _share(target: Target, group: str) -> tuple[int, int, int]:
    share, least = target.groups[group]
    return int(share), target.size, int(least)


def _fill(g: np.ndarray, n: np.ndarray, want: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Deal each group's quota by weight, no cell above its supply."""
    take, groups = np.zeros(len(n)), len(want)
    free = np.ones(len(n), bool)
    for _ in range(30):
        left = want - np.bincount(g, take * ~free, groups)
        total = np.bincount(g, weight * free, groups)
        share = np.where(free, weight * (left / np.maximum(total, 1e-300))[g], take)
        over = free & (share > n)
        take = np.where(free, np.minimum(share, n), take)
        if not over.any():
            break
        free &= ~over
    return take


def capacities(targets: list[Target]) -> dict[str, int]:
    """What all splits together may take of one cell of a group: the quotas, or the samples' sizes where others' shortfall may come from it."""
    caps: dict[str, int] = {}
    for t in targets:
        for g, (share, least) in t.groups.items():
            caps[g] = caps.get(g, 0) + max(quota(int(share), t.size, int(least)), t.size if t.fill else 0)
    return caps


def reservoirs(photos: DataFrame, targets: list[Target], seed: int = 42) -> DataFrame:
    """The state: (grp, mask, key, h, seen), per task and cell the rows with the least hashes.

    ``photos``: key, grp, mask, each key once.  ``seen`` is the number of rows that the task had of
    the cell, on one of its rows, and 0 on the others; a cell of no target keeps that one row.
    Two states merge by taking the least hashes of both; ``seen`` adds up.
    """
    caps = capacities(targets)
    cols = ["grp", "mask", "key", "h"]

    def keep(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["grp", "mask", "h", "key"], ignore_index=True)
        by = t.groupby(["grp", "mask"], dropna=False, sort=False)
        t["seen"] = by["seen"].transform("sum").where(by.cumcount() == 0, 0)
        return t[by.cumcount() < np.maximum(t["grp"].map(caps).fillna(0), 1)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, new, size = None, [], 0
        for f in frames:
            new.append(f.assign(seen=1))
            size += len(f)
            if size > 1 << 16 and size > (0 if state is None else len(state)):  # so each row is sorted a few times
                state, new, size = keep(pd.concat([*([] if state is None else [state]), *new])), [], 0
        if new or state is not None:
            yield keep(pd.concat([*([] if state is None else [state]), *new]))[[*cols, "seen"]]

    t = photos.where("key is not null").select("grp", "mask", "key", F.xxhash64(F.lit(seed), "key").alias("h"))
    kind = dict(t.dtypes)
    return t.mapInPandas(run, ", ".join(f"{c} {kind[c]}" for c in cols) + ", seen long")


def cell_counts(state: DataFrame) -> pd.DataFrame:
    """The final counts (grp, mask, n) of all cells: at most groups x 2**labels rows."""
    t = state.where("seen > 0").groupBy("grp", "mask").agg(F.sum("seen").alias("n"))
    return t.toPandas().sort_values(["grp", "mask"], ignore_index=True)


def plans(cells: pd.DataFrame, targets: list[Target]) -> list[pd.DataFrame]:
    """Per target the cells (grp, mask, n) with the rows to take of each."""
    out = []
    for t in targets:
        own = cells[cells["grp"].isin(t.groups)].reset_index(drop=True)
        out.append(own.assign(take=allot(own, t)))
    return out


def draw(state: DataFrame, plan: list[pd.DataFrame], targets: list[Target]) -> DataFrame:
    """(split, key, grp, mask) of the samples: the tasks' reservoirs merged and trimmed.

    Each split takes the rows behind those of the splits before it, and goes on from the cell's beginning
    where there are no more.
    """
    rows, used = [], {}
    for t, p in zip(targets, plan, strict=True):
        for r in p[p["take"] > 0].itertuples():
            at = used.get((r.grp, r.mask), 0)
            rows.append((t.split, str(r.grp), int(r.mask), int(at % r.n), int(r.take), int(r.n)))
            used[r.grp, r.mask] = at + int(r.take)
    spark = state.sparkSession
    want = spark.createDataFrame(rows, "split string, grp string, mask int, first long, take long, n long")
    some = state.join(want.select("grp", "mask").distinct(), ["grp", "mask"], "left_semi").select("grp", "mask", "key", "h", F.struct("h", "key").alias("o"))
    t = R.ranked(some, ["grp", "mask"], "o", uniform="h").join(want, ["grp", "mask"])
    return t.where((F.col("rank") < F.col("n")) & (F.pmod(F.col("rank") - F.col("first"), F.col("n")) < F.col("take"))).select("split", "key", "grp", "mask")


def label_counts(cells: pd.DataFrame, labels: int) -> list[int]:
    """Rows with each label."""
    mask, n = cells["mask"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    return [int(n[(mask >> i) & 1 == 1].sum()) for i in range(labels)]


def exhausted(cells: pd.DataFrame, labels: list[str], targets: list[Target]) -> list[tuple]:
    """(split, kind, key, wanted, available) of the targets that all rows together cannot meet."""
    return [r[:5] for r in report(cells, labels, targets) if r[3] > r[4]]


def report(cells: pd.DataFrame, labels: list[str], targets: list[Target], plan: list[pd.DataFrame] | None = None) -> list[tuple]:
    """(split, kind, key, wanted, available, attainable) of all targets.

    ``attainable``: the most that a sample can have of a label when every group gives what the plan takes of it;
    of a group, what all rows have of it.
    """
    supply = cells.groupby("grp")["n"].sum().to_dict()
    label_supply = label_counts(cells, len(labels))
    out = []
    for i, t in enumerate(targets):
        for g, (share, least) in t.groups.items():
            n = int(supply.get(g, 0))
            out.append((t.split, "species", g, quota(int(share), t.size, int(least)), n, n))
        for j, want in enumerate(t.labels):
            most = label_supply[j]
            if plan is not None:
                p = plan[i]
                has = p["n"].where((p["mask"].to_numpy(np.int64) >> j) & 1 == 1, 0).groupby(p["grp"]).sum()
                most = int(np.minimum(has, p.groupby("grp")["take"].sum()).sum()) if len(p) else 0
            out.append((t.split, "class", labels[j], int(want), int(label_supply[j]), most))
    return out
