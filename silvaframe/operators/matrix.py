"""Statistics of one small square matrix (DV-7..10, DV-12): labels are a bounded number, so NumPy on the driver.

Only the permutations of the Mantel test are dealt to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def square(m: DataFrame, most: int = 5000) -> tuple[list[str], np.ndarray]:
    """Labels and the full symmetric matrix of a long (a, b, d); more than ``most`` labels raise."""
    labels = sorted({str(r[0]) for c in ("a", "b") for r in m.select(c).distinct().limit(most + 1).collect()})
    if len(labels) > most:
        raise ValueError(f"more than {most} labels")
    at = {x: i for i, x in enumerate(labels)}
    out = np.zeros((len(labels), len(labels)))
    p = m.select("a", "b", "d").toPandas()
    i, j = p["a"].astype(str).map(at).to_numpy(), p["b"].astype(str).map(at).to_numpy()
    out[i, j] = out[j, i] = p["d"].to_numpy(float)
    return labels, out


def _pearson(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    n = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / n) if n > 0 else 0.0


def mantel(m1: DataFrame, m2: DataFrame, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """DV-7: observed correlation and p = (permutations at least as extreme + 1) / (permutations + 1).

    Each permutation has a seed of its own, so the result does not depend on how they are dealt.
    """
    spark = m1.sparkSession
    l1, a = square(m1)
    l2, b = square(m2)
    both = [x for x in l1 if x in set(l2)]
    a = a[np.ix_(*[[l1.index(x) for x in both]] * 2)]
    b = b[np.ix_(*[[l2.index(x) for x in both]] * 2)]
    tri = np.triu_indices(len(both), 1)
    seen = _pearson(a[tri], b[tri]) if len(both) > 2 else 0.0
    shared = spark.sparkContext.broadcast((a, b))  # labels squared

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = shared.value
        t = np.triu_indices(len(x), 1)
        for f in frames:
            hits = 0
            for i in f["id"]:
                p = np.random.default_rng([seed, int(i)]).permutation(len(x))
                hits += abs(_pearson(x[t], y[np.ix_(p, p)][t])) >= abs(seen) - 1e-12
            yield pd.DataFrame({"hits": [hits]})

    n = spark.range(permutations).mapInPandas(run, "hits long").groupBy().sum("hits").first()[0] or 0
    return spark.createDataFrame([(seen, (n + 1) / (permutations + 1), len(both), permutations)], "pearson double, p_value double, n_labels int, n_permutations int")


def classical_mds(d: np.ndarray, k: int = 2) -> np.ndarray:
    """DV-8: coordinates from the leading eigenvectors of the doubly centred squares; signs fixed by the largest entry."""
    n = len(d)
    c = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * c @ (d * d) @ c)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])] + 0.0)
    return v * np.sqrt(np.maximum(w, 0))


def procrustes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """DV-9: b moved, scaled and turned onto a, and the remaining Frobenius error."""
    ma, mb = a.mean(0), b.mean(0)
    u, s, vt = np.linalg.svd((b - mb).T @ (a - ma))
    scale = s.sum() / max(((b - mb) ** 2).sum(), 1e-300)
    fitted = scale * (b - mb) @ (u @ vt) + ma
    return fitted, float(np.linalg.norm(a - fitted))


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """DV-10: merges (left, right, height, size) of average linkage; clusters are numbered from n on."""
    n = len(d)
    m = d.astype(float).copy()
    np.fill_diagonal(m, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    live = np.ones(n, bool)
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(m), m.shape)
        i, j = min(i, j), max(i, j)
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(m[i, j]), size[i] + size[j]))
        row = (m[i] * size[i] + m[j] * size[j]) / (size[i] + size[j])
        m[i], m[:, i] = row, row
        m[i, i] = np.inf
        m[j], m[:, j] = np.inf, np.inf
        live[j] = False
        m[i, ~live] = m[~live, i] = np.inf
        size[i] += size[j]
        ids[i] = n + step
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """DV-10: leaves from left to right."""
    if not merges:
        return list(range(n))
    kids = {n + i: (a, b) for i, (a, b, _, _) in enumerate(merges)}
    out, stack = [], [n + len(merges) - 1]
    while stack:
        x = stack.pop()
        if x in kids:
            stack += [kids[x][1], kids[x][0]]
        else:
            out.append(x)
    return out


def random_spread(d: np.ndarray, k: int, draws: int = 1000, seed: int = 42) -> tuple[float, float]:
    """DV-12: mean and deviation (+1e-12) of the mean distance within k labels drawn without replacement."""
    rng = np.random.default_rng(seed)
    t = np.triu_indices(k, 1)
    v = [d[np.ix_(p, p)][t].mean() for p in (rng.choice(len(d), k, replace=False) for _ in range(draws))]
    return float(np.mean(v)), float(np.std(v) + 1e-12)
