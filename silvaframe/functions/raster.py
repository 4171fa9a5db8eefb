"""Filled polygons (FN-29 .. FN-31, FN-34): the few functions that need NumPy on the workers."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill(points, width: int, height: int) -> np.ndarray:
    """FN-30: mask of a polygon whose vertices are rounded to pixels; the outline belongs to it.

    Even-odd scan lines over pixel centres, then the outline's own pixels.  Parts
    outside of the image are cut off; fewer than three points give an empty mask.
    """
    mask = np.zeros((height, width), bool)
    p = np.rint(np.asarray(points, float)[: len(points) // 2 * 2]).reshape(-1, 2)
    if len(p) < 3 or not np.isfinite(p).all():
        return mask
    q = np.roll(p, -1, axis=0)
    y0, y1 = int(max(p[:, 1].min(), 0)), int(min(p[:, 1].max(), height - 1))
    if y1 >= y0:
        y = np.arange(y0, y1 + 1)[:, None]
        cross = (p[None, :, 1] <= y) != (q[None, :, 1] <= y)
        rise = np.where(q[:, 1] == p[:, 1], 1.0, q[:, 1] - p[:, 1])
        x = np.where(cross, p[:, 0] + (y - p[:, 1]) * ((q[:, 0] - p[:, 0]) / rise), np.inf)
        x.sort(axis=1)
        across = np.arange(width)
        for k in range(0, int(cross.sum(1).max(initial=0)), 2):  # spans from left to right
            lo, hi = np.ceil(x[:, k])[:, None], np.where(np.isinf(x[:, k + 1]), -1, np.floor(x[:, k + 1]))[:, None]
            mask[y0 : y1 + 1] |= (across >= lo) & (across <= hi)
    n = np.maximum(np.abs(q - p).max(1).astype(int), 1)
    edge = np.repeat(np.arange(len(p)), n)
    t = ((np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)) / n[edge])[:, None]
    at = np.rint(p[edge] + (q[edge] - p[edge]) * t).astype(int)
    at = at[(at >= 0).all(1) & (at[:, 0] < width) & (at[:, 1] < height)]
    mask[at[:, 1], at[:, 0]] = True
    return mask


def _pair(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Masks of two polygons in their common window, so that large images cost nothing."""
    both = np.concatenate([np.asarray(a, float), np.asarray(b, float)])
    x0, y0 = np.floor(both[::2].min()), np.floor(both[1::2].min())
    w, h = int(np.ceil(both[::2].max()) - x0) + 2, int(np.ceil(both[1::2].max()) - y0) + 2
    shift = np.tile([x0, y0], max(len(a), len(b)))
    return fill(np.asarray(a, float) - shift[: len(a)], w, h), fill(np.asarray(b, float) - shift[: len(b)], w, h)


def iou(a, b) -> float:
    """FN-30: intersection over union of the filled polygons, 0 if the union is empty."""
    if a is None or b is None or len(a) < 6 or len(b) < 6:
        return 0.0
    x, y = _pair(a, b)
    union = (x | y).sum()
    return float((x & y).sum() / union) if union else 0.0


def overlap_pct(a, b) -> float:
    """FN-29: the intersection in % of the larger polygon."""
    if a is None or b is None or len(a) < 6 or len(b) < 6:
        return 0.0
    x, y = _pair(a, b)
    larger = max(x.sum(), y.sum())
    return float(100 * (x & y).sum() / larger) if larger else 0.0


def cells(points, width: float, height: float, grid: int = 128) -> list[int]:
    """FN-31: the cells of a grid over the image that the polygon fills; vertices are cut to whole cells."""
    if points is None or not width or not height or len(points) < 6:
        return []
    p = np.asarray(points, float)[: len(points) // 2 * 2].reshape(-1, 2)
    p = np.clip(np.trunc(p / [width, height] * grid), 0, grid - 1)
    return np.flatnonzero(fill(p.ravel(), grid, grid)).tolist()


def rle_runs(counts) -> np.ndarray:
    """FN-34: lengths of the runs of 0 and 1, given as a list or in the packed text form; negative ones raise."""
    if not isinstance(counts, str):
        return _no_negative(np.asarray(counts, np.int64))
    runs, at = [], 0
    while at < len(counts):
        value, shift = 0, 0
        while True:
            c = ord(counts[at]) - 48
            value |= (c & 31) << shift
            shift += 5
            at += 1
            if not c & 32:
                if c & 16:
                    value -= 1 << shift
                break
        runs.append(value + (runs[-2] if len(runs) > 2 else 0))
    return _no_negative(np.asarray(runs, np.int64))


def _no_negative(runs: np.ndarray) -> np.ndarray:
    if (runs < 0).any():
        raise ValueError("negative run")
    return runs


def rle_mask(counts, height: int, width: int) -> np.ndarray:
    """FN-34: mask of a run-length object: runs of 0 and 1 by columns."""
    runs = rle_runs(counts)
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)[: height * width]
    return np.pad(flat, (0, height * width - len(flat))).reshape(width, height).T


def rle_outlines(counts, height: int, width: int) -> list[list[float]]:
    """FN-34: the outlines of a run-length object; only the columns and rows that it touches are unpacked."""
    runs = rle_runs(counts)
    stop = np.minimum(np.cumsum(runs), height * width)
    begin, end = stop[0::2][: len(stop) // 2], stop[1::2]
    some = end > begin
    if not some.any():
        return []
    x0, x1 = int(begin[some][0] // height), int((end[some][-1] - 1) // height) + 1
    flat = np.zeros((x1 - x0) * height + 1, np.int8)
    np.add.at(flat, begin[some] - x0 * height, 1)
    np.add.at(flat, end[some] - x0 * height, -1)
    mask = np.cumsum(flat[:-1]).astype(bool).reshape(x1 - x0, height).T
    rows = np.flatnonzero(mask.any(1))
    y0, y1 = int(rows[0]), int(rows[-1]) + 1
    shift = np.array([x0, y0], float)
    return [(np.reshape(p, (-1, 2)) + shift).ravel().tolist() for p in outlines(mask[y0:y1])]


def outlines(mask: np.ndarray, least: float = 4.0, eps: float = 1.0) -> list[list[float]]:
    """FN-34: outer outlines of a mask's regions as flat polygons, simplified by ``eps``; smaller ones than ``least`` pixels are dropped.

    The sides between set and unset pixels are directed with the region on their right and
    linked to loops; outer loops turn one way, holes the other.
    """
    m = np.pad(mask.astype(bool), 1)
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for dy, dx, a, b in ((-1, 0, (0, 0), (0, 1)), (0, 1, (0, 1), (1, 1)), (1, 0, (1, 1), (1, 0)), (0, -1, (1, 0), (0, 0))):
        for y, x in zip(*np.nonzero(m & ~np.roll(m, (-dy, -dx), (0, 1))), strict=True):
            nxt.setdefault((y + a[0] - 1, x + a[1] - 1), []).append((y + b[0] - 1, x + b[1] - 1))
    out = []
    while nxt:
        start = min(nxt)
        loop, at, came = [start], start, None
        while True:
            ways = nxt[at]
            pick = 0
            if len(ways) > 1 and came is not None:  # where two corners touch, turn right: regions stay apart
                d = (at[0] - came[0], at[1] - came[1])
                pick = next((i for i, w in enumerate(ways) if (w[0] - at[0], w[1] - at[1]) == (d[1], -d[0])), 0)
            came, at_next = at, ways.pop(pick)
            if not ways:
                del nxt[at]
            at = at_next
            if at == start:
                break
            loop.append(at)
        p = np.array(loop, float)[:, ::-1]
        q = np.roll(p, -1, axis=0)
        area = 0.5 * (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()
        if area >= least:  # holes have the other sign
            out.append(_simplified(p, eps).ravel().tolist())
    return out


def _simplified(p: np.ndarray, eps: float) -> np.ndarray:
    """A closed outline without vertices that are within ``eps`` of the chord between kept ones; at least three stay."""
    far = int(np.linalg.norm(p - p[0], axis=1).argmax())
    keep = {0, far}
    stack = [(0, far), (far, len(p))]
    ring = np.concatenate([p, p[:1]])
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        chord = ring[j] - ring[i]
        between = ring[i + 1 : j] - ring[i]
        n = np.linalg.norm(chord)
        d = np.abs(between[:, 0] * chord[1] - between[:, 1] * chord[0]) / n if n > 0 else np.linalg.norm(between, axis=1)
        k = int(d.argmax())
        if d[k] > eps:
            keep.add(i + 1 + k)
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[sorted(keep)] if len(keep) > 2 else p


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def rle_parts(payload: pd.Series) -> pd.Series:
    """FN-34 on a column of run-length objects as JSON text; other text and broken objects have no parts."""

    def parts(text: str | None) -> list:
        try:
            o = json.loads(text or "null")
            return rle_outlines(o["counts"], *map(int, o["size"]))
        except (ValueError, KeyError, TypeError, IndexError):
            return []

    return payload.map(parts)


@F.pandas_udf(T.DoubleType())
def mask_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """``iou`` on columns."""
    return pd.Series([iou(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def mask_overlap_pct(a: pd.Series, b: pd.Series) -> pd.Series:
    """``overlap_pct`` on columns."""
    return pd.Series([overlap_pct(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def mask_cells(points: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """``cells`` on columns."""
    return pd.Series([cells(p, w, h) for p, w, h in zip(points, width, height, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("w", T.LongType())])))
def mask_words(outlines: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """FN-31 as bits: the words that are not empty of the grid that all of an annotation's outlines fill, 64 cells to a word."""

    def words(parts, w, h) -> list:
        at = sorted({c for p in (parts if parts is not None else ()) for c in cells(p, w, h)})
        bits = np.zeros(128 * 128, np.uint8)
        bits[at] = 1
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        return [{"i": int(i), "w": int(packed[i])} for i in np.flatnonzero(packed)]

    return pd.Series([words(p, w, h) for p, w, h in zip(outlines, width, height, strict=True)])
