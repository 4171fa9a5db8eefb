"""Polygon functions on columns (FN-20 .. FN-33).

A polygon is a flat array x0, y0, x1, y1, ... as exports hold it, closed
implicitly.  Everything here is a built-in expression; clipping and filling are in
``raster``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xs(points: Column) -> Column:
    return F.filter(points, lambda x, i: i % 2 == 0)


def ys(points: Column) -> Column:
    return F.filter(points, lambda x, i: i % 2 == 1)


def valid(points: Column) -> Column:
    """At least three whole points, no null among them."""
    return F.coalesce((F.size(points) >= 6) & (F.size(points) % 2 == 0) & ~F.exists(points, lambda x: x.isNull()), F.lit(False))


def _edges(points: Column, term) -> Column:
    """Sum of term(x, y, next x, next y) over the edges, the closing one included."""
    n = F.size(points)
    at = lambda i: F.element_at(points, (i % n) + 1)
    steps = F.sequence(F.lit(0), (n / 2).cast("int") - 1)
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + term(at(2 * i), at(2 * i + 1), at(2 * i + 2), at(2 * i + 3)))


def signed_area(points: Column) -> Column:
    """FN-20: shoelace area with the sign of the vertex order; 0 for fewer than three points."""
    return F.when(valid(points), 0.5 * _edges(points, lambda x, y, u, v: x * v - u * y)).otherwise(F.lit(0.0))


def area(points: Column) -> Column:
    """FN-20: shoelace area."""
    return F.abs(signed_area(points))


def perimeter(points: Column) -> Column:
    """FN-21: length of the closed outline."""
    return F.when(valid(points), _edges(points, lambda x, y, u, v: F.sqrt((u - x) * (u - x) + (v - y) * (v - y)))).otherwise(F.lit(0.0))


def centroid(points: Column) -> Column:
    """FN-24: struct (x, y), the mean of the vertices."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.when(valid(points), F.struct(mean(xs(points)).alias("x"), mean(ys(points)).alias("y")))


def box(points: Column) -> Column:
    """FN-24: struct (x0, y0, x1, y1) of the bounding box."""
    return F.when(valid(points), F.struct(F.array_min(xs(points)).alias("x0"), F.array_min(ys(points)).alias("y0"), F.array_max(xs(points)).alias("x1"), F.array_max(ys(points)).alias("y1")))


def moments(points: Column) -> Column:
    """Struct (n, sx, sy, sxx, syy, sxy) of the vertices relative to the first, in one pass."""
    x0, y0 = F.get(points, F.lit(0)), F.get(points, F.lit(1))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])

    def add(m: Column, i: Column) -> Column:
        x, y = F.element_at(points, 2 * i + 1) - x0, F.element_at(points, 2 * i + 2) - y0
        return F.struct((m["sx"] + x).alias("sx"), (m["sy"] + y).alias("sy"), (m["sxx"] + x * x).alias("sxx"), (m["syy"] + y * y).alias("syy"), (m["sxy"] + x * y).alias("sxy"))

    return F.when(valid(points), F.aggregate(F.sequence(F.lit(0), (F.size(points) / 2).cast("int") - 1), zero, add))


def elongation_of(m: Column, n: Column) -> Column:
    """FN-22 from moments: root of the ratio of the principal variances (sample covariance), floored at 1e-12."""
    var = lambda a, b, c: (m[c] - m[a] * m[b] / n) / (n - 1)
    sxx, syy, sxy = var("sx", "sx", "sxx"), var("sy", "sy", "syy"), var("sx", "sy", "sxy")
    mid, half = (sxx + syy) / 2, F.sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)
    ratio = F.sqrt(F.greatest(mid + half, F.lit(1e-12)) / F.greatest(mid - half, F.lit(1e-12)))
    return F.when(F.isnan(ratio), 1.0).otherwise(ratio)


def elongation(points: Column) -> Column:
    """FN-22 of a polygon's vertices; null if it is not valid."""
    return elongation_of(moments(points), F.size(points) / 2)


def with_descriptors(df: DataFrame, points: str = "points", width: str = "width", height: str = "height") -> DataFrame:
    """FN-23: adds area_frac, log_area, sphericity, log_aspect, log_elong and bbox_extent; rows of degenerate polygons (FL-4) are dropped.

    Area, perimeter, box and moments are columns of their own first, so each outline is walked once for each.
    """
    p = F.col(points)
    t = df.where(valid(p)).withColumns({"_a": area(p), "_p": perimeter(p), "_b": box(p), "_m": moments(p)}).where("_a > 0")
    frac = F.col("_a") / F.nullif(F.col(width) * F.col(height), F.lit(0))
    bw, bh = F.greatest(F.col("_b.x1") - F.col("_b.x0"), F.lit(1e-6)), F.greatest(F.col("_b.y1") - F.col("_b.y0"), F.lit(1e-6))
    t = t.withColumns({"_f": frac, "_w": bw, "_h": bh})
    sphere = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 4 * F.pi() * F.col("_a") / F.nullif(F.col("_p") * F.col("_p"), F.lit(0.0))))
    out = {"area_frac": F.col("_f"), "log_area": F.ln(F.greatest("_f", F.lit(1e-12))), "sphericity": sphere, "log_aspect": F.ln(F.col("_w") / F.col("_h")), "log_elong": F.ln(elongation_of(F.col("_m"), F.size(p) / 2)), "bbox_extent": F.col("_a") / (F.col("_w") * F.col("_h"))}
    return t.withColumns(out).drop("_a", "_p", "_b", "_m", "_f", "_w", "_h")


def largest(parts: Column) -> Column:
    """FN-25: the part with the greatest area; the first of equals; null if no part is valid."""
    some = F.filter(parts, valid)
    top = F.array_max(F.transform(some, area))
    return F.get(F.filter(some, lambda p: area(p) == top), F.lit(0))


def box_iou(a: Column, b: Column) -> Column:
    """FN-26: intersection over union of two boxes, 0 if the union is empty."""
    return F.coalesce(F.try_divide(box_overlap(a, b), _size(a) + _size(b) - box_overlap(a, b)), F.lit(0.0))


def box_containment(a: Column, b: Column) -> Column:
    """FN-27: the share of a's box that lies in b's."""
    return F.coalesce(F.try_divide(box_overlap(a, b), _size(a)), F.lit(0.0))


def _size(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def box_overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def min_vertex_distance(a: Column, b: Column) -> Column:
    """FN-28: the least distance between a vertex of a and one of b."""
    pa, pb = F.arrays_zip(xs(a).alias("x"), ys(a).alias("y")), F.arrays_zip(xs(b).alias("x"), ys(b).alias("y"))
    near = lambda p: F.array_min(F.transform(pb, lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return F.sqrt(F.array_min(F.transform(pa, near)))


def label_line(class_id: Column, points: Column, width: Column, height: Column, digits: int = 6) -> Column:
    """FN-32: ``class x y x y ...`` with coordinates over the image's size, clamped to 0..1; empty for odd arrays."""
    share = F.transform(points, lambda v, i: F.format_string(f"%.{digits}f", F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / F.when(i % 2 == 0, width).otherwise(height).cast("double")))))
    return F.when((F.size(points) % 2 == 0) & (F.size(points) > 0), F.concat_ws(" ", class_id.cast("string"), F.array_join(share, " "))).otherwise(F.lit(""))


def multipart(parts: Column, policy: str) -> Column:
    """FN-33: the polygons a segmentation of several parts stands for: ``split`` all, ``skip`` none, ``concat`` one."""
    some = F.filter(parts, valid)
    if policy == "split":
        return some
    if policy == "skip":
        return F.when(F.size(some) == 1, some).otherwise(F.slice(some, 1, 0))
    if policy == "concat":
        return F.when(F.size(some) > 0, F.array(F.flatten(some))).otherwise(some)
    raise ValueError(f"unknown policy: {policy}")
