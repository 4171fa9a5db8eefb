"""The scalar functions under SQL names (2.14): SQL functions, so they stay expressions for Catalyst.

``register(spark)`` makes them temporary functions of the session; Unicode and raster
functions, which need Python, are registered as Pandas UDFs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import raster, text

#: name -> (parameters, result type, body)
SQL_FUNCTIONS = {
    "base_name": ("p STRING", "STRING", r"regexp_extract(p, r'([^/\\]*)$', 1)"),
    "slashes": ("p STRING", "STRING", r"coalesce(translate(p, '\\', '/'), '')"),
    "species_token": ("p STRING", "STRING", r"coalesce(nullif(trim(regexp_extract(regexp_replace(regexp_extract(p, r'([^/\\]*)$', 1), r'\.[^.]+$', ''), r'^([^-_]*)', 1)), ''), 'unknown')"),
    "species_token_strict": ("p STRING", "STRING", r"nullif(regexp_extract(p, r'^(\d{3,5})-', 1), '')"),
    "leading_digits": ("p STRING", "STRING", r"nullif(regexp_extract(p, r'^(\d+)', 1), '')"),
    "safe_name": ("s STRING", "STRING", r"concat('feat_', coalesce(nullif(regexp_replace(regexp_replace(s, '[^0-9A-Za-z_]+', '_'), '^_+|_+$', ''), ''), 'unknown'))"),
    "canonical_id": ("s STRING", "STRING", r"CASE WHEN lower(trim(s)) IN ('', 'nan') THEN NULL WHEN regexp_replace(trim(s), r'^(\d+)\.0*$', '$1') RLIKE r'^\d{1,3}$' THEN lpad(regexp_replace(trim(s), r'^(\d+)\.0*$', '$1'), 4, '0') ELSE regexp_replace(trim(s), r'^(\d+)\.0*$', '$1') END"),
    "genus": ("s STRING", "STRING", r"coalesce(nullif(regexp_extract(trim(s), r'^(\S+)', 1), ''), '?')"),
    "list_cell": ("s STRING", "ARRAY<STRING>", r"""coalesce(from_json(CASE WHEN trim(s) LIKE '[%' THEN s END, 'array<string>'), filter(transform(split(s, '[;,|]'), x -> trim(regexp_replace(x, r'[\[\]"'']', ''))), x -> x <> ''))"""),
    "polygon_area": ("p ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(p) >= 6 AND size(p) % 2 = 0 THEN abs(aggregate(sequence(0, size(p) div 2 - 1), 0D, (s, i) -> s + p[2 * i] * p[(2 * i + 3) % size(p)] - p[(2 * i + 2) % size(p)] * p[2 * i + 1])) / 2 ELSE 0D END"),
    "polygon_perimeter": ("p ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(p) >= 6 AND size(p) % 2 = 0 THEN aggregate(sequence(0, size(p) div 2 - 1), 0D, (s, i) -> s + sqrt(pow(p[(2 * i + 2) % size(p)] - p[2 * i], 2) + pow(p[(2 * i + 3) % size(p)] - p[2 * i + 1], 2))) ELSE 0D END"),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "1 - least(1D, greatest(-1D, coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)))"),
    "species_reliability": ("n BIGINT", "DOUBLE", "least(1D, n / 5D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to ``spark.sql``; their names."""
    for name, (params, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    python = {"ascii_form": text._ascii, "mask_iou": raster.mask_iou, "mask_overlap_pct": raster.mask_overlap_pct}
    for name, f in python.items():
        spark.udf.register(name, f)
    return [*SQL_FUNCTIONS, *python]
