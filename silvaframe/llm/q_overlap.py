"""Queries of problem 2 over train, val and test.

A photograph is two short token sequences, and both go through the winnowing operator; the
rules of the definition are checked on the aligned pairs.

*Path*: begin, lot folder, slash, all words of the photograph's name but the last, the last
word, end, and one token for marks of copying or editing, where there are any.  Two ways of
writing one path share the first six tokens, whatever their marks.

*Traits*: per grid and class that the photograph has, a token of class, count and cell of
ln(area).  The ``GRIDS`` grids have cells of ``GRIDS`` times the tolerance and are shifted by
one tolerance each, so a class whose areas differ by at most 1 % is torn apart in one grid at
most.  Of any ``RUN`` = k + w - 1 neighbouring classes at least one of the RUN + 1 grids so
has them all in the same cells: near copies always share a fingerprint, and at least
1 - 1 / GRIDS = 0.8 of their tokens match.  Conversely, of two sequences of at least
GRIDS * RUN tokens that match in 0.8 of their places some RUN places in a row match,
so every such pair is found.  Photographs with fewer than RUN classes repeat theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R
from .overlap import overlaps

#: The trait classes, in the tables' order.
CLASSES = ("5", "13", "22", "45", "61", "66", "72", "76", "77", "78", "93", "98", "vx", "rad")
#: The six tokens that two spellings share are two 5-grams, one window.
PATH_K, PATH_W = 5, 2
TRAIT_K, TRAIT_W = 3, 2
RUN = TRAIT_K + TRAIT_W - 1
GRIDS = RUN + 1
#: Share of its tokens that a record must have in common with one of the other split.
LEAST = 0.8
#: Mismatches in a row that the alignment walks over: a grid in which every class is torn apart.
DROP = len(CLASSES) + 2
#: Areas that differ by at most 1 % of the larger differ by less than this in ln(area).
TOLERANCE = 0.01006

#: File types and marks of copying or editing at the end of a photograph's name.
TYPES = r"(\.(jpe?g|jpe|jfif|png|tiff?|bmp|gif|webp|heic|raw|dng|cr2|nef|orig|bak|tmp))+$"
WORDS = r"copia|copie|copy|kopie|edit(?:ed|ado|ada)?|orig(?:inal)?|crop(?:ped)?|recorte|flip(?:ped)?|mirror|espejo|rot(?:ated?)?\d*|girad[oa]|gris|gray|grey|bw|bn|v\d+|ver\d+|rev\d+|aug\d*|mod|final|retoque|resized?|thumb|small|dup\d*"
MARKS = rf"(\s*\(\d+\)|\s*\[\d+\]|~\d+|[\s._-]+(?:{WORDS})(?:[\s_-]*\d+)?(?=$|[\s._~(\[-]))+\s*$"


def _plain(c: Column) -> Column:
    """Letters and digits in lower case; runs of anything else are one hyphen; no leading zeros."""
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", "-")
    c = F.regexp_replace(c, r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", "-")
    c = F.regexp_replace(c, r"(?<!\p{N})0+(?=\p{N})", "")
    return F.regexp_replace(c, r"^-+|-+$", "")


def _split_path(path: Column) -> tuple[Column, Column, Column]:
    """Lot, photograph's name without marks and file types, and the marks, each in one spelling."""
    p = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    p = F.lower(F.trim(F.translate(p, "\\", "/")))
    whole = F.trim(F.regexp_extract(p, r"([^/]*)$", 1))
    lot = F.regexp_extract(p, r"([^/]+)/+[^/]*$", 1)
    name = F.regexp_replace(whole, TYPES, "")
    name = F.regexp_replace(F.regexp_replace(name, MARKS, ""), TYPES, "")
    name = F.regexp_replace(name, MARKS, "")  # a beginning of the whole name
    return _plain(lot), _plain(name), _plain(F.regexp_replace(F.substr(whole, F.length(name) + 1), TYPES, ""))


def photo_key(path: Column) -> Column:
    """``lot/photograph`` in one spelling, or null where either is missing."""
    lot, name, _ = _split_path(path)
    return F.when((name != "") & (lot != ""), F.concat_ws("/", lot, name))


def _side(spark: SparkSession, sf: str, names: tuple[str, ...]) -> DataFrame:
    """record_id, split, lot, name, marks, counts and areas of the tables."""
    out = None
    for n in names:
        t = spark.read.parquet(f"{sf}/{n}.parquet")
        lot, name, marks = _split_path(F.col("image_path"))
        t = t.select("record_id", F.lit(n).alias("split"), lot.alias("lot"), name.alias("name"), marks.alias("marks"), F.array(*[F.col(f"count_feat_{c}") for c in CLASSES]).alias("counts"), F.array(*[F.col(f"area_feat_{c}") for c in CLASSES]).alias("areas"))
        out = t if out is None else out.unionByName(t)
    return R.written(out.where("record_id is not null").distinct(), "side")  # the wide tables are read once


def _path_docs(side: DataFrame) -> DataFrame:
    """record_id, seq_id, tokens, path_key of the records with a lot and a name."""
    t = side.where("lot <> '' and name <> ''")
    head, tail = F.regexp_extract("name", r"^(.*)-[^-]*$", 1), F.substring_index("name", "-", -1)
    tokens = [F.hash(F.lit(what), x) for what, x in (("^", F.lit(0)), ("lot", F.col("lot")), ("/", F.lit(0)), ("head", head), ("tail", tail), ("$", F.lit(0)))]
    marks = F.when(F.col("marks") != "", F.array(F.hash(F.lit("marks"), "marks"))).otherwise(F.array().cast("array<int>"))
    t = t.select("record_id", F.concat(F.array(*tokens), marks).alias("tokens"), F.concat_ws("/", "lot", "name").alias("path_key"))
    return t.withColumn("seq_id", F.xxhash64("tokens"))


def _trait_docs(side: DataFrame) -> DataFrame:
    """record_id, seq_id, tokens, counts and areas of the records with instances and without unknown values."""
    known = ~F.exists("counts", lambda x: x.isNull()) & ~F.exists("areas", lambda x: x.isNull() | F.isnan(x))
    t = side.where(known & F.exists("counts", lambda x: x != 0))
    here = F.filter(F.transform("counts", lambda c, i: F.struct(i.alias("i"), c.alias("c"), F.get("areas", i).alias("a"))), lambda s: (s["c"] != 0) | (s["a"] != 0))
    t = t.select("record_id", "counts", "areas", here.alias("h"))
    again = F.transform(F.sequence(F.lit(0), F.greatest(F.size("h"), F.lit(RUN)) - 1), lambda j: F.get("h", j % F.size("h")))
    t = t.withColumn("h", again)

    def grid(g: int) -> Column:
        cell = lambda a: F.floor((F.ln(F.when(a > 0, a)) + g * TOLERANCE) / (GRIDS * TOLERANCE))
        return F.transform("h", lambda s: F.hash(F.lit(g), s["i"], s["c"], cell(s["a"])))

    tokens = F.concat(*[grid(g) for g in range(GRIDS)])
    return t.select("record_id", "counts", "areas", tokens.alias("tokens")).withColumn("seq_id", F.xxhash64("tokens"))


def _seqs(docs: DataFrame, what: str) -> DataFrame:
    """seq_id, tokens of the distinct sequences."""
    return R.written(docs.groupBy("seq_id").agg(F.any_value("tokens").alias("tokens")), what)


def _aligned(train: DataFrame, held: DataFrame, k: int, w: int, what: str) -> DataFrame:
    """(seq_a, seq_b, cover_a, cover_b) of the sequences that both sides' records have in common to ``LEAST`` or more."""
    return overlaps(_seqs(train, f"{what}-train"), _seqs(held, f"{what}-held"), k, w, LEAST, DROP)


def _records(train: DataFrame, held: DataFrame, pairs: DataFrame, cols: list[str]) -> DataFrame:
    """The records of both sides behind the pairs of sequences: ra, rb and the columns as a_... and b_..."""
    left = train.select(F.col("seq_id").alias("seq_a"), F.col("record_id").alias("ra"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = held.select(F.col("seq_id").alias("seq_b"), F.col("record_id").alias("rb"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return pairs.select("seq_a", "seq_b").join(left, "seq_a").join(right, "seq_b")


def _pairs(train: DataFrame, held: DataFrame) -> DataFrame:
    """(record_a of train, record_b of val or test, rule)."""
    pa, pb = _path_docs(train), _path_docs(held)
    by_path = _records(pa, pb, _aligned(pa, pb, PATH_K, PATH_W, "paths"), ["path_key"]).where("a_path_key = b_path_key")
    ta, tb = _trait_docs(train), _trait_docs(held)
    by_trait = _records(ta, tb, _aligned(ta, tb, TRAIT_K, TRAIT_W, "traits"), ["counts", "areas"])
    close = F.forall(F.arrays_zip("a_areas", "b_areas"), lambda z: F.abs(z["a_areas"] - z["b_areas"]) <= 0.01 * F.greatest(z["a_areas"], z["b_areas"]))
    by_trait = by_trait.where((F.col("a_counts") == F.col("b_counts")) & close)
    return by_path.select("ra", "rb", F.lit("path").alias("rule")).unionByName(by_trait.select("ra", "rb", F.lit("traits").alias("rule")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    t = _pairs(_side(spark, sf, ("train",)), _side(spark, sf, ("val", "test")))
    return t.select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b")).where("record_a < record_b").distinct()


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and lot: records, records that train holds too (by path, by traits), pairs and the share covered."""
    held = _side(spark, sf, ("val", "test"))
    pairs = R.written(_pairs(_side(spark, sf, ("train",)), held), "overlap")
    per = pairs.groupBy("rb").agg(F.countDistinct("ra").alias("n_pairs"), F.max(F.when(F.col("rule") == "path", 1).otherwise(0)).alias("by_path"), F.max(F.when(F.col("rule") == "traits", 1).otherwise(0)).alias("by_traits"))
    lots = held.select("record_id", "split", _lot()).distinct()
    t = lots.join(per, lots["record_id"] == per["rb"], "left")
    t = t.groupBy("split", "lot").agg(F.count(F.lit(1)).alias("records"), F.count("rb").alias("overlapping"), F.coalesce(F.sum("by_path"), F.lit(0)).alias("by_path"), F.coalesce(F.sum("by_traits"), F.lit(0)).alias("by_traits"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("pairs"))
    return t.withColumn("share", F.round(F.col("overlapping") / F.col("records"), 6))


def _lot() -> Column:
    """The lot of a record with a name, else empty."""
    return F.when((F.col("lot") != "") & (F.col("name") != ""), F.col("lot")).otherwise("").alias("lot")


def p2_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per record of val and test how much of its path and of its traits the best record of train covers.

    The shares of the record's tokens (see above) that the winnowing alignment matches, from 0.8 on;
    null means that no record of train comes so close.
    """
    return _coverage(_side(spark, sf, ("train",)), _side(spark, sf, ("val", "test")))


def _coverage(tr: DataFrame, held: DataFrame) -> DataFrame:
    t = held.select("record_id", "split", _lot()).distinct()
    for name, docs, k, w in (("path", _path_docs, PATH_K, PATH_W), ("traits", _trait_docs, TRAIT_K, TRAIT_W)):
        own = docs(held)
        best = _aligned(docs(tr), own, k, w, name).groupBy(F.col("seq_b").alias("seq_id")).agg(F.max("cover_b").alias("c")).where(F.col("c") >= LEAST - 1e-9)
        per = own.join(best, "seq_id").groupBy("record_id").agg(F.round(F.max("c"), 6).alias(f"cover_{name}"))
        t = t.join(per, "record_id", "left")
    return t


_CNT = "[" + ", ".join(f"count_feat_{c}" for c in CLASSES) + "]"
_ARE = "[" + ", ".join(f"area_feat_{c}" for c in CLASSES) + "]"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '(\\p{{L}})(\\p{{N}})', '\\1-\\2', 'g'), '(\\p{{N}})(\\p{{L}})', '\\1-\\2', 'g'), '(^|[^\\p{{N}}])0+(\\p{{N}})', '\\1\\2', 'g'), '^-+|-+$', '', 'g')"
_SQLMARKS = r"(\s*\(\d+\)|~\d+|[\s._-]+(copia|copy|edit|orig|crop|flip|rot\d*|gris|v\d+|aug\d*))+\s*$"
_BASE = rf"""
WITH s AS (
  SELECT DISTINCT record_id, 'train' AS split, image_path, {_CNT} AS n, {_ARE} AS a FROM train
  UNION SELECT record_id, 'val', image_path, {_CNT}, {_ARE} FROM val UNION SELECT record_id, 'test', image_path, {_CNT}, {_ARE} FROM test),
p AS (SELECT *, string_split(regexp_replace(lower(trim(replace(replace(image_path, '%20', ' '), '\', '/'))), '/+', '/', 'g'), '/') AS q FROM s),
r AS (SELECT record_id, split, n, a, {_PLAIN.format("q[-2]")} AS lot,
        {_PLAIN.format("regexp_replace(regexp_replace(trim(q[-1]), '(\\.(jpe?g|png|tiff?|orig))+$', ''), '" + _SQLMARKS + "', '')")} AS photo FROM p),
pr AS (
  SELECT x.record_id AS ra, y.record_id AS rb, 'path' AS rule FROM r x JOIN r y ON x.lot = y.lot AND x.photo = y.photo WHERE x.split = 'train' AND y.split <> 'train'
  UNION SELECT x.record_id, y.record_id, 'traits' FROM r x JOIN r y ON x.n = y.n
  WHERE x.split = 'train' AND y.split <> 'train' AND list_max(x.n) > 0
    AND len(list_filter(list_zip(x.a, y.a), lambda z: abs(z[1] - z[2]) > 0.01 * greatest(z[1], z[2]))) = 0)
"""
QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_coverage": p2_coverage}
SQL = {
    "p2_found": _BASE + "SELECT DISTINCT least(ra, rb) AS record_a, greatest(ra, rb) AS record_b FROM pr",
    "p2_report": _BASE
    + """, k AS (SELECT rb, count(DISTINCT ra) AS n, max(CASE WHEN rule = 'path' THEN 1 ELSE 0 END) AS bp, max(CASE WHEN rule = 'traits' THEN 1 ELSE 0 END) AS bt FROM pr GROUP BY 1)
SELECT split, lot, count(*) AS records, count(rb) AS overlapping, CAST(coalesce(sum(bp), 0) AS BIGINT) AS by_path, CAST(coalesce(sum(bt), 0) AS BIGINT) AS by_traits,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs, round(count(rb) / count(*), 6) AS share
FROM (SELECT DISTINCT record_id, split, lot FROM r WHERE split <> 'train') l LEFT JOIN k ON k.rb = l.record_id GROUP BY 1, 2""",
}
