"""Items that appear together: an incremental pair table.

Method.  The state is a set of hash-bucketed Parquet tables in the shared folder: the
*baskets* (basket, group, sorted distinct items), the *counts* per group (group, a, b, n),
where ``b`` null is the marginal of ``a`` and both null the number of baskets, the
*totals* (the same over all baskets), and the *scores* of both.  A batch of rows is grouped
into changed baskets; each emits its old pairs and marginals with sign -1 and its new ones
with +1; the deltas are summed (map-side first) and merged into just the buckets they
touch.  When scores are asked for, those of the groups that changed since are computed again,
from their buckets alone.

Scale.  The number of buckets follows the size of the first batch and stays; the tasks that
write one bucket follow the size of all batches, so no stage has fewer tasks than the data
need.  Totals come from the groups' summed deltas, so no key holds every basket.  Baskets
with more than ``wide`` distinct items are not opened in one row; their items are dealt to
blocks and the pairs come from an equi-join on (basket, block, block), which spreads a hot
basket over as many tasks as a shuffle has.

Defined cases.  Rows with a null basket or a null item are ignored (a basket left
without items does not count).  Doubled rows count once.  A basket has one
group: the least non-null ``grp`` among its rows or, without any, the least ``weak``;
baskets without a group count only in ``all``.  An empty table gives empty results.  Extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime as R

ALL = "all"
#: Bytes of input that one bucket stands for when a state is begun, and that one writing task gets.
PER_BUCKET, PER_TASK = 8 << 20, 64 << 20
MOST_BUCKETS = 1024


class PairTable:
    """Persistent co-occurrence counts that follow additions to, and replacements of, baskets."""

    def __init__(self, spark: SparkSession, basket: T.DataType, item: T.DataType, path: str | None = None, buckets: int | None = None, wide: int = 512):
        self.spark, self.buckets, self.wide = spark, buckets, wide
        self.path = path or R.scratch(spark, "pairs")
        s, f = T.StructType, T.StructField
        count = [f("grp", T.StringType()), f("a", item), f("b", item)]
        score = s([*count, *(f(c, T.LongType()) for c in ("nab", "na", "nb", "n")), f("lift", T.DoubleType())])
        self.schemas = {
            "baskets": s([f("basket", basket), f("grp", T.StringType()), f("weak", T.StringType()), f("items", T.ArrayType(item))]),
            "counts": s([*count, f("n", T.LongType())]),
            "totals": s([*count, f("n", T.LongType())]),
            "scores": score,
            "overall": score,
        }
        self.version, self.bytes, self.last, self.stale, self.live = 0, 0, None, [], {t: {} for t in self.schemas}  # table -> bucket -> folder
        if path:
            self._open()

    # -- state ---------------------------------------------------------------
    def _open(self) -> None:
        """Go on from the newest manifest of the folder, if there is one."""
        found = [n for n in R.children(self.spark, self.path) if n.startswith("manifest-")]
        if found:
            m = json.loads(R.read_text(self.spark, f"{self.path}/{found[-1]}"))
            if self.buckets not in (None, m["buckets"]):
                raise ValueError(f"this state has {m['buckets']} buckets")
            self.version, self.buckets, self.bytes, self.last, self.stale = (m[k] for k in ("version", "buckets", "bytes", "last", "stale"))
            self.live = {t: {int(b): p for b, p in x.items()} for t, x in m["live"].items()}

    def _commit(self) -> None:
        """Name the live folders in a manifest; a batch that failed before this has changed nothing."""
        text = json.dumps({"version": self.version, "buckets": self.buckets, "bytes": self.bytes, "last": self.last, "stale": self.stale, "live": self.live})
        R.write_text(self.spark, f"{self.path}/manifest-{self.version:09d}", text)

    def vacuum(self) -> int:
        """Remove the bucket folders that no table uses any more; how many they were."""
        used = {p for x in self.live.values() for p in x.values()}
        gone = 0
        for v in (n for n in R.children(self.spark, self.path) if n.startswith("v")):
            for what in R.children(self.spark, f"{self.path}/{v}"):
                for b in R.children(self.spark, f"{self.path}/{v}/{what}"):
                    p = f"{self.path}/{v}/{what}/{b}"
                    if b.startswith("bucket=") and p not in used:
                        R.remove(self.spark, p)
                        gone += 1
        return gone

    def _bucket(self, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, only: set[int] | None = None) -> DataFrame:
        paths = [p for b, p in self.live[table].items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def _write(self, df: DataFrame, what: str, salt: tuple[str, ...]) -> tuple[str, set[int]]:
        """Write by bucket, a bucket by as many tasks as its share of the bytes needs; the folder and the buckets that got rows."""
        path = f"{self.path}/v{self.version}/{what}"
        spread = max(1, -(-self.bytes // (self.buckets * PER_TASK)))
        task = F.col("bucket") * spread + F.pmod(F.xxhash64(*salt), F.lit(spread)).cast("int")
        df.repartitionById(self.buckets * spread, task.cast("int")).write.partitionBy("bucket").parquet(path)
        return path, {int(x.split("=")[1]) for x in R.children(self.spark, path) if x.startswith("bucket=")}

    def _swap(self, table: str, path: str, wrote: set[int], touched: set[int]) -> None:
        """Point the touched buckets to their new folders; an emptied bucket disappears."""
        for b in touched:
            self.live[table].pop(b, None)
        self.live[table] |= {b: f"{path}/bucket={b}" for b in wrote}

    # -- change --------------------------------------------------------------
    def apply(self, rows: DataFrame, replace: bool = False) -> "PairTable":
        """Merge a batch with the columns basket, grp, item and, optionally, weak: the group where no row has a ``grp``.

        ``replace`` says that the batch holds the *whole* new content of its
        baskets (a row with a null item empties one); otherwise items are added.
        """
        self.version += 1
        self.bytes += R.estimated_bytes(rows)
        if self.buckets is None:
            self.buckets = min(MOST_BUCKETS, max(4, 1 << (-(-self.bytes // PER_BUCKET) - 1).bit_length()))
        rows = rows.where(F.col("basket").isNotNull())
        if not replace:
            rows = rows.where(F.col("item").isNotNull())
        if "weak" not in rows.columns:
            rows = rows.withColumn("weak", F.lit(None).cast("string"))
        none = F.array().cast(self.schemas["baskets"]["items"].dataType)
        new = rows.groupBy("basket").agg(F.min("grp").alias("grp"), F.min("weak").alias("weak"), F.collect_set("item").alias("items"))
        new = new.withColumn("bucket", self._bucket("basket"))
        first = not self.live["baskets"]
        if first:
            change = new.select("bucket", "basket", F.lit(None).cast("string").alias("old_grp"), none.alias("old_items"), "grp", "weak", F.array_sort("items").alias("items"))
        else:
            old = self._read("baskets").select(F.col("basket").alias("_k"), F.col("grp").alias("_g"), F.col("weak").alias("_w"), F.coalesce("items", none).alias("old_items"))
            t = new.join(old, F.col("basket") == F.col("_k"), "left")
            join = (lambda n, o: F.col(n)) if replace else (lambda n, o: F.least(F.col(n), F.col(o)))  # least() skips nulls
            items = F.col("items") if replace else F.array_union(F.coalesce("old_items", none), "items")
            change = t.select("bucket", "basket", F.coalesce("_g", "_w").alias("old_grp"), F.coalesce("old_items", none).alias("old_items"), join("grp", "_g").alias("grp"), join("weak", "_w").alias("weak"), F.array_sort(items).alias("items"))
            change = change.where(~(F.col("items").eqNullSafe(F.col("old_items")) & F.coalesce("grp", "weak").eqNullSafe(F.col("old_grp"))))
        log, touched = self._write(change, "changes", ("basket",))
        if not touched:
            self.last = None
            self._commit()
            return self
        change = self.spark.read.parquet(log)
        if first:
            self._swap("baskets", log, touched, touched)  # the log has the baskets' columns
        else:
            kept = self._read("baskets", touched).join(change.select("basket"), "basket", "left_anti")
            whole = kept.unionByName(change.where(F.size("items") > 0).select("basket", "grp", "weak", "items"))
            path, wrote = self._write(whole.withColumn("bucket", self._bucket("basket")), "baskets", ("basket",))
            self._swap("baskets", path, wrote, touched)
        self.last = log
        self.stale.append(log)
        path, groups = self._write(self._deltas(change).withColumn("bucket", self._bucket("grp")), "deltas", ("a",))
        deltas = self.spark.read.schema(self.schemas["counts"]).parquet(path).drop("bucket")
        if first:
            self._swap("counts", path, groups, groups)
        else:
            self._add("counts", deltas, groups, ("grp",), ("a",))
        over = deltas.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        self._add("totals", over.select(F.lit(ALL).alias("grp"), "a", "b", "n"), set(range(self.buckets)), ("a",), ("b",))
        self._commit()
        return self

    def _deltas(self, change: DataFrame) -> DataFrame:
        """Signed changes of totals, marginals and pairs, summed."""
        signed = change.select("basket", F.col("old_grp").alias("grp"), F.col("old_items").alias("items"), F.lit(-1).cast("long").alias("d")).where(F.size("items") > 0)
        signed = signed.unionByName(change.select("basket", F.coalesce("grp", "weak").alias("grp"), "items", F.lit(1).cast("long").alias("d")).where(F.size("items") > 0))
        none = F.array(F.lit(None).cast(self.schemas["counts"]["a"].dataType))
        narrow = F.size("items") <= self.wide
        own = signed.select("grp", "d", "items", narrow.alias("narrow"), F.posexplode(F.concat(none, "items")).alias("i", "a"))
        later = F.when(F.col("narrow") & (F.col("i") > 0), F.concat(none, F.slice("items", F.col("i") + 1, F.size("items")))).otherwise(none)
        out = own.select("grp", "a", F.explode(later).alias("b"), "d")
        side = signed.where(~narrow).select("basket", "grp", "d", F.explode("items").alias("x"))
        blocks = max(2, int(int(self.spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
        side = side.withColumn("k", F.pmod(F.xxhash64("x"), F.lit(blocks)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        left = side.select("basket", "grp", "d", F.col("x").alias("a"), F.col("k").alias("ka"), every.alias("kb"))
        right = side.select("basket", "grp", "d", F.col("x").alias("b"), F.col("k").alias("kb"), every.alias("ka"))
        cond = [left["basket"] == right["basket"], left["d"] == right["d"], left["ka"] == right["ka"], left["kb"] == right["kb"], left["a"] < right["b"]]
        crossed = left.join(right, cond).select(left["grp"], left["a"], right["b"], left["d"])
        out = out.unionByName(crossed)
        out = out.groupBy("grp", "a", "b").agg(F.sum("d").alias("n")).where("n <> 0")
        return out

    def _add(self, table: str, deltas: DataFrame, touched: set[int], by: tuple[str, ...], salt: tuple[str, ...]) -> None:
        """Add deltas to the buckets of a table of counts that they touch."""
        both = self._read(table, touched).unionByName(deltas).groupBy("grp", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
        path, wrote = self._write(both.withColumn("bucket", self._bucket(*by)), table, salt)
        self._swap(table, path, wrote, touched)

    def _changed(self, logs: list[str]) -> DataFrame:
        """The groups whose baskets the batches touched: _g."""
        if not logs:
            return self.spark.createDataFrame([], "_g string")
        change = self.spark.read.parquet(logs[0])
        for log in logs[1:]:  # one per batch since the last scoring
            change = change.unionByName(self.spark.read.parquet(log))
        return change.select(F.explode(F.array("old_grp", F.coalesce("grp", "weak"))).alias("_g")).where("_g is not null").distinct()

    def _touched(self, changed: DataFrame) -> set[int]:
        return {r[0] for r in changed.select(self._bucket("_g")).distinct().collect()}  # at most the number of buckets

    def rescore(self) -> "PairTable":
        """Compute the scores of the groups that changed since the last time, from their buckets, and those of all baskets."""
        if self.stale:
            self.version += 1
            changed = self._changed(self.stale)
            touched = self._touched(changed) if self.live["scores"] else set(range(self.buckets))
            own = self._read("counts", touched)
            if self.live["scores"]:
                own = own.join(changed, F.col("grp") == F.col("_g"), "left_semi")
                kept = self._read("scores", touched).join(changed, F.col("grp") == F.col("_g"), "left_anti")
                new = kept.unionByName(self._scored(own))
            else:
                new = self._scored(own)
            path, wrote = self._write(new.withColumn("bucket", self._bucket("grp")), "scores", ("a",))
            self._swap("scores", path, wrote, touched)
            path, wrote = self._write(self._scored(self._read("totals")).withColumn("bucket", self._bucket("a")), "overall", ("b",))
            self._swap("overall", path, wrote, set(self.live["overall"]))
            self.stale = []
            self._commit()
        return self

    def _scored(self, c: DataFrame) -> DataFrame:
        """Counts as pairs with their marginals, the number of baskets and the lift."""
        c = c.where("grp is not null")
        pair = c.where("b is not null").select("grp", "a", "b", F.col("n").alias("nab"))
        one = c.where("a is not null and b is null").select("grp", F.col("a").alias("x"), F.col("n").alias("nx"))
        one = one.join(c.where("a is null").select("grp", "n"), "grp")
        out = pair.join(one.select("grp", F.col("x").alias("a"), F.col("nx").alias("na"), "n"), ["grp", "a"])
        out = out.join(one.select("grp", F.col("x").alias("b"), F.col("nx").alias("nb")), ["grp", "b"])
        lift = F.col("nab").cast("double") * F.col("n") / (F.col("na").cast("double") * F.col("nb"))
        return out.select("grp", "a", "b", "nab", "na", "nb", "n", lift.alias("lift"))

    # -- result --------------------------------------------------------------
    def counts(self) -> DataFrame:
        """Counts per group and, as the group ``all``, over all baskets."""
        return self._read("counts").where("grp is not null").unionByName(self._read("totals"))

    def scores(self, only_changed: bool = False) -> DataFrame:
        """Pairs with joint count, marginals, baskets and lift, per group and over ``all``.

        ``only_changed``: just the groups that the last batch touched, and ``all``; only their buckets are read.
        """
        self.rescore()
        if not only_changed:
            return self._read("scores").unionByName(self._read("overall"))
        changed = self._changed([self.last] if self.last else [])
        own = self._read("scores", self._touched(changed)).join(changed, F.col("grp") == F.col("_g"), "left_semi")
        return own.unionByName(self._read("overall")) if self.last else own


def strong(scores: DataFrame, least: int = 8, over: tuple[int, int] = (3, 2)) -> DataFrame:
    """Pairs with a joint count of ``least`` that exceed chance by the factor over[0]/over[1], in exact numbers."""
    d = lambda c: F.col(c).cast("decimal(18,0)")
    return scores.where((F.col("nab") >= least) & (F.lit(over[1]) * d("nab") * d("n") >= F.lit(over[0]) * d("na") * d("nb")))
