"""Things that every operator shares: the shared folder, written stages, ranks.

Long lineages are cut by *written tables* in the folder that the cluster names
in ``spark.checkpoint.dir``.  All executors see that folder, so a lost executor
costs the recomputation of single tasks and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` wins; only a local session without that setting
    (tests) gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="silvaframe-")
    return _OWN_DIR[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/silvaframe/{what}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append((spark, path))
    return path


def hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path, through the driver's JVM."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries, without hidden ones; empty if it is absent."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n[0] not in "._")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one go: written beside its place, then renamed, so nobody sees half of it."""
    fs, tmp = hadoop(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(tmp, hadoop(spark, path)[1]):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop(spark, path)
    src = fs.open(p)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
    src.close()
    return text


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


def written(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = scratch(spark, what)
    w = df.write.mode("error")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size, from the sizes of the files it scans.

    Frames that come from no file have no estimate; their rows are counted.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 64 * df.count()


def ranked(df: DataFrame, keys: list[str], order: str, rank: str = "rank", shards: int | None = None, uniform: str | None = None) -> DataFrame:
    """0-based rank of every row within ``keys`` without one task per key.

    The rows of a key are dealt to ``shards`` slices (as many as a shuffle has partitions) by
    the hash of ``order``.  The rank is the number of rows in the key's earlier slices (from
    counts, at most ``keys x shards`` rows and never more than rows) plus the row number in
    the own slice.  A key that holds a third of all rows is so sorted by ``shards`` tasks.
    ``order`` should be unique within the key; ties get different, arbitrary ranks.
    ``uniform``: a 64-bit hash that ``order`` begins with; then slices are ranges of it and ranks follow
    ``order`` itself, else they follow (slice, order).
    """
    shards = shards or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if uniform:  # the upper 31 bits, from 0 on
        part = F.floor((F.shiftright(uniform, 33) + F.lit(1 << 30)) * F.lit(shards) / F.lit(1 << 31)).cast("int")
    else:
        part = F.pmod(F.xxhash64(F.col(order), F.lit("slice")), F.lit(shards)).cast("int")
    t = df.withColumn("_s", part)
    own = W.partitionBy(*keys, "_s").orderBy(F.col(order))
    t = t.withColumn("_r", F.row_number().over(own) - 1)
    n = t.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    n = n.select("_b", *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_s"])])
    cond = None
    for i, k in enumerate([*keys, "_s"]):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = c if cond is None else cond & c
    return t.join(n, cond).select(*df.columns, (F.col("_r") + F.col("_b")).cast("long").alias(rank))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it.

    A cluster that has the package installed gets the same code once more, which does no harm.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="silvaframe-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def pick(df: DataFrame, **cols: str | Column) -> DataFrame:
    """Only the columns that are needed, under the operator's own names."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in cols.items()])
