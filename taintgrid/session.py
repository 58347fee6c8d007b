"""Session settings, lineage cuts, and the two row-numbering helpers every operator shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Every fact table carries these two columns; ids are unique only inside one (project, scan).
KEYS = ["project_id", "scan_id"]


def get_session(app: str = "taintgrid", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches. On a cluster, bring your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_private: dict[str, str] = {}  # application id -> private folder, where the session names none
_owned: set[str] = set()  # folders of applications of this process, removed at exit


def _remove(sc: SparkContext, folder: str) -> None:
    """Delete this application's part of the shared folder; nothing to do once the JVM is gone."""
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except (Py4JError, OSError, AttributeError):
        pass


def _stage_folder(spark: SparkSession) -> str:
    """A folder of this application inside the shared folder the cluster names in
    spark.checkpoint.dir; a private one only where none is named and all runs in one process, as in tests.
    Either is removed when the driver process ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not named:
        named = _private.get(sc.applicationId)
        if named is None:
            named = _private[sc.applicationId] = tempfile.mkdtemp(prefix="spark-taintgrid-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)  # ours alone, so it goes with us
    folder = f"{named.rstrip('/')}/taintgrid-{sc.applicationId}"
    if folder not in _owned:
        _owned.add(folder)
        atexit.register(_remove, sc, folder)
    return folder


def checkpoint(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the checkpoint folder, in folders by `partition_by` if given, and return a frame that reads it.

    Lineage is cut, a lost executor costs a re-read and not a re-run of the loop, and later joins
    see the true size of the written table when they choose between broadcast and shuffle.
    """
    path = f"{_stage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20  # a side counted to be smaller may be sent to all executors


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast only if its counted rows stay under BROADCAST_BYTES; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


HEAVY_ROWS = 1 << 20  # a key with more rows is numbered over several tasks


def ranked_by_key(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rn", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`ranked` for keys that are mostly small: one shuffle, and the rows stay dealt by their keys for the joins that follow.

    Keys of more than heavy_rows rows are numbered by `ranked` and the others by a window. df is read once more to count.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    small = lambda part: part.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols)).cast("long"))
    heavy = checkpoint(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy_rows).drop("_n"))
    if heavy.isEmpty():
        return small(df)
    cond = _all([df[k].eqNullSafe(heavy[k]) for k in keys])
    return small(df.join(heavy, cond, "left_anti")).unionByName(ranked(df.join(heavy, cond, "left_semi"), keys, order, name))


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rn") -> DataFrame:
    """Exact row_number() over (partition by keys order by order) without sending a key to one task.

    A plain window puts each key into a single sort. Here rows are range-partitioned by
    (keys, order), numbered inside each partition, and shifted by the rows the same key has in
    earlier partitions. Only one (partition, key) count row per pair is windowed.
    The order must end in a unique key.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    sort = [F.col(k) for k in keys] + order_cols
    parts = df.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id())
    # The part number must not change between the two uses below, so the frame is cut here.
    parts = checkpoint(parts)
    within = Window.partitionBy("_part", *keys).orderBy(*order_cols)
    counts = parts.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        if keys
        else Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = parts.withColumn("_rn", F.row_number().over(within))
    on = ["_part", *keys]
    cond = [numbered[c].eqNullSafe(shift[c]) for c in on]
    joined = numbered.join(shift, _all(cond), "inner")
    return joined.select(
        *[numbered[c] for c in df.columns], (F.col("_rn") + F.col("_shift")).cast("long").alias(name)
    )


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """First n rows per key. Spark limits each map task to n rows per key before the shuffle
    (window group limit), so a hot key reaches the final task as n rows per map task."""
    part = keys if keys else [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def one_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of several the smallest by the other columns in their order, whatever the task order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_one")).select(*[f"_one.{c}" if c in rest else c for c in df.columns])


def best_per(df: DataFrame, keys: list[str], order: Column, worst: bool = False) -> DataFrame:
    """The row with the smallest (or largest) order value per key, by a partial aggregate."""
    pick = F.max_by if worst else F.min_by
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_best"))
    return agg.select(*keys, "_best.*")
