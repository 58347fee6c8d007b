"""State of loops: tables bucketed on their join columns, and sets that grow by levels.

A bucketed table is read by the join on its bucket columns as it lies, so a round of a loop moves its frontier only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from taintgrid.session import _stage_folder


class Stored(NamedTuple):
    frame: DataFrame  # in buckets, for joins
    rows: int
    plain: DataFrame  # the same files read without buckets, for unions


def stored(df: DataFrame, by: list[str] | None = None, dealt: bool = False) -> Stored:
    """df written to the checkpoint folder, in buckets of the columns `by` if given, and its number of rows, which the write
    itself counts. dealt: df comes from an aggregate or distinct by these columns, so its rows needn't move again.

    Unions must take the plain frame: Spark 4.1 takes a union of bucketed tables to be dealt by the buckets, yet may then
    read the tables without them, and an aggregate over the union would give a key twice.
    """
    spark = df.sparkSession
    name = f"taintgrid_{uuid.uuid4().hex}"
    path = f"{_stage_folder(spark)}/{name}"
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if not by:
        out.write.parquet(path)
        frame = spark.read.schema(df.schema).parquet(path)
        return Stored(frame, seen.get["n"], frame)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (out if dealt else out.repartition(n, *by)).write.bucketBy(n, *by).option("path", path).saveAsTable(name)
    table = spark.table(name)
    # the frame has resolved its files and buckets; the name isn't needed any more and the files stay
    spark.sql(f"DROP TABLE {name}")
    return Stored(table, seen.get["n"], spark.read.schema(table.schema).parquet(path))


def counted(df: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, int]:
    return stored(df, by)[:2]


def bucketed(df: DataFrame, by: list[str]) -> DataFrame:
    return stored(df, by).frame


class Levels:
    """Rows found so far, as a few bucketed tables. A new level stands beside the old ones; as soon as there are too many, the last
    ones that aren't larger than what follows them are written as one, so each row is rewritten a logarithmic number of times."""

    MOST = 6

    def __init__(self, by: list[str], fold: Callable[[DataFrame], DataFrame] | None = None):
        """fold: makes one row of rows that agree in the bucket columns; without it a row is found once."""
        self.by = by
        self.fold = fold
        self.parts: list[Stored] = []

    def add(self, level: Stored) -> None:
        self.parts.append(level)
        if len(self.parts) <= self.MOST:
            return
        last = [self.parts.pop()]
        while self.parts and (len(last) < 2 or self.parts[-1].rows <= 2 * sum(x.rows for x in last)):
            last.append(self.parts.pop())
        whole = union([x.plain for x in last])
        self.parts.append(stored(self.fold(whole) if self.fold else whole, self.by))

    def without(self, df: DataFrame) -> DataFrame:
        """Rows of df, by the bucket columns, that aren't among those found."""
        for part in self.parts:
            df = df.join(part.frame.select(*self.by), self.by, "left_anti")
        return df

    def all(self) -> DataFrame:
        return union([x.plain for x in self.parts])


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
