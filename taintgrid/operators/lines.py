"""Joins on line distance and line containment, without method-wide pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgrid.session import checkpoint

LINE_LEVELS = 31  # all line numbers of an INT
FEW_POINTS = 32  # a key with more has its points cut into ranges


def near_lines(
    a: DataFrame, b: DataFrame, k: int, on: list[str], line_a: str = "line_a", line_b: str = "line_b",
) -> DataFrame:
    """Pairs with equal `on` and abs(line_a - line_b) <= k.

    Lines fall in buckets k wide; `a` is copied to its bucket and the two beside it. A hot method
    spreads over its buckets, so no task holds it whole.
    """
    bucket_a = F.floor(F.col(line_a) / k)
    left = a.withColumn("_b", F.explode(F.array(bucket_a - 1, bucket_a, bucket_a + 1)))
    right = b.withColumn("_b", F.floor(F.col(line_b) / k))
    return left.join(right, [*on, "_b"]).where(F.abs(F.col(line_a) - F.col(line_b)) <= k).drop("_b")


def _cover(lo: str, hi: str, top: int = LINE_LEVELS):
    """The few aligned power-of-two ranges that make up [lo, hi]; none is wider than 2**top lines."""
    start = F.struct(
        F.col(lo).cast("long").alias("l"),
        (F.col(hi).cast("long") + 1).alias("r"),
        F.expr("cast(array() as array<struct<lv: int, id: bigint>>)").alias("out"),
    )

    def step(acc, lv):
        live = acc["l"] < acc["r"]
        none = F.expr("cast(array() as array<struct<lv: int, id: bigint>>)")
        left = F.when(live & (acc["l"] % 2 == 1), F.array(F.struct(lv.alias("lv"), acc["l"].alias("id")))).otherwise(none)
        right = F.when(live & (acc["r"] % 2 == 1), F.array(F.struct(lv.alias("lv"), (acc["r"] - 1).alias("id")))).otherwise(none)
        return F.struct(
            F.shiftright(acc["l"] + acc["l"] % 2, 1).alias("l"),
            F.shiftright(acc["r"] - acc["r"] % 2, 1).alias("r"),
            F.concat(acc["out"], left, right).alias("out"),
        )

    levels = F.sequence(F.lit(0), F.lit(top))
    return F.aggregate(levels, start, step, lambda acc: acc["out"])


def between_lines(
    pairs: DataFrame, points: DataFrame, on: list[str], pair_id: list[str], lo: str, hi: str,
    line: str = "line", anti: bool = False,
) -> DataFrame:
    """Pairs that have (or, with anti, have not) a point with equal `on` and lo <= line <= hi.

    A point lies in one aligned range per level; an interval is a union of at most two ranges per
    level. So containment is an equality join on (on, level, range), whatever the interval length
    and however many points one method has. Points are copied to the levels that fit into the widest interval only.
    Where no key has more than FEW_POINTS points, the lines of a key are a list that its pairs look through.
    """
    lines = points.select(*on, F.col(line).cast("long").alias("_l")).where("_l is not null")
    if lines.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_POINTS).isEmpty():
        listed = lines.groupBy(*on).agg(F.collect_set("_l").alias("_ls"))
        held = F.coalesce(F.exists("_ls", lambda x: (x >= F.col(lo)) & (x <= F.col(hi))), F.lit(False))
        return pairs.join(listed, on, "left").where(~held if anti else held).drop("_ls")
    pairs = checkpoint(pairs)  # read three times below
    pair_id = list(dict.fromkeys([*pair_id, lo, hi]))  # an id may have several intervals, and each is asked for itself
    width = pairs.where(F.col(lo) <= F.col(hi)).agg(F.max(F.col(hi).cast("long") - F.col(lo).cast("long") + 1)).first()[0]
    top = min(max(width or 1, 1).bit_length() - 1, LINE_LEVELS)
    cells = (
        points.select(*on, F.col(line).cast("long").alias("_l"))
        .withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(top))))
        .select(*on, "_lv", F.expr("shiftright(_l, _lv)").alias("_id"))
        .distinct()
    )
    spans = pairs.where(F.col(lo) <= F.col(hi)).select(*dict.fromkeys([*pair_id, *on]), F.explode(_cover(lo, hi, top)).alias("_c"))
    hit = (
        spans.select(*dict.fromkeys([*pair_id, *on]), F.col("_c.lv").alias("_lv"), F.col("_c.id").alias("_id"))
        .join(cells, [*on, "_lv", "_id"], "left_semi")
        .select(*pair_id)
        .distinct()
    )
    return pairs.join(hit, pair_id, "left_anti" if anti else "left_semi")
