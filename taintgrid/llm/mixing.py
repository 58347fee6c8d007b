"""Mixing sources to target weights by Poisson replication.

A source of n rows that shall make up the share w of N output rows has a mean repetition rate of w * N / n.
Each row's number of copies inverts the Poisson distribution of that mean at a uniform number taken from a hash
of the seed and doc_id, so a row's copies depend on it and its source's rate alone, whatever the partitions.
Copies are dealt out over the whole output by a hash of (doc_id, copy).

Rates come from one aggregate per source; they go to the rows by broadcast if their counted size allows it, else by a join
on the source that Spark splits where a source is hot.
Defined cases: a null source is a source of its own; a null doc_id counts as the text "null", and rows that repeat a
doc_id get the same number of copies each; a source without a target has weight 0; targets that sum to 0 or an empty
table give no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.llm.shared import sized
from taintgrid.session import checkpoint

SEED = 42
POWER = 0.5  # default targets are in proportion to the source's rows to this power


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of an MD5 of the seed and the key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def poisson_steps(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, as far as doubles tell them from 1.

    A mean over 500, where exp(-mean) nears the smallest double, is split into that many independent parts by the caller.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    start = F.struct(F.lit(0).alias("k"), first.alias("p"), F.array(first).alias("c"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(k.alias("k"), p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["c"])


def rates(docs: DataFrame, targets: DataFrame | None = None, power: float = POWER) -> DataFrame:
    """source, rate: the mean number of copies of a row. targets: source, weight."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighed = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        want = targets.groupBy("source").agg(F.sum("weight").alias("weight")).select(F.col("source").alias("_s"), "weight")
        weighed = n.join(want, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_w"))
    return weighed.crossJoin(F.broadcast(total)).where("all_w > 0 and weight > 0").select("source", (F.col("weight") / F.col("all_w") * F.col("all_n") / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, targets: DataFrame | None = None, power: float = POWER, seed: int = SEED, packed_rows: bool = False) -> DataFrame:
    """Each row of docs as often as its Poisson count, with its number copy (from 0) and shuffle_key, globally shuffled;
    input columns of those two names give way. packed_rows: docs' columns come as one struct _row."""
    parts = F.ceil(F.col("rate") / 500).cast("int")
    by_source = rates(docs, targets, power).select(
        F.col("source").alias("_source"), parts.alias("_parts"), poisson_steps(F.col("rate") / parts).alias("_steps"))
    packed = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_own"), F.col("doc_id").alias("_id"))
    rows = packed.join(sized(checkpoint(by_source), 400), F.col("_own").eqNullSafe(F.col("_source")))
    draw = lambda part: F.size(F.filter("_steps", lambda c: c <= uniform(seed, F.col("_id"), part)))
    one = F.size(F.filter("_steps", lambda c: c <= F.col("_u")))
    many = F.aggregate(F.sequence(F.lit(1), F.col("_parts") - 1), F.lit(0), lambda n, part: n + draw(part))
    rows = rows.withColumn("_u", uniform(seed, F.col("_id"))).withColumn("_copies", one + F.when(F.col("_parts") > 1, many).otherwise(F.lit(0)))
    rows = rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("_copy")))
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("copy", "shuffle_key")]
    out = rows.select("_row", F.col("_copy").alias("copy"), key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return out if packed_rows else out.select(*own, "copy", "shuffle_key")


def mix(docs: DataFrame, targets: DataFrame | None = None, power: float = POWER, seed: int = SEED) -> DataFrame:
    """The rows of docs, repeated and shuffled, with docs' own columns."""
    return replicate(docs, targets, power, seed, packed_rows=True).select("_row.*")
