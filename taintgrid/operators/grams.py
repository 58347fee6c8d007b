"""Which texts hold which pieces, by the rarest gram of each piece.

A condition `contains` in a join plans as a nested loop, and cutting texts at every length a piece has
costs a row per character and length. Here a piece of Q characters or more is looked up by one of its grams
of Q characters, the one that the fewest texts have, so a text makes candidates only where that gram
occurs, and `contains` decides on them. Shorter pieces have at most Q - 1 lengths and meet the texts' cuts by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 8
BLOCK = 1024  # characters cut at a time, since each cut is counted from the begin of what it is cut from


def grams(text: str, q: int) -> Column:
    """Hashes of all runs of q characters of a text, each once."""
    block = F.expr(
        f"transform(sequence(0, greatest(length({text}) - {q}, 0), {BLOCK}), b -> substring({text}, b + 1, {BLOCK + q - 1}))")
    cut = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - q + 1), lambda i: F.xxhash64(b.substr(i, F.lit(q))))
    every = F.array_distinct(F.flatten(F.transform(F.filter(block, lambda b: F.length(b) >= q), cut)))
    return F.when(F.length(text) >= q, every).otherwise(F.expr("cast(array() as array<bigint>)"))


def contains_pairs(texts: DataFrame, pieces: DataFrame, keys: list[str], text: str = "text", piece: str = "piece", q: int = Q) -> DataFrame:
    """(keys, text, piece): distinct pairs with equal keys whose text holds the whole piece. Null and empty
    pieces are held by no text; null keys meet nothing. There must be a key."""
    t = texts.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > 0).distinct().withColumn("_id", F.xxhash64("_text"))
    p = pieces.select(*keys, F.col(piece).alias("_piece")).where(F.length("_piece") > 0).distinct()
    own = p.select(*keys, "_piece", F.explode(grams("_piece", q)).alias("_gram"))
    asked = own.select(*keys, "_gram").distinct()
    met = t.select(*keys, "_id", F.explode(grams("_text", q)).alias("_gram")).join(asked, [*keys, "_gram"], "left_semi")
    often = met.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = own.join(often, [*keys, "_gram"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    # a piece with a gram that no text has ends here: its rarest gram meets nothing
    anchor = counted.groupBy(*keys, "_piece").agg(F.min(F.struct("_n", "_gram")).alias("_a")).where("_a._n > 0").select(
        *keys, "_piece", F.col("_a._gram").alias("_gram"))
    long = met.join(anchor, [*keys, "_gram"]).select(*keys, "_id", "_piece").join(t, [*keys, "_id"]).where(F.contains("_text", "_piece"))
    short = p.where(F.length("_piece") < q)
    lengths = short.select(*keys, F.length("_piece").alias("_len")).distinct()
    cuts = t.join(lengths, keys).where("_len <= length(_text)").select(
        *keys, "_text", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(_text) - _len + 1), i -> substring(_text, i, _len))"))).alias("_piece"))
    found = long.select(*keys, "_text", "_piece").unionByName(short.join(cuts, [*keys, "_piece"]).select(*keys, "_text", "_piece"))
    return found.select(*keys, F.col("_text").alias(text), F.col("_piece").alias(piece))
