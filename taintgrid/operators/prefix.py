"""Prefix joins between symbols and rules, as hash joins.

`startswith` in a join condition plans as a nested loop. Here every distinct symbol is cut at the
few lengths rule prefixes have, and the cuts meet the rules by equality. The work is done once per
distinct symbol; the result then joins back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgrid.operators.graph import closure
from taintgrid.session import checkpoint


def _cuts(symbols: DataFrame, prefixes: DataFrame, symbol: str, prefix: str) -> DataFrame:
    """symbol -> (symbol, prefix) for every cut length some rule has. Lengths are a short list:
    at most one entry per character of the longest rule."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().orderBy(1).collect()]
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(symbol))
    return symbols.withColumn("_n", F.explode(fits)).select(
        symbol, F.expr(f"substring(`{symbol}`, 1, _n)").alias(prefix)
    )


def prefix_matches(df: DataFrame, rules: DataFrame, symbol: str = "resolved_symbol", prefix: str = "symbol") -> DataFrame:
    """All (symbol, rule) pairs where the rule is a prefix of the symbol, per distinct symbol."""
    found = df.select(F.col(symbol).alias("_symbol")).where(F.col("_symbol").isNotNull()).distinct()
    named = rules.withColumnRenamed(prefix, "_prefix").where(F.length("_prefix") > 0)
    return _cuts(found, named, "_symbol", "_prefix").join(named, "_prefix")


def _attach(df: DataFrame, picked: DataFrame, symbol: str, how: str = "left") -> DataFrame:
    return df.join(picked.withColumnRenamed("_symbol", symbol), symbol, how)


def prefix_first(
    df: DataFrame, rules: DataFrame, cols: list[str], symbol: str = "resolved_symbol", prefix: str = "symbol",
    how: str = "left",
) -> DataFrame:
    """Add `cols` of the rule with the smallest ordinal whose prefix starts the symbol."""
    hits = prefix_matches(df, rules.select(prefix, "ordinal", *[c for c in cols if c != prefix]), symbol, prefix)
    if prefix in cols:
        hits = hits.withColumn(prefix, F.col("_prefix"))
    picked = hits.groupBy("_symbol").agg(F.min_by(F.struct(*cols), "ordinal").alias("_r"))
    return _attach(df, picked.select("_symbol", *[F.col(f"_r.{c}").alias(c) for c in cols]), symbol, how)


def prefix_longest(
    df: DataFrame, rules: DataFrame, cols: list[str], symbol: str = "resolved_symbol", prefix: str = "symbol",
) -> DataFrame:
    """Add `cols` of the rule with the longest matching prefix; equal prefixes keep the smaller ordinal."""
    hits = prefix_matches(df, rules.select(prefix, "ordinal", *[c for c in cols if c != prefix]), symbol, prefix)
    if prefix in cols:
        hits = hits.withColumn(prefix, F.col("_prefix"))
    order = F.struct(-F.length("_prefix"), F.col("ordinal"))
    picked = hits.groupBy("_symbol").agg(F.min_by(F.struct(*cols), order).alias("_r"))
    return _attach(df, picked.select("_symbol", *[F.col(f"_r.{c}").alias(c) for c in cols]), symbol)


def match_pattern(
    nodes: DataFrame, patterns: DataFrame, catalog: DataFrame, cols: list[str], symbol: str = "resolved_symbol",
) -> DataFrame:
    """Exact built-in pattern, else first built-in prefix, else first catalogue prefix.

    `patterns` and `catalog` have `symbol`, `ordinal` and `cols`. Unmatched nodes are dropped.
    """
    tiered = patterns.select("symbol", "ordinal", *cols, F.lit(1).alias("_tier")).unionByName(
        catalog.select("symbol", "ordinal", *cols, F.lit(2).alias("_tier"))
    )
    hits = prefix_matches(nodes, tiered, symbol)
    exact = (F.col("_tier") == 1) & (F.col("_prefix") == F.col("_symbol"))
    order = F.struct(F.when(exact, 0).otherwise(F.col("_tier")), F.col("ordinal"))
    best = hits.withColumn("matched_prefix", F.col("_prefix")).groupBy("_symbol").agg(
        F.min_by(F.struct("matched_prefix", *cols), order).alias("_r")
    )
    picked = best.select("_symbol", "_r.matched_prefix", *[F.col(f"_r.{c}").alias(c) for c in cols])
    return _attach(nodes, picked, symbol, "inner")


def with_roles(
    nodes: DataFrame, roles: DataFrame, symbol: str = "resolved_symbol", ignore_case: bool = False,
) -> DataFrame:
    """Flags is_known_sink / is_known_source / is_known_sanitizer by prefix.

    `roles(symbol, rule_type)`. A sanitizer prefix beats a sink prefix; source is independent.
    """
    base = nodes.drop("is_known_sink", "is_known_source", "is_known_sanitizer")
    table = roles.select("symbol", "rule_type")
    if ignore_case:
        base = base.withColumn("_key", F.lower(symbol))
        table = table.withColumn("symbol", F.lower("symbol"))
    else:
        base = base.withColumn("_key", F.col(symbol))
    hits = prefix_matches(base, table, "_key")
    flag = lambda t: F.max((F.col("rule_type") == t).cast("int"))
    per = hits.groupBy("_symbol").agg(
        flag("sink").alias("_snk"), flag("source").alias("_src"), flag("sanitizer").alias("_san")
    )
    # written, so that Spark knows how few symbols meet a rule and needn't move the nodes to them
    out = base.join(checkpoint(per.withColumnRenamed("_symbol", "_key")), "_key", "left")
    yes = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return out.select(
        *[c for c in base.columns if c != "_key"],
        (yes("_snk") & ~yes("_san")).alias("is_known_sink"),
        yes("_src").alias("is_known_source"),
        yes("_san").alias("is_known_sanitizer"),
    )


def sink_by_hierarchy(nodes: DataFrame, type_parents: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes whose type, an ancestor or interface of it, or ancestor + method name, starts with a
    sink prefix. `nodes(resolved_type, method_name, …)`, `type_parents(child, parent)`."""
    used = nodes.select("resolved_type", "method_name").where(F.col("resolved_type").isNotNull()).distinct()
    types = used.select(F.col("resolved_type").alias("node")).distinct()
    up = closure(
        type_parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")),
        types.select(F.col("node").alias("seed"), "node"),
        [],
    )
    names = used.join(up, used.resolved_type == up.seed).select(
        "resolved_type", "method_name",
        F.explode(F.array(F.col("node"), F.concat_ws(".", "node", "method_name"))).alias("candidate"),
    )
    hits = prefix_matches(names, rules.where("rule_type = 'sink'").select("symbol"), "candidate")
    found = names.join(hits.select(F.col("_symbol").alias("candidate")).distinct(), "candidate", "left_semi")
    return nodes.join(found.select("resolved_type", "method_name").distinct(), ["resolved_type", "method_name"], "left_semi")


def contains_first(df: DataFrame, rules: DataFrame, cols: list[str], text: str, needle: str = "symbol") -> DataFrame:
    """Add `cols` of the rule with the smallest ordinal that occurs anywhere in the text.

    Distinct texts are cut at every position into pieces as long as some rule, and the pieces meet
    the rules by equality.
    """
    lengths = [r[0] for r in rules.select(F.length(needle)).where(F.length(needle) > 0).distinct().orderBy(1).collect()]
    found = df.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    pieces = found.withColumn("_n", F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("_text"))))
    pieces = pieces.select(
        "_text", F.explode(F.expr("transform(sequence(1, length(_text) - _n + 1), i -> substring(_text, i, _n))")).alias("_piece")
    ).distinct()
    hits = pieces.join(rules.select(F.col(needle).alias("_piece"), "ordinal", *cols), "_piece")
    picked = hits.groupBy("_text").agg(F.min_by(F.struct(*cols), "ordinal").alias("_r"))
    out = df.join(picked.withColumnRenamed("_text", text), text, "left")
    return out.select(*[F.col(c) for c in df.columns], *[F.col(f"_r.{c}").alias(c) for c in cols])
