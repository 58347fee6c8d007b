"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (what line feeds part). A paragraph is hashed to a wide vector; a text's
fingerprint is the sum of its paragraphs' vectors modulo powers of two. So it does not depend on their order, equal multisets have
equal fingerprints, and putting in or taking out a paragraph is an addition or subtraction (`plus`, `minus`) that
leaves the rest of the text unread. A paragraph's vector has three parts:

* NAME_WORDS lanes modulo 2 ** 32, uniform, drawn by XXH64 from the paragraph's SHA-256: for equality;
* the number of its pieces (its text parted where blanks follow a mark);
* SIGN_WORDS x 2 lanes modulo 2 ** 32, the sum of one random bit per piece and lane: for likeness. Twice a lane less the number is
  a sum of random signs, so the mean square of the difference of two texts' lanes estimates how many pieces (weighed by
  their repeats squared) the two don't share, and likeness is 1 less its share in both texts' own, 0 to 1.

A text holds fewer than 2 ** 31 pieces, so neither kind of sum leaves its long before it is reduced. The estimate has
a standard error of about 0.04 near a likeness of 0.75.

DataFrame functions only. Texts are dealt once, by (doc_id, MD5), which no group shares; paragraphs and pieces are exploded
there and summed by hash aggregates without another shuffle. For the edited text only the paragraphs from the edit on are
read: their vectors go in with sign -1 and +1. Only the beginning of the next text and its vector are sent. Ranks come from narrow rows.

Defined cases: null text is empty, and the empty text has one empty paragraph; documents ascend by doc_id, null first, rows of equal doc_id by the
MD5 of their text, and rows equal in both are one document with equal results; with one document the next is itself; a very
long text is exploded like any other; an empty table gives no rows; other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintgrid.session import checkpoint, ranked

NAME_WORDS = 16
SIGN_WORDS = 64  # 32 of each of two hashes a piece
_LOW = (1 << 32) - 1
_PAIR = 1 | 1 << 32
_PIECE = r"(?<=[^\p{L}\p{N}\s])\s+"  # blanks after anything but letters, digits and blanks


def vectors(rows: DataFrame, keys: list[str], text: str, sign: str | None = None) -> DataFrame:
    """keys and the sum v of the vectors of all paragraphs of the text, over rows of equal keys; sign: a column of factors."""
    factor = [sign] if sign else []
    signed = (lambda x: x * F.col(sign)) if sign else (lambda x: x)
    paragraphs = rows.select(*keys, *factor, F.explode(F.split(text, "\n", -1)).alias("_p"))
    # two aggregates, since the code of one with all sums is too long for the JVM to compile
    names = [F.sum(signed(F.xxhash64("_name", F.lit(j)).bitwiseAND(F.lit(_LOW)))).alias(f"_w{j}") for j in range(NAME_WORDS)]
    named = paragraphs.select(*keys, *factor, F.sha2("_p", 256).alias("_name")).groupBy(*keys).agg(*names)
    pieces = paragraphs.select(*keys, *factor, F.explode(F.split("_p", _PIECE, -1)).alias("_s"))
    hashed = pieces.select(*keys, *factor, *[F.xxhash64("_s", F.lit(seed)).alias(f"_h{seed}") for seed in (0, 1)])
    number = F.sum(signed(F.lit(1).cast("bigint"))).alias("_n0")
    bits = [
        F.sum(signed(F.shiftrightunsigned(F.col(f"_h{seed}"), k).bitwiseAND(F.lit(_PAIR)))).alias(f"_s{seed}_{k}")
        for seed in (0, 1) for k in range(SIGN_WORDS // 2)]
    sums = named.join(hashed.groupBy(*keys).agg(number, *bits).hint("merge"), keys)
    every = [*[f"_w{j}" for j in range(NAME_WORDS)], "_n0", *[f"_s{seed}_{k}" for seed in (0, 1) for k in range(SIGN_WORDS // 2)]]
    return sums.select(*keys, _reduced(F.array(*every)).alias("v"))


def _reduced(v: Column) -> Column:
    return F.transform(v, lambda x, i: F.when(i < NAME_WORDS, x.bitwiseAND(F.lit(_LOW))).otherwise(x))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return _reduced(F.zip_with(a, b, lambda x, y: x + y))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a without b's paragraphs."""
    return _reduced(F.zip_with(a, b, lambda x, y: x - y))


def _signs(v: Column) -> Column:
    return F.slice(v, NAME_WORDS + 2, SIGN_WORDS)


def _squares(words: Column, n: Column) -> Column:
    """Sum over the two lanes of each word of the square of twice the lane less n."""
    def add(acc: Column, w: Column) -> Column:
        low = F.shiftright(F.shiftleft(w, 32), 32)
        one = 2 * low - n
        two = 2 * F.shiftright(w - low, 32) - n
        return acc + one.cast("double") * one + two.cast("double") * two

    return F.aggregate(words, F.lit(0.0), add)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the estimated product of two texts' counts of pieces over the sum of their squares."""
    n = lambda v: F.get(v, F.lit(NAME_WORDS))
    both = _squares(_signs(a), n(a)) + _squares(_signs(b), n(b))
    apart = _squares(F.zip_with(_signs(a), _signs(b), lambda x, y: x - y), n(a) - n(b))
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / both))


def written(v: Column) -> Column:
    """A fingerprint as text: its words in hexadecimal."""
    return F.array_join(F.transform(v, lambda x: F.hex(x)), ".")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    key = ["_k", "_h"]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("_d"), F.md5(text).alias("_h"), text.alias("_t"))
    narrow = base.select("_d", "_h", F.char_length("_t").alias("_n")).distinct()
    placed = checkpoint(ranked(narrow, [], [F.col("_d").asc_nulls_first(), F.col("_h")], "_r"))
    total = placed.agg(F.max("_r")).first()[0] or 0  # one number
    as_text = lambda d: F.coalesce(F.col(d).cast("string"), F.lit("null"))
    quarter = F.floor(F.col("_n") / 4).cast("int")
    follow = placed.select((F.col("_r") % max(total, 1) + 1).alias("_r"), as_text("_d").alias("_pk"), F.col("_h").alias("_ph"), quarter.alias("_take"))
    links = follow.join(placed.select("_r", as_text("_d").alias("_k"), "_h"), "_r").drop("_r")

    # rows of equal keys are one document; every join and aggregate below stays in the partitions of this exchange
    dealt = base.select(as_text("_d").alias("_k"), "_h", "_t").repartition(*key)
    copies = Window.partitionBy(*key).orderBy(F.lit(0))
    one = dealt.select(*key, "_t", F.row_number().over(copies).alias("_i"), F.count(F.lit(1)).over(copies.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_m")).where("_i = 1")
    own = vectors(one, key, "_t").repartition(*key)  # both uses share this exchange, so it is summed up once
    heads = one.join(links.hint("merge"), key).join(own.hint("merge"), key).select(
        F.col("_pk").alias("_k"), F.col("_ph").alias("_h"), F.substring("_t", F.lit(1), F.col("_take")).alias("_head"), F.col("v").alias("_next"))
    heads = heads.repartition(*key)
    both = one.join(heads.hint("merge"), key).withColumn("_n", F.char_length("_t"))
    both = both.withColumn("_keep", F.col("_n") - F.floor(F.col("_n") / 4).cast("int")).withColumn("_kept", F.substring("_t", F.lit(1), F.col("_keep")))
    # paragraphs that end within what is kept stay in the sum; the open one and the rest are exchanged
    both = both.withColumn("_open", F.substring_index("_kept", "\n", -1))
    old = F.struct(F.lit(-1).cast("bigint").alias("sign"), F.concat("_open", F.substring("_t", F.col("_keep") + 1, F.col("_n"))).alias("text"))
    new = F.struct(F.lit(1).cast("bigint").alias("sign"), F.concat("_open", "_head").alias("text"))
    tails = both.select(*key, F.explode(F.array(old, new)).alias("x")).select(*key, "x.sign", "x.text")
    change = vectors(tails, key, "text", "sign").withColumnRenamed("v", "_change")
    rows = both.select(*key, "_m", "_n", F.sha2(F.concat("_kept", "_head"), 256).alias("edited_sha256"), "_next").join(
        own.hint("merge"), key).join(change.hint("merge"), key).withColumn("_e", plus(F.col("v"), F.col("_change")))
    out = rows.select(
        F.when(F.col("_k") != "null", F.col("_k")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("_n").cast("bigint").alias("n_chars"), "edited_sha256",
        written(F.col("v")).alias("fingerprint"), written(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("_e")).alias("near_edited"), likeness(F.col("v"), F.col("_next")).alias("near_next"), "_m")
    return out.withColumn("_m", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m")))).drop("_m")
