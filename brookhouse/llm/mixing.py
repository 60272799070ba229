"""Mixing sources to target weights: temperature and budgeted block permutations, DataFrame functions only.

The share p of a source is its part of all tokens (words). The target weight is p^a / sum(p^a).
The exponent a is found by bisection between 0 (all sources alike) and 1 (as they are): the largest
a at which the entropy of the weights reaches `target_entropy` of its maximum, but no smaller than
the smallest a at which no source would be repeated more than `max_repeats` times.

The weights are realised over `budget` tokens (the corpus size by default). A source gets
floor(weight * budget) tokens: as many whole epochs as fit and a part of one more. An epoch is a
permutation of blocks of documents, and of the documents in a block, by hash. The part of an epoch
takes whole blocks in the order of the permutation and, in the block where the budget ends, whole
documents as long as they fit. So a source misses its budget by less than one document.

Nothing but counts is shuffled: which documents are taken is a function of three numbers per source.
A source that holds most rows is spread over its blocks, and only the block in which its
budget ends is ordered document by document.

Defined results: a null source is a source of its own; null, empty and word-less texts hold no
tokens and are never drawn; equal rows have equal hashes and are taken or left together;
an empty table, or one without any word, gives an empty result; other columns, `copies` aside,
come back untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import WORD, let, stored

STEPS = 60
OWN = "__mix"


def hashed(*parts: Column) -> Column:
    """60 bits of the md5 of the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _weights(shares: Column, exponent: Column) -> Column:
    return let(F.transform(shares, lambda p: F.pow(p, exponent)), lambda q: let(_total(q), lambda z: F.transform(q, lambda x: x / z)))


def _bisect(good: callable, low_when: str) -> Column:
    """STEPS halvings of [0, 1]; `low_when` names the end that moves to the middle when the middle is good."""
    def step(acc: Column, _: Column) -> Column:
        def halve(mid: Column) -> Column:
            moves = good(mid) if low_when == "good" else ~good(mid)
            return F.struct(
                F.when(moves, mid).otherwise(acc["lo"]).alias("lo"), F.when(moves, acc["hi"]).otherwise(mid).alias("hi"),
            )
        return let((acc["lo"] + acc["hi"]) / 2, halve)

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return end["lo"] if low_when == "good" else end["hi"]


def exponent(shares: Column, ratio: Column, target_entropy: float, max_repeats: float) -> Column:
    """The exponent for an array of positive shares; `ratio` is budget over corpus tokens."""
    def entropy(a: Column) -> Column:
        return _total(F.transform(_weights(shares, a), lambda w: F.when(w > 0, -w * F.ln(w)).otherwise(0.0)))

    def most_repeats(a: Column) -> Column:
        return F.array_max(F.zip_with(_weights(shares, a), shares, lambda w, p: w * ratio / p))

    def mixed(a: Column) -> Column:
        even = entropy(a) >= F.lit(target_entropy) * F.ln(F.size(shares).cast("double"))
        return even

    by_entropy = F.when(mixed(F.lit(1.0)), 1.0).otherwise(_bisect(mixed, "good"))
    in_limit = lambda a: most_repeats(a) <= F.lit(float(max_repeats))
    by_repeats = F.when(in_limit(F.lit(0.0)), 0.0).otherwise(_bisect(in_limit, "bad"))
    return F.greatest(by_entropy, by_repeats)


def mix(
    documents: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id",
    target_entropy: float = 0.97, max_repeats: float = 4.0, budget: int | None = None, n_blocks: int = 256, seed: int = 7,
) -> DataFrame:
    """One row per drawn copy: the columns of `documents` and a struct column `mix`.

    `mix` holds n_tokens, weight, epoch (0, 1, ...), block_order and doc_order: reading a source by
    (epoch, block_order, doc_order) gives its permutations.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    body = F.coalesce(F.col(text), F.lit(""))
    key = hashed(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(body.cast("binary")))
    keyed = documents.select(
        F.struct("*").alias("row"), name.alias("s"), key.alias("h"), F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("n"),
    ).withColumn("b", F.col("h") % n_blocks)
    counts = stored(keyed.select("s", "b", "h", "n"), "mix")

    blocks = counts.groupBy("s", "b").agg(F.sum("n").alias("n"))
    sources = blocks.groupBy("s").agg(F.sum("n").alias("tokens")).filter("tokens > 0")
    # One row with one entry per source, in the order of the names.
    whole = sources.agg(F.sort_array(F.collect_list(F.struct("s", "tokens"))).alias("all"), F.sum("tokens").alias("corpus"))
    whole = whole.select("all", "corpus", F.coalesce(F.lit(budget).cast("bigint"), F.col("corpus")).alias("budget"))
    whole = whole.withColumn("p", F.transform("all", lambda x: x["tokens"] / F.col("corpus")))
    whole = whole.withColumn(
        "a", exponent(F.col("p"), F.col("budget") / F.col("corpus"), target_entropy, max_repeats))
    plan = whole.withColumn("w", _weights(F.col("p"), F.col("a"))).select(
        "budget", F.explode(F.arrays_zip("all", "w")).alias("x"),
    ).select(
        F.col("x.all.s").alias("s"), F.col("x.all.tokens").alias("tokens"), F.col("x.w").alias("weight"),
        F.floor(F.col("x.w") * F.col("budget")).alias("take"),
    )
    plan = plan.select(
        "s", "weight", F.floor(F.col("take") / F.col("tokens")).cast("bigint").alias("epochs"), (F.col("take") % F.col("tokens")).alias("rest"))

    # The part of an epoch: the blocks that fit whole, then the documents of the next one that fit.
    order = hashed(F.lit(seed), F.col("epochs"), F.col("s"), F.col("b"))
    ranked = blocks.join(plan, "s").withColumn("o", order).withColumn("upto", F.sum("n").over(W.partitionBy("s").orderBy("o", "b")))
    # Blocks tie on `o` only where hashes collide; `b` then decides, here and below.
    cut = ranked.filter("upto > rest").groupBy("s").agg(F.min(F.struct("o", "b", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("c"))
    cut = cut.select("s", F.col("c.o").alias("cut_o"), F.col("c.b").alias("cut_b"), F.col("c.left").alias("left"))
    last = counts.join(cut.withColumnRenamed("cut_b", "b"), ["s", "b"])
    last = last.withColumn("upto", F.sum("n").over(W.partitionBy("s", "b").orderBy("h").rangeBetween(W.unboundedPreceding, 0)))
    last = last.filter("upto <= left").groupBy("s").agg(F.max("h").alias("cut_h"))
    plan = stored(plan.join(cut.drop("left"), "s", "left").join(last, "s", "left"), "mixplan")

    drawn = keyed.filter("n > 0").join(plan, "s").withColumn("o", order)
    in_part = (
        (F.col("o") < F.col("cut_o")) | ((F.col("o") == F.col("cut_o")) & (F.col("b") < F.col("cut_b")))
        | ((F.col("b") == F.col("cut_b")) & (F.col("h") <= F.coalesce("cut_h", F.lit(-1))))
    )
    copies = F.col("epochs") + F.when(in_part, 1).otherwise(0)
    drawn = drawn.withColumn("copies", copies).filter("copies > 0")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return drawn.select(
        *[F.col("row")[c].alias(c) for c in documents.columns if c != "mix"],
        F.struct(
            F.col("n").alias("n_tokens"), "weight", "epoch",
            hashed(F.lit(seed), F.col("epoch"), F.col("s"), F.col("b")).alias("block_order"), F.col("h").alias("doc_order"),
        ).alias("mix"),
    )


