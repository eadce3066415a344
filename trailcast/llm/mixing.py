"""Mixing sources to target weights: tempered token shares, realised as budgeted block permutations.

DataFrame operations only. The exponent is found on the table of sources by repeated section; a
block is one pass over a source in an own random order, and the last block of a source ends where
its token budget does. Documents are not shuffled: a hash bucket of the order decides for all but
the bucket in which the budget ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailcast.llm import common

#: Exponents tried at once; each round keeps one of the GRID intervals.
GRID = 64
ROUNDS = 5
#: Leading hex digits of the order key: 16**3 buckets for each source.
DIGITS = 3
#: Sources whose plan may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    """Either the entropy (nats) of the weights or the most often that a source's tokens may repeat."""

    entropy: float | None = None
    max_repeats: float | None = None
    budget: int | None = None  # tokens of the mixture; None: all tokens of the input
    seed: int = 1


def words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, common.SPACE))).otherwise(0).cast("long")


def order_key(seed: int, block: Column, doc_id: Column, digest: Column) -> Column:
    """Hex key that orders a block: 32 digits from seed, block, id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")),
                             digest))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def exponent(sources: DataFrame, target: Target, budget: int) -> float:
    """Exponent in [0, 8] that meets the target, from (tokens) of each source.

    The entropy of the weights falls with the exponent and so do the repeats of small sources;
    the result is the smallest exponent on the grid that does not exceed the target (0 if all
    meet it, the largest if none does).
    """
    if (target.entropy is None) == (target.max_repeats is None):
        raise ValueError("give either an entropy or a limit of repeats")
    low, high = 0.0, 8.0 if target.entropy is not None else 1.0
    share = F.col("tokens") / F.col("total")
    for _ in range(ROUNDS):
        step = (high - low) / GRID
        grid = sources.where("tokens > 0").select(
            share.alias("p"), "tokens",
            F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("k"))
        a = F.lit(low) + F.col("k") * F.lit(step)
        powered = F.pow("p", a)
        sums = grid.groupBy("k").agg(
            F.sum(powered).alias("z"), F.sum(powered * a * F.log("p")).alias("u"),
            F.max(F.log(powered / F.col("tokens"))).alias("r"))
        found = sums.select(
            "k", (F.log("z") - F.col("u") / F.col("z")).alias("entropy"),
            (F.exp("r") / F.col("z") * F.lit(float(budget))).alias("repeats")).collect()
        met = [row["k"] for row in found
               if (row["entropy"] <= target.entropy if target.entropy is not None
                   else row["repeats"] <= target.max_repeats * (1 + 1e-12))]
        if not found or (met and min(met) == 0):
            return low
        k = min(met, default=GRID)
        low, high = low + (k - 1) * step, low + k * step
    return high


def source_plan(narrow: DataFrame, target: Target) -> DataFrame:
    """source, weight, quota, passes (whole blocks), rest (tokens of the last block), from (source, n, bucket key)."""
    totals = narrow.groupBy("source").agg(F.sum("n").alias("tokens"))
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    sources = common.write_table(totals.crossJoin(F.broadcast(total)))
    first = sources.select("total").first()
    everything = first["total"] if first else 0
    budget = everything if target.budget is None else target.budget
    power = exponent(sources, target, budget)
    tempered = sources.withColumn("powered", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.lit(power)))
                                  .otherwise(0.0))
    norm = tempered.agg(F.sum("powered").alias("z"))
    weight = F.when(F.col("z") > 0, F.round(F.col("powered") / F.col("z"), 9)).otherwise(0.0)
    quota = F.floor(F.col("weight") * F.lit(float(budget))).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("long")
    return (tempered.crossJoin(F.broadcast(norm)).withColumn("weight", weight).withColumn("quota", quota)
            .withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))
            .select("source", "tokens", "weight", "quota", "passes", "rest"))


def mix(docs: DataFrame, target: Target) -> DataFrame:
    """The mixture: the rows of docs once for each block that takes them, with block, order_key and n_tokens.

    Sorting by (block, order_key) gives the realised order. Tokens are words of ``text``. In the
    last block of a source those documents are taken whose running number of tokens, in the order
    of the key, stays within the rest of its quota. Null sources are one source. Null and empty
    texts have no tokens and come with each whole block; a source without tokens gets no weight and
    comes once. Rows with equal id and text are interchangeable. Input columns called block,
    order_key, n_tokens are replaced. Memory: one bucket of a source at a time is summed in order.
    """
    keep = [c for c in docs.columns if c not in ("block", "order_key", "n_tokens")]
    rows = docs.select(F.struct(*keep).alias("_in"), F.col("source").alias("_source"),
                       text_digest(F.col("text")).alias("_digest"))
    narrow = common.write_table(docs.select(
        "source", "doc_id", words(F.col("text")).alias("n"), text_digest(F.col("text")).alias("digest")))
    plan = common.write_table(source_plan(narrow, target))
    few = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)

    keyed = narrow.alias("d").join(hint(plan.alias("p")), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.source", "n", "rest", order_key(target.seed, F.col("passes"), F.col("doc_id"), F.col("digest")).alias("key"))
    buckets = keyed.groupBy("source", F.substring("key", 1, DIGITS).alias("bucket")).agg(
        F.sum("n").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    # The first bucket that does not fit as a whole; "g" lies behind all hex digits.
    ends = buckets.withColumn("upto", upto).groupBy("source").agg(
        F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))), F.lit("g")).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"))
    full = common.write_table(plan.alias("p").join(ends.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source"))).select(
        F.col("p.source").alias("source"), "passes", "rest", "edge", "before"))

    joined = rows.join(hint(full), F.col("_source").eqNullSafe(F.col("source"))).withColumn(
        "_key", order_key(target.seed, F.col("passes"), F.col("_in.doc_id"), F.col("_digest")))
    bucket = F.substring("_key", 1, DIGITS)
    clear = joined.where(bucket != F.col("edge")).withColumn("_last", (bucket < F.col("edge")).cast("long"))
    running = F.sum(words(F.col("_in.text"))).over(
        Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    edge = joined.where(bucket == F.col("edge")).withColumn(
        "_last", (F.col("before") + running <= F.col("rest")).cast("long"))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("passes") + F.col("_last") - 1)
    taken = clear.unionByName(edge).where(F.col("passes") + F.col("_last") > 0)
    taken = taken.withColumn("block", F.explode(blocks))
    return taken.select(
        "_in.*", "block",
        order_key(target.seed, F.col("block"), F.col("_in.doc_id"), F.col("_digest")).alias("order_key"),
        words(F.col("_in.text")).alias("n_tokens"))
