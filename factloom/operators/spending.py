"""Spending a token budget in order of promise, without ordering all pairs in one place and without a job per batch of calls.

Pairs are dealt to ranges of (promise downwards, ids). Each range's estimated tokens are summed, a running sum over the ranges
(one number each) gives their offsets, and a window within each range gives every pair the estimate of all that
come before it. That table is written once. A turn then calls, in all tasks at once, the pairs whose
running estimate lies within what is left; what the calls really cost is summed, estimates are corrected by the greatest
ratio of cost to estimate seen so far, and the next turn goes on where the last one ended. Where estimates are not too low, a pair is
called exactly if the calls before it have not used up the budget, so the last call may overshoot it. A later call that costs
more, for its estimate, than any before can overshoot it further, by that excess.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import estimate_tokens
from factloom.operators.seams import Classifier, classify_pairs
from factloom.sources.scratch import stored

# Fixed value: tokens that an answer may have.
ANSWER_TOKENS = 1200


def _order() -> list:
    return [F.col("promise").desc(), F.col("claim_a_id"), F.col("claim_b_id")]


def with_running_estimates(pairs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Stored pairs with `estimate` (given, or by their prompts) and `before`, the estimates of all pairs that come first."""
    n = ranges or max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if "estimate" not in pairs.columns:
        pairs = pairs.withColumn("estimate", estimate_tokens("prompt") + ANSWER_TOKENS)
    dealt = pairs.select("claim_a_id", "claim_b_id", "prompt", "promise", F.greatest(F.col("estimate").cast("long"), F.lit(1)).alias("estimate"))
    dealt = stored(dealt.repartitionByRange(n, *_order()).withColumn("range", F.spark_partition_id()), "spending-ranges")
    sums = dealt.groupBy("range").agg(F.sum("estimate").alias("of_range"))  # a row a range
    offsets = sums.withColumn("offset", F.sum("of_range").over(Window.orderBy("range")) - F.col("of_range")).drop("of_range")
    inside = F.sum("estimate").over(Window.partitionBy("range").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1))
    return stored(dealt.join(F.broadcast(offsets), "range").withColumn("before", F.col("offset") + F.coalesce(inside, F.lit(0))).drop("offset"), "spending")


def spend(pairs: DataFrame, classifier: Classifier, budget: int, ranges: int | None = None) -> DataFrame:
    """Verdicts of the pairs (claim_a_id, claim_b_id, prompt, promise[, estimate]) that the budget reaches, in order of promise."""
    line = with_running_estimates(pairs, ranges)
    spent, ratio, low, made = 0, Fraction(1), 0, []
    while spent < budget:
        base = line.where(F.col("before") >= low).agg(F.min("before")).first()[0]
        if base is None:
            break
        within = F.lit(True) if ratio == 0 else F.col("before") < min(base + ceil((budget - spent) / ratio), 2**62)
        mine = line.where((F.col("before") >= base) & within)
        done = stored(classify_pairs(mine, classifier).join(mine.select("claim_a_id", "claim_b_id", "estimate", "before"), ["claim_a_id", "claim_b_id"]), "spending-turn")
        made.append(done)
        cost = F.col("prompt_tokens").cast("long") + F.col("completion_tokens")
        seen = done.agg(F.sum(cost).alias("cost"), F.max(cost / F.col("estimate")).alias("ratio"), F.max("before").alias("last")).first()
        spent, low = spent + seen["cost"], seen["last"] + 1
        top = Fraction(seen["ratio"]).limit_denominator(10**6)
        ratio = top if len(made) == 1 else max(ratio, top)
    if not made:
        return classify_pairs(line.limit(0), classifier)
    return reduce(DataFrame.unionByName, made).drop("estimate", "before")
