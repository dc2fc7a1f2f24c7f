"""Neyman-allocated review samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Strata and their least probabilities.
BINS = {"A": 0.99, "B": 0.95, "C": 0.90, "D": 0.75, "E": 0.50, "F": 0.25, "G": 0.10, "H": 0.00}


def stratum_of(p: Column) -> Column:
    """The stratum of a probability; what lies outside 0 to 1 goes to the last."""
    out = None
    for name, least in BINS.items():
        hit = (p >= least) & (p < 1.01)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("H")


def probability_of(probability: Column, score: Column) -> Column:
    """The probability, or else the score between 0 and 1, or else 0."""
    return F.coalesce(probability, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), F.lit(0.0))


def allocation(sizes: dict[str, tuple[int, float]], target: int = 500, floor: int = 35) -> dict[str, int]:
    """Rows to draw from each stratum, from its (rows, mean probability)."""
    if sum(n for n, _ in sizes.values()) <= target:
        return {k: n for k, (n, _) in sizes.items()}
    names = sorted(sizes)
    weight = {}
    for k in names:
        p = min(0.99, max(0.01, sizes[k][1]))
        weight[k] = sizes[k][0] * math.sqrt(p * (1 - p))
    least = {k: min(sizes[k][0], floor) for k in names}
    out, budget = dict(least), target - sum(least.values())
    whole = sum(weight.values())
    if budget <= 0 or not whole:
        return out
    for k in names:
        if sizes[k][0] > out[k]:
            out[k] += min(sizes[k][0] - out[k], math.floor(budget * weight[k] / whole + 0.5))
    # What rounding left goes around the strata that still have rows, heaviest first, one row at a time.
    turn = sorted((k for k in names if out[k] < sizes[k][0]), key=lambda k: -weight[k])
    short = target - sum(out.values())
    for i in range(abs(short) if turn else 0):
        k = turn[i % len(turn)]
        if short > 0 and out[k] < sizes[k][0]:
            out[k] += 1
        elif short < 0 and out[k] > least[k]:
            out[k] -= 1
    return out


def strata(scored: DataFrame, p: str = "probability") -> DataFrame:
    """stratum, n, pbar, weight."""
    g = scored.groupBy(stratum_of(F.col(p)).alias("stratum")).agg(F.count("*").alias("n"), F.avg(p).alias("mean"))
    pbar = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("mean")))
    return g.select("stratum", "n", pbar.alias("pbar"), (F.col("n") * F.sqrt(pbar * (1 - pbar))).alias("weight"))


def neyman_sample(scored: DataFrame, key: str, p: str = "probability", target: int = 500, floor: int = 35, seed: int = 0) -> DataFrame:
    """A stratified sample; which rows of a stratum are drawn follows from a seeded hash of their key.

    The bound of each stratum is a filter on a rank that Spark keeps by partial top lists, so no stratum is sorted whole.
    """
    s = scored.withColumn("stratum", stratum_of(F.col(p)))
    take = allocation({r["stratum"]: (r["n"], r["pbar"]) for r in strata(scored, p).collect()}, target, floor)
    if not take:
        return s.limit(0)
    n = F.create_map(*[F.lit(x) for kv in take.items() for x in kv])[F.col("stratum")]
    order = Window.partitionBy("stratum").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return s.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(take.values())).where(F.col("r") <= n).drop("r")
