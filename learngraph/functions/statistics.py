"""Summary statistics, histograms and agreement between raters.

Ranks and percentiles come from the counts of distinct scores, so no window ever sees one row per
rating: what a single task holds is bounded by the number of distinct values of a rater.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from learngraph.shared import written


def numeric_stats(df: DataFrame, metrics: list[str], digits: int = 3) -> DataFrame:
    """metric, n, mean, std (sample; 0 for one value), min and max of each metric's non-null values; nulls where there are none or no such column."""
    present = [m for m in metrics if m in df.columns]
    absent = [m for m in metrics if m not in df.columns]
    wide = df.select([F.col(m).cast("double").alias(m) for m in present] + [F.lit(None).cast("double").alias(m) for m in absent])
    aggs = [F.struct(F.lit(m).alias("metric"), F.count(m).alias("n"), F.avg(m).alias("mean"), F.when(F.count(m) == 1, 0.0).otherwise(F.stddev_samp(m)).alias("std"), F.min(m).alias("min"), F.max(m).alias("max")) for m in metrics]
    rows = wide.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return rows.select("metric", "n", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "max")])


def boolean_rates(df: DataFrame, flags: list[str], digits: int = 3) -> DataFrame:
    """flag, count of yes, total (missing ones too) and rate; null rate for no rows."""
    aggs = [F.struct(F.lit(f).alias("flag"), F.count_if(F.col(f) == "yes").alias("n_yes"), F.count(F.lit(1)).alias("total")) for f in flags]
    rows = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return rows.withColumn("rate", F.round(F.when(F.col("total") > 0, F.col("n_yes") / F.col("total")), digits))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 1), lower edge and count of every equal bin, empty ones too; the last bin is closed, values outside count nowhere."""
    x = F.col(column).cast("double")
    b = F.when(x == high, bins).otherwise(F.expr(f"width_bucket(cast(`{column}` as double), {low}D, {high}D, {bins})"))
    counted = df.select(b.cast("int").alias("bin")).where(F.col("bin").between(1, bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = edges.join(F.broadcast(counted), "bin", "left")
    return out.select("bin", F.round(F.lit(low) + (F.col("bin") - 1) * ((high - low) / bins), 6).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def range_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``histogram`` between the least and the greatest value; half a unit to either side of a single value, no bin for no value."""
    ends = df.agg(F.min(F.col(column).cast("double")).alias("low"), F.max(F.col(column).cast("double")).alias("high")).first()
    if ends["low"] is None:
        return histogram(df, column, 0.0, 1.0, bins).limit(0)
    spread = 0.0 if ends["high"] > ends["low"] else 0.5
    return histogram(df, column, ends["low"] - spread, ends["high"] + spread, bins)


def five_numbers(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact quartiles, the extremes and the whiskers (the furthest values within 1.5 interquartile ranges) by group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("v", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]), F.col("n"))
    quart = counts.groupBy(group).agg(q.alias("q"))
    names = ["min", "q1", "median", "q3", "max"]
    quart = quart.select(group, *[F.col("q")[k].alias(n) for k, n in enumerate(names)])
    span = 1.5 * (F.col("q3") - F.col("q1"))
    inside = counts.join(quart, group).where(F.col("v").between(F.col("q1") - span, F.col("q3") + span))
    whiskers = inside.groupBy(group).agg(F.min("v").alias("low_whisker"), F.max("v").alias("high_whisker"))
    return quart.join(whiskers, group)


def rater_pairs(ratings: DataFrame, item: str = "item", model: str = "model", score: str = "score") -> DataFrame:
    """m1 < m2, a, b and the number of items n with these two scores; items that either left unrated count for neither.

    Equal ratings of an item by one rater are counted before items are put together, and pairs are made inside
    an item's own array: an item rated very often still is one entry per rater and score.
    """
    known = ratings.where(F.col(score).isNotNull() & F.col(item).isNotNull())
    counted = known.groupBy(item, F.col(model).alias("m"), F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("m", "s", "n"))).alias("r"))
    first = per.select("r", F.posexplode("r").alias("i", "x"))
    both = first.select("x", F.explode(F.expr("slice(r, i + 2, size(r))")).alias("y")).where("x.m != y.m")
    return both.groupBy(F.col("x.m").alias("m1"), F.col("y.m").alias("m2"), F.col("x.s").alias("a"), F.col("y.s").alias("b")).agg(F.sum(F.expr("x.n * y.n")).alias("n"))


def _marginals(pairs: DataFrame) -> DataFrame:
    """m1, m2, label and its counts na and nb on either side."""
    ends = pairs.select("m1", "m2", F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("e"))
    return ends.groupBy("m1", "m2", "e.label").agg(F.sum("e.na").cast("double").alias("na"), F.sum("e.nb").cast("double").alias("nb"))


def cohens_kappa(ratings: DataFrame, weighted: bool = False) -> DataFrame:
    """m1, m2, n and kappa by pair of raters; with quadratic weights on the labels' indexes if ``weighted``. Null where chance agreement is whole.

    The counts of score pairs are written once. What chance would have them differ by follows from sums over labels, since
    sum na nb [a != b] = n^2 - sum na nb and sum na nb (a - b)^2 = n (sum na a^2 + sum nb b^2) - 2 (sum na a) (sum nb b): labels never meet labels.
    """
    pairs = written(rater_pairs(ratings), "score-pairs")
    labels = _marginals(pairs)
    if weighted:
        labels = labels.withColumn("k", (F.row_number().over(Window.partitionBy("m1", "m2").orderBy("label")) - 1).cast("double"))
        index = lambda side: labels.select("m1", "m2", F.col("label").alias(side), F.col("k").alias(f"k{side}"))
        seen = pairs.join(index("a"), ["m1", "m2", "a"]).join(index("b"), ["m1", "m2", "b"])
        gap = F.pow(F.col("ka") - F.col("kb"), 2)
        chance = F.sum("na") * F.sum((F.col("na") + F.col("nb")) * F.pow("k", 2)) - 2 * F.sum(F.col("na") * F.col("k")) * F.sum(F.col("nb") * F.col("k"))
    else:
        seen, gap = pairs, (F.col("a") != F.col("b")).cast("double")
        chance = F.sum("na") * F.sum("nb") - F.sum(F.col("na") * F.col("nb"))
    observed = seen.groupBy("m1", "m2").agg(F.sum("n").alias("n"), F.sum(F.col("n") * gap).alias("observed"))
    both = observed.join(labels.groupBy("m1", "m2").agg(chance.alias("expected")), ["m1", "m2"])
    return both.select("m1", "m2", "n", F.when(F.col("expected") > 0, 1 - F.col("observed") * F.col("n") / F.col("expected")).alias("kappa"))


def _average_ranks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n and r: the average rank of rows that tie at a value, from the counts n of distinct values."""
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("r", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)


def spearman(ratings: DataFrame) -> DataFrame:
    """m1, m2, n, rho and p (two-sided, by the t distribution) of average ranks; rho null for a constant rater or fewer than two items."""
    pairs = written(rater_pairs(ratings), "score-pairs")
    ranks = [_average_ranks(pairs.groupBy("m1", "m2", s).agg(F.sum("n").alias("n")), ["m1", "m2"], s).select("m1", "m2", s, F.col("r").alias(f"r{s}")) for s in "ab"]
    seen = pairs.join(ranks[0], ["m1", "m2", "a"]).join(ranks[1], ["m1", "m2", "b"])
    w, x, y = F.col("n"), F.col("ra"), F.col("rb")
    sums = seen.groupBy("m1", "m2").agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    n = F.col("n")
    vx, vy = F.col("sxx") - F.pow("sx", 2) / n, F.col("syy") - F.pow("sy", 2) / n
    rho = F.when((vx > 0) & (vy > 0), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    return sums.select("m1", "m2", "n", rho.alias("rho")).withColumn("p", _t_two_sided(F.col("rho"), F.col("n")))


EXACT = 50  # pairs at most for the exact distribution


def wilcoxon(ratings: DataFrame) -> DataFrame:
    """m1, m2, n (pairs that differ), w = the lesser signed rank sum, and p (two-sided); zero differences are dropped, p null where none is left.

    p is exact for ``EXACT`` pairs at most of which none are equal and no two differ by the same, else by the normal approximation with ties.
    """
    gaps = rater_pairs(ratings).select("m1", "m2", (F.col("a") - F.col("b")).alias("d"), "n")
    sized = gaps.groupBy("m1", "m2", F.abs("d").alias("size")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("up"))
    sized = written(sized, "gaps")
    equal = sized.where("size = 0").select("m1", "m2", F.lit(True).alias("equal"))
    ranked = _average_ranks(sized.where("size != 0"), ["m1", "m2"], "size")
    sums = ranked.groupBy("m1", "m2").agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("up")).alias("plus"), F.sum(F.col("r") * (F.col("n") - F.col("up"))).alias("minus"), F.sum(F.pow("n", 3) - F.col("n")).alias("ties"))
    sums = sums.join(equal, ["m1", "m2"], "left")
    n, w = F.col("n").cast("double"), F.least("plus", "minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (w - n * (n + 1) / 4) / F.sqrt(var)
    exact = (F.col("n") <= EXACT) & (F.col("ties") == 0) & F.col("equal").isNull()
    p = F.when(exact, _signed_rank_two_sided(F.col("n"), w)).when(var > 0, _normal_two_sided(z))
    return sums.select("m1", "m2", "n", w.alias("w"), p.alias("p"))


def signed_rank_counts(n: int) -> list[int]:
    """How many of the 2^n choices of signs give each sum of positive ranks 1 to n."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(counts) - 1, rank - 1, -1):
            counts[s] += counts[s - rank]
    return counts


@F.udf(DoubleType())
def _signed_rank_two_sided(n, w):
    """One row a pair of raters."""
    if n is None or w is None or not 0 < n <= EXACT:
        return None
    return min(1.0, 2 * sum(signed_rank_counts(n)[: int(w) + 1]) / 2**n)


@F.udf(DoubleType())
def _normal_two_sided(z):
    """One row a pair of raters."""
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


@F.udf(DoubleType())
def _t_two_sided(rho, n):
    """One row a pair of raters: the incomplete beta function by its continued fraction."""
    if rho is None or n is None or n < 3:
        return None
    if abs(rho) >= 1 - 1e-15:
        return 0.0
    df = n - 2
    x = 1 - rho * rho  # df / (df + t^2)
    a, b = df / 2, 0.5

    def fraction(a, b, x):
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + top / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-13:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def agreement_by_model(evaluations: DataFrame, flags: list[str], plausibility: str | None = None) -> DataFrame:
    """model, evaluations, share of yes per flag (missing ones count against it) and the mean and number of a nullable score."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")] + [(F.count_if(F.col(f) == "yes") / F.count(F.lit(1))).alias(f"{f}_rate") for f in flags]
    if plausibility:
        aggs += [F.avg(plausibility).alias(f"{plausibility}_mean"), F.count(plausibility).alias(f"{plausibility}_n")]
    return evaluations.groupBy("model").agg(*aggs)
