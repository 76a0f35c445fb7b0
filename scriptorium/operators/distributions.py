"""Distributions of measures over a reference bank and where candidates stand in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import measures as M
from scriptorium.operators.metrics import ranges
from scriptorium.session import materialize


def exact_medians(rows: DataFrame, by: str, value: str = "value", margin: float = 0.001) -> DataFrame:
    """(by, median, n): exact medians of few groups of any size. Null and NaN values are left out.

    Approximate quantiles close to the middle bracket the median; what lies below is only counted, and what lies within, a five-hundredth of the rows or so, is sorted. Their error is a tenth of the margin, so
    the bracket always holds the median. No task ever holds a group.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(by, F.col(value).cast("double").alias("value"))
    q = F.percentile_approx("value", F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), F.lit(int(10 / margin)))
    bracket = rows.groupBy(by).agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    # the next smaller and larger values belong to the bracket too, for small groups
    marked = rows.join(F.broadcast(bracket), by)  # a row per group
    sides = marked.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("value") < F.col("q")[0], F.col("value"))), F.first(F.col("q")[0])).alias("lo"), F.coalesce(F.min(F.when(F.col("value") > F.col("q")[1], F.col("value"))), F.first(F.col("q")[1])).alias("hi"))
    marked = rows.join(F.broadcast(bracket.join(sides, by).select(by, "n", "lo", "hi")), by)
    below = marked.groupBy(by).agg(F.count_if(F.col("value") < F.col("lo")).alias("below"))
    inside = marked.where("value >= lo and value <= hi").groupBy(by, "n", "value").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(below), by)
    upto = F.col("below") + F.sum("c").over(W.partitionBy(by).orderBy("value"))
    inside = inside.select(by, "n", "value", (upto - F.col("c")).alias("first"), upto.alias("next"))
    at = lambda k: F.max(F.when((F.col("first") <= k) & (F.col("next") > k), F.col("value")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return inside.groupBy(by, "n").agg(((at(low) + at(high)) / 2).alias("median")).select(by, "median", "n")


def distribution(long: DataFrame) -> DataFrame:
    """(feature, median, std, mad, scale, n) of `long(feature, value)`: robust centre and scale of each measure.

    mad is 1.4826 times the median absolute deviation, scale the largest of mad, a quarter of the population deviation, a tenth of the median and 0.01. Null values are left out.
    `long` is read several times, so it should come from stored measures.
    """
    centre = materialize(exact_medians(long, "feature"))
    std = long.where("value is not null").groupBy("feature").agg(F.stddev_pop("value").alias("std"))
    off = long.join(F.broadcast(centre.select("feature", "median")), "feature").select("feature", F.abs(F.col("value") - F.col("median")).alias("value"))
    spread = exact_medians(off, "feature").select("feature", (1.4826 * F.col("median")).alias("mad"))
    scale = F.greatest(F.col("mad"), 0.25 * F.col("std"), F.greatest(0.1 * F.abs("median"), F.lit(0.01)))
    return centre.join(spread, "feature").join(std, "feature").select("feature", "median", "std", "mad", scale.alias("scale"), "n")


def deviations(long: DataFrame, dist: DataFrame) -> DataFrame:
    """`long(…, feature, value)` with robust_z and position (within, higher, lower); measures without a distribution are left out."""
    z = (F.col("value") - F.col("median")) / F.col("scale")
    joined = long.join(F.broadcast(dist.select("feature", "median", "scale")), "feature").withColumn("robust_z", z)
    return joined.withColumn("position", F.when(F.abs("robust_z") < 1, "within").when(F.col("value") > F.col("median"), "higher").otherwise("lower"))


def label_of(feature: Column) -> Column:
    """How a measure is called in print."""
    spoken = F.replace(F.replace(feature, F.lit("function_"), F.lit("Function word: ")), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spoken, 1, 1)), F.substring(spoken, 2, 200))


def described(long: DataFrame, history: DataFrame, dist: DataFrame) -> DataFrame:
    """`deviations` of `long(doc_id, feature, value)` with label, mean, std, percentile (share of the history below, ties counted half) and `varies`, whether the history has different values.

    The history's values are counted once per measure and value; a candidate looks its value up by a running sum over both.
    """
    counts = history.where("value is not null").groupBy("feature", F.round("value", 9).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    asked = long.select("feature", F.round("value", 9).alias("v")).distinct().withColumn("c", F.lit(0))
    every = counts.unionByName(asked).groupBy("feature", "v").agg(F.sum("c").alias("c"))
    every = every.withColumn("b", ranges(every, "v"))
    per = every.groupBy("feature", "b").agg(F.sum("c").alias("n"))
    per = per.select("feature", "b", (F.sum("n").over(W.partitionBy("feature").orderBy("b")) - F.col("n")).alias("ahead"), F.sum("n").over(W.partitionBy("feature")).alias("all"))
    upto = F.col("ahead") + F.sum("c").over(W.partitionBy("feature", "b").orderBy("v"))
    ranks = every.join(per, ["feature", "b"]).select("feature", "v", (100.0 * (upto - 0.5 * F.col("c")) / F.col("all")).alias("percentile"))
    spread = history.where("value is not null").groupBy("feature").agg(F.avg("value").alias("mean"), (F.min("value") < F.max("value")).alias("varies"))
    out = deviations(long, dist).join(F.broadcast(dist.select("feature", "std")), "feature").join(F.broadcast(spread), "feature").withColumn("v", F.round("value", 9)).join(ranks, ["feature", "v"])
    return out.drop("v").withColumn("label", label_of(F.col("feature")))


def sentence_of(label: Column, value: Column, median: Column, position: Column) -> Column:
    """A deviation in words."""
    return F.concat(label, F.lit(" is "), F.format_string("%.3g", value), F.lit(", "), F.when(position == "within", "within the usual range").otherwise(F.concat(position, F.lit(" than usual"))), F.lit(" (median "), F.format_string("%.3g", median), F.lit(")."))


def stylometry_similarity(wide: DataFrame, dist: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep and exp(-mean(min(|z|, 8)) / 2) over all measures. The distribution has a row per measure and is broadcast; a document's measures come from one row, so they combine before the shuffle."""
    long = deviations(M.long_form(wide, keep), dist)
    return long.groupBy(*keep).agg(F.exp(-F.avg(F.least(F.abs("robust_z"), F.lit(8.0))) / 2).alias("similarity"))


def percentiles(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """candidates with the share of `history(v)` below their `v`, ties counted half, in percent.

    The history is reduced to running counts of its distinct values and looked up by rank in one sorted pass, so a long history costs no candidate-by-history join.
    """
    h = history.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    own = candidates.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k")).join(h, "v", "full_outer").select("v", F.coalesce("c", F.lit(0)).alias("c"))
    # ranges of values carry their sums ahead, then each range is summed on its own
    ranged = own.withColumn("b", ranges(own, "v"))
    per = ranged.groupBy("b").agg(F.sum("c").alias("bc"))
    before = per.select("b", (F.sum("bc").over(W.orderBy("b")) - F.col("bc")).alias("ahead"), F.sum("bc").over(W.partitionBy()).alias("n"))
    within = W.partitionBy("b").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    ranks = ranged.join(before, "b").select("v", (100.0 * (F.col("ahead") + F.coalesce(F.sum("c").over(within), F.lit(0)) + 0.5 * F.col("c")) / F.col("n")).alias("percentile"))
    return candidates.join(ranks, "v")


def _of_rest(a: np.ndarray) -> list[float]:
    """pivot, and the median of the other values for a value below, at and above it."""
    n = len(a)
    m = n // 2
    a = np.partition(a, [m - 1, m, min(m + 1, n - 1)])
    if n % 2 == 0:
        return [a[m - 1], a[m], a[m], a[m - 1]]
    return [a[m], (a[m] + a[m + 1]) / 2, (a[m - 1] + a[m + 1]) / 2, (a[m - 1] + a[m]) / 2]


def leave_one_out(long: DataFrame) -> DataFrame:
    """(feature, n, mean, ss, median, below, at, above) of `long(feature, value)`: all that the distribution of a feature's other values depends on, for every value.

    Without one value a median can only be one of three, by the side of the middle that the value was on. `median` holds the pivot and these three,
    `below`, `at` and `above` the same for the absolute deviations from each. Features of a single value have no rest and are left out. One task sorts a feature's values.
    """

    def run(t: pa.Table) -> pa.Table:
        x = t.column("value").to_numpy()
        if len(x) < 2:
            return pa.Table.from_pylist([], schema)
        rest = _of_rest(x)
        row = {"feature": t.column("feature")[0].as_py(), "n": len(x), "mean": x.mean(), "ss": ((x - x.mean()) ** 2).sum(), "median": rest}
        return pa.Table.from_pylist([row | {k: _of_rest(np.abs(x - c)) for k, c in zip(("below", "at", "above"), rest[1:])}], schema)

    quads = [(k, pa.list_(pa.float64())) for k in ("median", "below", "at", "above")]
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64()), ("mean", pa.float64()), ("ss", pa.float64()), *quads])
    kinds = "feature string, n bigint, mean double, ss double, median array<double>, below array<double>, at array<double>, above array<double>"
    return long.where("value is not null").select("feature", "value").groupBy("feature").applyInArrow(run, kinds)


def against_rest(rows: DataFrame) -> DataFrame:
    """`rows(feature, value, …leave_one_out's columns)` with `component`: the value normalised by the other rows' values of its feature."""
    side = lambda v, q: F.when(v < q[0], q[1]).when(v == q[0], q[2]).otherwise(q[3])
    v, n, pivot = F.col("value"), F.col("n"), F.col("median")[0]
    out = rows.withColumn("_centre", side(v, F.col("median"))).withColumn("_own", F.when(v < pivot, F.col("below")).when(v == pivot, F.col("at")).otherwise(F.col("above")))
    mad = side(F.abs(v - F.col("_centre")), F.col("_own"))
    std = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - (v - F.col("mean")) ** 2 * n / (n - 1)) / (n - 1)))
    return out.withColumn("component", normalise(v, F.col("_centre"), mad, std, n - 1)).drop("_centre", "_own")


def similarity_to_rest(wide: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep and `similarity` as in stylometry_similarity, of every row to the distribution of all other rows."""
    long = M.long_form(wide, keep).join(F.broadcast(leave_one_out(M.long_form(wide, ()))), "feature")
    side = lambda v, q: F.when(v < q[0], q[1]).when(v == q[0], q[2]).otherwise(q[3])
    v, n, pivot = F.col("value"), F.col("n"), F.col("median")[0]
    long = long.withColumn("centre", side(v, F.col("median"))).withColumn("own", F.when(v < pivot, F.col("below")).when(v == pivot, F.col("at")).otherwise(F.col("above")))
    mad = 1.4826 * side(F.abs(v - F.col("centre")), F.col("own"))
    std = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - (v - F.col("mean")) ** 2 * n / (n - 1)) / (n - 1)))
    z = (v - F.col("centre")) / F.greatest(mad, 0.25 * std, 0.1 * F.abs("centre"), F.lit(0.01))
    return long.groupBy(*keep).agg(F.exp(-F.avg(F.least(F.abs(z), F.lit(8.0))) / 2).alias("similarity"))


def spread_of_history(wide: DataFrame) -> DataFrame:
    """(length_class, documents, mean_similarity, spread) of a bank's documents to the distribution of the bank's other documents; length_class is 0 under 150 `words`, 1 under 500, else 2. A bank of one document has no rest and gives no row."""
    sim = similarity_to_rest(wide, ("doc_id", "words"))
    level = F.when(F.col("words") < 150, 0).when(F.col("words") < 500, 1).otherwise(2)
    return sim.groupBy(level.alias("length_class")).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.round(F.stddev_pop("similarity"), 6).alias("spread"))


def normalise(value: Column, median: Column, mad: Column, std: Column, n: Column) -> Column:
    """A similarity against the bank's own: a logistic of the robust z, cut at 30; without history the value itself, cut to 0..1."""
    scale = F.greatest(1.4826 * mad, 0.25 * std, F.lit(0.05))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (value - median) / scale))
    return F.when(F.coalesce(n, F.lit(0)) > 0, 1 / (1 + F.exp(-z))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def evidence_strength(words: Column, *components: Column) -> Column:
    """LOW under 150 words, MEDIUM under 500, else HIGH; one level less where the components are 0.65 or more apart."""
    level = F.when(words < 150, 0).when(words < 500, 1).otherwise(2)
    apart = (F.greatest(*components) - F.least(*components)) >= 0.65 if len(components) > 1 else F.lit(False)
    level = F.when(apart, F.greatest(level - 1, F.lit(0))).otherwise(level)
    return F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), level + 1)
