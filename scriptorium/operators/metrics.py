"""Ranking metrics, thresholds, weights and summaries of scored rows, per group.

Everything that needs an order works on running counts of distinct scores: counted first, summed over score ranges, then within a range. So no window ever holds
all rows, whatever the group's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def ranges(df: DataFrame, col: str, n: int = 256) -> Column:
    """The number of the range that a row's value lies in, of at most `n` ranges of about equally many rows, as an expression; so windows within a range stay small whatever the values are."""
    cuts = sorted(set(df.approxQuantile(col, [i / n for i in range(1, n)], 1 / (4 * n))))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(col))) if cuts else F.lit(0)


def running(rows: DataFrame, by: str, score: str = "score", label: str = "label") -> DataFrame:
    """(by, score, pos, neg, tp, fp, all_pos, all_neg): counts at each distinct score and from it upward. Rows without a finite score or label are left out."""
    at = rows.where(finite(score) & F.col(label).isNotNull()).groupBy(by, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))
    at = at.withColumn("b", ranges(at, "score"))
    per = at.groupBy(by, "b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    down, whole = W.partitionBy(by).orderBy(F.desc("b")), W.partitionBy(by)
    per = per.select(by, "b", (F.sum("bp").over(down) - F.col("bp")).alias("hp"), (F.sum("bn").over(down) - F.col("bn")).alias("hn"), F.sum("bp").over(whole).alias("all_pos"), F.sum("bn").over(whole).alias("all_neg"))
    inside = W.partitionBy(by, "b").orderBy(F.desc("score"))
    return at.join(per, [by, "b"]).select(by, "score", "pos", "neg", (F.col("hp") + F.sum("pos").over(inside)).alias("tp"), (F.col("hn") + F.sum("neg").over(inside)).alias("fp"), "all_pos", "all_neg")


def roc(r: DataFrame, by: str) -> DataFrame:
    """(by, score, tpr, fpr) of the operating points `>= score`; groups of one class only give none."""
    return r.where("all_pos > 0 and all_neg > 0").select(by, "score", (F.col("tp") / F.col("all_pos")).alias("tpr"), (F.col("fp") / F.col("all_neg")).alias("fpr"))


def auroc(r: DataFrame, by: str) -> DataFrame:
    """Chance that a positive scores higher than a negative, ties counted half; null for one class."""
    below = F.col("all_neg") - F.col("fp")
    return r.groupBy(by).agg(F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.max(F.col("all_pos") * F.col("all_neg"))).alias("auroc"))


def average_precision(r: DataFrame, by: str) -> DataFrame:
    """Sum of recall gains times precision over distinct scores."""
    return r.groupBy(by).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("all_pos")).alias("average_precision"))


def equal_error(points: DataFrame, by: str) -> DataFrame:
    """Mean of both errors where they are closest; the highest such score."""
    gap = F.round(F.abs(F.col("fpr") - (1 - F.col("tpr"))), 12)
    return points.groupBy(by).agg(F.min_by(F.struct(((F.col("fpr") + 1 - F.col("tpr")) / 2).alias("eer"), F.col("score").alias("at_score")), F.struct(gap, -F.col("score"))).alias("x")).select(by, "x.eer", "x.at_score")


def tpr_at(points: DataFrame, by: str, rates: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Best true-positive rate at each false-positive rate (in percent) over the operating points; 0 if none qualifies."""
    return points.groupBy(by).agg(*(F.coalesce(F.max(F.when(F.col("fpr") <= n / 100, F.col("tpr"))), F.lit(0.0)).alias(f"tpr_at_{n}") for n in rates))


def brier(rows: DataFrame, by: str, score: str = "score", label: str = "label", top: float = 100.0) -> DataFrame:
    return rows.where(finite(score)).groupBy(by).agg(F.avg(F.pow(F.col(score) / top - F.col(label), F.lit(2))).alias("brier"))


def calibration_error(rows: DataFrame, by: str, score: str = "score", label: str = "label", top: float = 100.0, bins: int = 10) -> DataFrame:
    """Mean gap of score and outcome over equal bins, the last one closed, weighed by rows."""
    b = F.least(F.floor(F.col(score) / top * bins), F.lit(bins - 1))
    per = rows.where(finite(score)).groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(score) / top).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))
    return per.groupBy(by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def operating_points(r: DataFrame, by: str) -> DataFrame:
    """(by, threshold, tp, fp, all_pos, all_neg, lowest, ceiling) of all thresholds worth a look: 0, every score, the next number above every score, and the ceiling (1 if no score is above it, else 100). A row is
    accepted from the threshold upward. Groups of one class only give none."""
    both = r.where("all_pos > 0 and all_neg > 0")
    counted = lambda c, k: F.sum(F.when(F.col("score") >= k, F.col(c)).otherwise(0))
    whole = both.groupBy(by).agg(F.max("score").alias("top"), F.min("score").alias("lowest"), F.max("all_pos").alias("all_pos"), F.max("all_neg").alias("all_neg"), *(counted(c, k).alias(f"{c}{k}") for c in ("pos", "neg") for k in (0, 1, 100)))
    ceiling = F.when(F.col("top") <= 1, 1.0).otherwise(100.0)
    whole = whole.withColumn("ceiling", ceiling)
    at_top = lambda c: F.when(F.col("ceiling") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}100"))
    shared = ["all_pos", "all_neg", "lowest", "ceiling"]
    here = both.select(by, "score", "pos", "neg", "tp", "fp").join(whole.select(by, *shared), by)
    points = here.select(by, F.col("score").alias("threshold"), "tp", "fp", *shared)
    above = here.where("score < ceiling").select(by, F.expr("double(reflect('java.lang.Math', 'nextUp', score))").alias("threshold"), (F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp"), *shared)
    ends = whole.select(by, F.lit(0.0).alias("threshold"), F.col("pos0").alias("tp"), F.col("neg0").alias("fp"), *shared).unionByName(whole.select(by, F.col("ceiling").alias("threshold"), at_top("pos").alias("tp"), at_top("neg").alias("fp"), *shared))
    return points.unionByName(above).unionByName(ends)


def thresholds(r: DataFrame, by: str, target_fpr: float = 0.05, target_fnr: float = 0.05) -> DataFrame:
    """(by, match, target_met, mismatch, fpr, tpr) from the running counts `r`.

    Match: of the operating points within the false-positive target those of the best true-positive rate, of these the lowest; without any the same among the points of the least false-positive rate. Mismatch: the highest
    threshold clearly below it under which no more than the target of positives fall, if it lies above the lowest score; it takes 1 / target rows of either class.
    """
    slack, least = 1e-12, math.ceil(1 / min(target_fpr, target_fnr))
    p = operating_points(r, by).withColumn("tpr", F.col("tp") / F.col("all_pos")).withColumn("fpr", F.col("fp") / F.col("all_neg")).withColumn("fnr", (F.col("all_pos") - F.col("tp")) / F.col("all_pos"))
    fits = F.col("fpr") <= target_fpr + slack
    row = F.struct("threshold", "fpr", "tpr")
    best = p.groupBy(by).agg(F.bool_or(fits).alias("target_met"), F.min_by(row, F.when(fits, F.struct(-F.col("tpr"), F.col("threshold")))).alias("good"), F.min_by(row, F.struct("fpr", -F.col("tpr"), F.col("threshold"))).alias("least_bad"))
    best = best.select(by, "target_met", F.when(F.col("target_met"), F.col("good")).otherwise(F.col("least_bad")).alias("m"))
    apart = (F.col("m.threshold") - F.col("threshold")) > 8 * 2.0**-52 * F.col("ceiling") + 1e-9 * F.abs("m.threshold")
    low = p.join(best, by).where(apart & (F.col("fnr") <= target_fnr + slack) & (F.least("all_pos", "all_neg") >= least)).groupBy(by).agg(F.max("threshold").alias("mismatch"), F.max("lowest").alias("lowest"))
    low = low.select(by, F.when(F.col("mismatch") > F.col("lowest"), F.col("mismatch")).alias("mismatch"))
    return best.join(low, by, "left").select(by, F.col("m.threshold").alias("match"), "target_met", "mismatch", F.col("m.fpr").alias("fpr"), F.col("m.tpr").alias("tpr"))


def decision(score: Column, match: Column, mismatch: Column) -> Column:
    """MATCH from the match threshold; below the mismatch threshold MISMATCH; between them INCONCLUSIVE; without mismatch threshold INCONCLUSIVE_OR_MISMATCH."""
    return F.when(score >= match, "MATCH").when(mismatch.isNull() | F.isnan(mismatch), "INCONCLUSIVE_OR_MISMATCH").when(score < mismatch, "MISMATCH").otherwise("INCONCLUSIVE")


def report(rows: DataFrame, by: str) -> DataFrame:
    """Rates of the decisions taken: documents, true- and false-positive rate, accuracy, share left open."""
    hit = (F.col("decision") == "MATCH").cast("double")
    pos, neg = F.col("label") == 1, F.col("label") == 0
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"), F.avg(F.when(pos, hit)).alias("tpr"), F.avg(F.when(neg, hit)).alias("fpr"),
        F.avg(F.when(pos, hit).otherwise(1 - hit)).alias("accuracy"), F.avg(F.col("decision").startswith("INCONCLUSIVE").cast("double")).alias("open_rate"),
    )


def full_report(rows: DataFrame, by: str, top: float = 100.0) -> DataFrame:
    """`report` of the decisions, with confusion counts, beside the ranking figures of the scores."""
    r = running(rows, by)
    points = roc(r, by)
    hit, pos = F.col("decision") == "MATCH", F.col("label") == 1
    counts = rows.groupBy(by).agg(F.count_if(hit & pos).alias("true_positive"), F.count_if(hit & ~pos).alias("false_positive"), F.count_if(~hit & ~pos).alias("true_negative"), F.count_if(~hit & pos).alias("false_negative"))
    out = report(rows, by).join(counts, by)
    for part in (auroc(r, by), average_precision(r, by), equal_error(points, by).drop("at_score"), brier(rows, by, top=top), calibration_error(rows, by, top=top), tpr_at(points, by)):
        out = out.join(part, by, "left")
    return out


def root_weights(rows: DataFrame, hard: Column | None = None) -> DataFrame:
    """`rows(root, author, label)` with `weight`: a root's views share one root's weight; known negative authors share the negatives' weight equally; hard authors count twice."""
    views = rows.groupBy("root").agg(F.count(F.lit(1)).alias("views"))
    known = rows.where("label = 0 and author is not null").select("root", "author").distinct()
    per = known.groupBy("author").agg(F.countDistinct("root").alias("author_roots"))
    total = known.agg(F.countDistinct("root").alias("roots"), F.countDistinct("author").alias("authors"))
    out = rows.join(views, "root").join(per, "author", "left").crossJoin(F.broadcast(total))
    base = F.when((F.col("label") == 0) & F.col("author").isNotNull(), F.col("roots") / F.col("authors") / F.col("author_roots") / F.col("views")).otherwise(1 / F.col("views"))
    weight = base * (F.when(hard, 2.0).otherwise(1.0) if hard is not None else 1.0)
    return out.withColumn("weight", weight).drop("views", "author_roots", "roots", "authors")


def balanced(weighted: DataFrame) -> DataFrame:
    """Each class scaled to half the total weight."""
    total = weighted.groupBy("label").agg(F.sum("weight").alias("of_class"))
    whole = total.agg(F.sum("of_class").alias("of_all"))
    return weighted.join(F.broadcast(total), "label").crossJoin(F.broadcast(whole)).withColumn("balanced_weight", F.col("weight") * F.col("of_all") / 2 / F.col("of_class")).drop("of_class", "of_all")


def margins(rows: DataFrame, root: str, margin: str) -> DataFrame:
    """Per root the spread of its finite margins; roots without one are left out."""
    q = F.percentile(margin, F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    s = rows.where(finite(margin)).groupBy(root).agg(q.alias("q"), F.var_pop(margin).alias("variance"), F.count(margin).alias("views"))
    return s.select(root, *(F.col("q")[i].alias(n) for i, n in enumerate(("min", "p25", "median", "p75", "max"))), "variance", "views")


def hard_negatives(rows: DataFrame, match: Column, mismatch: Column, share: float = 0.1) -> DataFrame:
    """`rows(author, root, score)` of negatives, with `hard`: at or over the match threshold, or among the best `share` by score (ties at the cut-off all qualify)."""
    ranked = running(rows.withColumn("_g", F.lit(0)).withColumn("_l", F.lit(1)), "_g", "score", "_l")
    cut = ranked.where(F.col("tp") >= F.greatest(F.ceil(F.lit(share) * F.col("all_pos")), F.lit(1))).agg(F.max("score").alias("cutoff"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("hard", (F.col("score") >= match) | (F.col("score") >= F.col("cutoff"))).drop("cutoff")
