"""Queries on scored rows (`predictions`), and the SQL that checks them. Repeated rows count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import metrics as M
from scriptorium.session import table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").distinct()


def _running(spark: SparkSession, d: str) -> DataFrame:
    return M.running(_rows(spark, d), "split")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in cols else c for c in df.columns))


def roc_points(spark: SparkSession, d: str) -> DataFrame:
    """Operating points of every population."""
    return _rounded(M.roc(_running(spark, d), "split"), "tpr", "fpr")


def auroc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the operating points."""
    return _rounded(M.auroc(_running(spark, d), "split"), "auroc")


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision."""
    return _rounded(M.average_precision(_running(spark, d), "split"), "average_precision")


def eer(spark: SparkSession, d: str) -> DataFrame:
    """Equal error rate."""
    return _rounded(M.equal_error(M.roc(_running(spark, d), "split"), "split"), "eer")


def tpr_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    """True-positive rates at fixed false-positive rates."""
    return _rounded(M.tpr_at(M.roc(_running(spark, d), "split"), "split"), "tpr_at_1", "tpr_at_5", "tpr_at_10")


def brier(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error of the scores as chances."""
    return _rounded(M.brier(_rows(spark, d), "split"), "brier")


def ece(spark: SparkSession, d: str) -> DataFrame:
    """Calibration error over ten bins."""
    return _rounded(M.calibration_error(_rows(spark, d), "split"), "ece")


def threshold_selection(spark: SparkSession, d: str) -> DataFrame:
    """Match and mismatch thresholds of every population."""
    return _rounded(M.thresholds(_running(spark, d), "split"), "fpr", "tpr")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by each population's own thresholds."""
    rows = _rows(spark, d)
    t = M.thresholds(M.running(rows, "split"), "split")
    return rows.where(M.finite("score")).join(F.broadcast(t), "split").groupBy("split", M.decision(F.col("score"), F.col("match"), F.col("mismatch")).alias("decided")).agg(F.count(F.lit(1)).alias("rows"))


def confusion_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Recorded decisions by source and label, with totals over all sources."""
    return _rows(spark, d).select("source", F.col("label").cast("string").alias("label"), "decision").rollup("source", "label", "decision").agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("level"))


def performance_report(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the recorded decisions per population."""
    return _rounded(M.report(_rows(spark, d), "split"), "tpr", "fpr", "accuracy", "open_rate")


def nested_report(spark: SparkSession, d: str) -> DataFrame:
    """Outer folds: each fold's frozen thresholds decide its rows, the decisions are pooled."""
    rows = _rows(spark, d).where(F.col("outer_fold").isNotNull() & M.finite("fold_match_threshold") & M.finite("score"))
    rows = rows.withColumn("decision", M.decision(F.col("score"), F.col("fold_match_threshold"), F.col("fold_mismatch_threshold")))
    return _rounded(M.report(rows, "outer_fold"), "tpr", "fpr", "accuracy", "open_rate")


def root_margin_summary(spark: SparkSession, d: str) -> DataFrame:
    """Spread of each root's finite margins over the populations."""
    m = M.margins(_rows(spark, d), "root_document_id", "raw_margin")
    return m.select("root_document_id", *(F.round(c, 9).alias(c) for c in ("min", "p25", "median", "p75", "max", "variance")), "views")


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    author = F.nullif(F.lower(F.trim("author_id")), F.lit(""))
    rows = _rows(spark, d).select(F.col("root_document_id").alias("root"), author.alias("author"), "label", "split", "score", "hard_negative")
    return M.root_weights(rows, F.coalesce("hard_negative", F.lit(False)))


def root_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights that give every root, and among negatives every author, the same say."""
    return _rounded(_weighted(spark, d).groupBy("root", "label").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("views")), "weight")


def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights after the classes are balanced, per class and population."""
    return _rounded(M.balanced(_weighted(spark, d)).groupBy("label", "split").agg(F.sum("balanced_weight").alias("weight")), "weight")


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Negative authors of the development population whose documents are taken for the writer's."""
    rows = _rows(spark, d).where((F.col("label") == 0) & M.finite("score") & (F.col("split") == "development_oof")).select(F.lower(F.trim("author_id")).alias("author"), "root_document_id", "score")
    rows = M.hard_negatives(rows, F.lit(80.0), F.lit(40.0))
    out = rows.groupBy("author").agg(F.count(F.lit(1)).alias("documents"), F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.max("score").alias("max_score"), F.avg((F.col("score") >= 80.0).cast("double")).alias("false_acceptance"), (F.bool_or("hard") | (F.median("score") >= 40.0)).alias("hard_author"))
    return _rounded(out, "mean_score", "median_score", "false_acceptance")


def source_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Negatives by kind of source: documents, authors, median score, false acceptance."""
    rows = _rows(spark, d).where((F.col("label") == 0) & M.finite("score"))
    kind = F.coalesce(F.lower(F.trim("source_type")), F.lit("none"))
    return _rounded(rows.groupBy(kind.alias("kind")).agg(F.countDistinct("root_document_id").alias("documents"), F.countDistinct(F.lower(F.trim("author_id"))).alias("authors"), F.median("score").alias("median_score"), F.avg((F.col("decision") == "MATCH").cast("double")).alias("false_acceptance")), "median_score", "false_acceptance")


def normalised_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The embedding score of every row against its population's positives."""
    from scriptorium.operators.distributions import normalise

    rows = _rows(spark, d).where(M.finite("embedding_score"))
    pos = rows.where("label = 1")
    centre = pos.groupBy("split").agg(F.median("embedding_score").alias("med"), F.stddev_pop("embedding_score").alias("sd"), F.count(F.lit(1)).alias("n"))
    mad = pos.join(F.broadcast(centre), "split").groupBy("split").agg(F.median(F.abs(F.col("embedding_score") - F.col("med"))).alias("mad"))
    both = rows.join(F.broadcast(centre), "split", "left").join(F.broadcast(mad), "split", "left")
    return both.select("root_document_id", "split", F.round("embedding_score", 6).alias("embedding_score"), F.round(normalise(F.col("embedding_score"), F.col("med"), F.col("mad"), F.col("sd"), F.col("n")), 6).alias("normalised")).distinct()


def ensemble_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score of the three signals, its evidence, and how far the signals are apart."""
    from scriptorium.operators.distributions import evidence_strength

    e, s, c = (F.col(x) for x in ("embedding_score", "stylometry_score", "character_score"))
    return _rows(spark, d).where(M.finite("embedding_score") & M.finite("stylometry_score") & M.finite("character_score")).select(
        "root_document_id", "split", F.round(100 * (0.60 * e + 0.25 * s + 0.15 * c), 8).alias("ensemble"), F.round((0.60 * e + 0.25 * s) / 0.85, 6).alias("without_characters"),
        F.round(F.greatest(e, s, c) - F.least(e, s, c), 6).alias("spread"), evidence_strength(F.coalesce("word_count", F.lit(0)), e, s, c).alias("evidence"),
    ).distinct()


def author_contrast(spark: SparkSession, d: str) -> DataFrame:
    """The reference similarity against the negative authors' best and median, where the recorded gaps disagree too."""
    rows = _rows(spark, d).where(M.finite("user_embedding_similarity") & M.finite("best_negative_author_similarity") & M.finite("median_negative_author_similarity"))
    best, mid = F.round(F.col("user_embedding_similarity") - F.col("best_negative_author_similarity"), 5), F.round(F.col("user_embedding_similarity") - F.col("median_negative_author_similarity"), 5)
    return rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(best), 5).alias("best_gap"), F.round(F.avg(mid), 5).alias("median_gap"), F.sum((F.abs(best - F.col("user_vs_best_negative_gap")) > 0.0001).cast("bigint")).alias("wrong_gaps"))


def fold_leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    """Author keys that stand in more than one outer fold of one population."""
    rows = _rows(spark, d).where(F.col("outer_fold").isNotNull() & F.col("author_id").isNotNull())
    return rows.groupBy("split", F.lower(F.trim("author_id")).alias("author")).agg(F.countDistinct("outer_fold").alias("folds"), F.countDistinct("root_document_id").alias("roots")).where("folds > 1")


def negative_supply(spark: SparkSession, d: str) -> DataFrame:
    """Per population: distinct positive and negative roots, negative authors, and the largest author's share of the negatives."""
    rows = _rows(spark, d)
    key = F.nullif(F.lower(F.trim("author_id")), F.lit(""))
    per = rows.where("label = 0").groupBy("split", key.alias("author")).agg(F.countDistinct("root_document_id").alias("roots"))
    neg = per.groupBy("split").agg(F.sum("roots").alias("negative_roots"), F.count("author").alias("negative_authors"), F.round(F.max(F.when(F.col("author").isNotNull(), F.col("roots"))) / F.sum("roots"), 6).alias("largest_share"))
    pos = rows.where("label = 1").groupBy("split").agg(F.countDistinct("root_document_id").alias("positive_roots"))
    return neg.join(pos, "split", "full_outer").select("split", F.coalesce("positive_roots", F.lit(0)).alias("positive_roots"), F.coalesce("negative_roots", F.lit(0)).alias("negative_roots"), F.coalesce("negative_authors", F.lit(0)).alias("negative_authors"), "largest_share")


_P = "p AS (SELECT DISTINCT * FROM predictions)"
_OK = "isfinite(score)"
_RUN = f"""WITH {_P}, cnt AS (SELECT split, score, sum((label = 1)::INT) AS pos, sum((label <> 1)::INT) AS neg FROM p WHERE {_OK} AND label IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY split) AS all_pos, sum(neg) OVER (PARTITION BY split) AS all_neg FROM cnt WINDOW w AS (PARTITION BY split ORDER BY score DESC)),
roc AS (SELECT split, score, tp/all_pos AS tpr, fp/all_neg AS fpr, (all_pos - tp)/all_pos AS fnr, all_pos, all_neg FROM r WHERE all_pos > 0 AND all_neg > 0)"""
_THR = f"""{_RUN}, s0 AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY split) <= 1 THEN 1.0 ELSE 100.0 END AS ceiling, min(score) OVER (PARTITION BY split) AS lowest FROM r WHERE all_pos > 0 AND all_neg > 0),
cand AS (SELECT split, score AS t FROM s0 UNION SELECT split, least(nextafter(score, 'Infinity'::DOUBLE), ceiling) FROM s0 UNION SELECT split, 0.0::DOUBLE FROM s0 UNION SELECT split, ceiling::DOUBLE FROM s0),
pt AS (SELECT c.split, c.t, sum(CASE WHEN score >= t THEN pos ELSE 0 END)/max(all_pos) AS tpr, sum(CASE WHEN score >= t THEN neg ELSE 0 END)/max(all_neg) AS fpr, sum(CASE WHEN score < t THEN pos ELSE 0 END)/max(all_pos) AS fnr,
max(all_pos) AS np, max(all_neg) AS nn, max(lowest) AS lowest, max(ceiling) AS ceiling FROM cand c JOIN s0 USING (split) GROUP BY 1, 2),
b AS (SELECT split, bool_or(fpr <= 0.05 + 1e-12) AS target_met, arg_min({{'t': t, 'f': fpr, 'p': tpr}}, (-tpr, t)) FILTER (WHERE fpr <= 0.05 + 1e-12) AS good, arg_min({{'t': t, 'f': fpr, 'p': tpr}}, (fpr, -tpr, t)) AS bad FROM pt GROUP BY 1),
m AS (SELECT split, target_met, CASE WHEN target_met THEN good ELSE bad END AS m FROM b),
lo AS (SELECT split, max(t) AS x, max(lowest) AS lowest FROM pt JOIN m USING (split) WHERE m.m.t - t > 8*2.220446049250313e-16*ceiling + 1e-9*abs(m.m.t) AND fnr <= 0.05 + 1e-12 AND least(np, nn) >= 20 GROUP BY 1),
thr AS (SELECT split, m.m.t AS match, target_met, CASE WHEN x > lowest THEN x END AS mismatch, round(m.m.f, 6) AS fpr, round(m.m.p, 6) AS tpr FROM m LEFT JOIN lo USING (split))"""
_DEC = "CASE WHEN score >= {m} THEN 'MATCH' WHEN {x} IS NULL OR isnan({x}) THEN 'INCONCLUSIVE_OR_MISMATCH' WHEN score < {x} THEN 'MISMATCH' ELSE 'INCONCLUSIVE' END"
_REP = "count(*) AS documents, round(avg((decision = 'MATCH')::INT) FILTER (WHERE label = 1), 6) AS tpr, round(avg((decision = 'MATCH')::INT) FILTER (WHERE label = 0), 6) AS fpr, round(avg(CASE WHEN label = 1 THEN (decision = 'MATCH')::INT ELSE 1 - (decision = 'MATCH')::INT END), 6) AS accuracy, round(avg(starts_with(decision, 'INCONCLUSIVE')::INT), 6) AS open_rate"
_WEIGHT = f"""WITH {_P}, v AS (SELECT root_document_id AS root, nullif(lower(trim(author_id)), '') AS author, label, split, coalesce(hard_negative, false) AS hard FROM p),
k AS (SELECT DISTINCT root, author FROM v WHERE label = 0 AND author IS NOT NULL), per AS (SELECT author, count(DISTINCT root) AS author_roots FROM k GROUP BY 1),
t AS (SELECT count(DISTINCT root) AS roots, count(DISTINCT author) AS authors FROM k), c AS (SELECT root, count(*) AS views FROM v GROUP BY 1),
w AS (SELECT v.*, CASE WHEN label = 0 AND v.author IS NOT NULL THEN roots/authors/author_roots/views ELSE 1.0/views END * CASE WHEN hard THEN 2 ELSE 1 END AS weight FROM v JOIN c USING (root) LEFT JOIN per ON v.author = per.author CROSS JOIN t)"""
SQL = {
    "roc_points": f"{_RUN} SELECT split, score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc",
    "auroc": f"{_RUN} SELECT split, round(sum(pos*(all_neg - fp + neg/2))/nullif(max(all_pos*all_neg), 0), 6) AS auroc FROM r GROUP BY 1",
    "average_precision": f"{_RUN} SELECT split, round(sum(pos*tp/(tp + fp))/nullif(max(all_pos), 0), 6) AS average_precision FROM r GROUP BY 1",
    "eer": f"{_RUN} SELECT split, round(arg_min((fpr + 1 - tpr)/2, (round(abs(fpr - (1 - tpr)), 12), -score)), 6) AS eer, arg_min(score, (round(abs(fpr - (1 - tpr)), 12), -score)) AS at_score FROM roc GROUP BY 1",
    "tpr_at_fpr": f"{_RUN} SELECT split, " + ", ".join(f"round(coalesce(max(tpr) FILTER (WHERE fpr <= {n}/100), 0), 6) AS tpr_at_{n}" for n in (1, 5, 10)) + " FROM roc GROUP BY 1",
    "brier": f"WITH {_P} SELECT split, round(avg(pow(score/100 - label, 2)), 6) AS brier FROM p WHERE {_OK} GROUP BY 1",
    "ece": f"WITH {_P}, b AS (SELECT split, least(floor(score/100*10), 9) AS bin, count(*) AS n, avg(score/100) AS s, avg(label) AS y FROM p WHERE {_OK} GROUP BY 1, 2) SELECT split, round(sum(n*abs(s - y))/sum(n), 6) AS ece FROM b GROUP BY 1",
    "threshold_selection": f"{_THR} SELECT * FROM thr",
    "decisions": f"{_THR} SELECT split, {_DEC.format(m='match', x='mismatch')} AS decided, count(*) AS rows FROM p JOIN thr USING (split) WHERE {_OK} GROUP BY 1, 2",
    "confusion_by_source": f"WITH {_P} SELECT source, label, decision, count(*) AS rows, grouping(source, label, decision) AS level FROM (SELECT source, label::VARCHAR AS label, decision FROM p) GROUP BY ROLLUP (source, label, decision)",
    "performance_report": f"WITH {_P} SELECT split, {_REP} FROM p GROUP BY 1",
    "nested_report": f"WITH {_P}, q AS (SELECT outer_fold, label, {_DEC.format(m='fold_match_threshold', x='fold_mismatch_threshold')} AS decision FROM p WHERE outer_fold IS NOT NULL AND isfinite(fold_match_threshold) AND {_OK}) SELECT outer_fold, {_REP} FROM q GROUP BY 1",
    "root_margin_summary": f"WITH {_P} SELECT root_document_id, round(min(raw_margin), 9) AS min, round(quantile_cont(raw_margin, 0.25), 9) AS p25, round(median(raw_margin), 9) AS median, round(quantile_cont(raw_margin, 0.75), 9) AS p75, round(max(raw_margin), 9) AS max, round(var_pop(raw_margin), 9) AS variance, count(*) AS views FROM p WHERE isfinite(raw_margin) GROUP BY 1",
    "root_weights": f"{_WEIGHT} SELECT root, label, round(sum(weight), 6) AS weight, count(*) AS views FROM w GROUP BY 1, 2",
    "balanced_weights": f"{_WEIGHT}, b AS (SELECT *, weight*(SELECT sum(weight) FROM w)/2/sum(weight) OVER (PARTITION BY label) AS bw FROM w) SELECT label, split, round(sum(bw), 6) AS weight FROM b GROUP BY 1, 2",
    "hard_negatives": f"""WITH {_P}, n AS (SELECT lower(trim(author_id)) AS author, root_document_id, score FROM p WHERE label = 0 AND {_OK} AND split = 'development_oof'),
cut AS (SELECT min(score) AS cutoff FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn FROM n) WHERE rn <= greatest(ceil(0.1*(SELECT count(*) FROM n)), 1))
SELECT author, count(*) AS documents, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score, max(score) AS max_score, round(avg((score >= 80)::INT), 6) AS false_acceptance, (bool_or(score >= 80 OR score >= cutoff) OR median(score) >= 40) AS hard_author FROM n, cut GROUP BY 1""",
    "source_diagnostics": f"WITH {_P} SELECT coalesce(lower(trim(source_type)), 'none') AS kind, count(DISTINCT root_document_id) AS documents, count(DISTINCT lower(trim(author_id))) AS authors, round(median(score), 6) AS median_score, round(avg((decision = 'MATCH')::INT), 6) AS false_acceptance FROM p WHERE label = 0 AND {_OK} GROUP BY 1",
    "normalised_similarity": f"""WITH {_P}, c AS (SELECT split, median(embedding_score) AS med, stddev_pop(embedding_score) AS sd, count(*) AS n FROM p WHERE label = 1 AND isfinite(embedding_score) GROUP BY 1),
m AS (SELECT split, median(abs(embedding_score - med)) AS mad FROM p JOIN c USING (split) WHERE label = 1 AND isfinite(embedding_score) GROUP BY 1)
SELECT DISTINCT root_document_id, p.split, round(embedding_score, 6) AS embedding_score, round(CASE WHEN coalesce(n, 0) > 0 THEN 1/(1 + exp(-greatest(-30.0, least(30.0, (embedding_score - med)/greatest(1.4826*mad, 0.25*sd, 0.05))))) ELSE greatest(0.0, least(1.0, embedding_score)) END, 6) AS normalised
FROM p LEFT JOIN c ON p.split = c.split LEFT JOIN m ON p.split = m.split WHERE isfinite(embedding_score)""",
    "ensemble_score": f"""WITH {_P}, s AS (SELECT root_document_id, split, embedding_score AS e, stylometry_score AS s, character_score AS c, coalesce(word_count, 0) AS w FROM p WHERE isfinite(embedding_score) AND isfinite(stylometry_score) AND isfinite(character_score)),
l AS (SELECT *, CASE WHEN w < 150 THEN 0 WHEN w < 500 THEN 1 ELSE 2 END AS lev, greatest(e, s, c) - least(e, s, c) AS spread FROM s)
SELECT DISTINCT root_document_id, split, round(100*(0.60*e + 0.25*s + 0.15*c), 8) AS ensemble, round((0.60*e + 0.25*s)/0.85, 6) AS without_characters, round(spread, 6) AS spread,
['LOW', 'MEDIUM', 'HIGH'][1 + CASE WHEN spread >= 0.65 THEN greatest(lev - 1, 0) ELSE lev END] AS evidence FROM l""",
    "author_contrast": f"""WITH {_P}, g AS (SELECT split, label, round(user_embedding_similarity - best_negative_author_similarity, 5) AS b, round(user_embedding_similarity - median_negative_author_similarity, 5) AS m, user_vs_best_negative_gap AS was FROM p WHERE isfinite(user_embedding_similarity) AND isfinite(best_negative_author_similarity) AND isfinite(median_negative_author_similarity))
SELECT split, label, count(*) AS rows, round(avg(b), 5) AS best_gap, round(avg(m), 5) AS median_gap, sum((abs(b - was) > 0.0001)::INT) AS wrong_gaps FROM g GROUP BY 1, 2""",
    "fold_leakage_audit": f"WITH {_P} SELECT split, lower(trim(author_id)) AS author, count(DISTINCT outer_fold) AS folds, count(DISTINCT root_document_id) AS roots FROM p WHERE outer_fold IS NOT NULL AND author_id IS NOT NULL GROUP BY 1, 2 HAVING folds > 1",
    "negative_supply": f"""WITH {_P}, per AS (SELECT split, nullif(lower(trim(author_id)), '') AS author, count(DISTINCT root_document_id) AS roots FROM p WHERE label = 0 GROUP BY 1, 2),
n AS (SELECT split, sum(roots) AS negative_roots, count(author) AS negative_authors, round(max(roots) FILTER (WHERE author IS NOT NULL)/sum(roots), 6) AS largest_share FROM per GROUP BY 1), q AS (SELECT split, count(DISTINCT root_document_id) AS positive_roots FROM p WHERE label = 1 GROUP BY 1)
SELECT split, coalesce(positive_roots, 0) AS positive_roots, coalesce(negative_roots, 0) AS negative_roots, coalesce(negative_authors, 0) AS negative_authors, largest_share FROM n FULL JOIN q USING (split)""",
}
QUERIES = {f.__name__: f for f in (roc_points, auroc, average_precision, eer, tpr_at_fpr, brier, ece, threshold_selection, decisions, confusion_by_source, performance_report, nested_report, root_margin_summary, root_weights, balanced_weights, hard_negatives, source_diagnostics, normalised_similarity, ensemble_score, author_contrast, fold_leakage_audit, negative_supply)}
