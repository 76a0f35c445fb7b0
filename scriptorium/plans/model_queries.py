"""Queries that fit or score a model: no SQL can stand beside them, so their rows are checked by tests on invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import learn, nested
from scriptorium.operators import metrics as M
from scriptorium.plans.engine import Engine
from scriptorium.plans.score_queries import _rows
from scriptorium.session import materialize, table

FEATURES = ["embedding_score", "stylometry_score", "character_score"]


def logistic_verifier(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of a verifier on the three signals: each outer fold is scored by the fit on the others."""
    rows = _rows(spark, d).where("outer_fold is not null and split = 'nested_outer'").select(F.col("root_document_id").alias("root"), F.nullif(F.lower(F.trim("author_id")), F.lit("")).alias("author"), "label", "outer_fold", *FEATURES)
    rows = materialize(M.balanced(M.root_weights(rows)))
    out = None
    for fold in sorted(r.outer_fold for r in rows.select("outer_fold").distinct().collect()):  # a handful of folds
        train = rows.where(F.col("outer_fold") != fold)
        v = learn.fit_verifier(train, FEATURES)
        a, b = learn.fit_calibrator(train.withColumn("margin", v.margin()))
        part = rows.where(F.col("outer_fold") == fold).withColumn("margin", v.margin())
        part = part.select("root", "outer_fold", "label", F.round("margin", 6).alias("margin"), F.round(learn.calibrated(F.col("margin"), a, b), 6).alias("chance"))
        out = part if out is None else out.union(part)
    return out if out is not None else rows.select("root", "outer_fold", "label", F.lit(None).cast("double").alias("margin"), F.lit(None).cast("double").alias("chance"))


def sample_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all curated samples against a bank of the letters of readers."""
    docs = table(spark, d, "documents").where("text is not null and lower(trim(source)) = 'reader_letters'").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    engine = Engine.build(docs)
    samples = table(spark, d, "manifest_rows").where("sample_id is not null and excerpt is not null").select(F.col("sample_id").alias("candidate_id"), F.col("excerpt").alias("text")).dropDuplicates(["candidate_id"])
    s = engine.score(samples)
    return s.select("candidate_id", "words", *(F.round(c, 5).alias(c) for c in ("authorship", "stylometry", "character", "authorship_component", "stylometry_component", "character_component", "score")), "decision", "evidence_strength")


def bank_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The reference source's documents against each other: every one by the others' history, itself left out of everything but the character vocabulary; with ablations."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & (F.lower(F.trim("source")) == "reader_letters")).select(F.col("doc_id").cast("string").alias("document_id"), "text")
    e = Engine.build(docs).evaluation()
    return e.select("document_id", *(F.round(c, 5).alias(c) for c in ("authorship", "stylometry", "character", "score", "without_characters", "spread")))


def development_rows(predictions: DataFrame) -> DataFrame:
    """One row per root of the development population of a table of predictions: the one of the best score. Placeholder authors count as none."""
    author = F.lower(F.trim("author_id"))
    rows = predictions.distinct().where("split = 'development_oof' and root_document_id is not null and label is not null")
    cols = F.struct(F.coalesce("score", F.lit(-1.0)).alias("score"), F.when(~author.isin("", "unknown", "n/a", "-"), author).alias("author"), "label", *nested.FEATURES)
    return rows.groupBy(F.col("root_document_id").alias("root")).agg(F.max(cols).alias("x")).select("root", "x.author", "x.label", *(f"x.{f}" for f in nested.FEATURES))


def _development(spark: SparkSession, d: str) -> DataFrame:
    return development_rows(table(spark, d, "predictions"))


_done: dict[tuple[str, str], nested.Evaluation] = {}


def _evaluated(spark: SparkSession, d: str) -> nested.Evaluation:
    """The nested evaluation of a folder's predictions, once in a session: three queries read it."""
    key = spark.sparkContext.applicationId, d
    if key not in _done:
        _done[key] = nested.evaluate(_development(spark, d))
    return _done[key]


def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    """Figures of each configuration inside each outer training set, and the one that the fold takes."""
    e = _evaluated(spark, d)
    taken = {r.outer_fold: r.configuration for r in e.outer.select("outer_fold", "configuration").distinct().collect()}
    rows = [(f["outer_fold"], f["configuration"], *(None if f[c] is None else round(f[c], 5) for c in ("auroc", "average_precision", "tpr_at_5", "tpr", "brier")), taken.get(f["outer_fold"]) == f["configuration"]) for f in e.figures]
    return spark.createDataFrame(rows, "outer_fold int, configuration string, auroc double, average_precision double, tpr_at_5 double, tpr double, brier double, taken boolean")


def nested_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every development root scored by the fold that never saw it or its author, with thresholds frozen in that fold's training set."""
    e = _evaluated(spark, d)
    return e.outer.select("root", "label", "outer_fold", "configuration", *(F.round(c, 5).alias(c) for c in ("margin", "score", "match", "mismatch")), "decision")


def production_verifier(spark: SparkSession, d: str) -> DataFrame:
    """The verifier refitted on all development roots: standardised coefficients, their importance, the calibrator and the thresholds."""
    e = _evaluated(spark, d)
    rows = [(e.selected, f, round(float(w), 5), round(abs(float(w)), 5)) for f, w in zip(nested.FEATURES, e.verifier.weights[0])]
    rows += [(e.selected, n, None if v is None else round(v, 5), None) for n, v in (("bias", float(e.verifier.bias[0])), ("calibrator_slope", e.calibrator[0]), ("calibrator_intercept", e.calibrator[1]), ("match", e.thresholds["match"]), ("mismatch", e.thresholds["mismatch"]))]
    return spark.createDataFrame(rows, "configuration string, name string, value double, importance double")


def verifier_contributions(spark: SparkSession, d: str) -> DataFrame:
    """What moves each development root's margin most."""
    rows = _development(spark, d)
    finite = [M.finite(f) for f in nested.FEATURES]
    for f in finite:
        rows = rows.where(f)
    return nested.contributions(rows, _evaluated(spark, d)).select("root", "feature", F.round("contribution", 5).alias("contribution"), "rank")


def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    """All rows that the evaluation scored, with signals and decisions."""
    return nested.prediction_rows(_evaluated(spark, d), _development(spark, d))


QUERIES = {f.__name__: f for f in (logistic_verifier, nested_selection, nested_predictions, production_verifier, verifier_contributions, prediction_table, bank_evaluation, sample_scores)}
SQL: dict[str, str] = {}
