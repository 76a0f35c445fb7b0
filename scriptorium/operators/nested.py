"""Nested evaluation of the verifier: all fits of a level at once.

Level 3 finds the hard authors of inner training sets, level 2 chooses a configuration, calibrates and sets thresholds inside each outer training set, level 1 predicts the outer folds, and the production fit takes
all rows. A level is one long table (fit, row, weight); every Newton step of all its fits is one aggregation, of which only gradients and curvatures reach the driver: a few numbers for each fit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import groups as G
from scriptorium.operators import metrics as M
from scriptorium.session import materialize

SIGNALS = ("embedding_score", "stylometry_score", "character_score")
CONTRAST = ("user_embedding_similarity", "best_negative_author_similarity", "median_negative_author_similarity", "user_vs_best_negative_gap", "user_vs_median_negative_gap")
FEATURES = (*SIGNALS, *CONTRAST)


@dataclass(frozen=True)
class Configuration:
    name: str
    contrast: bool
    character: bool
    weighted: bool

    def uses(self) -> np.ndarray:
        return np.array([(f not in CONTRAST or self.contrast) and (f != "character_score" or self.character) for f in FEATURES])


CONFIGURATIONS = (
    Configuration("baseline", False, True, False), Configuration("contrast", True, True, False), Configuration("hard_negative_weighting", True, True, True),
    Configuration("without_character", True, False, False), Configuration("hard_negative_weighting_without_character", True, False, True),
)


def choose_configuration(figures: dict[str, dict[str, float]]) -> str:
    """The configuration to adopt, of `figures[name]` with tpr_at_5, auroc, tpr and brier.

    Configurations in order replace the one held if they are strictly better at 5 % false positives and elsewhere no worse than the tolerances, against the one held and, from the third on, against plain contrast. Where hard
    weighting wins, characters are dropped unless they bring something.
    """
    slack = 1e-12

    def better(new: dict[str, float], old: dict[str, float]) -> bool:
        return new["tpr_at_5"] > old["tpr_at_5"] + slack and new["auroc"] >= old["auroc"] - 0.01 - slack and new["tpr"] >= old["tpr"] - 0.03 - slack and new["brier"] <= old["brier"] + slack

    held = "baseline"
    for name in ("contrast", "hard_negative_weighting", "without_character"):
        if name in figures and better(figures[name], figures[held]) and (name == "contrast" or "contrast" not in figures or better(figures[name], figures["contrast"])):
            held = name
    plain = "hard_negative_weighting_without_character"
    if held == "hard_negative_weighting" and plain in figures:
        gain = {k: figures[held][k] - figures[plain][k] for k in ("tpr_at_5", "auroc", "tpr")}
        if not (gain["tpr_at_5"] >= 0.02 - slack or gain["auroc"] > 0.01 + slack or gain["tpr"] > 0.03 + slack):
            held = plain
    return held


@dataclass(frozen=True)
class Fits:
    """Coefficients (fits, features) on standardised features, intercepts, means and scales, by fit name."""

    names: list[str]
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def _sums(rows: DataFrame, work, extra: tuple[str, ...] = ()) -> dict[str, np.ndarray]:  # noqa: ANN001
    """Sums over the rows of each fit of the vectors `work(fit, x, y, w, b)` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = np.array(batch.column("fit").to_pylist(), object)
            if not len(fit):
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(fit), -1)
            y, w, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "w", "b"))
            for name in sorted(set(fit)):
                own = fit == name
                v = np.asarray(work(name, x[own], y[own], w[own], b[own]), float)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["fit", "k", "v"])

    got = rows.select("fit", "x", "label", "w", "b").mapInArrow(run, "fit string, k int, v double").groupBy("fit", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[str, dict[int, float]] = {}
    for r in got:
        out.setdefault(r.fit, {})[r.k] = r.v
    return {name: np.array([v[k] for k in range(len(v))]) for name, v in out.items()}


def fit_many(rows: DataFrame, uses: dict[str, np.ndarray], c: float = 0.1, standardise: bool = True, rounds: int = 25) -> Fits:
    """Penalised logistic fits of `rows(fit, label, x array<double>, w, b)`: standardised by the weights `w`, fitted by `b`, with penalty 1 / (2 c) on the squared coefficients but not on the intercept.

    `uses[fit]` masks features. A feature that doesn't vary has scale 1. Newton's method for all fits at once.
    """
    names = sorted(uses)
    d = len(next(iter(uses.values())))
    if standardise:
        first = _sums(rows, lambda _, x, y, w, b: np.concatenate([[w.sum()], w @ x]))
        means = {n: v[1:] / v[0] for n, v in first.items()}
        second = _sums(rows, lambda n, x, y, w, b: np.concatenate([[w.sum()], w @ (x - means[n]) ** 2]))
        scales = {n: np.where((s := np.sqrt(v[1:] / v[0])) > 1e-12, s, 1.0) for n, v in second.items()}
    else:
        means, scales = {n: np.zeros(d) for n in names}, {n: np.ones(d) for n in names}
    beta = {n: np.zeros(d + 1) for n in names}

    def step(n: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.where(uses[n], (x - means[n]) / scales[n], 0.0), np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(z @ beta[n], -700, 700)))
        return np.concatenate([z.T @ (b * (p - y)), ((z * (b * p * (1 - p))[:, None]).T @ z).ravel()])

    keep = np.append(np.ones(d), 0.0)
    for _ in range(rounds):
        moved = 0.0
        for n, v in _sums(rows, step).items():
            g, h = c * v[: d + 1] + keep * beta[n], c * v[d + 1 :].reshape(d + 1, d + 1) + np.diag(keep)
            delta = np.linalg.solve(h + 1e-12 * np.eye(d + 1), g)
            beta[n] = beta[n] - delta
            moved = max(moved, float(np.abs(delta).max()))
        if moved < 1e-9:
            break
    return Fits(names, np.array([means[n] for n in names]), np.array([scales[n] for n in names]), np.array([beta[n][:d] for n in names]), np.array([beta[n][d] for n in names]))


def weighted(rows: DataFrame) -> DataFrame:
    """`rows(fit, root, author, label, hard)` with `w`, equal for roots and, among negatives of known authors, for authors, double for hard authors; and `b`, the same with each class half of the whole."""
    known = (F.col("label") == 0) & F.col("author").isNotNull()
    per = rows.where(known).groupBy("fit", "author").agg(F.countDistinct("root").alias("_own"))
    total = per.groupBy("fit").agg(F.sum("_own").alias("_roots"), F.count(F.lit(1)).alias("_authors"))
    out = rows.join(per, ["fit", "author"], "left").join(F.broadcast(total), "fit", "left")  # a row per fit
    out = out.withColumn("w", F.when(known, F.col("_roots") / F.col("_authors") / F.col("_own")).otherwise(1.0) * F.when(known & F.col("hard"), 2.0).otherwise(1.0))
    size = out.groupBy("fit").agg(F.sum("w").alias("_all"), F.sum(F.when(F.col("label") == 1, F.col("w"))).alias("_p"), F.sum(F.when(F.col("label") == 0, F.col("w"))).alias("_q"))
    out = out.join(F.broadcast(size), "fit")
    return out.withColumn("b", F.col("w") * F.col("_all") / 2 / F.when(F.col("label") == 1, F.col("_p")).otherwise(F.col("_q"))).drop("_own", "_roots", "_authors", "_all", "_p", "_q")


def margins(rows: DataFrame, fits: Fits) -> DataFrame:
    """`rows(fit, x)` with `margin`."""
    at = {n: i for i, n in enumerate(fits.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.array([at[n] for n in b.column("fit").to_pylist()], np.int64)
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1) if len(k) else np.zeros((0, fits.means.shape[1]))
            m = ((x - fits.means[k]) / fits.scales[k] * fits.weights[k]).sum(1) + fits.bias[k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m)], names=[*b.schema.names, "margin"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("margin", DoubleType())]))


def calibrated(scored: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """`scored(set, label, margin)` with `score` (0 to 100) by a calibrator for each set in which either class weighs 1 in all, and the calibrators."""
    size = scored.groupBy("set").agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_q"))
    rows = scored.join(F.broadcast(size), "set").select(F.col("set").alias("fit"), "label", F.array("margin").alias("x"), F.lit(1.0).alias("w"), F.when(F.col("label") == 1, 1.0 / F.col("_p")).otherwise(1.0 / F.col("_q")).alias("b"))
    rows = materialize(rows)
    fits = fit_many(rows, {r.fit: np.ones(1, bool) for r in rows.select("fit").distinct().collect()}, c=1.0, standardise=False)
    found = {n: (float(fits.weights[i, 0]), float(fits.bias[i])) for i, n in enumerate(fits.names)}
    return apply_calibrators(scored, found), found


def apply_calibrators(scored: DataFrame, found: dict[str, tuple[float, float]]) -> DataFrame:
    """`scored(set, margin)` with `score`; sets without a calibrator are left out."""
    table = scored.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in found.items()], "set string, _a double, _b double")
    return scored.join(F.broadcast(table), "set").withColumn("score", 100 / (1 + F.exp(-(F.col("_a") * F.col("margin") + F.col("_b"))))).drop("_a", "_b")


def hard_authors(scored: DataFrame) -> DataFrame:
    """(set, author): negative authors of `scored(set, root, author, label, score)` of whom some root scores like a match, or among the best tenth, or whose median reaches the mismatch threshold."""
    t = M.thresholds(M.running(scored, "set"), "set")
    neg = scored.where("label = 0")
    ranked = M.running(neg.withColumn("_one", F.lit(1)), "set", "score", "_one")
    cut = ranked.where(F.col("tp") >= F.greatest(F.ceil(0.1 * F.col("all_pos")), F.lit(1))).groupBy("set").agg(F.max("score").alias("cut"))
    rows = neg.where("author is not null").join(F.broadcast(t), "set").join(F.broadcast(cut), "set")
    per = rows.groupBy("set", "author").agg(F.bool_or((F.col("score") >= F.col("match")) | (F.col("score") >= F.col("cut"))).alias("hard"), F.median("score").alias("mid"), F.first("mismatch").alias("mismatch"))
    return per.where(F.col("hard") | F.coalesce(F.col("mid") >= F.col("mismatch"), F.lit(False))).select("set", "author")


def _folded(rows: DataFrame, column: str, n: int) -> DataFrame:
    """`rows(set, root, group, label)` with `column`, the fold of the row's group within its set; sets that can't be folded are left out."""
    out = None
    for name in sorted(r.set for r in rows.select("set").distinct().collect()):  # as many as folds
        own = rows.where(F.col("set") == name)
        try:
            part = G.folds(own.select(F.col("root").alias("document_id"), F.col("group").alias("group_id"), "label"), n).select(F.col("group_id").alias("group"), F.col("fold").alias(column)).distinct()
        except ValueError:
            continue
        part = own.join(part, "group")
        out = part if out is None else out.unionByName(part)
    return materialize(out) if out is not None else materialize(rows.where("false").withColumn(column, F.lit(0)))


def _level(folded: DataFrame, fold: str, hard: DataFrame | None, configurations: tuple[Configuration, ...]) -> DataFrame:
    """(set, configuration, root, author, label, group, x, margin): out-of-fold margins of every row of every set, by the fit on the set's other folds. `hard(set, fold, author)` are the hard authors of these."""
    sets = [(r.set, r[fold]) for r in folded.select("set", fold).distinct().collect()]  # a few folds each
    spark = folded.sparkSession
    plan = spark.createDataFrame([(s, k, c.name, f"{s}/{k}/{c.name}", c.weighted) for s, k in sets for c in configurations], "set string, held int, configuration string, fit string, weighted boolean")
    uses = {f"{s}/{k}/{c.name}": c.uses() for s, k in sets for c in configurations}
    train = folded.join(F.broadcast(plan), "set").where(F.col(fold) != F.col("held"))
    train = train.join(hard.withColumnRenamed("out", "held").withColumn("is_hard", F.lit(True)), ["set", "held", "author"], "left") if hard is not None else train.withColumn("is_hard", F.lit(False))
    train = materialize(weighted(train.select("fit", "root", "author", "label", "x", (F.coalesce("is_hard", F.lit(False)) & F.col("weighted")).alias("hard"))))
    fits = fit_many(train, uses)
    test = folded.join(F.broadcast(plan), "set").where(F.col(fold) == F.col("held")).select("set", "configuration", "fit", "root", "author", "label", "group", "x")
    return materialize(margins(test, fits))


@dataclass
class Evaluation:
    """What a nested evaluation found."""

    outer: DataFrame  # (root, label, outer_fold, configuration, margin, score, match, mismatch, decision)
    development: DataFrame  # (configuration, root, author, label, margin, score) out of fold
    figures: list[dict]  # one for each outer fold and configuration, inside its training set
    selected: str
    thresholds: dict[str, float | None]
    calibrator: tuple[float, float]
    verifier: Fits
    hard: list[str]


def _figures(scored: DataFrame, by: str) -> dict[str, dict[str, float]]:
    """Ranking figures, and the true-positive rate at the own match threshold, of each value of `by`."""
    t = M.thresholds(M.running(scored, by), by)
    rows = scored.join(F.broadcast(t.select(by, "match", "mismatch")), by).withColumn("decision", M.decision(F.col("score"), F.col("match"), F.col("mismatch")))
    out = M.full_report(materialize(rows), by).join(t.select(by, "match", "mismatch"), by)
    return {r[by]: r.asDict() for r in out.collect()}  # a few rows


def evaluate(rows: DataFrame, folds: int = 3) -> Evaluation:
    """Nested evaluation of `rows(root, author, label, FEATURES…)`, one row per root. Rows with a null or non-finite feature or a null label are left out.

    Groups are roots, and for negatives of known authors the authors. Fewer than two groups of a label are an error.
    """
    finite = F.forall(F.array(*(F.col(f).cast("double") for f in FEATURES)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = rows.where(F.col("label").isNotNull() & finite)
    group = F.when((F.col("label") == 0) & F.col("author").isNotNull(), F.concat(F.lit("a:"), "author")).otherwise(F.concat(F.lit("r:"), "root"))
    own = materialize(own.select(F.lit("all").alias("set"), "root", "author", "label", group.alias("group"), F.array(*(F.col(f).cast("double") for f in FEATURES)).alias("x")))
    outer = _folded(own, "out", folds)
    if outer.isEmpty():
        raise ValueError("too few independent groups of a label")
    k = [r.out for r in outer.select("out").distinct().collect()]
    # the training set of each outer fold, and within it those of the inner folds
    part = lambda df, fold, name: df.withColumn("_k", F.explode(F.array(*map(F.lit, k)))).where(F.col("_k") != F.col(fold)).withColumn("set", F.concat_ws("|", F.lit(name), F.col("_k").cast("string")))
    inner = _folded(part(outer, "out", "o").select("set", "root", "author", "label", "group", "x"), "in", folds)
    deep = inner.withColumn("_i", F.explode(F.array(*map(F.lit, range(folds))))).where(F.col("_i") != F.col("in")).withColumn("set", F.concat_ws("|", "set", F.col("_i").cast("string")))
    deep = _folded(deep.select("set", "root", "author", "label", "group", "x"), "deep", folds)
    plain = (CONFIGURATIONS[1],)
    third, _ = calibrated(_level(deep, "deep", None, plain).drop("x"))
    split = F.split("set", r"\|")
    hard_inner = hard_authors(third).select(F.concat_ws("|", split[0], split[1]).alias("set"), split[2].cast("int").alias("out"), "author")
    # inside the outer training sets: configurations, calibrators, thresholds
    second = _level(inner, "in", materialize(hard_inner), CONFIGURATIONS).drop("x").withColumnRenamed("set", "within").withColumn("set", F.concat_ws("/", "within", "configuration"))
    second, calibrators = calibrated(second)
    second = materialize(second)
    hard_outer = hard_authors(second.where("configuration = 'contrast'")).select(F.lit("all").alias("set"), F.split(F.split("set", "/")[0], r"\|")[1].cast("int").alias("out"), "author")
    figures = _figures(second, "set")
    # the outer folds, scored by what their training sets found
    first = _level(outer, "out", materialize(hard_outer), CONFIGURATIONS).drop("x")
    first = first.withColumn("outer_fold", F.split("fit", "/")[1].cast("int")).withColumn("set", F.concat(F.lit("o|"), F.col("outer_fold").cast("string"), F.lit("/"), F.col("configuration")))
    first = materialize(apply_calibrators(first, calibrators))
    chosen = []
    for o in k:
        of = {c.name: {**figures[f"o|{o}/{c.name}"]} for c in CONFIGURATIONS if f"o|{o}/{c.name}" in figures}
        name = choose_configuration(of)
        chosen.append((o, name, of[name]["match"], of[name]["mismatch"]))
    frozen = rows.sparkSession.createDataFrame(chosen, "outer_fold int, configuration string, match double, mismatch double")
    nested = first.join(F.broadcast(frozen), ["outer_fold", "configuration"]).withColumn("decision", M.decision(F.col("score"), F.col("match"), F.col("mismatch")))
    # development figures choose the configuration that goes into production
    pooled = _figures(first.withColumn("set", F.col("configuration")), "set")
    selected = choose_configuration(pooled)
    conf = next(c for c in CONFIGURATIONS if c.name == selected)
    dev = first.withColumn("set", F.col("configuration"))
    final, calibrator = calibrated(dev.where(F.col("configuration") == selected).drop("score"))
    hard = [r.author for r in hard_authors(dev.where("configuration = 'contrast'")).select("author").distinct().orderBy("author").collect()] if conf.weighted else []
    train = own.withColumn("fit", F.lit(selected)).withColumn("hard", F.coalesce(F.col("author").isin(hard), F.lit(False)) if hard else F.lit(False))
    verifier = fit_many(materialize(weighted(train.select("fit", "root", "author", "label", "x", "hard"))), {selected: conf.uses()})
    inside = [{"outer_fold": int(n.split("|")[1].split("/")[0]), "configuration": n.split("/")[1], **v} for n, v in figures.items()]
    bounds = pooled[selected]
    return Evaluation(nested.select("root", "label", "outer_fold", "configuration", "margin", "score", "match", "mismatch", "decision"), first.select("configuration", "root", "author", "label", "margin", "score"), inside, selected, {"match": bounds["match"], "mismatch": bounds["mismatch"]}, calibrator[selected], verifier, hard)


def contributions(rows: DataFrame, e: Evaluation, top: int = 10) -> DataFrame:
    """(root, feature, contribution, rank): the largest parts of each root's margin by the production verifier, signed; ties by name. `rows(root, FEATURES…)`; parts of features the configuration doesn't use are left out."""
    v, uses = e.verifier, next(c for c in CONFIGURATIONS if c.name == e.selected).uses()
    parts = [F.struct(F.lit(f).alias("feature"), ((F.col(f) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))).alias("contribution")) for f, m, s, w, u in zip(FEATURES, v.means[0], v.scales[0], v.weights[0], uses) if u]
    out = rows.select("root", F.posexplode(F.array_sort(F.array(*parts), lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))).alias("k", "p"))
    return out.where(F.col("k") < top).select("root", "p.feature", "p.contribution", (F.col("k") + 1).alias("rank"))


def prediction_rows(e: Evaluation, rows: DataFrame) -> DataFrame:
    """All scored rows in one table, never any prose: `nested_outer` by the thresholds frozen in each fold, and `development_oof` of the selected configuration by the production thresholds, with the signals of `rows(root, author, FEATURES…)`
    and whether a negative is hard."""
    shared = rows.select("root", "author", *FEATURES)
    outer = e.outer.select("root", "label", F.lit("nested_outer").alias("split"), F.col("margin").alias("raw_margin"), F.col("score").alias("compatibility_score"), "decision", "outer_fold", F.col("match").alias("fold_match_threshold"), F.col("mismatch").alias("fold_mismatch_threshold"), F.lit(False).alias("hard_negative"))
    match, mismatch = F.lit(e.thresholds["match"]).cast("double"), F.lit(e.thresholds["mismatch"]).cast("double")
    dev = e.development.where(F.col("configuration") == e.selected)
    neg = M.running(dev.where("label = 0").withColumn("_g", F.lit(0)).withColumn("_one", F.lit(1)), "_g", "score", "_one")
    cut = neg.where(F.col("tp") >= F.greatest(F.ceil(0.1 * F.col("all_pos")), F.lit(1))).agg(F.max("score").alias("cut"))
    dev = dev.crossJoin(F.broadcast(cut))  # one row
    hard = (F.col("label") == 0) & F.coalesce((F.col("score") >= match) | (F.col("score") >= F.col("cut")), F.lit(False))
    nothing = F.lit(None).cast("double")
    dev = dev.select("root", "label", F.lit("development_oof").alias("split"), F.col("margin").alias("raw_margin"), F.col("score").alias("compatibility_score"), M.decision(F.col("score"), match, mismatch).alias("decision"), F.lit(None).cast("int").alias("outer_fold"), nothing.alias("fold_match_threshold"), nothing.alias("fold_mismatch_threshold"), hard.alias("hard_negative"))
    return outer.unionByName(dev).join(shared, "root").withColumnRenamed("root", "root_document_id").withColumnRenamed("author", "author_id").withColumn("score", F.col("compatibility_score") / 100)


def frozen(e: Evaluation) -> dict:
    """What production keeps of an evaluation, as plain values with a digest of them."""
    v = e.verifier
    kept = {
        "configuration": e.selected, "features": list(FEATURES), "means": v.means[0].tolist(), "scales": v.scales[0].tolist(), "weights": v.weights[0].tolist(), "bias": float(v.bias[0]), "calibrator": list(e.calibrator),
        "thresholds": e.thresholds, "hard_authors": e.hard, "schema_version": 1,
    }
    return kept | {"digest": hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()}


def thawed(kept: dict) -> tuple[Fits, dict]:
    """The verifier of `frozen` values; changed values, other features and another schema are errors."""
    rest = {k: v for k, v in kept.items() if k != "digest"}
    if hashlib.sha256(json.dumps(rest, sort_keys=True).encode()).hexdigest() != kept.get("digest"):
        raise ValueError("the frozen configuration has changed since it was written")
    if kept["features"] != list(FEATURES) or kept["schema_version"] != 1:
        raise ValueError("the frozen configuration has another schema")
    one = lambda k: np.array([kept[k]], float)
    return Fits([kept["configuration"]], one("means"), one("scales"), one("weights"), np.array([kept["bias"]], float)), rest


def refit(rows: DataFrame, kept: dict) -> Fits:
    """The verifier fitted anew on `rows(root, author, label, FEATURES…)` under a frozen configuration: its features and hard authors; calibrator and thresholds stay as they were frozen."""
    _, rest = thawed(kept)
    conf = next(c for c in CONFIGURATIONS if c.name == rest["configuration"])
    hard = F.coalesce(F.col("author").isin(rest["hard_authors"]), F.lit(False)) if rest["hard_authors"] else F.lit(False)
    train = rows.where(F.col("label").isNotNull()).select(F.lit(conf.name).alias("fit"), "root", "author", "label", F.array(*(F.col(f).cast("double") for f in FEATURES)).alias("x"), hard.alias("hard"))
    train = train.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    return fit_many(materialize(weighted(train)), {conf.name: conf.uses()})
