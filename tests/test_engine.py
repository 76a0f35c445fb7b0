import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import learn, nested
from scriptorium.operators import metrics as M
from scriptorium.operators import segments
from scriptorium.plans.engine import SIGNALS, Engine, Settings, embed, highlight_ranges, projection_encoder, write_report
from scriptorium.streaming import scoring

OWN = "I walk to the harbour and I watch the boats. The boats are small and the water is grey! We talk, we laugh, and we go home. "
OTHER = "Quarterly revenue exceeded projections; consequently, management recommended accelerating infrastructure investment. "


def test_bank_round_trip_and_scores(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", OWN * (3 + i)) for i in range(4)] + [("copy", OWN * 3), ("none", None)], "document_id string, text string")
    engine = Engine.build(docs)
    assert engine.measures.count() == 4
    path = str(tmp_path / "bank")
    engine.save(path)
    engine = Engine.load(spark, path)
    cands = spark.createDataFrame([("own", OWN * 5), ("other", OTHER * 12), ("tiny", "two words"), ("none", None)], "candidate_id string, text string")
    s = {r.candidate_id: r for r in engine.score(cands).collect()}
    assert set(s) == {"own", "other"} and s["own"].score > s["other"].score and 0 <= s["other"].score <= 100 and s["own"].evidence_strength in ("LOW", "MEDIUM")
    spread = engine.spread()
    for x in SIGNALS:  # components are the signals against the bank's own history
        median, mad, std, n = spread[x]
        z = max(-30.0, min(30.0, (getattr(s["own"], x) - median) / max(1.4826 * mad, 0.25 * std, 0.05)))
        assert n == 4 and getattr(s["own"], f"{x}_component") == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    one = cands.where("candidate_id = 'other'")
    assert engine.deviations(one).count() == 5 and engine.analogues(one).count() == 3 and engine.best_documents(one).count() == 4
    f = engine.features(one).collect()
    assert len(f) == 10 and {r.side for r in f} == {"match", "mismatch"} and all(r.text.startswith(r.label) for r in f)
    assert abs(max(r.robust_z for r in f if r.side == "match")) <= min(abs(r.robust_z) for r in f if r.side == "mismatch")
    assert {r.warning.split()[0] for r in engine.warnings(cands).collect()} >= {"the", "fewer"}
    with pytest.raises(ValueError, match="fast or deep"):
        engine.highlights(one, "slow")
    assert {r.severity for r in engine.highlights(cands, "fast").collect()} <= {"high", "medium", "low"}
    e = engine.evaluation().collect()
    assert len(e) == 4 and all(0 <= r.score <= 100 and r.spread == pytest.approx(max(r[x] for x in SIGNALS) - min(r[x] for x in SIGNALS)) for r in e)
    changed = embed(engine.passages.select("document_id", "passage_id", "text"), lambda t: 1 / 0, engine.settings, engine.passages.select("embedding_key", "embedding").dropDuplicates(["embedding_key"]))
    assert changed.count() == engine.passages.count()  # all from the cache
    with pytest.raises(Exception, match="not finite"):
        embed(engine.passages.select("document_id", "text"), lambda t: projection_encoder(t) * float("nan"), Settings()).collect()
    engine.measures.limit(2).write.mode("overwrite").parquet(path + "/history")
    with pytest.raises(ValueError, match="changed"):
        Engine.load(spark, path)
    with pytest.raises(ValueError, match="at most"):
        write_report(spark.range(5), str(tmp_path / "r.html"), most=4)
    write_report(spark.createDataFrame([("<b>", 0.5)], "a string, b double"), str(tmp_path / "r.html"))
    assert "&lt;b&gt;" in (tmp_path / "r.html").read_text()
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "draft.txt").write_text(OWN * 4)
    q = scoring.score_stream(engine, scoring.drafts(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.candidate_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["draft.txt"]


def test_character_signal_by_passages_counts_missing_pairs(spark):
    greek = "Πηγαίνω στο λιμάνι και βλέπω τις βάρκες κάθε πρωί. "
    docs = [("a", OWN * 3), ("b", OTHER * 30), ("g", greek * 8), ("h", greek * 5)]
    engine = Engine.build(spark.createDataFrame(docs, "document_id string, text string"))
    texts = [("same", OWN * 3), ("long", OWN * 14 + "\n\n" + OTHER * 30)]
    got = {r.candidate_id: r.character for r in engine.signals(spark.createDataFrame(texts, "candidate_id string, text string")).collect()}
    bank = [(r.document_id, r.text) for r in engine.passages.collect()]
    own = [(r.document_id, r.text) for r in segments.passages(spark.createDataFrame(texts, "document_id string, text string")).collect()]
    assert len([1 for d, _ in own if d == "long"]) > 1
    grams = lambda t: Counter(t[i : i + n] for t in [re.sub(r"\s\s+", " ", t.lower())] for n in (3, 4, 5) for i in range(len(t) - n + 1))
    df = Counter(g for _, t in bank for g in set(grams(t)))

    def vector(t):
        w = {g: (1 + math.log(c)) * (math.log((1 + len(bank)) / (1 + df[g])) + 1) for g, c in grams(t).items() if g in df}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        return {g: x / norm for g, x in w.items()}

    for name, _ in texts:
        each = []
        for d, _ in docs:
            s = np.array([[sum(x * v.get(g, 0) for g, x in u.items()) for v in (vector(t) for k, t in bank if k == d)] for u in (vector(t) for k, t in own if k == name)])
            each.append((s.max(1).mean() + s.max(0).mean()) / 2)
        assert got[name] == pytest.approx(np.median(each), abs=1e-9)


def test_history_leaves_a_document_and_what_it_shares_out(spark):
    greek = "Πηγαίνω στο λιμάνι και βλέπω τις βάρκες κάθε πρωί. "
    long = " ".join(f"word{i}" for i in range(40)) + "."
    docs = [("a", OWN * 4), ("b", OTHER * 20), ("c", greek * 9), ("d", "Quite different lines on lamps. " * 12 + "\n\n" + long), ("e", "Again other lines, on ropes. " * 12 + "\n\n" + long)]
    engine = Engine.build(spark.createDataFrame(docs, "document_id string, text string"))
    got = {r.document_id: r for r in engine.history.collect()}
    ps = [(r.document_id, np.array(r.embedding, float)) for r in engine.passages.collect()]
    assert len(ps) == 5
    for d, v in ps:
        left = [u for k, u in ps if k != d and not {d, k} == {"d", "e"}]  # d and e share a long paragraph
        assert got[d].authorship == pytest.approx(np.median([v @ u / np.linalg.norm(v) / np.linalg.norm(u) for u in left]), abs=1e-6)


def test_ranges_do_not_overlap(spark):
    s = spark.createDataFrame([("c", 0, 10, 6.0), ("c", 5, 15, 3.0), ("c", 12, 18, 2.5), ("c", 20, 30, 2.0), ("c", 40, 50, 0.5), ("c", None, 3, 9.0), ("n", 1, 2, None)], "candidate_id string, start_char int, end_char int, effect double")
    # the third overlaps only the second, which was itself not taken
    assert [(r.start_char, r.severity) for r in highlight_ranges(s).orderBy("start_char").collect()] == [(0, "high"), (12, "medium"), (20, "medium"), (40, "low")]
    many = spark.createDataFrame([("c", i, i + 60, 100.0 - i) for i in range(60)] + [("c", 200 + 10 * i, 205 + 10 * i, 1.0) for i in range(20)], "candidate_id string, start_char int, end_char int, effect double")
    assert highlight_ranges(many).count() == 10


def scored_rows(rng, n):
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.5)
        f = rng.normal(0.35 + 0.25 * y, 0.15, 8)
        rows.append((f"r{i}", None if y or i % 7 == 0 else f"a{i % 9}", y, *map(float, f)))
    return rows


def test_fits_at_once_equal_newton_one_by_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    x[:, 2] = 5.0
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    w, b = rng.uniform(0.5, 2, 200), rng.uniform(0.5, 2, 200)
    rows = [(f, y[i].item(), x[i].tolist(), float(w[i]), float(b[i])) for f in ("p", "q") for i in range(200) if f == "p" or i % 2]
    fits = nested.fit_many(spark.createDataFrame(rows, "fit string, label int, x array<double>, w double, b double"), {"p": np.array([True, True, True]), "q": np.array([True, False, True])})
    for k, (name, some) in enumerate((("p", np.arange(200)), ("q", np.arange(1, 200, 2)))):
        xs, ys, ws, bs = x[some], y[some], w[some], b[some]
        mean = ws @ xs / ws.sum()
        scale = np.sqrt(ws @ (xs - mean) ** 2 / ws.sum())
        scale[scale < 1e-12] = 1
        z = np.column_stack([(xs - mean) / scale, np.ones(len(xs))])
        if name == "q":
            z[:, 1] = 0
        beta = np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ beta))
            pen = np.array([1, 1, 1, 0])
            beta -= np.linalg.solve(0.1 * (z * (bs * p * (1 - p))[:, None]).T @ z + np.diag(pen) + 1e-12 * np.eye(4), 0.1 * z.T @ (bs * (p - ys)) + pen * beta)
        assert np.allclose(np.append(fits.weights[k], fits.bias[k]), beta, atol=1e-6) and fits.weights[k][2] == pytest.approx(0, abs=1e-9)


def test_nested_evaluation_never_sees_what_it_scores(spark):
    rows = scored_rows(np.random.default_rng(5), 150)
    df = spark.createDataFrame([*rows, ("bad", None, 1, float("nan"), *[0.5] * 7), ("null", None, None, *[0.5] * 8)], "root string, author string, label int, " + ", ".join(f"{f} double" for f in nested.FEATURES))
    e = nested.evaluate(df)
    out = e.outer.collect()
    assert len(out) == 150 and len({r.root for r in out}) == 150 and {r.outer_fold for r in out} == {0, 1, 2}
    fold = {r.root: r.outer_fold for r in out}
    by_author = {}
    for root, author, *_ in rows:
        if author:
            by_author.setdefault(author, set()).add(fold[root])
    assert all(len(v) == 1 for v in by_author.values())  # authors of negatives stay whole
    assert len(e.figures) == 15 and e.selected in {c.name for c in nested.CONFIGURATIONS} and e.calibrator[0] > 0
    best = np.mean([r.score > 50 for r in out if r.label == 1]) + np.mean([r.score < 50 for r in out if r.label == 0])
    assert best > 1.7 and {r.decision for r in out} <= {"MATCH", "MISMATCH", "INCONCLUSIVE", "INCONCLUSIVE_OR_MISMATCH"}
    assert len({(r.outer_fold, r.configuration, r.match, r.mismatch) for r in out}) == 3
    good = df.where("root not in ('bad', 'null')")
    parts = nested.contributions(good, e, 3).collect()
    assert len(parts) == 450 and all(abs(a.contribution) >= abs(b.contribution) for a, b in zip(parts, parts[1:]) if a.root == b.root and a["rank"] < b["rank"])
    table = nested.prediction_rows(e, good).collect()
    assert len(table) == 300 and {r.split for r in table} == {"nested_outer", "development_oof"} and not any(r.hard_negative and r.label for r in table)
    assert sum(r.hard_negative for r in table) >= np.ceil(0.1 * sum(r.label == 0 for r in out))
    kept = json.loads(json.dumps(nested.frozen(e)))
    fits, _ = nested.thawed(kept)
    again = nested.refit(good, kept)
    assert np.allclose(fits.weights, e.verifier.weights) and np.allclose(again.weights, e.verifier.weights, atol=1e-6)
    with pytest.raises(ValueError, match="changed"):
        nested.thawed(kept | {"bias": 9.0})
    with pytest.raises(ValueError, match="too few"):
        nested.evaluate(df.where("label = 1"))


def test_half_precision_gate_holds_exactly_at_its_limits():
    fine = {"decision_agreement": 1.0, "mean_drift": 0.5, "max_drift": 1.5, "auroc_decline": 0.005, "brier_increase": 0.005, "speedup": 0.2}
    assert learn.accept_half_precision(fine)
    for k, v in {"decision_agreement": 0.99, "mean_drift": 0.51, "max_drift": 1.51, "auroc_decline": 0.006, "brier_increase": 0.006, "speedup": 0.19}.items():
        assert not learn.accept_half_precision(fine | {k: v})


def test_encoding_halves_batches_and_rejects_long_passages(spark):
    from scriptorium.plans.engine import _encoded

    sizes = []

    def small(texts):
        sizes.append(len(texts))
        if len(texts) > 2:
            raise MemoryError
        return np.ones((len(texts), 4))

    assert _encoded(small, ["a"] * 5, 8).shape == (5, 4) and max(sizes[-3:]) <= 2
    with pytest.raises(MemoryError):
        _encoded(lambda t: (_ for _ in ()).throw(MemoryError()), ["a"], 1)
    long = spark.createDataFrame([("d", "word " * 5000)], "document_id string, text string")
    with pytest.raises(Exception, match="more than 4096 tokens"):
        embed(long, projection_encoder, Settings()).collect()


def test_configurations_are_adopted_only_for_a_gain():
    base = {"tpr_at_5": 0.5, "auroc": 0.9, "tpr": 0.8, "brier": 0.1}
    better = base | {"tpr_at_5": 0.6}
    assert nested.choose_configuration({"baseline": base, "contrast": base}) == "baseline"
    assert nested.choose_configuration({"baseline": base, "contrast": better}) == "contrast"
    assert nested.choose_configuration({"baseline": base, "contrast": better | {"auroc": 0.889}}) == "baseline"
    assert nested.choose_configuration({"baseline": base, "contrast": better | {"auroc": 0.89}}) == "contrast"
    assert nested.choose_configuration({"baseline": base, "contrast": better | {"brier": 0.11}}) == "baseline"
    assert nested.choose_configuration({"baseline": base, "contrast": better | {"tpr": 0.76}}) == "baseline"
    best = base | {"tpr_at_5": 0.7}
    assert nested.choose_configuration({"baseline": base, "contrast": better, "hard_negative_weighting": best, "hard_negative_weighting_without_character": best}) == "hard_negative_weighting_without_character"
    assert nested.choose_configuration({"baseline": base, "contrast": better, "hard_negative_weighting": best, "hard_negative_weighting_without_character": best | {"tpr_at_5": 0.68}}) == "hard_negative_weighting"
    assert nested.choose_configuration({"baseline": base, "contrast": base, "without_character": better}) == "without_character"
    assert nested.choose_configuration({"baseline": base, "contrast": best, "without_character": better}) == "contrast"


def test_verifier_and_calibrator(spark):
    rows = [(f"r{i}", None if i % 2 else f"a{i % 3}", i % 2, float(i % 2) + (i * 7 % 13) / 13, float(i % 5), 1.0) for i in range(60)] + [("bad", None, 1, float("nan"), 1.0, 1.0)]
    df = M.balanced(M.root_weights(spark.createDataFrame(rows, "root string, author string, label int, x double, y double, const double")))
    v = learn.fit_verifier(df, ["x", "y", "const"])
    assert v.weights[0] > 0 and v.scales[2] == 1.0
    twice = M.balanced(M.root_weights(df.select("root", "author", "label", "x", "y", "const").union(df.select("root", "author", "label", "x", "y", "const"))))
    again = learn.fit_verifier(twice, ["x", "y", "const"])
    assert all(abs(a - b) < 1e-6 for a, b in zip(v.weights, again.weights))  # repeated views change nothing
    m = df.withColumn("margin", v.margin())
    a, b = learn.fit_calibrator(m)
    assert a > 0
    top = m.where("x > 1").select(v.contributions(2).alias("c")).first().c
    assert len(top) == 2 and top[0].feature == "x"
    with pytest.raises(ValueError):
        learn.fit_calibrator(m.where("label = 1"))
    assert learn.choose_verifier({"auroc": 0.8, "tpr_at_5": 0.5}, {"auroc": 0.82, "tpr_at_5": 0.5}) == "boosted"
    assert json.dumps(v.features) == '["x", "y", "const"]' and m.where(F.col("margin").isNull()).count() == 0
