"""Command line: build a bank, score or explain a text, report metrics."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scriptorium")
    sub = p.add_subparsers(dest="verb", required=True)
    b = sub.add_parser("build", help="bank from a folder of Markdown")
    b.add_argument("corpus")
    b.add_argument("bank")
    for verb in ("score", "explain"):
        s = sub.add_parser(verb)
        s.add_argument("bank")
        s.add_argument("file", nargs="?")
        s.add_argument("--text")
        s.add_argument("--format", choices=("markdown", "email", "plain"), default="markdown")
        if verb == "explain":
            s.add_argument("--mode", choices=("fast", "deep"), default="deep")
    e = sub.add_parser("evaluate", help="ranking metrics of a table of scored rows")
    e.add_argument("predictions")
    e.add_argument("--freeze", help="run the nested evaluation and write what production keeps of it to this JSON file")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from scriptorium.functions import cleaning
    from scriptorium.operators import metrics
    from scriptorium.plans.engine import Engine
    from scriptorium.sources.markdown import load_markdown

    builder = SparkSession.builder
    if SparkSession.getActiveSession() is None and not os.environ.get("SPARK_CONF_DIR"):  # a command on one machine
        builder = builder.config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='scriptorium-')}")
    spark = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if a.verb == "build":
            Engine.build(load_markdown(spark, a.corpus).select("document_id", F.col("clean_text").alias("text"))).save(a.bank)
        elif a.verb == "evaluate":
            r = metrics.running(spark.read.parquet(a.predictions).distinct(), "split")
            for row in metrics.auroc(r, "split").join(metrics.average_precision(r, "split"), "split").join(metrics.thresholds(r, "split"), "split").collect():
                print(json.dumps(row.asDict()))
            if a.freeze:
                from scriptorium.operators import nested
                from scriptorium.plans.model_queries import development_rows

                found = nested.evaluate(development_rows(spark.read.parquet(a.predictions)))
                for figures in found.figures:
                    print(json.dumps({k: figures[k] for k in ("outer_fold", "configuration", "auroc", "tpr_at_5", "tpr", "brier")}))
                Path(a.freeze).write_text(json.dumps(nested.frozen(found), indent=1), encoding="utf-8")
        else:
            if (a.text is None) == (a.file is None):
                raise ValueError("give either a file or --text")
            text = a.text if a.text is not None else Path(a.file).read_text(encoding="utf-8")
            text = {"markdown": cleaning.clean_markdown, "email": cleaning.clean_email, "plain": str}[a.format](text)
            one = spark.createDataFrame([("text", text)], "candidate_id string, text string")
            engine = Engine.load(spark, a.bank)
            rows = engine.score(one).collect()
            if not rows:
                raise ValueError("the text has fewer than three words")
            out = rows[0].asDict()
            if a.verb == "explain":
                out["features"] = [r.asDict() for r in engine.features(one).orderBy("side", "rank").collect()]
                out["weakest_passages"] = [r.asDict() for r in engine.weakest_passages(one).orderBy("rank").collect()]
                out["highlights"] = [r.asDict() for r in engine.highlights(one, a.mode).orderBy("start_char").collect()]
                out["best_documents"] = [r.asDict() for r in engine.best_documents(one).orderBy(F.desc("similarity"), "document_id").limit(10).collect()]
                out["analogues"] = [r.asDict() for r in engine.analogues(one).orderBy("rank").collect()]
            out["warnings"] = [r.warning for r in engine.warnings(one).collect()]
            print(json.dumps(out, ensure_ascii=False))
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
