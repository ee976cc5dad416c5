"""Command line: detect, evaluate, addresses, bootstrap, export, export-masking, experiment, plan, summary, stats, to-array.

Errors in arguments or inputs end with status 2, failed conversations with 1.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from velaspan import runs
from velaspan.operators import evaluation as E
from velaspan.operators import export as X
from velaspan.operators import generation as G
from velaspan.operators import matching as M
from velaspan.sources import configs, tables


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="velaspan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    detect = commands.add_parser("detect", help="regex predictions of conversations")
    for name in ("--input", "--output"):
        detect.add_argument(name, required=True)
    detect.add_argument("--rules", default=str(M.CONFIGS / "rules.json"), help="rules of a configuration; by default those of the package")
    evaluate = commands.add_parser("evaluate", help="exact-match report of predictions")
    for name in ("--input", "--gold", "--predictions", "--output"):
        evaluate.add_argument(name, required=True)
    evaluate.add_argument("--types", nargs="+", default=list(M.MASKING_TYPES))
    evaluate.add_argument("--focus", nargs="*", default=[])
    addresses = commands.add_parser("addresses", help="coverage of addresses by predicted locations")
    for name in ("--input", "--gold", "--predictions", "--output"):
        addresses.add_argument(name, required=True)
    boot = commands.add_parser("bootstrap", help="paired bootstrap of several models")
    for name in ("--input", "--gold", "--addresses", "--output"):
        boot.add_argument(name, required=True)
    boot.add_argument("--model", action="append", required=True, metavar="NAME=PREDICTIONS")
    boot.add_argument("--replicates", type=int, default=10_000)
    boot.add_argument("--seed", type=int, default=20261014)
    boot.add_argument("--confidence", type=float, default=0.95)
    for name, what in (("export", "inputs, gold and views of generated records"), ("export-masking", "the same in the older masking format")):
        export = commands.add_parser(name, help=what)
        export.add_argument("--input", action="append", required=True)
        export.add_argument("--output", required=True)
    experiment = commands.add_parser("experiment", help="check an experiment's configuration, inputs and gold")
    experiment.add_argument("--config", required=True)
    experiment.add_argument("--root", default=".")
    plan = commands.add_parser("plan", help="rows of a stratified plan")
    for name in ("--plan", "--scenarios", "--output"):
        plan.add_argument(name, required=True)
    plan.add_argument("--seed", type=int, default=42)
    summary = commands.add_parser("summary", help="states of a run's stored answers")
    for name in ("--prompts", "--answers", "--deployment"):
        summary.add_argument(name, required=True)
    stats = commands.add_parser("stats", help="counts of checked catalogues")
    for name in ("--names", "--surnames", "--towns", "--streets", "--surveys"):
        stats.add_argument(name, required=True)
    array = commands.add_parser("to-array", help="JSON lines as one indented JSON array")
    for name in ("--input", "--output"):
        array.add_argument(name, required=True)
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"velaspan {args.command}").getOrCreate()
    try:
        if getattr(args, "output", None) and Path(args.output).exists():
            raise ValueError("the output exists already")
        if args.command == "detect":
            rules = M.read_rules(args.rules)
            got = runs.predict_regex(runs.conversations(spark, args.input), rules)
            for name in ("detections", "spans", "outcomes"):
                tables.write_json_lines(getattr(got, name), f"{args.output}/{name}")
            states = {r["state"]: r["n"] for r in got.outcomes.groupBy("state").agg(F.count("*").alias("n")).collect()}
            print(json.dumps(states))
            return int(E.FAILED in states)
        if args.command == "evaluate":
            result = runs.evaluate_files(spark, args.input, args.gold, args.predictions, args.types, args.focus)
            tables.write_report(result, args.output)
            print(json.dumps(result["span_esatti_micro"]))
        elif args.command == "addresses":
            result = runs.addresses_files(spark, args.input, args.gold, args.predictions)
            tables.write_report(result, args.output)
            print(json.dumps({k: result[k] for k in ("full_address", "outcomes")}))
        elif args.command == "bootstrap":
            models = dict(m.partition("=")[::2] for m in args.model)
            result = runs.bootstrap_files(spark, args.input, args.gold, args.addresses, models, args.replicates, args.seed, args.confidence)
            tables.write_report(result, args.output)
            print(result["markdown"])
        elif args.command in ("export", "export-masking"):
            records = runs.records_of(spark, args.input)
            got = X.exported(records) if args.command == "export" else X.masking_exported(records)
            got.write(args.output)
            print(json.dumps(got.manifest.first().asDict(True)))
        elif args.command == "experiment":
            e = configs.read_experiment(args.config)
            inputs, gold = f"{args.root}/{e.input}", f"{args.root}/{e.gold}"
            messages = runs.conversations(spark, inputs)
            none = spark.createDataFrame([], "id string, state string, error string")
            spans = runs.flat_spans(spark, gold)
            E.require(E.problems(messages, spans, runs.gold_ids(spark, gold), spans.limit(0), none, e.allowed), messages)
            print(json.dumps({"models": [m.name for m in e.models], "conversations": messages.select("id").distinct().count(), "evaluated": list(e.types), "focus": list(e.focus)}))
        elif args.command == "plan":
            own = tables.config(args.plan)
            rows = G.plan_rows(spark, own, configs.scenarios(spark, args.scenarios), args.seed)
            if (bad := G.plan_problems(rows, own["totale"]).first()) is not None:
                raise ValueError(f"the plan gives {bad['rows']} rows with {bad['ids']} ids instead of {own['totale']}")
            tables.write_json_lines(rows, args.output)
            print(json.dumps({r["batch"]: r["count"] for r in rows.groupBy("batch").count().orderBy("batch").collect()}))
        elif args.command == "summary":
            prompts = tables.json_lines(spark, args.prompts, "id string, seed long, versione_prompt string")
            answers = tables.json_lines(spark, args.answers, "id string, prompt struct<seed:long,versione_prompt:string>, deployment string, provider string, stato string").select("id", "prompt.*", "deployment", "provider", F.col("stato").alias("state"))
            if bad := X.run_problems(prompts, answers, ["seed", "versione_prompt"], args.deployment, "openai").limit(5).collect():
                raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
            print(json.dumps(X.run_summary(prompts, answers).first().asDict()))
        elif args.command == "stats":
            print(json.dumps(tables.catalogue(spark, args.names, args.surnames, args.towns, args.streets, args.surveys)["stats"].first().asDict()))
        else:
            if not (bad := tables.malformed_lines(spark, args.input)).isEmpty():
                raise ValueError(f"line {bad.first()['line']} is no JSON")
            rows = spark.read.text(args.input).where("trim(value) <> ''")
            Path(args.output).write_text(json.dumps([json.loads(r["value"]) for r in rows.toLocalIterator()], ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    except (ValueError, OSError, KeyError, PySparkException) as error:
        parser.exit(2, f"velaspan: {str(error).splitlines()[0]}\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
