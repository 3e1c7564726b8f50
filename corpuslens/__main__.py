"""Command line: crawl, answer, analyse and evaluate."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens.operators import bm25, validate
from corpuslens.operators.classify import Endpoint
from corpuslens.plans import analysis, crawl, report, retrieval
from corpuslens.session import ship_package
from corpuslens.sources import readers, web


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corpuslens")
    commands = parser.add_subparsers(dest="command", required=True)

    c = commands.add_parser("crawl", help="read pages into page documents")
    c.add_argument("--output", required=True)
    c.add_argument("--collections", nargs="+", default=["all"], choices=["all", *fv.INDEX_URLS])
    c.add_argument("--delay", type=float, default=0.75)
    c.add_argument("--timeout", type=float, default=45)
    c.add_argument("--user-agent", default="corpuslens/1.0")
    c.add_argument("--no-raw-html", action="store_true")
    c.add_argument("--use-cache", action="store_true")
    c.add_argument("--ignore-robots", action="store_true")

    a = commands.add_parser("answer", help="classify questions, going on where a run stopped")
    a.add_argument("--questions", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--pages", nargs="*", default=[], help="page JSON folders; none answers without retrieval")
    a.add_argument("--prompts", nargs="+", default=fv.PROMPTS, choices=fv.PROMPTS)
    a.add_argument("--model")
    a.add_argument("--top-k", type=int, default=fv.TOP_K)
    a.add_argument("--first", type=int)
    a.add_argument("--workers", type=int, default=8, help="requests at a time in a task")
    a.add_argument("--tasks", type=int, help="tasks that send requests; by default one for each 200")
    a.add_argument("--max-attempts", type=int, default=3)

    r = commands.add_parser("analyse", help="compare the answers of both conditions")
    r.add_argument("--questions", required=True)
    r.add_argument("--rag-dir", required=True)
    r.add_argument("--non-rag-dir", required=True)
    r.add_argument("--output", required=True)

    e = commands.add_parser("evaluate", help="metrics of one folder of answers")
    e.add_argument("--questions", required=True)
    e.add_argument("--results-dir", required=True)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = ship_package(SparkSession.builder.appName(f"corpuslens {args.command}").getOrCreate())
    if args.command == "crawl":
        manifest = crawl.crawl(
            spark, args.output, collections=args.collections, user_agent=args.user_agent, use_cache=args.use_cache,
            robots_text=None if args.ignore_robots else web.robots_rules(), keep_html=not args.no_raw_html,
            delay=args.delay, timeout=args.timeout,
        )
        print(manifest)
    elif args.command == "answer":
        validate.require_at_least_one(top_k=args.top_k, workers=args.workers, max_attempts=args.max_attempts)
        endpoint = Endpoint.from_environment(args.model).check(batch=True)
        rows = readers.read_questions(spark, args.questions)
        validate.require_none(validate.question_violations(rows, ["id", "question"]))
        chosen = readers.first_questions(rows, args.first).select(F.col("id").alias("question_id"), "question")
        index = bm25.build_index(retrieval.load_chunks(spark, args.pages)) if args.pages else None
        left = retrieval.resume(
            chosen, args.prompts, endpoint, args.output, index=index, k=args.top_k, attempts=args.max_attempts,
            threads=args.workers, tasks=args.tasks,
        ).count()
        if index:
            index.close()
        print(f"{left} answers are still missing")
        return 1 if left else 0
    elif args.command == "evaluate":
        rows, common = analysis.evaluate(spark, args.questions, args.results_dir)
        names = ["prompt"] + [f for f in fv.METRIC_FIELDS if f not in ("scope", "condition", "prompt")]
        print(",".join(names))
        for row in rows:
            print(",".join(report.rate(row.get(name)) for name in names))
        print(f"questions answered under all prompts: {common}")
    else:
        analysis.run(spark, args.questions, {"rag": args.rag_dir, "non_rag": args.non_rag_dir}, args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
