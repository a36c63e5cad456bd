"""Command line: ingest, query, search, evaluate, ablate, log."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .config import load_config
from .operators.chunking import chunk_corpus
from .operators.evaluation import explain_trace
from .plans.engine import Engine, ablations
from .sources.corpus import append_traces, read_corpus, read_gold, read_traces, write_chunks


def main() -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("command", choices=("ingest", "query", "search", "evaluate", "ablate", "log"))
    parser.add_argument("text", nargs="?", default="")
    parser.add_argument("--docs"), parser.add_argument("--forum"), parser.add_argument("--blog"), parser.add_argument("--gold")
    parser.add_argument("--config"), parser.add_argument("--set", action="append", default=[])
    parser.add_argument("--out", default="out"), parser.add_argument("--log", default="traces"), parser.add_argument("--explain", action="store_true"), parser.add_argument("-n", type=int, default=20)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    config = load_config(args.config, args.set)
    if args.command == "log":
        read_traces(spark, args.log, args.n, args.text or None).show(truncate=80)
        return
    corpus = read_corpus(spark, args.docs, args.forum, args.blog)
    if args.command == "ingest":
        write_chunks(chunk_corpus(corpus, config), args.out)
    elif args.command == "ablate":
        ablations(spark, corpus, read_gold(spark, args.gold), config).show(truncate=False)
    else:
        engine = Engine.build(corpus, config)
        one = spark.createDataFrame([("q", args.text)], "qid string, query string")
        if args.command == "search":
            engine.search(one).orderBy("arm", "source", "rank").show(100, truncate=False)
        elif args.command == "evaluate":
            scores, row = engine.evaluate(read_gold(spark, args.gold))
            row.show(truncate=False)
            print("ndcg10 95 % interval", engine.confidence(scores))
        else:
            run = engine.run(one)
            append_traces(run.traces, args.log)
            for line in run.traces.toJSON().collect():
                print(explain_trace(json.loads(line)) if args.explain else json.loads(line)["answer_text"])
    spark.stop()


if __name__ == "__main__":
    main()
