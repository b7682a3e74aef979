"""python -m graphweave.plans --indexes FOLDER --dataset cases.jsonl --output report.json"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import evaluate, indexing


def main() -> None:
    parser = argparse.ArgumentParser(description="Run an evaluation set over stored indexes.")
    for name in ("indexes", "dataset", "output"):
        parser.add_argument(f"--{name}", required=True)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("graphweave-evaluate").getOrCreate()
    cases, out = evaluate.read_cases(spark, args.dataset), None
    for index_id in [r[0] for r in cases.select("index_id").distinct().orderBy("index_id").collect()]:
        got = evaluate.run(indexing.load(spark, args.indexes, index_id), cases.filter(cases["index_id"] == index_id))
        out = got if out is None else out.unionByName(got)
    if out is not None:
        evaluate.write_report(out, args.output)


if __name__ == "__main__":
    main()
