"""Score a CSV file of pairs from the command line."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import fields

from contagraph.functions.parameters import NaturalHistory

log = logging.getLogger("contagraph")
SCORE = "linkage_score"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contagraph", description="Score pairs of cases for recent transmission.")
    p.add_argument("input", help="CSV file with sample_time_difference and genetic_distance")
    p.add_argument("-o", "--output", help="CSV file; else standard output")
    p.add_argument("--mc-samples", type=int, default=10_000)
    p.add_argument("--maximum-depth", type=int, default=2)
    p.add_argument("--target", nargs="+", default=["ad(0)"])
    p.add_argument("--mutation-process", choices=("deterministic", "stochastic"), default="stochastic")
    p.add_argument("--seed", type=int, help="makes a run repeatable")
    p.add_argument("-v", "--verbose", action="store_true")
    for f in fields(NaturalHistory):
        # the command line's own default for this one is 1
        default = 1.0 if f.name == "testing_delay_shape" else f.default
        p.add_argument("--" + f.name.replace("_", "-"), type=int if f.name == "genome_length" else float, default=default)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(levelname)s %(message)s")
    try:
        from pyspark.sql import SparkSession

        from contagraph.functions.profiles import FromInfectiousness
        from contagraph.operators.scorer import LinkageModel
        from contagraph.plans.shared import discard_all
        from contagraph.sources.csv_io import read_observations, write_csv

        spark = SparkSession.builder.appName("contagraph").getOrCreate()
        obs = read_observations(spark, args.input, keep_order=True)
        parameters = NaturalHistory(**{f.name: getattr(args, f.name) for f in fields(NaturalHistory)})
        profile = FromInfectiousness(parameters, rng_seed=args.seed)
        model = LinkageModel(spark, profile, args.maximum_depth, args.mc_samples, args.target, args.mutation_process)
        write_csv(model.score_target(obs, out=SCORE), args.output or sys.stdout)
        discard_all(spark)
        log.info("scored %s", args.input)
    except Exception as e:
        log.error("%s", e)
        sys.exit(1)


if __name__ == "__main__":
    main()
