"""Command line: segment a cloud, generate a room, convert annotated rooms, score a report."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from cairn.config import PipelineConfig, load_config
from cairn.plans import scene
from cairn.sinks import writers
from cairn.sources.reports import evaluate_files
from cairn.sources.synthetic import synthetic_room
from cairn.sources.text import read_annotated_room


def _arguments(words: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="cairn", description=__doc__)
    top.add_argument("--verbose", action="store_true")
    command = top.add_subparsers(dest="command", required=True)
    one = command.add_parser("segment", help="a cloud to a labelled cloud, a report and map layers")
    one.add_argument("--input", required=True)
    one.add_argument("--config")
    one.add_argument("--no-topdown", action="store_true")
    one = command.add_parser("generate", help="a synthetic room as .ply")
    one.add_argument("--output", required=True)
    one.add_argument("--layout", choices=("rectangular", "l-shaped"), default="rectangular")
    one.add_argument("--density", type=int, default=10_000)
    one.add_argument("--seed", type=int, default=0)
    one.add_argument("--no-noise", action="store_true")
    one = command.add_parser("convert", help="a room of annotation files as .ply")
    one.add_argument("--input", required=True)
    one.add_argument("--output", required=True)
    one = command.add_parser("evaluate", help="scores of a report's labels against true ones")
    one.add_argument("--predicted", required=True)
    one.add_argument("--truth", required=True)
    return top.parse_args(words)


def _told(scores: dict) -> list[str]:
    """A line for each label that occurs, then the accuracy."""
    rows = scores["per_class"].where("support > 0 or predicted > 0").orderBy("label").collect()  # one for each label
    lines = [f"{'label':20} {'precision':>9} {'recall':>9} {'f1':>9} {'support':>9}"]
    lines += [f"{r.label:20} {r.precision:9.4f} {r.recall:9.4f} {r.f1:9.4f} {r.support:9d}" for r in rows]
    return [*lines, f"accuracy {scores['accuracy'].first()[0]:.4f}"]


def main(words: list[str] | None = None) -> None:
    args = _arguments(words)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(message)s")
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    if args.command == "segment":
        config = load_config(args.config) if args.config else PipelineConfig()
        found = scene.run(spark, args.input, config, topdown=not args.no_topdown)
        for stage, seconds in found.seconds.items():
            print(f"{stage:12} {seconds:8.1f} s")
        print(f"{found.planes.count()} planes, {found.clusters.count()} objects; {config.output.report}")
    elif args.command == "generate":
        room = synthetic_room(spark, density=args.density, layout=args.layout, noise=not args.no_noise, seed=args.seed)
        print(writers.write_ply(room, args.output))
    elif args.command == "convert":
        print(writers.write_ply(read_annotated_room(spark, args.input), args.output))
    else:
        print("\n".join(_told(evaluate_files(spark, args.predicted, args.truth))))


if __name__ == "__main__":
    main()
