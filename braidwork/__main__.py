"""``python -m braidwork``: convert sources, load, query and clear graphs, run the data-set pipeline."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import experiment, mappings, sparql
from .plans.store import TripleStore
from .settings import settings


def main(arguments: list[str] | None = None) -> int:
    known = settings()
    parser = argparse.ArgumentParser(prog="braidwork", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="source files to triples")
    convert.add_argument("root")
    convert.add_argument("destination")
    convert.add_argument("--targets", nargs="*", default=sorted(mappings.REGISTRY))
    convert.add_argument("--parts", nargs="*")
    convert.add_argument("--force", action="store_true")
    for name, text in (("load", "triples into a graph"), ("query", "run a query"), ("clear", "drop a graph")):
        command = commands.add_parser(name, help=text)
        command.add_argument("store", help="a folder; - for the one that the settings name")
        if name != "clear":
            command.add_argument("input", help="a folder of triples" if name == "load" else "the query")
        command.add_argument("--graph", default=known["store"]["default_graph"])
        if name == "query":
            command.add_argument("--output", help="a folder for the rows, instead of printing them")
    trial = commands.add_parser("run-experiment", help="from a graph and an ontology to folds, rules, labels and statistics")
    trial.add_argument("store")
    trial.add_argument("ontology", help="an OBO file")
    trial.add_argument("destination")
    trial.add_argument("--graph", default=known["store"]["default_graph"])
    trial.add_argument("--tables", help="a folder of expression, complex, domain and scoring tables, for the kernels")
    trial.add_argument("--targets", nargs="*", help="outputs to make and show, instead of the data set")
    trial.add_argument("--aspects", nargs="*")
    for option, kind, default in (("max-depth", int, None), ("min-annot", int, None), ("num-folds", int, 10), ("seed", int, 0), ("min-sequence-len", int, 50), ("redundancy", float, 0.6)):
        trial.add_argument(f"--{option}", type=kind, default=default)
    trial.add_argument("--force", action="store_true")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("braidwork").getOrCreate()
    if args.command == "convert":
        for target in args.targets:
            print(target, *mappings.convert(spark, args.root, target, args.parts, args.destination, args.force))
        return 0
    store = TripleStore(spark, known["store"]["path"] if args.store == "-" else args.store)
    if args.command == "run-experiment":
        options = {k: getattr(args, k) for k in ("aspects", "max_depth", "min_annot", "num_folds", "seed", "min_sequence_len", "redundancy")}
        made = experiment.run(spark, lambda: store.view(args.graph), args.ontology, args.destination, args.tables, args.targets, args.force, **options)
        for name, rows in made.items():
            print(name, *rows.columns, sep="\t")
            for row in rows.toLocalIterator():
                print(*row, sep="\t")
        return 0
    if args.command == "load":
        store.load(spark.read.parquet(args.input), args.graph)
    elif args.command == "query":
        rows = sparql.run(lambda g: store.view(g or args.graph), args.input)
        if args.output:
            rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(args.output)
        else:
            print(*rows.columns, sep="\t")
            for row in rows.toLocalIterator():  # all rows, of which the driver holds a partition at a time
                print(*row, sep="\t")
    else:
        store.clear(args.graph)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
