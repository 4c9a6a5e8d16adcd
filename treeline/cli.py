"""Command line: python -m treeline.cli DATASET [FOLDER] [options]."""

from __future__ import annotations

import argparse
import json
import random

from pyspark.sql import SparkSession

from treeline import profile
from treeline.operators import counting, joins, padding
from treeline.sources import datasets, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeline", description="Acyclic joins over a join tree.")
    p.add_argument("dataset", choices=["sample", "full-ternary", "star4", "star15", *datasets.SHAPES, *datasets.TREES])
    p.add_argument("folder", nargs="?", help="text tables of a shape, or Parquet tables of a tree")
    p.add_argument("--strategy", choices=list(joins.STRATEGIES), default="native")
    p.add_argument("--all", action="store_true", help="every strategy, side by side")
    p.add_argument("--profile", action="store_true", help="stage times instead of rows")
    p.add_argument("--stats", action="store_true", help="exact and protected sizes only")
    p.add_argument("--count", action="store_true", help="the exact size only")
    p.add_argument("--pad", action="store_true", help="pad the result to its protected size")
    p.add_argument("--tau", type=int, default=0, help="size to pad to")
    p.add_argument("--epsilon", type=float, default=1.0)
    p.add_argument("--delta", type=float, default=1e-9)
    p.add_argument("--cap", type=int, default=padding.CAP)
    p.add_argument("--cells", type=int, default=1_000_000, help="cells that are collected at most")
    p.add_argument("--print-limit", type=int, default=20)
    p.add_argument("--threshold", type=int, help="exit code 2 if the join has more rows")
    p.add_argument("--sweep", help="comma-separated numbers of shuffle partitions")
    p.add_argument("--rows", type=int, default=500)
    p.add_argument("--key-range", type=int, default=300)
    p.add_argument("--seed", default="1", help='a number, or "random"')
    p.add_argument("--partitions", type=int, help="shuffle partitions")
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """Values that make no sense together or alone are errors."""
    own = args.dataset in ("sample", "full-ternary", "star4", "star15")
    problems = [
        (not own and not args.folder, "this dataset needs a folder"),
        (own and args.folder, "this dataset takes no folder"),
        (args.rows < 1 or args.key_range < 1, "rows and key range must be positive"),
        (args.tau < 0 or args.cap < 1 or args.cells < 1 or args.print_limit < 0, "sizes must not be negative"),
        (args.partitions is not None and args.partitions < 1, "partitions must be positive"),
        (args.seed != "random" and not args.seed.isdigit(), 'a seed is a number or "random"'),
        (args.all and args.strategy != "native", "--all and --strategy exclude each other"),
        (args.sweep is not None and not all(x.isdigit() and int(x) for x in args.sweep.split(",")), "a sweep lists positive numbers"),
    ]
    for bad, why in problems:
        if bad:
            raise SystemExit(f"treeline: {why}")
    return args


def load(spark: SparkSession, args: argparse.Namespace):
    """(tree, expected rows or None)."""
    seed = random.randrange(1 << 31) if args.seed == "random" else int(args.seed)
    if args.dataset == "sample":
        return datasets.sample(spark), 20
    if args.dataset == "full-ternary":
        return datasets.full_ternary(spark, args.rows, args.key_range, seed), None
    if args.dataset.startswith("star") and args.dataset[4:] in ("4", "15"):
        return datasets.star(spark, int(args.dataset[4:]), args.rows, args.key_range, seed), None
    if args.dataset in datasets.TREES:
        return datasets.TREES[args.dataset](spark, args.folder), None
    n = datasets.expected_rows(spark, args.folder)
    return datasets.load_shape(spark, args.dataset, args.folder), n if n >= 0 else None


def main(argv: list[str] | None = None) -> int:
    args = checked(parser().parse_args(argv))
    spark = SparkSession.builder.appName("treeline").getOrCreate()
    if args.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(args.partitions))
    tree, expected = load(spark, args)
    if args.threshold is not None and counting.exceeds(tree, args.threshold):
        print(f"over {args.threshold} rows")
        return 2
    if args.count:
        print(counting.size(tree))
    elif args.stats:
        s = padding.sizes(tree, args.epsilon, args.delta, args.tau)
        print(json.dumps({"exact": s.exact, "protected": s.protected, "padding": s.padding, **(vars(s.breakdown) if s.breakdown else {})}))
    elif args.sweep:
        print(json.dumps(profile.sweep(tree, [int(x) for x in args.sweep.split(",")], args.strategy)))
    elif args.all or args.profile:
        for row in profile.compare(tree, tuple(joins.STRATEGIES) if args.all else (args.strategy,), expected):
            print(json.dumps(row))
    else:
        df = padding.padded_join(tree, args.strategy, args.epsilon, args.delta, args.tau, args.cap) if args.pad or args.tau else joins.join(tree, args.strategy, args.cap)
        text.collect_capped(df, args.cells)
        print(text.show(df, args.print_limit))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
