"""Jobs for spark-submit: `index` a manifest of snapshots, `search` a table of queries."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from repoquarry.params import IndexParams
from repoquarry.plans.jobs import index_repositories, search, search_rendered
from repoquarry.session import build_session, drop_scratch, ship_package
from repoquarry.sources.index_table import IndexTable


def _arguments() -> argparse.Namespace:
    defaults = IndexParams()
    parser = argparse.ArgumentParser(prog="repoquarry", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    index = jobs.add_parser("index")
    index.add_argument("manifest", help="parquet of (repo_url, commit, root)")
    index.add_argument("index", help="path of the index, created if missing")
    index.add_argument("--report", help="path to write the summaries and failures to")
    index.add_argument("--keep-existing", action="store_true", help="append to old rows")
    for name in (
        "max_bytes", "batch_size", "chunk_lines", "chunk_lines_overlap", "max_chars",
        "max_tokens", "token_overlap", "declaration_overlap", "dim", "repo_buckets", "embed_partitions",
    ):
        index.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(defaults, name))
    index.add_argument("--expand-chunks", action="store_true", help="put path and declaration on chunks")
    index.add_argument("--scope", choices=("file", "group"), default=defaults.scope)
    index.add_argument("--on-error", choices=("fail", "quarantine"), default=defaults.on_error)
    find = jobs.add_parser("search")
    find.add_argument("index")
    find.add_argument("queries", help="parquet of (query_id, query)")
    find.add_argument("output")
    find.add_argument("--k", type=int, default=2)
    find.add_argument("--max-distance", type=float)
    find.add_argument("--approximate", action="store_true", help="compare hashed cells only")
    find.add_argument("--rendered", action="store_true", help="write Markdown, a row per query")
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = build_session()
    ship_package(spark)
    try:
        _run(spark, args)
    finally:
        drop_scratch(spark)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "search":
        run = search_rendered if args.rendered else search
        queries = spark.read.parquet(args.queries)
        found = run(
            IndexTable(spark, args.index),
            queries,
            k=args.k,
            max_distance=args.max_distance,
            approximate=args.approximate,
        )
        found.write.parquet(args.output)
        return
    names = IndexParams.__dataclass_fields__
    params = IndexParams(**{k: v for k, v in vars(args).items() if k in names})
    done = index_repositories(
        IndexTable.open(spark, args.index, params.dim, params.repo_buckets),
        spark.read.parquet(args.manifest),
        params,
        clear_existing=not args.keep_existing,
    )
    if args.report:
        done.summary.write.parquet(f"{args.report}/summary")
        done.failures.write.parquet(f"{args.report}/failures")
        done.bad_urls.write.parquet(f"{args.report}/bad_urls")
        if done.ingested:
            done.ingested.quarantine.write.parquet(f"{args.report}/quarantine")


if __name__ == "__main__":
    main()
