"""One run as a job: ``python -m saleskiln``, or this file under ``spark-submit`` with the package in ``--py-files``.

Reads landed pages from ``<landing>/users``, ``<landing>/products`` and ``<landing>/carts`` and brings
the tables below ``--root`` up to date. Steps run in the order given.
"""

from __future__ import annotations

import argparse
import logging
from datetime import datetime

from saleskiln.plans import runs
from saleskiln.session import open_session
from saleskiln.sources.pages import read_pages
from saleskiln.sources.schemas import ENTITIES
from saleskiln.sources.tables import Warehouse

BUILD_STEPS = {
    "dim_client": runs.run_dim_client,
    "dim_product": runs.run_dim_product,
    "ft_sale": runs.run_ft_sale,
    "sales_by_client": runs.run_sales_by_client,
}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="saleskiln", description=__doc__)
    parser.add_argument("--landing", required=True, help="folder with one subfolder of page files per entity")
    parser.add_argument("--root", required=True, help="shared folder of the tables")
    parser.add_argument("--prefix", default="", help="put in front of the layer databases, e.g. shop_")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--native-merge", action="store_true", help="the format can MERGE")
    parser.add_argument("--id-type", default="bigint", choices=("int", "bigint"))
    parser.add_argument("--buckets", type=int, default=0, help="buckets of the fact table")
    parser.add_argument("--partitions", type=int, default=0, help="partitions by key of upserted tables, in place of versions")
    parser.add_argument("--page-per-line", action="store_true")
    parser.add_argument("--batch-time", default=None, help="yyyy-MM-dd HH:mm:ss, default: now")
    parser.add_argument("--shuffled-gb", type=int, default=1)
    parser.add_argument("--cores", type=int, default=8)
    parser.add_argument("--hive", action="store_true")
    parser.add_argument("--steps", nargs="+", default=[*ENTITIES, *BUILD_STEPS], choices=[*ENTITIES, *BUILD_STEPS])
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> list[runs.IngestResult | runs.MergeResult]:
    logging.basicConfig(level=logging.INFO)
    args = arguments(argv)
    spark = open_session("saleskiln", args.shuffled_gb << 30, args.cores, args.hive)
    warehouse = Warehouse.open(
        spark,
        args.root,
        prefix=args.prefix,
        fmt=args.format,
        native_merge=args.native_merge,
        id_type=args.id_type,
        buckets=args.buckets,
        partitions=args.partitions,
    )
    batch_time = args.batch_time or f"{datetime.now():%Y-%m-%d %H:%M:%S}"
    results = []
    for step in args.steps:
        if step in BUILD_STEPS:
            results.append(BUILD_STEPS[step](warehouse))
        else:
            pages = read_pages(spark, f"{args.landing}/{step}", args.page_per_line)
            results.append(runs.ingest(warehouse, step, pages, batch_time))
    return results


if __name__ == "__main__":
    for result in main():
        print(result)
