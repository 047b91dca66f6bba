"""Show report sections for a set of exports.

    python -m loadlens --source memory=/data/memory.csv --source hitlist_db=/data/hitlist.parquet \\
                       [--accounts A,B] [--reports R1] [--wp-types DIA] [--section memory --section kpis] [--rows 20]

Each output table is shown with ``DataFrame.show`` (only the shown rows reach
the driver). Sources not given are skipped, like missing files.
"""

from __future__ import annotations

import argparse
import sys

from loadlens.plans import reports
from loadlens.session import get_session
from loadlens.sources import CATALOG, load_all


def _list(v: str | None) -> list[str]:
    return [x for x in (v or "").split(",") if x]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loadlens", description=__doc__.splitlines()[0])
    p.add_argument("--source", action="append", default=[], metavar="KEY=PATH",
                   help=f"export to load; KEY in {', '.join(CATALOG)}")
    p.add_argument("--accounts", help="comma-separated account filter")
    p.add_argument("--reports", help="comma-separated report filter (hit list)")
    p.add_argument("--wp-types", help="comma-separated work-process type filter")
    p.add_argument("--section", action="append", choices=["kpis", *reports.SECTIONS, "users"],
                   help="section to show (repeatable; default: all)")
    p.add_argument("--ml-target", help="numeric column to predict: adds the regression section")
    p.add_argument("--ml-source", default=reports.ML_SOURCES[0], choices=reports.ML_SOURCES,
                   help="source of the regression section")
    p.add_argument("--rows", type=int, default=20, help="rows shown per table")
    p.add_argument("--master", help="Spark master (default: from the launcher)")
    a = p.parse_args(argv)

    paths = {}
    for item in a.source:
        key, _, path = item.partition("=")
        if key not in CATALOG or not path:
            p.error(f"bad --source {item!r}")
        paths[key] = path
    spark = get_session(a.master)
    dfs = load_all(spark, paths)
    f = reports.Filters(accounts=_list(a.accounts), reports=_list(a.reports), wp_types=_list(a.wp_types))
    chosen = a.section or ["kpis", *reports.SECTIONS, "users"]
    out = reports.report(spark, dfs, f, [s for s in chosen if s != "kpis"])
    if "kpis" not in chosen:
        out.pop("kpis", None)
    if a.ml_target:
        out["ml"] = reports.ml_section(reports.apply_filters(dfs, f), a.ml_target, a.ml_source)
    for section, tables in out.items():
        for name, df in tables.items():
            print(f"== {section} / {name}")
            df.show(a.rows, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
