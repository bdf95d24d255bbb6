"""python -m cumulo [csv N F C] [--norm=none|l2|minmax|zscore] [--no-idf] [--out DIR]"""

from __future__ import annotations

import argparse

from cumulo.plans.clustering import RunSettings, run
from cumulo.session import local_session


def settings_from(args: list[str] | None = None) -> tuple[RunSettings, str | None]:
    parser = argparse.ArgumentParser(prog="cumulo", description="Fuzzy C-Means by three strategies, compared")
    parser.add_argument("csv", nargs="*", help="path N F C; without it the synthetic matrix is used")
    parser.add_argument("--norm", default="l2", choices=("none", "l2", "minmax", "zscore"))
    parser.add_argument("--no-idf", action="store_true")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--compat", action="store_true", help="lenient CSV parsing")
    parser.add_argument("--out")
    given = parser.parse_args(args)
    if given.csv and len(given.csv) != 4:
        parser.error("a CSV needs its path, N, F and C")
    common = {"norm": given.norm, "idf": not given.no_idf, "seed": given.seed, "mode": "compat" if given.compat else "strict"}
    try:
        if given.csv:
            path, n, f, c = given.csv
            return RunSettings(int(n), int(f), int(c), source="csv", path=path, **common), given.out
        return RunSettings(**common), given.out
    except ValueError as e:
        parser.error(str(e))


def main(args: list[str] | None = None) -> None:
    settings, out = settings_from(args)
    spark = local_session()
    report, table = run(spark, settings, out)
    report.show(truncate=False)
    table.show(truncate=False)


if __name__ == "__main__":
    main()
