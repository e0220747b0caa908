"""python -m loamline: index, search, impact, trace, eval, status and doctor for one tree of source files."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamline")
    p.add_argument("--index-dir", help="where indexes lie (default: inside the tree)")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"index": [], "search": ["query"], "impact": ["symbol"], "trace": ["start", "end"], "eval": ["queries"], "status": [], "doctor": []}.items():
        one = sub.add_parser(name)
        one.add_argument("root")
        for a in args:
            one.add_argument(a)
        if name == "search":
            one.add_argument("-k", "--top", type=int, default=10)
            one.add_argument("--spans", type=int, default=2)
        if name == "eval":
            one.add_argument("--verbose", action="store_true")
        if name in ("index", "status"):
            one.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """The exit code: 1 where nothing was found or something is wrong, 2 for wrong arguments."""
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .config import Settings
    from .service import Repository
    from .shipping import ship
    from .workspace import index_folder

    spark = SparkSession.builder.appName("loamline").getOrCreate()
    ship(spark)
    repo = Repository(spark, a.root, index_folder(a.root, a.index_dir), Settings.from_environment())
    if a.command in ("index", "status"):
        got = repo.index() if a.command == "index" else repo.status()
        print(json.dumps(got) if a.json else "  ".join(f"{k}={v}" for k, v in got.items()))
        return 0
    if a.command == "search":
        lines = repo.lines(a.query, a.top, a.spans)
        print("\n".join(lines))
        return int(lines == ["no results"])
    if a.command == "eval":
        print("\n".join(repo.evaluation_report(a.queries, a.verbose)))
        return 0
    if a.command == "doctor":
        rows = repo.diagnose()
        print("\n".join(f"[{m}] {label}: {detail}" for m, label, detail in rows))
        return int(any(m == "bad" for m, _, _ in rows))
    got = repo.impact(a.symbol) if a.command == "impact" else repo.trace(a.start, a.end)
    print(json.dumps(got))
    return int(not any(got.values()))


if __name__ == "__main__":
    sys.exit(main())
