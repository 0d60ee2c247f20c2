"""python -m strataline COMMAND STORE ...: build, search, expand, check, context, read, list. Prints JSON lines.

A session is taken from the environment (spark-submit) or is a local one.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from strataline.api import Index
from strataline.build import build
from strataline.session import get_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options) -> None:
        c = sub.add_parser(name)
        c.add_argument("store")
        for a in args:
            c.add_argument(a, nargs="+")
        for k, v in options.items():
            c.add_argument(f"--{k}", type=type(v) if v is not None else str, default=v)
        c.add_argument("--repo")

    command("build", "roots", snapshots=None)
    sub.choices["build"].add_argument("--force", action="store_true")
    command("search", "texts", k=10, kind=None, ext=None)
    command("expand", "ids", hops=1)
    command("check", "ids", hops=3)
    command("context", "texts", k=8, budget=24_000)
    command("read", "spans")
    command("list")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or get_session("strataline")
    spark.sparkContext.setLogLevel("ERROR")
    x = Index(spark, a.store, a.repo)
    if a.command == "build":  # ID=FOLDER each
        out = build(spark, [tuple(r.split("=", 1)) for r in a.roots], a.store, a.force, snapshots=a.snapshots)
    elif a.command == "search":
        out = x.search(a.texts, a.k, a.kind, a.ext)
    elif a.command in ("expand", "check"):
        out = getattr(x, a.command)([int(i) for i in a.ids], a.hops)
    elif a.command == "context":
        out = x.context(a.texts, a.k, budget=a.budget).select("bundle")
    elif a.command == "read":  # PATH:FROM-TO each
        out = x.read([(s.rsplit(":", 1)[0], *map(int, s.rsplit(":", 1)[1].split("-"))) for s in a.spans])
    else:
        out = x.list()
    for line in out.toJSON().toLocalIterator() if a.command != "context" else (r.bundle for r in out.toLocalIterator()):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
