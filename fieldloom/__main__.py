"""``python -m fieldloom ops [--signatures] [-m MODULE]`` lists the operations."""

from __future__ import annotations

import argparse
import importlib

from .registry import ops


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fieldloom")
    sub = parser.add_subparsers(dest="command", required=True)
    listing = sub.add_parser("ops", help="list operations")
    listing.add_argument("--signatures", action="store_true")
    listing.add_argument("-m", "--module", action="append", default=[], help="import a module first, for the operations it adds")
    args = parser.parse_args(argv)
    for m in args.module:
        importlib.import_module(m)
    for name in ops.names():
        print(ops.signature(name) if args.signatures else name)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
