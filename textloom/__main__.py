"""Text of one file: ``python -m textloom -i FILE [-t TYPE] [-v | -vv]``. Errors end with a status of 1."""

from __future__ import annotations

import argparse
import logging
import sys

from textloom.functions import filetypes
from textloom.operators.registry import Registry


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom")
    parser.add_argument("-i", required=True, metavar="FILE")
    parser.add_argument("-t", type=int, default=0, metavar="TYPE")
    parser.add_argument("-v", action="count", default=0)
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=(logging.WARNING, logging.INFO, logging.DEBUG)[min(args.v, 2)])
    code = args.t or filetypes.detect(args.i)
    try:
        with open(args.i, "rb") as f:
            result = Registry().safely(code, f.read(), args.i)
    except OSError as e:
        print(e)
        return 1
    if result.error and not result.text:
        print(result.error)
        return 1
    print(f"file[{args.i}], size[{len(result.text.encode())}]")
    if args.v:
        print(result.text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
