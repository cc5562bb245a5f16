"""Runs statements of the dialect: ``python -m tidewater [--stream] [--to-end] [-e STATEMENTS | FILE ...]``.

Without statements or files they are read from standard input, each up to its semicolon;
on a terminal, an error does not end the session.  Rows are printed as CSV below their
names.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError
from .session import Engine
from .sql import parse


def show(out) -> None:
    """A result: rows, or text as EXPLAIN gives it."""
    if isinstance(out, DataFrame) and not out.isStreaming:
        print(",".join(out.columns))
        for row in out.toLocalIterator():
            print(",".join("NULL" if v is None else str(v) for v in row))
    elif out is not None:
        print(out)


def _typed() -> Iterator[str]:
    """What is read from standard input, up to each line that ends in a semicolon."""
    lines: list[str] = []
    for line in sys.stdin:
        lines.append(line)
        if line.rstrip().endswith(";"):
            yield "".join(lines)
            lines.clear()
    if "".join(lines).strip():
        yield "".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewater", description="Runs statements of the windowed stream dialect.")
    parser.add_argument("files", nargs="*", help="files of statements")
    parser.add_argument("-e", dest="statements", action="append", default=[], help="statements")
    parser.add_argument("--stream", action="store_true", help="read sources as streams")
    parser.add_argument("--to-end", action="store_true", help="with --stream: read what is there, fire all windows, and stop")
    args = parser.parse_args(argv)
    engine = Engine(spark or SparkSession.builder.appName("tidewater").getOrCreate(), streaming=args.stream, to_end=args.to_end)
    texts = [*args.statements]
    for path in args.files:
        with open(path, encoding="utf-8") as f:
            texts.append(f.read())
    alone = not texts and sys.stdin.isatty()
    for text in texts or _typed():
        try:
            for statement in parse(text):
                show(engine.run(statement))
        except EngineError as e:
            print(e, file=sys.stderr)
            if not alone:
                return 1
    for running in engine.queries.values():
        if running.stream is not None and running.stream.isActive:
            running.stream.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
