"""Command line: a query, or file [columns] [where] [limit] [orderby]."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import TextIO

import flatsql
from flatsql.api import Engine
from flatsql.errors import QueryError
from flatsql.sinks.table import render_table
from flatsql.sinks.text import rows_as_text, to_csv, to_json, to_jsonl
from flatsql.sources.csv import delimiter, read_piped, size_of


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("flatsql", description=__doc__)
    p.add_argument("query", nargs="*", help="SQL, or file [columns] [where] [limit] [orderby]; none: read SQL from standard input")
    p.add_argument("-v", "--version", action="version", version=f"flatsql {flatsql.__version__}")
    p.add_argument("--mcp", action="store_true", help="serve tools over standard input and output")
    p.add_argument("-s", "--schema", metavar="FILE", help="show the columns of a file and their types")
    p.add_argument("--no-header", action="store_true", help="leave the header out of CSV")
    p.add_argument("-d", "--delimiter", default=",", help=r"one character, or \t")
    p.add_argument("--multiline", action=argparse.BooleanOptionalAction, help="quoted fields may, or may not, hold line breaks; neither: look for them")
    form = p.add_mutually_exclusive_group()
    form.add_argument("--json", action="store_true")
    form.add_argument("--jsonl", action="store_true")
    form.add_argument("--table", nargs="?", const="unicode", choices=["unicode", "ascii", "minimal", "markdown", "none"])
    p.add_argument("--no-table", action="store_true", help="CSV even on a terminal")
    p.add_argument("--wrap", action="store_true", help="wrap long values in tables")
    return p


def is_sql(words: Sequence[str]) -> bool:
    return bool(words) and words[0].lstrip().upper().startswith("SELECT") and (len(words[0].strip()) == 6 or words[0].strip()[6].isspace())


def main(argv: Sequence[str] | None = None, stdin: TextIO | None = None, out: TextIO | None = None, err: TextIO | None = None) -> int:
    stdin, out, err = stdin or sys.stdin, out or sys.stdout, err or sys.stderr
    args = parser().parse_args(argv)
    if args.mcp:
        from flatsql.mcp import serve

        return serve(stdin, out)
    try:
        sep = delimiter(args.delimiter)
        engine = Engine(sep=sep, multiline=args.multiline)
        engine.resolver.stdin = lambda: read_piped(engine.spark, stdin, sep, args.multiline)
        if args.schema:
            _schema(engine, args.schema, out)
            return 0
        words = args.query or [stdin.read()]
        df = engine.sql(" ".join(words)) if is_sql(words) else engine.simple(words)
        if args.json:
            to_json(df, out)
        elif args.jsonl:
            to_jsonl(df, out)
        elif args.table or (not args.no_table and not args.no_header and out.isatty()):
            rows = list(rows_as_text(df))
            out.write(render_table(df.columns, rows, args.table or "unicode", wrap=args.wrap))
        else:
            to_csv(df, out, not args.no_header, sep)
        return 0
    except QueryError as error:
        err.write(f"error: {error}\n")
    except Exception as error:  # noqa: BLE001  what Spark reports, without its trace
        err.write(f"error: {str(error).splitlines()[0] if str(error) else type(error).__name__}\n")
    return 1


def readable(size: int) -> str:
    for unit, one in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if size >= one:
            return f"{size / one:.1f} {unit}"
    return f"{size} B"


def _schema(engine: Engine, path: str, out: TextIO) -> None:
    found = engine.profile(path)
    out.write(f"File: {path}\nRows: {found[0]['rows'] if found else 0}  |  Columns: {len(found)}  |  Size: {readable(size_of(engine.spark, path))}\n")
    rows = [[str(c["index"] + 1), c["name"], c["type"], str(c["non_empty"]), str(c["empty"])] for c in found]
    out.write(render_table(["#", "Column", "Type", "Non-Empty", "Empty"], rows))


if __name__ == "__main__":
    sys.exit(main())
