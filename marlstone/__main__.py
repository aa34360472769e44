"""``python -m marlstone [FOLDER]``: read statements that end with ``;`` and run them.

``\\s`` switches the output of rows, ``\\p`` that of plans, ``\\h`` helps, ``quit`` ends.
"""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException

from .plans.dialect import SqlError
from .plans.engine import Engine
from .session import build

#: A statement, up to a semicolon that stands outside texts, names and comments.
STATEMENT = re.compile(r"""((?:'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*(?:\n|$)|/\*.*?\*/|[^;'"`/-]|-(?!-)|/(?!\*))*);""", re.S)


def statements(lines: Iterable[str]) -> Iterator[str]:
    """Commands and statements, in order."""
    buffer = ""
    for line in lines:
        if not buffer.strip() and line.strip() in ("quit", "\\s", "\\p", "\\h"):
            buffer = ""
            yield line.strip()
            continue
        buffer += line
        while m := STATEMENT.match(buffer):
            buffer = buffer[m.end() :].lstrip()
            if m[1].strip():
                yield m[1].strip()


def main(root: str, lines: Iterable[str] = sys.stdin) -> None:
    engine = Engine(build("local[*]"), root)
    engine.catalog.vacuum()
    rows_shown, plans_shown = True, False
    for statement in statements(lines):
        if statement == "quit":
            return
        if statement == "\\h":
            print(__doc__)
        elif statement == "\\s":
            rows_shown = not rows_shown
            print(f"rows are {'shown' if rows_shown else 'not shown'}")
        elif statement == "\\p":
            plans_shown = not plans_shown
            print(f"plans are {'shown' if plans_shown else 'not shown'}")
        else:
            began = time.monotonic()
            try:
                found = engine.sql(statement)
                if plans_shown:
                    found.explain("formatted")
                rows = found.collect()
            except (SqlError, PySparkException) as e:
                print(f"error: {str(e).splitlines()[0]}")
                continue
            if rows_shown:
                for r in rows:
                    print(*("NULL" if v is None else v for v in r), sep=" | ")
            print(f"{len(rows)} rows, {time.monotonic() - began:.3f} s")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "file:///tmp/marlstone-db")
