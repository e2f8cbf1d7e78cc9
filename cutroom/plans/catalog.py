"""Where queries register: a name, what makes its rows, and DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .standins import DUCK, Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Registers make(tables) under name. sql may use the stand-ins by name; None: rows only."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            used = [text for table, text in DUCK.items() if re.search(rf"\b{table}\b", sql)]
            body = sql.strip()
            begin = re.match(r"WITH (RECURSIVE )?", body)
            rest = body[begin.end() :] if begin else None
            recursive = "RECURSIVE " if begin and begin[1] else ""
            if used and rest is not None:
                ORACLES[name] = f"WITH {recursive}{', '.join(used)}, {rest}"
            elif used:
                ORACLES[name] = f"WITH {', '.join(used)} {body}"
            else:
                ORACLES[name] = body
        return make

    return register
