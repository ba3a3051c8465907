"""Compare a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

import math
from pathlib import Path


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in by) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if columns and rows agree."""
    cur = con.execute(sql)
    names, theirs = [x[0] for x in cur.description], cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, theirs)
    if a != b:
        return f"{len(a)} and {len(b)} rows; first difference {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
    return ""
