"""Result frames of Python tasks."""

from __future__ import annotations

import pandas as pd

_TYPES = {"bigint": "int64", "int": "int32", "double": "float64"}


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame of the given 'name type, ...' schema; an empty one keeps its types, which Arrow needs."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    df = pd.DataFrame(rows, columns=[name for name, _ in fields])
    return df if len(df) else df.astype({name: _TYPES.get(kind, object) for name, kind in fields})
