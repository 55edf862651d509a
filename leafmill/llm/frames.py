"""Batches that Python operators give back."""

from __future__ import annotations

import pandas as pd


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame of plain objects, so that Arrow gets one chunk per column."""
    return pd.DataFrame(rows, columns=columns, dtype=object)
