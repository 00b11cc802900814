"""Comparing results of two engines."""

import pandas as pd


def plain(value):
    if pd.isna(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 6) if isinstance(value, float) else value


def row_set(pdf):
    columns = sorted(pdf.columns)
    data = pdf[columns].astype(object)
    return columns, sorted((tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in map(plain, row)) for row in data.itertuples(index=False)))
