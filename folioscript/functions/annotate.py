"""User-supplied batch annotators over prepared rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def annotate(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType) -> DataFrame:
    """Apply ``fn`` to Arrow batches of ``df``.

    The result has ``schema`` plus ``error``. A batch that raises is retried row
    by row, so only the failing rows carry an error; good rows have a null.
    """
    out = StructType([*schema.fields, StructField("error", StringType())])
    names = [f.name for f in schema.fields]

    def attempt(rows: pd.DataFrame) -> pd.DataFrame:
        return fn(rows)[names].assign(error=None)

    def one(row: pd.DataFrame) -> pd.DataFrame:
        try:
            return attempt(row)
        except Exception as e:  # noqa: BLE001
            known = {n: row[n].tolist() if n in row.columns else [None] for n in names}
            return pd.DataFrame(known).assign(error=f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            try:
                yield attempt(rows)
            except Exception:  # noqa: BLE001
                for i in range(len(rows)):
                    yield one(rows.iloc[i:i + 1])

    return df.mapInPandas(run, out)
