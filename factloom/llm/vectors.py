"""What the vector operators share: which vectors take part, and their arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector that is not null or zero and has finite components only.
    Vectors of another length than the commonest (the smaller, if tied) take no part either."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("v")).where("vec_id is not null and v is not null")
    sizes = rows.groupBy(F.size("v").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].k if sizes else 0))


def stacked(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()) if len(s) else np.zeros((0, 1))
