"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(vectors: DataFrame) -> DataFrame:
    """The rows of ``vectors`` (``vec_id, embedding`` and more) with an id and a usable vector, and its length ``dims``.

    Zeros lose their sign, so that equal vectors are equal in every bit; the numbers keep their type.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast(kind)).otherwise(v))
    return vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("embedding", plain).withColumn("dims", F.size("embedding"))


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))
