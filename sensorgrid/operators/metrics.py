"""Prediction errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def errors(
    df: DataFrame, truth: str = "truth", pred: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """(*by, rmse, mae, n), in one pass.

    `n` counts every row, also those whose error is null, and is the divisor of
    both means. Without rows rmse and mae are null and n is 0.
    """
    diff = F.col(truth) - F.col(pred)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.sqrt(F.try_divide(F.sum(diff * diff), n)).alias("rmse"),
        F.try_divide(F.sum(F.abs(diff)), n).alias("mae"),
        n.alias("n"),
    )


def time_errors(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Per-time error table (ts, rmse, mae, sensor_count)."""
    return errors(df, by=[ts_col]).withColumnRenamed("n", "sensor_count")


def join_truth(
    predictions: DataFrame,
    truth: DataFrame,
    on: Sequence[str] = ("station_id", "ts"),
    value_col: str = "value",
) -> DataFrame:
    """Predictions with the reading of the same keys as `truth`."""
    return predictions.join(truth.select(*on, F.col(value_col).alias("truth")), list(on))
