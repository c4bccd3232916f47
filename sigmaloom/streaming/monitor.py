"""Extension: individuals monitored as they arrive, against limits fixed beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monitor(stream: DataFrame, limits: DataFrame, by: str, value: str, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts, means and values beyond the limits by series and time window; rows later than `late` are left out.

    limits(by, centre, lower, upper) is a static table of a row a series.
    """
    rows = stream.withWatermark(time, late).join(limits, by)
    out = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return rows.groupBy(F.window(time, window).alias("window"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.count_if(out).alias("n_out"))
