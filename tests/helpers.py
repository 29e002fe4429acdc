"""Small literal tables."""
from __future__ import annotations

import datetime as dt

DAY = dt.date
TS = dt.datetime


def rows(df, *columns):
    """Collected tuples, floats rounded."""
    picked = df.select(*columns) if columns else df
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in picked.collect()]


def fares(spark, data):
    """Observations from (route, date, airline, fare) tuples."""
    return spark.createDataFrame(data, "route string, outbound_date date, airline string, total_fare double")
