"""Dates of any spelling: built-in forms first, a lenient reader for what is left alone."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import rules


def lenient(default: dt.datetime):
    """An Arrow UDF: text in any order of parts, in UTC unless it says otherwise; parts that are missing come from `default`."""

    @pandas_udf("timestamp")
    def read(texts: pd.Series) -> pd.Series:
        from dateutil import parser

        def one(text: str):
            try:
                found = parser.parse(text, default=default)
            except (ValueError, OverflowError, TypeError):
                return pd.NaT
            found = found if found.tzinfo else found.replace(tzinfo=dt.UTC)
            return pd.Timestamp(found.astimezone(dt.UTC))

        return pd.Series(pd.to_datetime([one(t) for t in texts], utc=True), dtype="datetime64[us, UTC]")

    return read


def with_dates(rows: DataFrame, raw: str, as_of: dt.datetime, name: str = "read_at") -> DataFrame:
    """Adds the time that the text `raw` says, or null; only texts that no built-in form reads go to Python."""
    known = rows.withColumn(name, rules.parse_date(F.col(raw)))
    left = F.col(name).isNull() & (F.coalesce(F.trim(raw), F.lit("")) != "")
    rest = known.filter(left).withColumn(name, lenient(as_of)(F.col(raw)))
    return known.filter(~left).unionByName(rest)
