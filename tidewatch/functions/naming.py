"""Names of series, configurations and run dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_NAME = r"(?:^|[/=])([^/=]*?)(?:_(train|test))?\.csv(?:/|$)"


def series_of(file_name: Column) -> Column:
    return F.regexp_extract(file_name, FILE_NAME, 1)


def split_of(file_name: Column, default: str = "test") -> Column:
    found = F.regexp_extract(file_name, FILE_NAME, 2)
    return F.when(found == "", F.lit(default)).otherwise(found)


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.regexp_replace(name, F.lit(f"\\Q{suffix}\\E$"), F.lit(""))


def config_name(dataset: str, context: Column, horizon: Column) -> Column:
    return F.format_string(f"{dataset}_context%d_h%d", context, horizon)


def split_percent(share: float) -> int:
    return int(share * 100)


def run_date(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd")


def synthetic_time(t: Column) -> Column:
    """One step a second from 2000-02-01, without a time zone."""
    return F.expr("timestamp_ntz'2000-02-01 00:00:00'") + F.make_dt_interval(secs=t.cast("decimal(18,6)"))
