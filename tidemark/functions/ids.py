"""Scene ids, their times, and predicates on names and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_time(item_id: Column) -> Column:
    """Time of a scene id yyyyMMdd_HHmmss[_fraction]_rest: with four parts the third is the fraction of the second, else it is 0."""
    p = F.split(item_id, "_")
    fraction = F.when(F.size(p) == 3, F.lit("000000")).otherwise(F.rpad(F.coalesce(F.get(p, 2), F.lit("")), 6, "0"))
    return F.to_timestamp_ntz(F.concat(F.get(p, 0), F.lit("_"), F.get(p, 1), F.lit("."), fraction), F.lit("yyyyMMdd_HHmmss.SSSSSS"))


def raw_time(raw: Column) -> Column:
    return F.to_timestamp_ntz(raw, F.lit("yyyyMMdd_HHmmss"))


def format_raw_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


_PERIOD = r"^.+_shoreline_\d{4}-\d{2}_(\d{4})-(\d{4})_(\d{2})-(\d{2})\.geojson$"


def reference_period(file_name: Column) -> Column:
    """struct(year_from, year_to, month_from, month_to) of a dated reference line's file name, else null."""
    parts = [F.regexp_extract(file_name, _PERIOD, i).try_cast("int").alias(n) for i, n in enumerate(("year_from", "year_to", "month_from", "month_to"), 1)]
    return F.when(file_name.rlike(_PERIOD), F.struct(*parts))


def name_valid(name: Column) -> Column:
    """18 characters, digits but for the places 9 and 16, which may be anything."""
    return F.coalesce(name.rlike(r"^[0-9]{8}.[0-9]{6}.[0-9]{2}$"), F.lit(False))


def month_in_range(month: Column, first: Column, last: Column) -> Column:
    """first <= month <= last, over the end of the year where first > last; months outside 1 to 12 raise an error."""
    good = month.between(1, 12) & first.between(1, 12) & last.between(1, 12)
    inside = F.when(first <= last, month.between(first, last)).otherwise((month >= first) | (month <= last))
    return F.when(good, inside).otherwise(F.raise_error(F.lit("a month is not in 1..12")).cast("boolean"))


def year_month_in_range(year: Column, month: Column, period: Column) -> Column:
    """Null, not false, outside the years."""
    return F.when(year.between(period.year_from, period.year_to), month_in_range(month, period.month_from, period.month_to))


def contains_all(name: Column, parts: list[str]) -> Column:
    """False for no parts."""
    return F.lit(False) if not parts else F.forall(F.array(*map(F.lit, parts)), lambda p: F.contains(name, p))


def contains_any(name: Column, parts: list[str]) -> Column:
    return F.lit(False) if not parts else F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(name, p))


def epsg_of(crs: Column) -> Column:
    """The number of urn:ogc:def:crs:EPSG::N or EPSG:N."""
    return F.regexp_extract(crs, r"(\d+)\D*$", 1).try_cast("int")


def array_text(values: Column) -> Column:
    """An array's elements as one string, parted by a space and a comma."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ,")


def keep_keys(entries: Column, keys: list[str]) -> Column:
    """A map without the entries whose keys aren't among keys."""
    return F.map_filter(entries, lambda k, _: k.isin(keys))
