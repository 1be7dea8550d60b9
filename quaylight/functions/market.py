"""Column functions of the data model: prices, symbols, derived book values. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaylight.schema import PRICE_UNIT


def price_from_double(value: Column) -> Column:
    """Micro-units, half away from zero."""
    scaled = value * F.lit(float(PRICE_UNIT))
    return F.when(value >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5)).cast("long")


def price_to_double(price: Column) -> Column:
    return price / F.lit(float(PRICE_UNIT))


def canonical_symbol(text: Column) -> Column:
    """At most eight letters, trailing blanks dropped; an empty symbol is null."""
    return F.nullif(F.rtrim(F.substring(text, 1, 8)), F.lit(""))


def mid(bid: Column, ask: Column) -> Column:
    """Half the sum, truncated toward zero; null if a side is empty."""
    total = bid + ask
    return (F.signum(total) * F.floor(F.abs(total) / 2)).cast("long")


def crossed(bid: Column, ask: Column) -> Column:
    return F.coalesce(bid >= ask, F.lit(False))


def permits(venue_mask: Column, venue_id: Column) -> Column:
    """Whether bit venue_id of the mask is set; an unknown venue is never permitted."""
    known = (venue_id >= 0) & (venue_id < 32)
    bit = F.pmod(F.floor(venue_mask.cast("long") / F.pow(F.lit(2.0), venue_id.cast("double"))).cast("long"), F.lit(2))
    return F.coalesce(known & (bit == 1), F.lit(False))


def wall_micros(ts: Column) -> Column:
    """Microseconds of a timestamp's wall clock since 1970, whatever the session's time zone."""
    day = F.unix_date(ts.cast("date"))
    minutes = (day * 24 + F.hour(ts)).cast("long") * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
