"""Host-name and location enrichment from dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetrisk.functions.scores import trust_of

#: Rows of a dimension that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def dimension(df: DataFrame, key: str = "ip") -> DataFrame:
    """One row per key, broadcast only when its counted size allows."""
    one = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    return F.broadcast(one) if one.count() <= BROADCAST_ROWS else one


def with_trust(df: DataFrame, rdns: DataFrame, ip: str = "source_ip") -> DataFrame:
    """``df`` with trust_score and domain of its address."""
    names = dimension(rdns).select(F.col("ip").alias("__ip"), F.col("hostname").alias("__host"))
    score, domain = trust_of(F.col("__host"), F.col(ip))
    return df.join(names, F.col(ip) == F.col("__ip"), "left").withColumns({"trust_score": score, "domain": domain}).drop("__ip", "__host")


def with_location(df: DataFrame, geo: DataFrame, ip: str = "source_ip") -> DataFrame:
    """``df`` with lat, lon (0 where unknown) and country ('Unknown')."""
    places = dimension(geo).select(F.col("ip").alias("__ip"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("country").alias("__country"))
    out = df.join(places, F.col(ip) == F.col("__ip"), "left")
    return out.withColumns({"lat": F.coalesce("__lat", F.lit(0.0)), "lon": F.coalesce("__lon", F.lit(0.0)), "country": F.coalesce("__country", F.lit("Unknown"))}).drop("__ip", "__lat", "__lon", "__country")
