"""Address enrichment by joins with a geolocation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.ips import ip_to_long, is_private_ip

# What private and unknown addresses are reported as.
PRIVATE = {"country": "Private Network", "city": "N/A", "isp": "Private/Reserved",
           "org": "Internal Network", "as_name": "N/A"}
UNAVAILABLE = "Unavailable"
UNKNOWN_FIELD = "Unknown"

TEXT_FIELDS = ["country", "city", "isp", "org", "as_name"]
PLACE_FIELDS = ["lat", "lon"]
GEO_COLUMNS = ["country", "city", "lat", "lon", "isp", "org", "as_name"]

_PREFIX = 65536  # addresses per /16 network


def dedupe_ips(df: DataFrame, ip_col: str = "ip") -> DataFrame:
    return df.select(F.col(ip_col).alias("ip")).distinct()


def lookup_exact(ips: DataFrame, geo: DataFrame) -> DataFrame:
    """Public addresses joined with a table keyed by address."""
    return ips.join(geo.select("ip", *GEO_COLUMNS).withColumn("found", F.lit(True)), "ip", "left")


def lookup_range(ips: DataFrame, geo: DataFrame) -> DataFrame:
    """Public addresses joined with ranges ``start..end``; the narrowest range wins.

    A range is listed under each /16 network it touches (65,536 at most), which turns
    the range test into an equality join with a filter behind it.
    """
    numbered = ips.withColumn("_n", ip_to_long(F.col("ip")))
    ranges = geo.withColumn(
        "_net",
        F.explode(F.sequence(F.floor(F.col("start") / _PREFIX), F.floor(F.col("end") / _PREFIX))),
    )
    found = (
        numbered.where("_n is not null")
        .withColumn("_net", F.floor(F.col("_n") / _PREFIX))
        .join(ranges, "_net")
        .where("_n between start and end")
        .groupBy("ip")
        .agg(
            F.min_by(
                F.struct(*GEO_COLUMNS), F.struct(F.col("end") - F.col("start"), F.col("start"))
            ).alias("g")
        )
        .select("ip", "g.*", F.lit(True).alias("found"))
    )
    return ips.join(found, "ip", "left")


def enrich(df: DataFrame, geo: DataFrame, ip_col: str = "ip", by: str = "exact") -> DataFrame:
    """One row per distinct address: place, network and how it was resolved.

    Private addresses never reach the lookup. A matched row with missing fields shows
    them as unknown; an address without a match is unavailable, with the reason.
    """
    ips = dedupe_ips(df, ip_col).withColumn("is_private", is_private_ip(F.col("ip")))
    public = ips.where(~F.col("is_private"))
    looked = lookup_exact(public, geo) if by == "exact" else lookup_range(public, geo)
    rows = ips.where("is_private").unionByName(looked, allowMissingColumns=True)
    found = F.coalesce(F.col("found"), F.lit(False))

    def text(name: str) -> Column:
        return (
            F.when(F.col("is_private"), F.lit(PRIVATE[name]))
            .when(found, F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(UNKNOWN_FIELD)))
            .otherwise(F.lit(UNAVAILABLE))
        )

    return rows.select(
        "ip",
        *[text(c).alias(c) for c in ("country", "city")],
        *[
            F.when(found, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0)).alias(c)
            for c in PLACE_FIELDS
        ],
        *[text(c).alias(c) for c in ("isp", "org", "as_name")],
        "is_private",
        F.when(~F.col("is_private") & ~found, F.lit("address not in the lookup table")).alias(
            "enrichment_error"
        ),
    )


def enrich_attackers(attackers: DataFrame, geo: DataFrame, by: str = "exact") -> DataFrame:
    """Profiles with geo, network and private flag."""
    info = enrich(attackers, geo, by=by).select(
        "ip", F.struct("country", "city", "lat", "lon").alias("geo"), "isp", "org", "as_name", "is_private"
    )
    return attackers.join(info, "ip", "left")
