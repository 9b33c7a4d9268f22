"""Shaping of place-search results: name, up to three parts of its locality, each pair of them once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:map<string,string>>>>"
#: Fixed value: the properties that make up a locality, in order.
LOCALITY = ("district", "locality", "city", "county", "state", "country")


def places(documents: DataFrame, json: str = "json") -> DataFrame:
    """documents (id, json) -> id, place, name, locality, lon, lat, kind."""
    rows = documents.select("id", F.posexplode(F.from_json(json, FEATURES)["features"]).alias("place", "f"))
    p = lambda k: F.col("f.properties")[k]
    street = F.concat_ws(" ", p("street"), p("housenumber"))
    rows = rows.withColumn("street", street).withColumn("name", F.coalesce(p("name"), F.when(street != "", street), p("city"), p("country"), F.lit("Unnamed")))
    parts = F.array_distinct(F.filter(F.array(*map(p, LOCALITY)), lambda x: x.isNotNull() & (x != "")))
    parts = F.slice(F.array_except(parts, F.array("name")), 1, 3)
    with_street = F.when((F.col("street") != "") & (F.col("street") != F.col("name")) & ~F.array_contains(parts, F.col("street")), F.concat(F.array("street"), parts)).otherwise(parts)
    rows = rows.withColumn("locality", F.array_join(F.slice(with_street, 1, 3), ", "))
    first = rows.groupBy("id", "name", "locality").agg(F.min_by(F.struct("place", "f"), "place").alias("x"))
    kind = F.coalesce(F.col("x.f.properties")["osm_value"], F.col("x.f.properties")["osm_key"], F.lit(""))
    return first.select("id", "x.place", "name", "locality", F.get("x.f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("x.f.geometry.coordinates", F.lit(1)).alias("lat"), kind.alias("kind"))
