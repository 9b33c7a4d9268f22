"""Map-server JSON of ways with geometry -> ways(way_id, tags, refs, coords)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,nodes:array<bigint>,geometry:array<struct<lat:double,lon:double>>>>>"


def ways(documents: DataFrame, json: str = "json") -> DataFrame:
    """Ways of two points or more; points that the server could not resolve stay as nulls. A document without elements is
    left out."""
    el = documents.select(F.explode(F.from_json(json, ELEMENTS)["elements"]).alias("e"))
    n = F.least(F.size("e.nodes"), F.size("e.geometry"))
    good = el.where((F.col("e.type") == "way") & F.col("e.id").isNotNull() & F.col("e.nodes").isNotNull() & F.col("e.geometry").isNotNull()).withColumn("n", n).where("n >= 2")
    coords = F.transform(F.slice("e.geometry", F.lit(1), F.col("n")), lambda g: F.struct(g["lon"].alias("lon"), g["lat"].alias("lat")))
    return good.select(F.col("e.id").alias("way_id"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"), F.slice("e.nodes", F.lit(1), F.col("n")).alias("refs"), coords.alias("coords"))


def query_text(west: Column, south: Column, east: Column, north: Column, highways: tuple) -> Column:
    """The request for kept ways of a box."""
    box = F.concat_ws(",", *[F.format_string("%.6f", x) for x in (south, west, north, east)])
    return F.concat(F.lit('[out:json][timeout:60];way["highway"~"^(' + "|".join(highways) + ')$"]('), box, F.lit(");out geom;"))
