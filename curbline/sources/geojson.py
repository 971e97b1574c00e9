"""GeoJSON reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Property names tried for the name, in this order.
NAME_KEYS = ["name", "Neighborhood", "NEIGHBORHOOD", "Name"]


def read_geojson(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """One row (name, geometry JSON) per feature that has a geometry; an empty one is none.

    Takes a FeatureCollection or a single Feature per document; anything else
    is an error. ``whole_file=False`` reads one document per line, the form
    that splits over tasks.
    """
    docs = spark.read.text(path, wholetext=whole_file).where(F.trim("value") != "")
    return features_of(docs)


def features_of(docs: DataFrame) -> DataFrame:
    """Features of JSON documents in column ``value``."""
    feature = "struct<type:string,properties:string,geometry:string>"
    kind = F.get_json_object("value", "$.type")
    many = F.from_json("value", f"features array<{feature}>")["features"]
    one = F.array(F.from_json("value", feature[7:-1].replace(":", " ").replace(",", ", ")))
    found = (
        F.when(kind == "FeatureCollection", many)
        .when(kind == "Feature", one)
        .otherwise(F.raise_error(F.lit("not a GeoJSON FeatureCollection or Feature")))
    )
    props = F.col("f.properties")
    names = [
        F.nullif(F.get_json_object(props, f"$.{k}"), F.lit("")) for k in NAME_KEYS
    ]
    return (
        docs.select(F.explode(found).alias("f"))
        .where(~F.coalesce(F.regexp_replace("f.geometry", r"\s", ""), F.lit("")).isin("", "{}", "[]", '""', "0", "false", "null"))
        .select(F.coalesce(*names, F.lit("")).alias("name"), F.col("f.geometry").alias("geometry"))
    )
