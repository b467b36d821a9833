"""Polygon annotations from GeoJSON files, one row an annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<classification:struct<name:string>,name:string>>>"
RINGS = "array<array<array<double>>>"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """file_key, id, label, type, rings and the exterior's bounds x1, y1, x2, y2 of every point and polygon of the files; several polygons of one feature are several rows."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = text.select("path", F.from_json("value", SCHEMA).alias("j"), F.from_json("value", "array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<classification:struct<name:string>,name:string>>>").alias("a"))
    features = parsed.select("path", F.posexplode(F.coalesce("j.features", "a")).alias("at", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    several = F.when(kind == "Polygon", F.array(F.from_json(raw, RINGS))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{RINGS}>")).when(kind == "Point", F.array(F.array(F.array(F.from_json(raw, "array<double>")))))
    rows = features.select("path", "at", kind.alias("kind"), F.coalesce("f.properties.classification.name", "f.properties.name").alias("label"), F.posexplode(several).alias("part", "rings"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = F.transform("rings", lambda r: F.transform(r, point))
    out = rows.select(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "").alias("file_key"), (F.col("at") * 1000 + F.col("part")).cast("long").alias("id"), "label", F.when(F.col("kind") == "Point", "point").otherwise("polygon").alias("type"), rings.alias("rings"))
    edge = lambda f, axis: f(F.transform(F.get("rings", F.lit(0)), lambda p: p[axis]))
    return out.withColumns({"x1": edge(F.array_min, "x"), "y1": edge(F.array_min, "y"), "x2": edge(F.array_max, "x"), "y2": edge(F.array_max, "y")})
