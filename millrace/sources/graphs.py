"""Edge lists, adjacency lists and GraphML as (src, dst) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fields(spark: SparkSession, path: str, sep: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    return lines.select(F.split("value", sep).alias("f"))


def read_edge_list(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """(src, dst, attrs): two ids per line, the rest kept as text."""
    f = _fields(spark, path, sep).filter("size(f) >= 2")
    return f.select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst"), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))).alias("attrs"))


def read_adjacency_list(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """A node followed by its neighbours on each line."""
    f = _fields(spark, path, sep)
    return f.select(F.col("f")[0].alias("src"), F.explode(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0)))).alias("dst"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, attrs), edges(src, dst, attrs)); attrs maps data keys to text."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    attrs = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")),
                                           lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("attrs")
    xml = spark.read.format("xml")
    nodes = xml.option("rowTag", "node").schema(f"_id string, {data}").load(path).select(F.col("_id").alias("id"), attrs)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    return nodes, edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attrs)
