"""The driver's tables read as classification data: nodes with codes and titles, queries, a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_code() -> Column:
    """A code of the right shape for a part, as ``E11.0``."""
    return F.concat(F.substring("p_type", 1, 1), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes: node_id, code, level, depth, title, kind."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("node_id"), part_code().alias("code"), F.lit("SUBCATEGORY").alias("level"), (F.col("p_partkey") % 3).alias("depth"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"))


def misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each distinct part name, without its second letter; ids are the first part's."""
    part = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    return part.select("query_id", F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")).alias("query"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as one tree: node_id, parent_id, title."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("title"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node_id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("title"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("node_id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_name").alias("title"))
    return region.unionByName(nation).unionByName(customer)
