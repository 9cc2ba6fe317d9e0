"""Matrices of doubles with named rows and columns, as Parquet: a row for each row and block of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_matrix(df: DataFrame, path: str, row: str, column: str, value: str, block: int = 4096) -> None:
    """A long table (row, column, value) as rows of arrays, ``block`` columns in each; names are kept as text.

    Two folders: columns (name, block, place) and values (row, block, values by
    place).  Cells that the table lacks are null; repeated ones are added up.
    """
    names = df.select(F.col(column).alias("name")).distinct()
    placed = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("n"))  # a row for each column's name
    placed = placed.select("name", F.floor(F.col("n") / block).alias("block"), (F.col("n") % block).alias("place"))
    placed.select(F.col("name").cast("string").alias("name"), "block", "place").write.parquet(f"{path}/columns")
    cells = df.groupBy(F.col(row).cast("string").alias("row"), F.col(column).alias("name")).agg(F.sum(F.col(value).cast("double")).alias("value")).join(placed, "name")
    arrays = cells.groupBy("row", "block").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("cells"))  # at most ``block`` cells
    values = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("cells"))), lambda i: F.try_element_at("cells", i))
    arrays.select("row", "block", values.alias("values")).write.partitionBy("block").parquet(f"{path}/values")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, column and value of all cells that are there."""
    columns = spark.read.parquet(f"{path}/columns")
    values = spark.read.parquet(f"{path}/values").select("row", F.col("block").cast("long").alias("block"), F.posexplode("values").alias("place", "value")).filter("value is not null")
    return values.join(columns, ["block", "place"]).select("row", F.col("name").alias("column"), "value")
