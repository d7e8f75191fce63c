"""Extension, not of the inventory: a directory watched as a stream, profiled as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """Path, category, format and length of files that appear below a folder."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return files.select("path", "modificationTime", X.category(F.col("path")).alias("category"), X.sniff(F.col("content")).alias("detected_format"), "length")


def profile(stream: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Files and bytes of each category and window of modification time; late files beyond the delay are left out."""
    return stream.withWatermark("modificationTime", delay).groupBy(F.window("modificationTime", width), "category").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
