"""Reading tables whose rows are costly in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts: a row costs far more than its bytes say.
HEAVY = frozenset(["wcxb_samples", "fixtures", "documents", "test_responses"])


def read(spark: SparkSession, where: str, table: str) -> DataFrame:
    """A table of a folder. A table of long texts that the scan gives in fewer parts than there are cores is spread over
    all of them; with as many parts or more nothing is moved."""
    df = spark.read.parquet(f"{where}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table in HEAVY and df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame) -> DataFrame:
    """The rows shuffled over all cores at least: a file of a single row group is one task, however many parts its scan has."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
