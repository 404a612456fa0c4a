"""State tables: scans and the three kinds of sink (append, upsert, insert if absent)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspan.plans.blocks import match_keys


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scan a state table; a table that does not exist yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a plain scan that has fewer splits than the cluster has cores.

    A few small or single-row-group files would otherwise keep costly row work on a few cores.
    Large inputs have more splits than cores and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same keys.

    With ``order`` the last of several new rows for one key wins. The result is written to a
    new location (or partition) by the caller, never over the files being read.
    """
    if order:
        newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        new = new.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")
    return match_keys(existing, new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``existing``; of several the first in ``order``."""
    if order:
        oldest = Window.partitionBy(*keys).orderBy(*order)
        new = new.withColumn("__rn", F.row_number().over(oldest)).where("__rn = 1").drop("__rn")
    else:
        new = new.dropDuplicates(list(keys))
    return match_keys(new, existing.select(*keys), keys, "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key. ``row_number = 1`` is limited per task before the shuffle, so a hot
    key sends one row per task."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")
