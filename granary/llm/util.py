"""Shared helpers of the training-data operators: tables, the shared folder and row digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.storage import forget, shared_dir, stored

__all__ = ["WHITE", "arrow_schema", "forget", "shared_dir", "shuffle_partitions", "slices", "stored", "table", "words_of"]

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 500):
    """Arrow batches cut to a few rows each, so that a Python worker holds the texts of few documents at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def arrow_schema(df: DataFrame, columns: list[str], more: str) -> str:
    """DDL of some columns of `df` and of what a function adds to them."""
    own = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]
    return ", ".join([*own, more])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text):
    """Column: the number of `[^\\x20\\x09-\\x0D]+` in `text`, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
