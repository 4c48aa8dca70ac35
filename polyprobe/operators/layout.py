"""Physical layout before expensive steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from polyprobe.session import scratch_path


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distribute rows by key over at least as many tasks as the cluster runs.

    For narrow rows about to fan out, or rows about to reach a model: the
    optimizer sizes tasks by bytes and would put such rows into very few.
    ``keys`` must not repeat much.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and continue from the table.

    For results that are costly to compute and read more than once, such as
    model scores: a lost executor then costs a re-read, not a re-run.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of narrow keys that are shipped to the tables they choose from; more meet them by a shuffle.
MAX_SHIPPED_KEYS = 500_000


def shipped_if_small(keys: DataFrame, limit: int = MAX_SHIPPED_KEYS) -> DataFrame:
    """Mark narrow rows for broadcast if they are few, which is checked by counting up to the limit.

    Evaluation items choose few of many documents; their keys then travel to
    the texts, and texts that nobody asked for are not moved.
    """
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys
