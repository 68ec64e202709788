"""Column profiles kept up to date over a stream: each micro-batch's value counts are added to a table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.profile import profile
from ..sources.tables import Table


def keep_profile(stream: DataFrame, name: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's counts as a part of `path` named by the batch, so that a repeated batch replaces its own part."""

    def add(batch: DataFrame, nth: int) -> None:
        profile([Table(name, batch)]).write.mode("overwrite").parquet(f"{path}/batch={nth}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_profile(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("table", "column", "pos", "value").agg(F.sum("freq").alias("freq"))
