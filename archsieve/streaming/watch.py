"""Rules over streams of edges: an extension of the batch engine to edges that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archsieve.operators import boundary, violations


def windowed_crossings(edges: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(begin, from_module, to_module, n): crossings a window of event time; later rows than the watermark are left out."""
    return edges.where("from_module <> to_module").withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "from_module", "to_module").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "from_module", "to_module", "n")


def watch(edges: DataFrame, specs: DataFrame, target: str, checkpoint: str, rules: Callable[[DataFrame, DataFrame], DataFrame] = boundary.evaluate) -> StreamingQuery:
    """Appends the fingerprinted findings of each batch of edges to a table of Parquet files. A batch that is tried again
    overwrites its own folder, so findings are written once."""

    def batch(df: DataFrame, number: int) -> None:
        violations.fingerprinted(rules(df, specs)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
